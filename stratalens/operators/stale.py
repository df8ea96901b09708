"""Markers left in comments, and comments that are code, with the age of their lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.sources.files import lines, split_lines

# The marker words, and what code looks like after its comment sign; one alternation a language, so that a
# line is matched once.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "TEMP", "WORKAROUND")
MARKER = rf"(?iU)\b({'|'.join(MARKERS)})\b[\s:]*(.*)$"
_WORDS = {
    ".py": r"if|elif|else|for|while|return|yield|raise|import|from|def|class|try|except|finally|with|as|assert|print|break|continue|pass",
    ".m": r"if|elseif|else|for|while|return|function|end|switch|case|otherwise|try|catch|break|continue|global|persistent",
}
CODE = {
    ".py": rf"(?U)^\s*(?:\w+\s*=|\w+\s*\(|(?:{_WORDS['.py']})\b|self\.\b|\w+\.\w+\s*\()",
    ".m": rf"(?U)^\s*(?:\w+\s*=|\w+\s*\(|(?:{_WORDS['.m']})\b|\w+\.\w+)",
}
DAY = 86_400


def _by_ext(make) -> Column:
    return F.when(F.col("ext") == ".m", make(".m")).otherwise(make(".py"))


def _sign() -> Column:
    return F.when(F.col("ext") == ".m", F.lit("%")).otherwise(F.lit("#"))


def quoted_lines(files: DataFrame) -> DataFrame:
    """(path, ext, line, raw, quoted): quoted lines lie in, or close, a triple-quoted string of a ``.py`` file.

    A line that holds one delimiter once opens a string; the state runs through a whole
    file, so this is one pass of an Arrow function over its array of lines.
    """

    def work(batches):
        for batch in batches:
            out = []
            for ext, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                inside, flags = None, []
                for raw in rows or []:
                    flags.append(inside is not None)
                    if inside is not None:
                        if inside in raw:
                            inside = None
                    elif ext == ".py":
                        inside = next((d for d in ('"' * 3, "'" * 3) if raw.count(d) == 1), None)
                out.append(flags)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.bool_()))], ["path", "ext", "rows", "flags"])

    held = files.where("ext in ('.py', '.m')").select("path", "ext", split_lines(F.col("text"), wide=True).alias("rows"))
    held = held.mapInArrow(work, "path string, ext string, rows array<string>, flags array<boolean>")
    each = held.select("path", "ext", F.posexplode(F.arrays_zip("rows", "flags")).alias("at", "r"))
    return each.select("path", "ext", (F.col("at") + 1).alias("line"), F.col("r.rows").alias("raw"), F.col("r.flags").alias("quoted"))


def markers(files: DataFrame) -> DataFrame:
    """(path, line, keyword, text) of marker words in comment lines and triple-quoted strings."""
    rows = quoted_lines(files).withColumn("s", F.trim("raw"))
    hit = (F.col("quoted") | F.col("s").startswith(_sign())) & F.col("s").rlike(MARKER)
    return rows.where(hit).select("path", "line", F.upper(F.regexp_extract("s", MARKER, 1)).alias("keyword"), F.trim(F.regexp_extract("s", MARKER, 2)).alias("text"))


def commented_code(files: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(path, start_line, end_line, line_count, lines) of runs of comment lines of which more than ``share`` look like code."""
    rows = lines(files.where("ext in ('.py', '.m')"), wide=True).withColumn("s", F.trim("raw"))
    rows = rows.where(F.col("s").startswith(_sign()) & ~F.col("s").startswith(F.concat(_sign(), _sign(), F.lit("!"))))
    order = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("run", F.col("line") - F.row_number().over(order)).withColumn("body", F.expr("substring(s, 2)"))
    counted = (F.trim("body") != "") & ~F.col("body").rlike(MARKER)
    like = counted & F.when(F.col("ext") == ".m", F.col("body").rlike(CODE[".m"])).otherwise(F.col("body").rlike(CODE[".py"]))
    runs = rows.groupBy("path", "run").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").cast("int").alias("line_count"),
        F.sum(like.cast("int")).alias("n_code"), F.sum(counted.cast("int")).alias("n_counted"),
        F.transform(F.sort_array(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]).alias("lines"),
    )
    return runs.where((F.col("line_count") >= least) & (F.col("n_counted") > 0) & (F.col("n_code") > share * F.col("n_counted"))).select("path", "start_line", "end_line", "line_count", "lines")


def staleness(age: Column) -> Column:
    return F.when(age < 30 * DAY, "FRESH").when(age < 180 * DAY, "AGING").when(age < 365 * DAY, "STALE").when(age.isNotNull(), "ANCIENT").otherwise("UNKNOWN")


def age_text(age: Column) -> Column:
    days = F.floor(age / DAY)
    some = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(days < 1, "today").when(days < 30, some(days, "day")).when(days < 360, some(F.floor(days / 30), "month")).when(age.isNotNull(), some(F.floor(days / 365), "year"))


def with_blame(found: DataFrame, blame: DataFrame, now: int) -> DataFrame:
    """blame (path, line, author, ts_epoch): adds author, age_seconds, age_text, staleness; a run takes its oldest line."""
    ages = blame.select("path", F.col("line").alias("at"), "author", (F.lit(now) - F.col("ts_epoch")).alias("age_seconds"))
    if "start_line" in found.columns:
        each = found.select("path", "start_line", F.explode(F.sequence("start_line", "end_line")).alias("at")).join(ages, ["path", "at"])
        oldest = each.groupBy("path", "start_line").agg(F.max(F.struct("age_seconds", "author")).alias("b")).select("path", "start_line", "b.author", "b.age_seconds")
        out = found.join(oldest, ["path", "start_line"], "left")
    else:
        out = found.join(ages.withColumnRenamed("at", "line"), ["path", "line"], "left")
    return out.withColumn("age_text", age_text(F.col("age_seconds"))).withColumn("staleness", staleness(F.col("age_seconds")))


def age_histogram(found: DataFrame) -> DataFrame:
    """(staleness, n) with all five names."""
    names = found.sparkSession.createDataFrame([(n,) for n in ("FRESH", "AGING", "STALE", "ANCIENT", "UNKNOWN")], "staleness string")
    return names.join(found.groupBy("staleness").agg(F.count("*").alias("n")), "staleness", "left").na.fill(0, ["n"])


def listed(found_markers: DataFrame, found_blocks: DataFrame, markers_only: bool = False, code_only: bool = False, stale_only: bool = False, by: str = "age") -> DataFrame:
    """Markers and commented blocks, with blame, as one sorted list: (path, line, kind, text, age_seconds, staleness).

    by ``age``: the oldest first, an unknown age as none; ``file``; or ``type``: markers, by word, before blocks.
    """
    marked = found_markers.select("path", "line", F.col("keyword").alias("kind"), "text", "age_seconds", "staleness", F.lit(0).alias("order"))
    blocks = found_blocks.select("path", F.col("start_line").alias("line"), F.lit("COMMENTED CODE").alias("kind"), F.col("line_count").cast("string").alias("text"), "age_seconds", "staleness", F.lit(1).alias("order"))
    rows = marked if markers_only and not code_only else blocks if code_only and not markers_only else marked.unionByName(blocks)
    if stale_only:
        rows = rows.where("staleness in ('STALE', 'ANCIENT')")
    keys = {"age": [F.coalesce("age_seconds", F.lit(0)).desc(), "path", "line"], "file": ["path", "line"], "type": ["order", "kind", "line", "path"]}[by]
    return rows.orderBy(*keys).drop("order")


def summary(found_markers: DataFrame, found_blocks: DataFrame) -> DataFrame:
    """One row: markers, commented blocks and their lines, files with any, and how many are stale."""
    old = lambda: F.count_if(F.col("staleness").isin("STALE", "ANCIENT"))
    m = found_markers.agg(F.count("*").alias("markers"), old().alias("stale_markers"))
    b = found_blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("block_lines"), old().alias("stale_blocks"))
    files = found_markers.select("path").unionByName(found_blocks.select("path")).agg(F.count_distinct("path").alias("files"))
    return m.join(F.broadcast(b), F.lit(True)).join(F.broadcast(files), F.lit(True))  # one row each

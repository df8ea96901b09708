"""Duplicated code and text: normalised lines, windows of them, digests, groups and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.plans.staging import stage
from stratalens.operators.graph import components
from stratalens.sources.files import split_lines

# Names that keep their identity when identifiers are blanked.
PYTHON_KEPT = (
    "if else elif for while def class return import from try except with as yield lambda pass break continue raise in not and or is True False None"
).split()
MATLAB_KEPT = (
    "function end if else elseif for while switch case otherwise try catch return break continue classdef properties methods persistent global "
    "disp fprintf sprintf length size zeros ones linspace plot xlabel ylabel title figure subplot hold legend abs sqrt sin cos tan exp log "
    "log10 max min sum mean std reshape transpose inv det eig fft ifft conv filter sort unique find isempty isnumeric ischar nargin nargout "
    "error warning cell struct fieldnames cellfun arrayfun strcmp strcmpi strsplit strcat num2str str2num str2double true false pi inf nan "
    "eye rand randn round floor ceil mod rem cross dot norm cat vertcat horzcat repmat ndims numel sub2ind ind2sub logical double single "
    "int8 int16 int32 int64 uint8 uint16 uint32 uint64 char string"
).split()

_PY_COMMENT = r"""^((?:\"{3}(?:(?!\"{3}).)*+\"{3}|'{3}(?:(?!'{3}).)*+'{3}|(?!\"{3})\"(?:[^\"\\]|\\.)*+\"|(?!'{3})'(?:[^'\\]|\\.)*+'|[^#\"'])*+)#.*$"""
_M_COMMENT = r"^((?:'[^']*'|[^%'])*+)%.*$"


def _blank(line: Column, kept: list[str]) -> Column:
    for number in (r"(?U)\b\d+\.\d+(?:[eE][+-]?\d+)?\b", r"(?U)\b0[xXoObB][\da-fA-F_]+\b", r"(?U)\b\d+\b"):
        line = F.regexp_replace(line, number, "_VAR_")
    line = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    names = "|".join(sorted({*kept, "_STR_", "_VAR_"}))
    return F.regexp_replace(line, rf"(?U)\b(?!(?:{names})\b)[A-Za-z_]\w*\b", "_VAR_")


def normalised(line: Column, ext: Column, keep_builtins: str = "observed") -> Column:
    """A line without comment, with literals and identifiers blanked; lines of other files have only numbers and names blanked.

    keep_builtins ``observed`` keeps the attribute names of a dictionary besides the keywords
    (what the analysed behaviour amounts to); ``intended`` keeps the names of built-ins.
    """
    import builtins

    names = dir(dict) if keep_builtins == "observed" else dir(builtins)
    double, single = r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'"
    py = F.regexp_replace(line, _PY_COMMENT, "$1")
    for literal in (r'"{3}.*?"{3}', r"'{3}.*?'{3}", double, single):
        py = F.regexp_replace(py, literal, '"_STR_"')
    m = F.regexp_replace(line, _M_COMMENT, "$1")
    for literal in (double, single):
        m = F.regexp_replace(m, literal, '"_STR_"')
    return F.when(ext == ".py", _blank(py, [*PYTHON_KEPT, *names])).when(ext == ".m", _blank(m, MATLAB_KEPT)).otherwise(_blank(line, []))


def normalise_lines(files: DataFrame, keep_builtins: str = "observed") -> DataFrame:
    """(path, numbered: array<struct<line, text>>): the lines that are left, with their first numbers."""
    rows = files.select("path", "ext", F.posexplode(split_lines(F.col("text"))).alias("at", "raw"))
    rows = rows.select("path", (F.col("at") + 1).alias("line"), normalised(F.col("raw"), F.col("ext"), keep_builtins).alias("text")).where("text <> ''")
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("numbered"))


def plain_lines(files: DataFrame) -> DataFrame:
    """(path, numbered): the lines that are not blank, trimmed.  No shuffle: a file stays in its row."""
    every = F.transform(split_lines(F.col("text")), lambda x, k: F.struct((k + 1).alias("line"), F.trim(x).alias("text")))
    return files.select("path", F.filter(every, lambda x: x["text"] != "").alias("numbered"))


def windows(numbered: DataFrame, size: int = 5) -> DataFrame:
    """(path, at, start_line, end_line, digest) of each run of ``size`` lines, within the row of the file."""
    lines = F.col("numbered")

    def block(k: Column) -> Column:
        part = F.slice(lines, k, F.lit(size))
        digest = F.md5(F.array_join(F.transform(part, lambda x: x["text"]), "\n"))
        return F.struct(k.alias("at"), F.element_at(part, 1)["line"].alias("start_line"), F.element_at(part, size)["line"].alias("end_line"), digest.alias("digest"))

    starts = F.when(F.size(lines) >= size, F.sequence(F.lit(1), F.size(lines) - size + 1)).otherwise(F.array().cast("array<int>"))
    return numbered.select("path", F.explode(F.transform(starts, block)).alias("b")).select("path", "b.*")


def shared_digests(blocks: DataFrame) -> DataFrame:
    """(digest, n_files, n_blocks, first) of the digests in two files or more.

    Counted from (digest, path) partial counts, so a digest that fills a third of the rows
    reaches the last stage as one row a file and mapper.
    """
    each = blocks.groupBy("digest", "path").agg(F.count("*").alias("n"), F.min("start_line").alias("line"))
    return each.groupBy("digest").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_blocks"), F.min(F.struct("path", "line")).alias("first")).where("n_files >= 2")


def duplicate_groups(files: DataFrame, size: int = 5) -> DataFrame:
    """Ranked groups of equal windows: digest, files, copies, lines to be saved, where the first stands."""
    found = shared_digests(windows(plain_lines(files), size))
    saved = (F.col("n_blocks") - 1) * size
    return found.select("digest", "n_files", "n_blocks", saved.alias("duplicate_lines"), F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line"))


def matched_blocks(files: DataFrame, size: int = 5, normal: bool = True) -> DataFrame:
    """The windows whose digest is shared, numbered within their file (``idx``)."""
    blocks = windows(normalise_lines(files) if normal else plain_lines(files), size)
    kept = blocks.join(shared_digests(blocks).select("digest"), "digest", "left_semi")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("start_line")))


def region_pairs(blocks: DataFrame, star: bool = False) -> DataFrame:
    """Maximal runs of matching blocks of two regions: (f1, s1, e1, f2, s2, e2, n_blocks).

    star: each place of a digest meets its first place only, so the pairs are as many as the
    places, however common a block; regions that hold the same text are still linked, by it.

    Blocks of a digest meet in an equi-join (a pair of places is the answer asked for, so the
    number of pairs is that of places matched, twice over a digest); runs are islands of equal
    difference of the two block numbers.  Within one file a run ends where the regions would
    overlap.
    """
    a = blocks.select("digest", F.col("path").alias("f1"), F.col("idx").alias("i1"), F.col("start_line").alias("s1"), F.col("end_line").alias("e1"))
    b = blocks.select("digest", F.col("path").alias("f2"), F.col("idx").alias("i2"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"))
    if star:
        first = blocks.groupBy("digest").agg(F.min(F.struct("path", "start_line")).alias("f")).select("digest", F.col("f.path").alias("f1"), F.col("f.start_line").alias("s1"))
        a = a.join(first, ["digest", "f1", "s1"], "left_semi")
    pairs = a.join(b, "digest").where("(f1 < f2 or (f1 = f2 and s1 < s2)) and not (f1 = f2 and e1 >= s2)")
    run = Window.partitionBy("f1", "f2", F.col("i2") - F.col("i1")).orderBy("i1")
    pairs = pairs.withColumn("island", F.col("i1") - F.row_number().over(run)).withColumn("gap", F.col("i2") - F.col("i1"))
    found = pairs.groupBy("f1", "f2", "gap", "island").agg(F.min("s1").alias("s1"), F.max("e1").alias("e1"), F.min("s2").alias("s2"), F.max("e2").alias("e2"), F.count("*").alias("n_blocks"))
    return found.select("f1", "s1", "e1", "f2", "s2", "e2", "n_blocks")


def undominated(pairs: DataFrame) -> DataFrame:
    """Pairs that no larger pair of the same two files contains, straight or swapped."""
    small, large = pairs.alias("x"), pairs.alias("y")
    inside = lambda p, q: (F.col(f"y.s{q}") <= F.col(f"x.s{p}")) & (F.col(f"x.e{p}") <= F.col(f"y.e{q}"))
    area = lambda t: F.col(f"{t}.e1") - F.col(f"{t}.s1") + F.col(f"{t}.e2") - F.col(f"{t}.s2")
    same = (F.col("x.f1") == F.col("y.f1")) & (F.col("x.f2") == F.col("y.f2"))
    held = inside(1, 1) & inside(2, 2) | (F.col("x.f1") == F.col("x.f2")) & inside(1, 2) & inside(2, 1)
    return small.join(large, same & held & (area("y") > area("x")), "left_anti")


def duplicate_regions(files: DataFrame, size: int = 5) -> DataFrame:
    """(group_id, path, start_line, end_line): regions linked by equal places are a group."""
    pairs = undominated(region_pairs(matched_blocks(files, size)))
    key = lambda k: F.struct(F.col(f"f{k}").alias("path"), F.col(f"s{k}").alias("start_line"), F.col(f"e{k}").alias("end_line"))
    links = stage(pairs.select(key(1).alias("x"), key(2).alias("y")).distinct(), "region-links")
    text = lambda c: F.concat_ws("\x00", F.col(c)["path"], F.lpad(F.col(c)["start_line"].cast("string"), 9, "0"), F.lpad(F.col(c)["end_line"].cast("string"), 9, "0"))
    labels = components(links.select(text("x").alias("a"), text("y").alias("b")))
    part = F.split("v", "\x00")
    return labels.select(F.md5("c").alias("group_id"), part[0].alias("path"), part[1].cast("int").alias("start_line"), part[2].cast("int").alias("end_line"))


def region_groups(regions: DataFrame) -> DataFrame:
    """Measures of each group of two regions or more, by the lines they repeat, and its regions as ``path:first-last``."""
    size = F.col("end_line") - F.col("start_line") + 1
    place = F.struct("path", "start_line", "end_line")
    found = regions.groupBy("group_id").agg(F.max(size).alias("line_count"), F.count("*").alias("copy_count"), F.sort_array(F.collect_list(place)).alias("places")).where("copy_count >= 2")
    total = F.col("line_count") * (F.col("copy_count") - 1)
    shown = F.array_join(F.transform("places", lambda x: F.concat(x["path"], F.lit(":"), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"))), " ")
    first = F.col("places")[0]
    return found.select("group_id", "line_count", "copy_count", total.alias("total_duplicate_lines"), first["path"].alias("first_path"), first["start_line"].alias("first_line"), shown.alias("regions"))


def previews(groups: DataFrame, files: DataFrame, most: int = 6) -> DataFrame:
    """Groups with ``preview``: the first lines of their first region."""
    text = files.select(F.col("path").alias("first_path"), split_lines(F.col("text")).alias("rows"))
    shown = F.slice("rows", F.col("first_line"), F.least(F.lit(most), F.col("line_count")))
    return groups.join(text, "first_path").select(*groups.columns, shown.alias("preview"))


def gate(groups: DataFrame) -> DataFrame:
    """One row: whether there is any duplicate, for a run that should fail on them."""
    return groups.agg((F.count("*") > 0).alias("failed"))

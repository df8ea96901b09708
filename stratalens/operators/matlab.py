"""MATLAB sources by lines: functions and their measures, try blocks and error handling.  Native expressions and windows.

A line table (path, line, raw, code) goes in, code being the line without its comment and
without what its quotes hold.  Blocks are found by running counts of openers and ends;
joins stay within a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.complexity import risk
from stratalens.sources.files import lines

# What a function header, an opener of a block and a decision look like.
HEADER = r"(?U)^\s*function\s+(?:\[?[^=\]]*\]?\s*=\s*)?(\w+)\s*(?:\(|$|%)"
OPENER = r"(?U)\b(?:if|for|while|switch|try|parfor)\b"
DECISION = r"(?U)\b(?:if|elseif|for|while|catch|case|parfor)\b|&&|\|\|"
END = r"(?U)\bend\b"
#: What stands before a comment: plain characters and closed strings, and maybe a string that is never closed.
_BEFORE_COMMENT = r"""^((?:[^'"%]++|'[^']*+'|"[^"]*+")*+(?:'[^']*$|"[^"]*$)?)"""


def strip_code(raw: Column) -> Column:
    """A line up to its comment, its strings emptied."""
    code = F.regexp_extract(raw, _BEFORE_COMMENT, 1)
    return F.regexp_replace(F.regexp_replace(code, "'[^']*'", "''"), '"[^"]*"', '""')


def matlab_lines(files: DataFrame) -> DataFrame:
    return lines(files.where("ext = '.m'"), wide=True).select("path", "line", "raw", strip_code(F.col("raw")).alias("code"))


def function_spans(rows: DataFrame) -> DataFrame:
    """(path, name, line, last): the body of a function is the lines after ``line`` up to ``last``.

    It ends where its own ``end`` closes it, before a header that follows at its own level,
    or else before the next header or at the end of the file.
    """
    order = Window.partitionBy("path").orderBy("line")
    name = F.regexp_extract("code", HEADER, 1)
    counted = rows.select("path", "line", name.alias("name"), (F.regexp_count("code", F.lit(OPENER)) + (name != "").cast("int") - F.regexp_count("code", F.lit(END))).alias("net"))
    counted = counted.withColumn("depth", F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("depth") - F.col("net"))
    ends = counted.groupBy("path").agg(F.max("line").alias("eof"))
    heads = counted.where("name <> ''").select("path", "name", "line", F.col("depth").alias("own"), (F.coalesce(F.lead("line").over(order), F.lit(1 << 30)) - 1).alias("next"))
    # Only a header, or a line that closes more than it opens, can end a function.
    stops = counted.where("name <> '' or net < 0").select("path", F.col("line").alias("at"), "depth", "before", (F.col("name") != "").alias("header"))
    met = heads.join(stops, "path").where("at > line and ((header and before = own) or depth < own)")
    last = F.when(F.col("header") & (F.col("before") == F.col("own")), F.col("at") - 1).otherwise(F.col("at"))
    first = met.groupBy("path", "line").agg(F.min_by(last, F.col("at")).alias("stop"))
    return heads.join(first, ["path", "line"], "left").join(ends, "path").select("path", "name", "line", F.coalesce("stop", F.least("next", "eof")).cast("int").alias("last"))


def matlab_functions(files: DataFrame) -> DataFrame:
    """(name, path, line, complexity, max_depth, length, score, risk), as of Python functions."""
    rows = matlab_lines(files)
    facts = rows.select(
        "path", F.col("line").alias("at"), F.regexp_count("code", F.lit(DECISION)).alias("decisions"), F.regexp_count("code", F.lit(OPENER)).alias("opened"),
        F.regexp_count("code", F.lit(END)).alias("closed"), (~F.col("raw").rlike(r"(?U)^\s*(?:%|$)")).cast("int").alias("counts"),
    )
    spans = function_spans(rows)
    inside = spans.join(facts, "path", "left").where("at is null or at > line and at <= last or at = line")
    order = Window.partitionBy("path", "line").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("at") > F.col("line")  # the header's row only keeps functions without a body
    zero = lambda c: F.when(own, F.col(c)).otherwise(0)
    inside = inside.withColumn("run", F.sum(zero("opened") - zero("closed")).over(order))
    # A depth that never falls below 0: the running sum less its lowest value so far.
    inside = inside.withColumn("floored", F.col("run") - F.least(F.lit(0), F.min("run").over(order)))
    before = F.coalesce(F.lag("floored").over(Window.partitionBy("path", "line").orderBy("at")), F.lit(0))
    inside = inside.withColumn("deepest", F.when(zero("opened") > 0, before + F.col("opened")).otherwise(0))
    out = inside.groupBy("path", "name", "line").agg(
        (1 + F.sum(zero("decisions"))).cast("int").alias("complexity"), F.max("deepest").cast("int").alias("max_depth"), F.sum(zero("counts")).cast("int").alias("length")
    )
    score = F.col("complexity") * F.greatest("max_depth", F.lit(1)) + F.col("length") / 10.0
    return out.select("name", "path", "line", "complexity", "max_depth", "length", score.cast("double").alias("score"), risk(F.col("complexity")).alias("risk"))


#: Lines that open and close blocks for the search of try blocks, which looks at raw lines.
_TRY, _CATCH = r"(?U)^\s*try\s*(?:%.*)?$", r"(?U)^\s*catch\b"
_OPENS, _CLOSES, _COMMENT = r"(?U)^\s*(?:try|for|while|if|switch|parfor)\b", r"(?U)^\s*end\b", r"(?U)^\s*%"


def try_blocks(rows: DataFrame) -> DataFrame:
    """(path, try_line, end_line or null, catch_line, ident or null, body: the lines of the catch at its own level)."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("raw")
    kind = F.when(raw.rlike(_OPENS), "open").when(raw.rlike(_CLOSES), "close").when(raw.rlike(_CATCH), "catch").otherwise("line")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    facts = rows.select("path", "line", "raw", kind.alias("kind")).withColumn("depth", F.sum(step).over(order))
    tries = facts.where(raw.rlike(_TRY)).select("path", F.col("line").alias("try_line"), F.col("depth").alias("own"))
    ends = tries.join(facts.where("kind = 'close'").select("path", "line", "depth"), "path").where("line > try_line and depth = own - 1").groupBy("path", "try_line").agg(F.min("line").alias("end_line"))
    blocks = tries.join(ends, ["path", "try_line"], "left")
    level = facts.where("kind in ('catch', 'line')").select("path", "line", "raw", "kind", "depth")
    inside = blocks.join(level, "path").where("line > try_line and depth = own and (end_line is null or line < end_line)")
    catches = inside.where("kind = 'catch'").groupBy("path", "try_line", "end_line", "own").agg(F.min("line").alias("first"), F.max("line").alias("catch_line"), F.max_by("raw", "line").alias("text"))
    body = inside.where("kind = 'line'").select("path", "try_line", "line", "raw").join(catches.select("path", "try_line", "first"), ["path", "try_line"]).where("line > first")
    body = body.groupBy("path", "try_line").agg(F.collect_list("raw").alias("body"))
    ident = F.regexp_extract("text", r"(?U)^\s*catch\s+(\w+)", 1)
    out = catches.join(body, ["path", "try_line"], "left")
    return out.select("path", "try_line", "end_line", "catch_line", F.when(ident != "", ident).alias("ident"), F.coalesce("body", F.array().cast("array<string>")).alias("body"))


# Calls that are looked for outside try blocks (pattern, severity, title; $ stands for the name).
UNGUARDED = (
    (r"(?U)\b(fread|fwrite|fclose|fscanf|fprintf|textscan|load|save)\s*\(", "MEDIUM", "Unguarded file I/O"),
    (r"(?U)\b(py)\.\w+", "MEDIUM", "No error handling on Python call"),
    (r"(?U)\b(eval|evalc|feval)\s*\(", "HIGH", "$ without try/catch"),
)
TEST_FILE = r"(?:^|/)(?:test_|Test)[^/]*$|(?:^|/)tests?/"


def matlab_issues(files: DataFrame) -> DataFrame:
    """(path, line, severity, title) of error handling in ``.m`` files outside tests."""
    rows = matlab_lines(files.where(~F.col("path").rlike(TEST_FILE))).select("path", "line", "raw")
    blocks = try_blocks(rows)
    issue = lambda df, line, severity, title: df.select("path", F.col(line).alias("line"), F.lit(severity).alias("severity"), title.alias("title"))
    busy = F.exists("body", lambda x: (F.trim(x) != "") & ~x.rlike(_COMMENT))
    text = F.array_join(F.transform("body", lambda x: F.regexp_replace(x, "%.*$", "")), "\n")
    parts = [
        issue(blocks.where(~busy), "catch_line", "MEDIUM", F.lit("Empty catch block")),
        issue(blocks.where("ident is null"), "catch_line", "LOW", F.lit("Catch without identifier")),
        issue(blocks.where(F.col("ident").isNotNull() & (F.instr(text, F.col("ident")) == 0)), "catch_line", "MEDIUM", F.lit("Catch-and-ignore")),
    ]
    ahead = Window.partitionBy("path").orderBy("line").rowsBetween(1, 4)
    var = F.regexp_extract("raw", r"(?U)(\w+)\s*=\s*fopen\s*\(", 1)
    asked = rows.withColumn("next", F.collect_list("raw").over(ahead)).withColumn("var", var)
    code = asked.where(~F.col("raw").rlike(_COMMENT))
    hit = F.col("line").between(F.col("try_line"), F.coalesce("end_line", F.lit(999_999)))
    spans = blocks.select(F.col("path").alias("p"), "try_line", "end_line")
    free = code.join(spans, (F.col("path") == F.col("p")) & hit, "left_anti")
    check = F.concat(F.lit("(?U)if\\s+.*"), F.col("var"), F.lit("\\s*(?:==\\s*-1|<\\s*0|~=\\s*-1)|assert\\s*\\(\\s*"), F.col("var"))
    unchecked = free.where((F.col("var") != "") & ~F.exists("next", lambda x: F.regexp_like(x, check)))
    parts.append(issue(unchecked, "line", "HIGH", F.lit("Unchecked fopen")))
    for pattern, severity, title in UNGUARDED:
        parts.append(issue(free.where(F.col("raw").rlike(pattern)), "line", severity, F.replace(F.lit(title), F.lit("$"), F.regexp_extract("raw", pattern, 1))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

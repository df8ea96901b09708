"""What MATLAB files refer to: other MATLAB files, added paths, and Python modules.  Patterns over whole texts, resolved by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.sources.files import split_lines, stem

# How dependencies are written.
CALL = r"(?Um)(?:^|(?<=[\s;,=({\[]))([a-zA-Z]\w*)\s*\("
CLASS = r"(?Um)(?:^|(?<=[\s;,=({\[]))([A-Z]\w*)\s*\("
RUN = r"""(?U)\brun\s*\(\s*['"]([^'"]+)['"]\s*\)"""
RUN_BARE = r"(?Um)^\s*run\s+(\S+)"
ADDPATH = r"""(?U)\baddpath\s*\(\s*['"]([^'"]+)['"]\s*\)"""
PY_DOT = r"(?U)\bpy\.([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)"
PYRUNFILE = r"""(?U)\bpyrunfile\s*\(\s*['"]([^'"]+\.py)['"]"""
PYRUN_IMPORT = r"""(?U)\bpyrun\s*\(\s*['"]import\s+([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)['"]"""
PYRUN_FROM = r"""(?U)\bpyrun\s*\(\s*['"]from\s+([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)\s+import"""

#: Names of the language that no file of a project stands for; a longer list, as of the toolboxes in use, is a parameter.
BUILTINS = tuple("if elseif else for while switch case otherwise try catch end function return break continue global persistent parfor spmd classdef true false inf nan eps pi size length numel zeros ones eye rand disp fprintf sprintf error warning isempty ischar isnumeric strcmp strrep num2str run addpath cell struct double char max min sum abs mod floor ceil round sqrt exp log any all find sort unique fopen fclose load save plot figure".split())

_TWO_QUOTES = r"""^((?:[^'"%]++|'[^']*+'|"[^"]*+")*+(?:'[^']*$|"[^"]*$)?)"""
_ONE_QUOTE = r"^((?:[^'%]++|'[^']*+')*+(?:'[^']*$)?)"


def without_comments(text: Column, double: bool = True) -> Column:
    """Block comments go, then line comments outside of strings; ``double``: whether double quotes make strings."""
    rows = split_lines(F.regexp_replace(text, r"(?s)%\{.*?%\}", ""), wide=True)
    return F.array_join(F.transform(rows, lambda x: F.regexp_extract(x, _TWO_QUOTES if double else _ONE_QUOTE, 1)), "\n")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)[^/]*$", 1)


def _named(texts: DataFrame, pattern: str, kind: str, rule: int) -> DataFrame:
    """(source, type, rule, at, raw) of the first group of a pattern."""
    return texts.select(F.col("path").alias("source"), F.lit(kind).alias("type"), F.lit(rule).alias("rule"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("at", "raw"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def name_index(files: DataFrame) -> DataFrame:
    """(name, target): file stems, the first path of each, and names of class folders ``@Name`` where no stem has it."""
    own = files.where("ext = '.m'").select(stem(F.col("path")).alias("name"), "path")
    stems = own.groupBy("name").agg(F.min("path").alias("target"))
    # Only files that the stems name stand for a class folder.
    folders = stems.select(F.explode(F.filter(F.split("target", "/"), lambda p: p.startswith("@"))).alias("folder"), "target")
    classes = folders.groupBy(F.expr("substring(folder, 2)").alias("name")).agg(F.min("target").alias("target"))
    return stems.unionByName(classes.join(stems.select("name"), "name", "left_anti"))


def _scripts(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked (source, .., script): target, the script beside the source or below the root."""
    both = F.array(F.struct(F.lit(0).alias("rank"), F.concat(_folder(F.col("source")), F.col("script")).alias("target")), F.struct(F.lit(1).alias("rank"), F.col("script").alias("target")))
    each = asked.withColumn("t", F.explode(both)).withColumn("target", F.col("t.target")).withColumn("rank", F.col("t.rank")).drop("t")
    found = each.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return found.groupBy("source", "type", "rule", "at", "raw").agg(F.min_by("target", "rank").alias("target"))


def matlab_edges(files: DataFrame, builtins: tuple[str, ...] = BUILTINS) -> DataFrame:
    """(source, target, type, raw): the first of calls, runs and classes for each target; every added path, as a folder."""
    texts = files.where("ext = '.m'").select("path", without_comments(F.col("text")).alias("text"))
    index = name_index(files)
    calls = _named(texts, CALL, "function_call", 1).where(~F.lower("raw").isin(*builtins) & ~F.col("raw").isin(*builtins))
    classes = _named(texts, CLASS, "class_usage", 5).where(~F.col("raw").isin(*builtins))
    named = calls.unionByName(classes).join(index.withColumnRenamed("name", "raw"), "raw")
    bare = _named(texts, RUN_BARE, "run", 3).withColumn("raw", F.regexp_replace("raw", ";+$", "")).where(~F.col("raw").isin(*builtins))
    runs = _named(texts, RUN, "run", 2).unionByName(bare).withColumn("script", F.when(F.col("raw").endswith(".m"), F.col("raw")).otherwise(F.concat("raw", F.lit(".m"))))
    found = named.unionByName(_scripts(runs, files)).where("source <> target")
    once = found.groupBy("source", "target").agg(F.min(F.struct("rule", "at", "type", "raw")).alias("f")).select("source", "target", "f.type", "f.raw")
    paths = _named(texts, ADDPATH, "addpath", 4).select("source", F.col("raw").alias("target"), "type", "raw")
    return once.unionByName(paths)


def cross_language_edges(files: DataFrame) -> DataFrame:
    """(source, target, type, raw): MATLAB files and the Python files, or names of unknown modules, that they call."""
    texts = files.where("ext = '.m'").select("path", "text")
    written = {"py_dot": ("py.", ""), "pyrun_import": ("pyrun('import ", "')"), "pyrun_from": ("pyrun('from ", " import ...')")}
    parts = [_named(texts, PY_DOT, "py_dot", 1), _named(texts, PYRUN_IMPORT, "pyrun_import", 3), _named(texts, PYRUN_FROM, "pyrun_from", 4)]
    asked = _union(parts)
    pieces = F.split("raw", r"\.")
    prefix = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(pieces, F.lit(1), k), "/").alias("base")))
    tried = asked.withColumn("p", F.explode(prefix)).select("source", "type", "rule", "at", "raw", F.col("p.n").alias("n"), F.explode(F.array(F.struct(F.lit(1).alias("own"), F.concat("p.base", F.lit(".py")).alias("path")), F.struct(F.lit(0).alias("own"), F.concat("p.base", F.lit("/__init__.py")).alias("path")))).alias("t"))
    met = tried.select("source", "rule", "at", "n", "t.*").join(files.select("path"), "path", "left_semi").groupBy("source", "rule", "at").agg(F.max_by("path", F.struct("n", "own")).alias("target"))
    modules = asked.join(met, ["source", "rule", "at"], "left").withColumn("target", F.coalesce("target", "raw"))
    shown = F.lit(None).cast("string")
    for kind, (a, b) in written.items():
        shown = F.when(F.col("type") == kind, F.concat(F.lit(a), F.col("raw"), F.lit(b))).otherwise(shown)
    modules = modules.withColumn("raw", shown).withColumn("type", F.when(F.col("type") == "pyrun_from", "pyrun_import").otherwise(F.col("type")))
    scripts = _named(texts, PYRUNFILE, "pyrunfile", 2).withColumn("script", F.col("raw"))
    run = scripts.drop("script").join(_scripts(scripts, files).select("source", "at", "target"), ["source", "at"], "left")
    run = run.withColumn("target", F.coalesce("target", "raw")).withColumn("raw", F.concat(F.lit("pyrunfile('"), F.col("raw"), F.lit("')")))
    every = modules.unionByName(run)
    return every.groupBy("source", "target").agg(F.min(F.struct("rule", "at", "type", "raw")).alias("f")).select("source", "target", "f.type", "f.raw")


def is_script(text: Column) -> Column:
    """Whether a MATLAB file can be started: its first line of code begins neither a function nor a class."""
    code = F.filter(F.transform(split_lines(text, wide=True), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+", ""))), lambda x: (x != "") & ~x.startswith("%"))
    first = F.get(code, F.lit(0))
    return F.coalesce(~first.startswith("function") & ~first.startswith("classdef"), F.lit(True))


def matlab_references(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct (source, target): identifiers that are stems of files, scripts that are run, and Python modules.

    modules: (key, target) of Python files.
    """
    texts = files.where("ext = '.m'").select("path", without_comments(F.col("text"), double=False).alias("text"))
    stems = files.where("ext = '.m'").groupBy(stem(F.col("path")).alias("key")).agg(F.min("path").alias("target"))
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    base = lambda c: F.regexp_replace(F.regexp_extract(F.regexp_replace(c, r"\.m$", ""), r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")
    words = texts.select(F.col("path").alias("source"), F.explode(F.array_distinct(every(r"(?U)\b([a-zA-Z_]\w*)\b"))).alias("key"))
    runs = texts.select(F.col("path").alias("source"), F.explode(every(RUN)).alias("raw")).select("source", base(F.col("raw")).alias("key"))
    own = words.unionByName(runs).join(stems, "key").select("source", "target")
    code = texts.select(F.col("path").alias("source"), F.explode(every(r"""(?U)\bpyrun\s*\(\s*['"]([^'"]+)['"]""")).alias("text"))
    asked = [
        texts.select(F.col("path").alias("source"), F.explode(every(r"(?U)\bpy\.(\w+)")).alias("key")),
        code.select("source", F.explode(F.concat(every(r"(?U)\bimport\s+(\w+)"), every(r"(?U)\bfrom\s+(\w+)"))).alias("key")),
    ]
    ran = texts.select(F.col("path").alias("source"), F.explode(every(r"""(?U)\bpyrunfile\s*\(\s*['"]([^'"]+)['"]""")).alias("raw"))
    bare = F.regexp_replace("raw", r"\.py$", "")
    dotted = F.regexp_replace(F.regexp_replace("raw", r"[/\\]", "."), r"\.py$", "")
    asked.append(ran.select("source", F.explode(F.array(F.regexp_replace(F.regexp_extract(bare, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", ""), dotted)).alias("key")))
    python = _union(asked).join(modules, "key").select("source", "target")
    return own.unionByName(python).where("source <> target").distinct()

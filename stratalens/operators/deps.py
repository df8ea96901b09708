"""Dependencies between files of a project and files that nothing refers to, from imports resolved by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.operators import matlab_deps
from stratalens.sources.files import stem

# Stems that are started from outside.
ENTRY_POINTS = ("__init__", "__main__", "setup", "conftest", "manage", "wsgi", "asgi", "fabfile", "tasks", "noxfile", "SConstruct", "SConscript")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _joined(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _statements(nodes: DataFrame) -> DataFrame:
    """(source, at, type, raw) of absolute and dynamic imports: raw is the dotted module, at the node in its file."""
    alias = nodes.where("kind = 'alias'").select("path", F.col("parent").alias("pre"), F.col("pre").alias("at"), F.col("name").alias("alias"))
    shape = lambda df, at, kind, raw: df.select(F.col("path").alias("source"), F.col(at).alias("at"), F.lit(kind).alias("type"), raw.alias("raw"))
    plain = shape(nodes.where("kind = 'alias' and parent_kind = 'Import'"), "pre", "import", F.col("name"))
    source = nodes.where("kind = 'ImportFrom' and n = 0 and value is not null").select("path", "pre", "value")
    module = shape(source, "pre", "from_import", F.col("value"))
    member = shape(source.join(alias, ["path", "pre"]), "at", "from_import", F.concat_ws(".", "value", "alias"))
    dynamic = shape(nodes.where("kind = 'Call' and name in ('importlib.import_module', 'import_module') and value is not null"), "pre", "dynamic_import", F.col("value"))
    return plain.unionByName(module).unionByName(member).unionByName(dynamic)


def python_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, type, raw): a multigraph, a row for each import that a file of the project answers.

    A dotted name is a package's ``__init__.py`` before it is a module; a relative import
    with a module gives an edge to each of both that exist.
    """
    known = files.where("ext = '.py'").select(F.col("path").alias("target"))
    asked = _statements(nodes).withColumn("base", F.replace(F.col("raw"), F.lit("."), F.lit("/")))
    options = F.array(F.struct(F.lit(0).alias("order"), F.concat("base", F.lit("/__init__.py")).alias("target")), F.struct(F.lit(1).alias("order"), F.concat("base", F.lit(".py")).alias("target")))
    asked = asked.select("at", "source", "type", "raw", F.explode(options).alias("o")).select("at", "source", "type", "raw", "o.*")
    absolute = asked.join(known, "target").groupBy("at", "source", "type", "raw").agg(F.min(F.struct("order", "target")).alias("best")).select("source", F.col("best.target").alias("target"), "type", "raw")

    alias = nodes.where("kind = 'alias'").select("path", F.col("parent").alias("pre"), F.col("name").alias("alias"))
    climbed = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - F.col("n"), F.lit(0))), "/")
    relative = nodes.where("kind = 'ImportFrom' and n > 0").withColumn("folder", climbed)
    named = relative.where("value is not null").select("path", "folder", "n", F.col("value").alias("module"))
    bare = relative.where("value is null").join(alias, ["path", "pre"]).select("path", "folder", "n", F.col("alias").alias("module"))
    both = named.unionByName(bare).withColumn("base", _joined(F.col("folder"), F.replace(F.col("module"), F.lit("."), F.lit("/"))))
    raw = F.concat(F.repeat(F.lit("."), F.col("n")), F.col("module"))
    both = both.select(F.col("path").alias("source"), F.lit("relative_import").alias("type"), raw.alias("raw"), F.explode(F.array(F.concat("base", F.lit("/__init__.py")), F.concat("base", F.lit(".py")))).alias("target"))
    return absolute.unionByName(both.join(known, "target").select("source", "target", "type", "raw"))


def module_index(files: DataFrame) -> DataFrame:
    """(key, target): dotted path of each ``.py`` file, and its bare stem (the first path wins)."""
    rows = files.where("ext = '.py'").select(F.col("path").alias("target"), F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit(".")).alias("dotted"), stem(F.col("path")).alias("stem"))
    exact = rows.select(F.col("dotted").alias("key"), "target")
    short = rows.groupBy(F.col("stem").alias("key")).agg(F.min("target").alias("target")).join(exact.select("key"), "key", "left_anti")
    return exact.unionByName(short)


def references(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (source, target): imports by longest known prefix, and string literals that name a module or file."""
    index = module_index(files)
    alias = nodes.where("kind = 'alias'").select("path", F.col("parent").alias("pre"), F.col("name").alias("alias"))
    plain = nodes.where("kind = 'alias' and parent_kind = 'Import'").select("path", F.col("name").alias("asked"))
    source = nodes.where("kind = 'ImportFrom' and value is not null").select("path", "pre", "value")
    dynamic = nodes.where("kind = 'Call' and name in ('importlib.import_module', '__import__', 'import_module') and value is not null").select("path", F.col("value").alias("asked"))
    asked = plain.unionByName(source.select("path", F.col("value").alias("asked"))).unionByName(source.join(alias, ["path", "pre"]).select("path", F.concat_ws(".", "value", "alias").alias("asked"))).unionByName(dynamic)
    broken = files.join(nodes.where("kind = 'SyntaxError'").select("path"), "path", "left_semi")
    for pattern in (r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import"):
        asked = asked.unionByName(broken.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("asked")))
    asked = asked.distinct()
    # Every prefix of a name asks for itself and for its package file; the longest that exists answers.
    parts = F.split("asked", r"\.")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("length"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("name")))
    each = asked.select("path", "asked", F.explode(prefix).alias("p")).select("path", "asked", F.col("p.length").alias("length"), F.explode(F.array(F.struct(F.lit(1).alias("own"), F.col("p.name").alias("key")), F.struct(F.lit(0).alias("own"), F.concat("p.name", F.lit(".__init__")).alias("key")))).alias("o"))
    best = each.select("path", "asked", "length", "o.*").join(index, "key").groupBy("path", "asked").agg(F.max_by("target", F.struct("length", "own")).alias("target"))
    imports = best.select(F.col("path").alias("source"), "target")

    whole = files.join(broken.select("path"), "path", "left_anti").where("ext = '.py'")
    tokens = whole.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"['\"]([a-zA-Z_][\w./]*)['\"]"), F.lit(1))).alias("token")).distinct()
    dots = F.replace(F.regexp_replace("token", r"\.py$", ""), F.lit("/"), F.lit("."))
    modules = tokens.where("contains(token, '.') and not endswith(token, '.py')").select("path", F.replace(F.col("token"), F.lit("/"), F.lit(".")).alias("key"))
    names = tokens.where("endswith(token, '.py')").select("path", F.explode(F.array(dots, stem(F.col("token")))).alias("key"))
    literals = modules.unionByName(names).join(index, "key").select(F.col("path").alias("source"), "target")
    return imports.unionByName(literals).unionByName(matlab_deps.matlab_references(files, index)).distinct()


def is_entry_point(path: Column, include_tests: bool = False) -> Column:
    name = stem(path)
    held = name.isin(*ENTRY_POINTS)
    return held if include_tests else held | name.startswith("test_") | name.startswith("tests_") | name.endswith("_test")


def dead_files(files: DataFrame, nodes: DataFrame, include_tests: bool = False) -> DataFrame:
    """(path) of the ``.py`` and ``.m`` files that are no entry point and to which no other file refers."""
    called = references(files, nodes).where("source <> target").select(F.col("target").alias("path"))
    started = F.when(F.col("ext") == ".py", is_entry_point(F.col("path"), include_tests)).otherwise(matlab_deps.is_script(F.col("text")))
    return files.where("ext in ('.py', '.m')").where(~started).select("path").join(called, "path", "left_anti")


def reference_counts(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, references): in how many other files each ``.py`` and ``.m`` file is referred to."""
    counts = references(files, nodes).where("source <> target").groupBy(F.col("target").alias("path")).agg(F.count_distinct("source").alias("references"))
    return files.where("ext in ('.py', '.m')").select("path").join(counts, "path", "left").na.fill(0, ["references"])


def dead_report(files: DataFrame, nodes: DataFrame, include_tests: bool = False) -> DataFrame:
    """One row: how many files, entry points and dead ones, the dead paths as JSON, and whether a gate fails on them."""
    kinds = files.where("ext in ('.py', '.m')")
    started = F.when(F.col("ext") == ".py", is_entry_point(F.col("path"), include_tests)).otherwise(matlab_deps.is_script(F.col("text")))
    whole = kinds.agg(F.count("*").alias("files"), F.count_if(started).alias("entry_points"))
    dead = dead_files(files, nodes, include_tests).agg(F.count("*").alias("dead"), F.to_json(F.sort_array(F.collect_list("path"))).alias("paths"))
    return whole.join(F.broadcast(dead), F.lit(True)).withColumn("failed", F.col("dead") > 0)  # one row each


def project_edges(files: DataFrame, nodes: DataFrame, python: bool = True, matlab: bool = True) -> DataFrame:
    """(source, target, type, raw, cross_language): the edges of both languages; those between them only where both are asked for."""
    plain = [part.withColumn("cross_language", F.lit(False)) for part, asked in ((python_edges(files, nodes), python), (matlab_deps.matlab_edges(files), matlab)) if asked]
    if python and matlab:
        plain.append(matlab_deps.cross_language_edges(files).withColumn("cross_language", F.lit(True)))
    out = plain[0].select("source", "target", "type", "raw", "cross_language")
    for part in plain[1:]:
        out = out.unionByName(part.select(out.columns))
    return out

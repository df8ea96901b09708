"""Files as rows: ``files(path, ext, text)`` from a directory tree, a text table or literals; ``lines`` of them."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import stratalens

# Functions sent to executors travel by value, so that workers need no copy of the repository.
cloudpickle.register_pickle_by_value(stratalens)

#: Names of directories that no analysis enters.
SKIPPED = (".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "env", "node_modules", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build")


def extension(path: Column) -> Column:
    """The suffix with its dot; '' for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"[^.](\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")


def _hidden(spark: SparkSession, root: str, base: str, skipped: tuple[str, ...]) -> DataFrame | None:
    """(path, content) of the files that Spark's readers skip: those whose names, or a folder's, begin with ``_`` or ``.``.

    The driver lists names, as Spark does for a reader; the executors read the files.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found, names = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        path = found.next().getPath().toString()
        parts = path.split(base, 1)[-1].split("/")
        if any(p[0] in "_." for p in parts) and not any(p in skipped for p in parts[:-1]):
            names.append((path,))
    if not names:
        return None

    def work(batches):
        for batch in batches:
            contents = []
            for path in batch.column(0).to_pylist():
                scheme, _, local = path.partition(":")
                if scheme == "file":
                    system, local = fs.LocalFileSystem(), "/" + local.lstrip("/")
                else:
                    system, local = fs.FileSystem.from_uri(quote(path, safe=":/@"))
                with system.open_input_stream(local) as stream:
                    contents.append(stream.read())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["path", "content"])

    return spark.createDataFrame(names, "path string").repartition(min(len(names), 256)).mapInArrow(work, "path string, content binary")


def tree(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED, binary_bytes: int = 1024) -> DataFrame:
    """(path, ext, text) of the text files below ``root``: invalid UTF-8 becomes U+FFFD.

    Files with a NUL in their first ``binary_bytes`` are left out; 0 keeps all.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    base = root.rstrip("/").split("://")[-1] + "/"
    hidden = _hidden(spark, root, base, skipped)
    if hidden is not None:
        raw = raw.unionByName(hidden)
    own = F.expr("substring(path, begins)")
    rows = raw.withColumn("begins", F.locate(base, F.col("path")) + len(base)).select(own.alias("path"), "content")
    if binary_bytes:
        rows = rows.where(F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, binary_bytes)), "(..)", "$1 ")) == 0)
    rows = rows.where(~_within(lambda p: p.isin(*skipped) | p.endswith(".egg-info"))) if skipped else rows
    return rows.select("path", extension(F.col("path")).alias("ext"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def _within(test, file_too: bool = False) -> Column:
    """Whether a folder of the path (or its file, too) passes a test."""
    parts = F.split("path", "/")
    return F.exists(parts if file_too else F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), test)


_CODE = (".py", ".m")
# For each analysis the kinds of files it reads, the folders it leaves out, the first letters of such
# folders, how many bytes it looks at for a NUL, and whether it leaves out files of such names as well.
COLLECTED = {
    "complexity": (_CODE, (), "", 0, False),
    "duplicates": (_CODE, ("__pycache__", ".git", ".venv", "venv", "node_modules", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".eggs", "env"), "", 1024, False),
    "dead files": (_CODE, ("__pycache__", ".git", ".hg", ".svn", ".venv", "venv", "env", ".env", "node_modules", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build"), "", 0, False),
    "dependencies": (_CODE, (".git", "__pycache__", ".venv", "node_modules", ".tox", ".mypy_cache", ".pytest_cache", "venv", "env"), "", 0, True),
    "errors": (_CODE, ("__pycache__", "node_modules", "venv", "env"), ".", 0, False),
    "secrets": ((".py", ".m", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env"), (".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache"), "", 8192, False),
    "stale comments": (_CODE, (".git", "__pycache__", ".venv", "venv", "node_modules", ".tox", ".mypy_cache", ".pytest_cache"), "", 0, False),
    "variable flow": ((".py",), ("__pycache__", "node_modules", "venv", "env"), ".", 0, False),
    "variable flow (MATLAB)": ((".m",), (), ".+@", 0, False),
}


def of_analysis(rows: DataFrame, analysis: str, python: bool = True, matlab: bool = True) -> DataFrame:
    """The files of a tree (path, ext, ..) that an analysis reads."""
    kinds, names, letters, _, file_too = COLLECTED[analysis]
    kinds = [k for k in kinds if (python or k != ".py") and (matlab or k != ".m")]
    left = lambda p: p.isin(*names) if names else F.lit(False)
    out = rows.where(F.col("ext").isin(*kinds)).where(~_within(left, file_too))
    if analysis == "dead files":
        out = out.where(~_within(lambda p: p.endswith(".egg-info")))
    return out.where(~_within(lambda p: F.substring(p, 1, 1).isin(*letters))) if letters else out


def tree_of_analysis(spark: SparkSession, root: str, analysis: str, python: bool = True, matlab: bool = True) -> DataFrame:
    return of_analysis(tree(spark, root, (), COLLECTED[analysis][3]), analysis, python, matlab)


def counts(rows: DataFrame) -> DataFrame:
    """(ext, n): how many files of each language there are, whether they parse or not."""
    return rows.where(F.col("ext").isin(*_CODE)).groupBy("ext").agg(F.count("*").alias("n"))


def table(rows: DataFrame, id_column: str, text_column: str, folder: str, ext: str = ".txt") -> DataFrame:
    """A text table as files ``folder/<id>.ext``; null ids and texts are left out."""
    path = F.concat(F.lit(f"{folder}/"), F.col(id_column).cast("string"), F.lit(ext))
    return rows.select(path.alias("path"), F.lit(ext).alias("ext"), F.col(text_column).cast("string").alias("text")).where("path is not null and text is not null")


def literal(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(sorted(texts.items()), "path string, text string")
    return rows.select("path", extension(F.col("path")).alias("ext"), "text")


def split_lines(text: Column, wide: bool = False) -> Column:
    """Array of lines without terminators; ``wide`` also ends lines at the rarer Unicode terminators."""
    ends = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]" if wide else "\\r\\n|\\r|\\n"
    found = F.split(text, ends, -1)
    return F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def lines(files: DataFrame, wide: bool = False) -> DataFrame:
    """(path, ext, line, raw), lines counted from 1."""
    return files.select("path", "ext", F.posexplode(split_lines(F.col("text"), wide)).alias("at", "raw")).select("path", "ext", (F.col("at") + 1).alias("line"), "raw")

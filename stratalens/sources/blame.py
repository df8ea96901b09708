"""Who changed a line last: ``git blame`` run beside the files, and its porcelain output as a table."""

from __future__ import annotations

import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blame_output(files: DataFrame, root: str, seconds: float = 30.0) -> DataFrame:
    """(path, output) of ``git blame -p`` for each of files (path), run on executors; ``root`` is a work tree they all see.

    A file that git does not know, or that takes longer, has no row.
    """

    def work(batches):
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    done = subprocess.run(["git", "blame", "-p", "--", path], cwd=root, capture_output=True, timeout=seconds)
                except (OSError, subprocess.TimeoutExpired):
                    continue
                if done.returncode == 0:
                    out.append((path, done.stdout.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["path", "output"])

    return files.select("path").distinct().mapInArrow(work, "path string, output string")


def porcelain(outputs: DataFrame) -> DataFrame:
    """(path, line, author, ts_epoch) of (path, output).

    A commit's author and time stand once in an output, at its first line; every other line
    of the commit takes them from there.
    """
    rows = outputs.select("path", F.posexplode(F.split("output", "\n")).alias("at", "text"))
    header = r"^([0-9a-f]{40}) \d+ (\d+)(?: |$)"
    order = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sha", F.last(F.when(F.col("text").rlike(header), F.regexp_extract("text", header, 1)), ignorenulls=True).over(order))
    author, time = F.regexp_extract("text", r"^author (.*)$", 1), F.regexp_extract("text", r"^author-time (\d+)$", 1)
    commits = rows.groupBy("path", "sha").agg(F.max(F.when(F.col("text").startswith("author "), F.trim(author))).alias("author"), F.max(F.when(time != "", time.cast("long"))).alias("ts_epoch"))
    lines = rows.where(F.col("text").rlike(header)).select("path", "sha", F.regexp_extract("text", header, 2).cast("int").alias("line"))
    return lines.join(commits, ["path", "sha"]).select("path", "line", F.coalesce("author", F.lit("unknown")).alias("author"), F.coalesce("ts_epoch", F.lit(0)).alias("ts_epoch"))

"""Complexity, nesting and length of Python functions, from the facts of their syntax trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import bar
from stratalens.sources.pyfacts import FUNCTIONS, NESTING

#: Nodes that add one decision each; BoolOp and comprehension add their operators and filters.
DECISIONS = ("If", "For", "AsyncFor", "While", "ExceptHandler", "With", "AsyncWith", "Assert", "IfExp")
RISKS = ("LOW", "MODERATE", "HIGH", "VERY HIGH")


def risk(complexity: Column) -> Column:
    return F.when(complexity <= 5, "LOW").when(complexity <= 10, "MODERATE").when(complexity <= 20, "HIGH").otherwise("VERY HIGH")


def python_functions(nodes: DataFrame) -> DataFrame:
    """(name, path, line, complexity, max_depth, length, score, risk) of the listed functions.

    What counts is summed by the functions around it, so each node meets only those.
    """
    weight = F.when(F.col("kind").isin(*DECISIONS), 1).when(F.col("kind").isin("BoolOp", "comprehension"), F.col("n")).otherwise(0)
    inside = nodes.where(F.col("kind").isin(*DECISIONS, *NESTING, "BoolOp", "comprehension"))
    inside = inside.select("path", F.explode("above").alias("pre"), weight.alias("weight"), F.when(F.col("kind").isin(*NESTING), F.col("nest")).otherwise(0).alias("deep"))
    sums = inside.groupBy("path", "pre").agg(F.sum("weight").alias("weight"), F.max("deep").alias("deep"))
    functions = nodes.where(F.col("kind").isin(*FUNCTIONS) & F.col("listed")).select("path", "pre", "name", "line", "code_lines", "nest")
    out = functions.join(sums, ["path", "pre"], "left")
    complexity, depth = (1 + F.coalesce("weight", F.lit(0))).cast("int"), F.greatest(F.coalesce(F.col("deep") - F.col("nest"), F.lit(0)), F.lit(0))
    score = complexity * F.greatest(depth, F.lit(1)) + F.col("code_lines") / 10.0
    return out.select("name", "path", "line", complexity.alias("complexity"), depth.cast("int").alias("max_depth"), F.col("code_lines").alias("length"), score.cast("double").alias("score"), risk(complexity).alias("risk"))


def ranked(functions: DataFrame, by: str = "score", threshold: int = 0, top: int | None = 20) -> DataFrame:
    """Functions of complexity ``threshold`` and above, the first ``top`` by a measure."""
    rows = functions.where(F.col("complexity") >= threshold).orderBy(F.desc(by), "path", "line", "name")
    return rows if top is None else rows.limit(top)


def summary(functions: DataFrame) -> DataFrame:
    mean = F.bround(F.coalesce(F.avg("complexity"), F.lit(0.0)), 1)
    return functions.agg(F.count_distinct("path").alias("files"), F.count("*").alias("functions"), mean.alias("average"), F.coalesce(F.max("complexity"), F.lit(0)).alias("highest"))


def histogram(functions: DataFrame) -> DataFrame:
    """(risk, n, share, bar) with all four names."""
    names = functions.sparkSession.createDataFrame([(r,) for r in RISKS], "risk string")
    counts = names.join(functions.groupBy("risk").agg(F.count("*").alias("n")), "risk", "left").na.fill(0, ["n"])
    total = functions.agg(F.count("*").alias("total"))
    out = counts.join(F.broadcast(total), F.lit(True))  # one row
    return out.select("risk", "n", F.when(F.col("total") > 0, F.bround(100 * F.col("n") / F.col("total"), 1)).otherwise(0.0).alias("share"), bar(F.col("n"), F.col("total")).alias("bar"))

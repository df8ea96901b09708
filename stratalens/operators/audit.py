"""The roll-up: every analysis over one tree, as rows of one shape, a scorecard and reports."""

from __future__ import annotations

import threading
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.operators import complexity, deps, duplicates, errors, flow, graph, matlab, matlab_flow, secrets, stale
from stratalens.sources.flowfacts import flow_events


@dataclass(frozen=True)
class Analysis:
    """One of the roll-up's parts; lang: ``python``, ``matlab`` or ``both``.

    Programs of others that a roll-up may call besides are out of scope here.
    """

    name: str
    slow: bool = False
    lang: str = "both"


ANALYSES = (
    Analysis("complexity"), Analysis("variable flow", lang="python"), Analysis("variable flow (MATLAB)", lang="matlab"), Analysis("errors"), Analysis("dead files"),
    Analysis("secrets"), Analysis("dependencies"), Analysis("duplicates", slow=True), Analysis("stale", slow=True),
)


def selected(files: DataFrame, quick: bool = False, python: bool = True, matlab: bool = True) -> list[Analysis]:
    """The analyses that fit the languages of a tree; ``quick`` leaves out the slow ones."""
    found = {r["ext"] for r in files.where("ext in ('.py', '.m')").select("ext").distinct().collect()}  # two at most
    held = {"both"} | ({"python"} if python and ".py" in found else set()) | ({"matlab"} if matlab and ".m" in found else set())
    return [a for a in ANALYSES if a.lang in held and not (quick and a.slow)]


def _shape(df: DataFrame, category: str, severity, path: str, line, title) -> DataFrame:
    return df.select(F.lit(category).alias("category"), severity.alias("severity"), F.col(path).alias("path"), line.cast("int").alias("line"), title.alias("title"))


def analysis(name: str, files: DataFrame, nodes: DataFrame, complex_from: int = 11) -> DataFrame:
    """(category, severity, path, line, title) of one analysis."""
    low = F.lit("LOW")
    if name == "complexity":
        found = complexity.python_functions(nodes).unionByName(matlab.matlab_functions(files)).where(F.col("complexity") >= complex_from)
        return _shape(found, name, F.col("risk"), "path", F.col("line"), F.col("name"))
    if name == "variable flow":
        found = flow.dead_variables(*flow.flow_graph(files, flow_events(files)))
        return _shape(found, name, low, "path", F.col("line"), F.col("name"))
    if name == "variable flow (MATLAB)":
        found = matlab_flow.dead_variables(*matlab_flow.flow_graph(files, matlab_flow.flow_events(files)))
        return _shape(found, name, low, "path", F.col("line"), F.col("name"))
    if name == "errors":
        python = _shape(errors.issues(nodes), name, F.col("severity"), "path", F.col("line"), F.col("title"))
        return python.unionByName(_shape(matlab.matlab_issues(files), name, F.col("severity"), "path", F.col("line"), F.col("title")))
    if name == "dead files":
        return _shape(deps.dead_files(files, nodes), name, low, "path", F.lit(1), F.lit("no reference"))
    if name == "secrets":
        return _shape(secrets.scan(files), name, F.col("severity"), "path", F.col("line"), F.col("label"))
    if name == "dependencies":
        edges = deps.project_edges(files, nodes)
        found = graph.cycles(files.where("ext in ('.py', '.m')").select(F.col("path").alias("node")), edges).withColumn("first", F.col("path")[0])
        return _shape(found, name, F.lit("MEDIUM"), "first", F.lit(1), F.array_join("path", " > "))
    if name == "duplicates":
        return _shape(duplicates.duplicate_groups(files), name, F.lit("MEDIUM"), "first_path", F.col("first_line"), F.col("digest"))
    if name == "stale":
        marked = _shape(stale.markers(files), name, low, "path", F.col("line"), F.col("keyword"))
        return marked.unionByName(_shape(stale.commented_code(files), name, low, "path", F.col("start_line"), F.lit("commented-out code")))
    raise ValueError(f"no analysis {name}")


def findings(files: DataFrame, nodes: DataFrame, chosen: list[Analysis] | None = None) -> DataFrame:
    """The findings of all or some analyses."""
    return reduce(DataFrame.unionByName, (analysis(a.name, files, nodes) for a in chosen or ANALYSES))


def run(spark: SparkSession, files: DataFrame, nodes: DataFrame, chosen: list[Analysis], seconds: float = 120.0, of=analysis) -> DataFrame:
    """(category, status, n): each analysis by itself, its jobs cancelled after ``seconds``.

    status: CLEAN, the number of issues, or SKIP with the reason; one failure leaves the others alone.
    """
    rows = []
    for each in chosen:
        late, group = threading.Event(), f"audit-{each.name}"

        def stop(late=late, group=group):
            late.set()
            spark.sparkContext.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        spark.sparkContext.setJobGroup(group, each.name, interruptOnCancel=True)
        timer.start()
        try:
            n = of(each.name, files, nodes).count()
            rows.append((each.name, f"{n} issues" if n else "CLEAN", n))
        except Exception as error:  # an analysis that fails is reported, and the next one runs
            rows.append((each.name, "SKIP (timeout)" if late.is_set() else f"SKIP ({type(error).__name__})", 0))
        finally:
            timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return spark.createDataFrame(rows, "category string, status string, n long")


def scorecard(found: DataFrame, chosen: list[Analysis] | None = None) -> DataFrame:
    """(category, status, n, mark): a row for each analysis, clean ones too, and a total under a null category.

    mark: ``!!`` above ten, ``!`` above none.
    """
    names = found.sparkSession.createDataFrame([(a.name,) for a in chosen or ANALYSES], "category string")
    rows = names.join(found.groupBy("category").agg(F.count("*").alias("found")), "category", "left")
    n = F.sum(F.coalesce("found", F.lit(0)))
    return rows.rollup("category").agg(n.alias("n")).select("category", F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" issues"))).otherwise("CLEAN").alias("status"), "n", F.when(F.col("n") > 10, "!!").when(F.col("n") > 0, "!").otherwise("").alias("mark"))


def top_findings(found: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` of each category, the gravest first: a top-k report."""
    grave = F.coalesce(F.array_position(F.array(*map(F.lit, ("CRITICAL", "VERY HIGH", "HIGH", "MEDIUM", "MODERATE", "LOW"))), F.col("severity")), F.lit(99))
    order = Window.partitionBy("category").orderBy(grave, "path", "line", "title")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def summary_lines(found: DataFrame) -> DataFrame:
    """(category, summary): how many of each severity, as one line."""
    each = found.groupBy("category", "severity").agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("severity", "n"))), lambda x: F.concat(x["severity"], F.lit(": "), x["n"].cast("string"))), " | ")
    return each.groupBy("category").agg(line.alias("summary"))


def report(found: DataFrame) -> DataFrame:
    """(category, json): the findings of each category in order, as one document a category and line."""
    return found.orderBy("category", "path", "line", "title").select("category", F.to_json(F.struct("severity", "path", "line", "title")).alias("json"))


def text_report(found: DataFrame) -> DataFrame:
    """(text): the findings as lines, in order."""
    return found.orderBy("category", "path", "line", "title").select(F.concat_ws(" ", F.concat(F.lit("["), F.col("category"), F.lit("]")), "severity", F.concat("path", F.lit(":"), F.col("line").cast("string")), "title").alias("text"))

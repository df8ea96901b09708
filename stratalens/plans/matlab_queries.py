"""Registered queries of MATLAB dependencies and variable flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import flow, matlab_deps, matlab_flow
from stratalens.plans import corpus
from stratalens.plans.matlab_sql import SQL
from stratalens.plans.staging import stage
from stratalens.registry import query


def graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files = corpus.matlab_files(spark)
    return matlab_flow.flow_graph(files, stage(matlab_flow.flow_events(files), "matlab-events"))


_AT = ("name", "path", "line", "scope", "kind")
_ENDS = ("src_name", "dst_name", "dst_line")


def _register(name: str, make) -> None:
    query(name, SQL[name])(lambda spark, sf_dir: make(spark))


_register("matlab_edges", lambda spark: matlab_deps.matlab_edges(corpus.matlab_files(spark)))
_register("matlab_python_edges", lambda spark: matlab_deps.cross_language_edges(corpus.matlab_files(spark)))
_register("matlab_statements", lambda spark: matlab_flow.statements(corpus.matlab_files(spark)).select("path", "line", "text", "kind"))
_register("matlab_flow_nodes", lambda spark: graph(spark)[0].select("id", "name", "kind", "scope", "line"))
_register("matlab_flow_edges", lambda spark: graph(spark)[1])
_register("matlab_flow_dead_variables", lambda spark: matlab_flow.dead_variables(*graph(spark)).select(*_AT))
_register("matlab_flow_unused_inputs", lambda spark: matlab_flow.unused_inputs(*graph(spark)).select(*_AT))
_register("matlab_flow_unused_outputs", lambda spark: matlab_flow.unused_outputs(*graph(spark)).select(*_AT))
_register("matlab_flow_shared_names", lambda spark: matlab_flow.shared_names(graph(spark)[0]).select(*_AT))
_register("matlab_flow_transformations", lambda spark: flow.transformations(*graph(spark)).select(*_ENDS, "transform", "transform_category"))
_register("matlab_flow_sinks", lambda spark: flow.sinks(*graph(spark)).select(*_ENDS, "sink", "sink_category"))
_register("matlab_flow_summary", lambda spark: matlab_flow.summary(*graph(spark)))


@query("matlab_flow_chains_of_x", SQL["matlab_flow_chains_of_x"])
def matlab_flow_chains_of_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark)
    return flow.chains(flow.by_name(nodes, "x"), edges).select("start", F.array_join("chain", " > ").alias("chain"))

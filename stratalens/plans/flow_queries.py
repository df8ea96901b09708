"""Registered queries of variable flow, and their DuckDB SQL over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import flow
from stratalens.plans import corpus
from stratalens.plans.corpus import rows_sql, sql_value
from stratalens.plans.staging import stage
from stratalens.registry import query
from stratalens.sources import flowfacts

_TAGS = "transform, transform_category, sink, sink_category"
def sql(texts: dict[str, str]) -> str:
    """CTEs: n: nodes, e: edges, with the same meaning as in operators.flow, written as plain joins."""
    events = [row for path, text in texts.items() if path.endswith(".py") for row in flowfacts.events(path, text)]
    return f"""WITH RECURSIVE ev AS {rows_sql(events, flowfacts.SCHEMA)}, f AS (SELECT * FROM (VALUES {", ".join(f"({sql_value(p)})" for p in texts if p.endswith(".py"))}) AS t(path)),
    b AS (SELECT path, seq, node, name, scopes[len(scopes)] AS own FROM ev WHERE event = 'bind' AND name IS NOT NULL),
    r AS (SELECT path, seq, name, unnest(scopes) AS own, generate_subscripts(scopes, 1) AS depth FROM ev WHERE event = 'read'),
    m AS (SELECT r.path, r.seq, r.depth, arg_max(b.node, b.seq) AS found FROM r JOIN b ON b.path = r.path AND b.own = r.own AND b.name = r.name AND b.seq < r.seq GROUP BY ALL),
    p AS (SELECT path, seq, arg_max(found, depth) AS found FROM m GROUP BY ALL),
    w AS (SELECT path || '#' || p.found AS src, path || '#' || node AS dst, kind, {_TAGS} FROM ev JOIN p USING (path, seq) WHERE may_loop OR found <> node),
    n0 AS (SELECT path || '#' || node AS id, path, node, shown AS name, kind, scope, line, col, module, imported, level FROM ev WHERE event = 'bind'),
    mods AS (SELECT arg_min(path, path NOT LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\') AS target, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.') AS module FROM f GROUP BY 2),
    a1 AS (SELECT id, imported, arg_max(target, length(mods.module)) AS target FROM n0 JOIN mods ON n0.module = mods.module OR starts_with(n0.module, mods.module || '.') WHERE kind = 'IMPORT' AND level = 0 GROUP BY ALL),
    a2 AS (SELECT id, imported, list_concat(string_split(path, '/')[1:len(string_split(path, '/')) - level], CASE WHEN module = '' THEN [] ELSE string_split(module, '.') END) AS base FROM n0 WHERE kind = 'IMPORT' AND level > 0),
    a3 AS (SELECT id, imported, coalesce((SELECT path FROM f WHERE path = array_to_string(base, '/') || '.py'), (SELECT path FROM f WHERE path = array_to_string(list_append(base, '__init__.py'), '/'))) AS target FROM a2),
    i AS (SELECT * FROM a1 UNION ALL SELECT * FROM a3 WHERE target IS NOT NULL),
    s AS (SELECT (SELECT c.id FROM n0 c WHERE c.path = target AND c.name = i.imported AND c.kind IN ('ASSIGN', 'IMPORT', 'PARAM') ORDER BY c.line DESC, c.node LIMIT 1) AS src, id AS dst FROM i WHERE imported IS NOT NULL),
    n AS (SELECT id, path, node, name, kind, scope, line, col, kind = 'IMPORT' AND id NOT IN (SELECT id FROM i) AS is_external FROM n0),
    e AS (SELECT * FROM w UNION ALL SELECT src, dst, 'IMPORT', NULL, NULL, NULL, NULL FROM s WHERE src IS NOT NULL),
    ends AS (SELECT e.*, x.name AS src_name, y.name AS dst_name, y.path AS dst_path, y.line AS dst_line FROM e JOIN n x ON x.id = src JOIN n y ON y.id = dst),
    dead AS (SELECT * FROM n WHERE id NOT IN (SELECT src FROM e) AND kind NOT IN ('RETURN', 'CALL_RESULT', 'COMPREHENSION') AND NOT is_external AND NOT starts_with(name, '_')
      AND name NOT IN ('self', 'cls') AND NOT starts_with(name, 'self.') AND NOT (kind = 'ASSIGN' AND upper(name) = name AND lower(name) <> name)),
    imports AS (SELECT * FROM n WHERE id NOT IN (SELECT src FROM e) AND kind = 'IMPORT'),
    params AS (SELECT * FROM n WHERE id NOT IN (SELECT src FROM e) AND kind = 'PARAM' AND name NOT IN ('self', 'cls') AND NOT starts_with(name, '_') AND NOT starts_with(name, '*')),
    reach AS (SELECT id FROM n WHERE name = 'url' UNION SELECT dst FROM reach JOIN e ON src = id),
    fwd AS (SELECT id AS start, [id] AS chain, id AS tip FROM n WHERE name = 'x' UNION ALL SELECT start, list_append(chain, dst), dst FROM fwd JOIN e ON src = tip WHERE NOT list_contains(chain, dst)),
    back AS (SELECT id AS start, [id] AS chain, id AS tip FROM n WHERE name = 'loop' UNION ALL SELECT start, list_prepend(src, chain), src FROM back JOIN e ON dst = tip WHERE NOT list_contains(chain, src))"""


SQL = sql(corpus.FLOW)
_AT = ("name", "path", "line", "scope", "kind")


def graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the corpus; its events are staged, so that each file is parsed once."""
    files = corpus.flow_files(spark)
    return flow.flow_graph(files, stage(flowfacts.flow_events(files), "flow-events"))


@query("flow_nodes_corpus", SQL + " SELECT id, name, kind, scope, line, col, is_external FROM n")
def flow_nodes_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark)[0].select("id", "name", "kind", "scope", "line", "col", "is_external")


@query("flow_edges_corpus", SQL + " SELECT * FROM e")
def flow_edges_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark)[1]


@query("flow_dead_variables_corpus", SQL + f" SELECT {', '.join(_AT)} FROM dead")
def flow_dead_variables_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.dead_variables(*graph(spark)).select(*_AT)


@query("flow_unused_imports_corpus", SQL + f" SELECT {', '.join(_AT)} FROM imports")
def flow_unused_imports_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.unused_imports(*graph(spark)).select(*_AT)


@query("flow_unused_parameters_corpus", SQL + f" SELECT {', '.join(_AT)} FROM params")
def flow_unused_parameters_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.unused_parameters(*graph(spark)).select(*_AT)


@query("flow_transformations_corpus", SQL + " SELECT src_name, dst_name, dst_line, transform, transform_category FROM ends WHERE transform_category IS NOT NULL")
def flow_transformations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.transformations(*graph(spark)).select("src_name", "dst_name", "dst_line", "transform", "transform_category")


@query("flow_sinks_of_url_corpus", SQL + " SELECT src_name, dst_name, dst_line, sink, sink_category FROM ends WHERE sink_category IS NOT NULL AND src IN (SELECT id FROM reach)")
def flow_sinks_of_url_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks that data of the variable ``url`` reaches."""
    return flow.sinks(*graph(spark), name="url").select("src_name", "dst_name", "dst_line", "sink", "sink_category")


@query("flow_chains_of_x_corpus", SQL + " SELECT start, array_to_string(chain, ' > ') AS chain FROM fwd WHERE tip NOT IN (SELECT src FROM e)")
def flow_chains_of_x_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark)
    return flow.chains(flow.by_name(nodes, "x"), edges).select("start", F.array_join("chain", " > ").alias("chain"))


@query("flow_origins_of_loop_corpus", SQL + " SELECT start, array_to_string(chain, ' > ') AS chain FROM back WHERE tip NOT IN (SELECT dst FROM e)")
def flow_origins_of_loop_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark)
    return flow.chains(flow.by_name(nodes, "loop"), edges, forward=False).select("start", F.array_join("chain", " > ").alias("chain"))


@query(
    "flow_summary_corpus",
    SQL + """ SELECT (SELECT count(*) FROM n) AS total_nodes, (SELECT count(*) FROM e) AS total_edges, (SELECT count(DISTINCT path) FROM n) AS files, (SELECT count(*) FROM dead) AS dead_variables,
    (SELECT count(*) FROM imports) AS unused_imports, (SELECT count(*) FROM params) AS unused_params, (SELECT count(transform_category) FROM e) AS transforms, (SELECT count(sink_category) FROM e) AS sinks""",
)
def flow_summary_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.summary(*graph(spark))


@query("flow_report_corpus", SQL + " SELECT section, count(*) AS n FROM (SELECT 'dead_variables' AS section FROM dead UNION ALL SELECT 'unused_imports' FROM imports UNION ALL SELECT 'unused_params' FROM params UNION ALL SELECT 'transformations' FROM ends WHERE transform_category IS NOT NULL UNION ALL SELECT 'sinks' FROM ends WHERE sink_category IS NOT NULL UNION ALL SELECT 'summary') GROUP BY section")
def flow_report_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.report(*graph(spark)).groupBy("section").agg(F.count("*").alias("n"))

"""The named queries of the core operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import complexity, deps, duplicates, errors, graph, matlab, secrets, stale
from stratalens.registry import query
from stratalens.plans import corpus
from stratalens.plans.code_sql import SQL
from stratalens.plans.staging import stage
from stratalens.sources import files, pyfacts

#: Fixed edges for the graph operators.
EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "f"), ("g", "a"), ("h", "h"), ("a", "b")]
LAYERS = [("a", 3), ("b", 2), ("c", 2), ("d", 0), ("e", 1), ("f", 0), ("g", 1), ("h", 0)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "pages", ".html")


def _lines_sql(table: str, key: str, column: str, folder: str, ext: str) -> str:
    return f"""l AS (SELECT path, k AS line, trim(rows[k], ' ') AS text, rows[k] AS raw FROM (
        SELECT '{folder}/' || {key} || '{ext}' AS path, string_split({column}, chr(10)) AS rows FROM {table} WHERE {column} IS NOT NULL AND {key} IS NOT NULL), LATERAL (SELECT unnest(range(1, len(rows) + 1)) AS k))"""


_WINDOWS_SQL = (
    "WITH "
    + _lines_sql("documents", "doc_id", "text", "documents", ".txt")
    + """, w AS (SELECT path, line AS start_line, lead(line, 4) OVER o AS end_line, concat_ws(chr(10), text, lead(text, 1) OVER o, lead(text, 2) OVER o, lead(text, 3) OVER o, lead(text, 4) OVER o) AS block
    FROM l WHERE text <> '' WINDOW o AS (PARTITION BY path ORDER BY line)),
    b AS (SELECT path, start_line, end_line, md5(block) AS digest FROM w WHERE end_line IS NOT NULL),
    g AS (SELECT digest, count(DISTINCT path) AS n_files, count(*) AS n_blocks FROM b GROUP BY digest HAVING count(DISTINCT path) >= 2)"""
)


@query(
    "dup_groups_documents",
    _WINDOWS_SQL
    + """ SELECT g.digest, n_files, n_blocks, (n_blocks - 1) * 5 AS duplicate_lines, p.path AS first_path, p.start_line AS first_line
    FROM g JOIN (SELECT digest, path, start_line, row_number() OVER (PARTITION BY digest ORDER BY path, start_line) AS r FROM b) p ON p.digest = g.digest AND p.r = 1""",
)
def dup_groups_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of five equal lines in two documents or more, the costliest first."""
    return duplicates.duplicate_groups(documents(spark, sf_dir)).orderBy(F.desc("duplicate_lines"), "digest")


@query("dup_windows_documents", _WINDOWS_SQL + " SELECT path, start_line, end_line, digest FROM b SEMI JOIN g USING (digest)")
def dup_windows_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.matched_blocks(documents(spark, sf_dir), normal=False).select("path", "start_line", "end_line", "digest")


@query("dup_total_documents", _WINDOWS_SQL + " SELECT count(*) AS n_groups, sum(n_blocks) AS n_blocks, max(n_files) AS most_files, sum((n_blocks - 1) * 5) AS duplicate_lines FROM g")
def dup_total_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates.duplicate_groups(documents(spark, sf_dir))
    return found.agg(F.count("*").alias("n_groups"), F.sum("n_blocks").alias("n_blocks"), F.max("n_files").alias("most_files"), F.sum("duplicate_lines").alias("duplicate_lines"))


@query("dup_regions_corpus", SQL["dup_regions_corpus"])
def dup_regions_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of regions that agree after normalisation, and where they lie."""
    regions = duplicates.duplicate_regions(corpus.files(spark))
    return duplicates.region_groups(regions).select("line_count", F.col("copy_count"), F.col("total_duplicate_lines").cast("long").alias("total_duplicate_lines"), "regions")


_LITERAL_SQL = f"""WITH {_lines_sql("documents", "doc_id", "text", "documents", ".txt")},
v AS (SELECT path, line, raw, unnest(regexp_extract_all(raw, '''[^''\\n]{{12,}}''|"[^"\\n]{{12,}}"')) AS q FROM l),
s AS (SELECT row_number() OVER () AS id, path, line, raw, substr(q, 2, length(q) - 2) AS value FROM v),
c AS (SELECT id, count(*) AS k FROM (SELECT id, unnest(string_split(value, '')) AS ch FROM s) GROUP BY id, ch),
e AS (SELECT id, -sum(k::DOUBLE / n * log2(k::DOUBLE / n)) AS entropy FROM c JOIN (SELECT id, sum(k) AS n FROM c GROUP BY id) USING (id) GROUP BY id)
SELECT path, line, value, round(entropy, 6) AS entropy, entropy > 3.5 AS flagged,
  nullif(regexp_extract(raw, '(?i)(?:secret|token|credential|auth|key|password|passwd|pwd|signing|private|api)'), '') AS context FROM s JOIN e USING (id)"""


@query("entropy_literals_documents", _LITERAL_SQL)
def entropy_literals_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted literals of the documents and whether their entropy passes 3.5 bits a character."""
    found = secrets.literals(files.lines(documents(spark, sf_dir)))
    return found.select("path", "line", "value", F.round("entropy", 6).alias("entropy"), (F.col("entropy") > 3.5).alias("flagged"), "context")


_NAME = r"(?:secret|token|credential|auth[_-]?key|api[_-]?key|password|passwd)\s*[=:]\s*[^''\"\s]"


@query(
    "sensitive_names_pages",
    f"""WITH {_lines_sql("pages", "page_id", "html", "pages", ".html")}
    SELECT path, line, 'LOW' AS severity, 'Sensitive variable name' AS label, regexp_extract(raw, '(?i){_NAME}') AS matched_text FROM l WHERE regexp_matches(raw, '(?i){_NAME}')""",
)
def sensitive_names_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.rule_findings(files.lines(pages(spark, sf_dir))).where("severity = 'LOW'")


_CORPUS_LINES = f"""c AS (SELECT path, k AS line, rows[k] AS raw FROM (SELECT path, string_split(text, chr(10)) AS rows FROM {corpus.values_sql()}), LATERAL (SELECT unnest(range(1, len(rows) + 1)) AS k))"""


@query(
    "secret_rules_corpus",
    f"""WITH {_CORPUS_LINES}, r(severity, label, pat) AS (VALUES """
    + ", ".join(f"('{s}', '{label}', '{p.replace(chr(39), chr(39) * 2).replace('(?iU)', '(?i)').replace('(?U)', '')}')" for label, s, p in secrets.RULES)
    + """) SELECT path, line, severity, label, regexp_extract(raw, pat) AS matched_text FROM c, r WHERE regexp_matches(raw, pat)""",
)
def secret_rules_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.rule_findings(files.lines(corpus.files(spark))).select("path", "line", "severity", "label", "matched_text")


@query("secret_scan_corpus", SQL["secret_scan_corpus"])
def secret_scan_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and literals of high entropy, without what is harmless; values as they may be shown."""
    return secrets.scan(corpus.files(spark)).select("path", "line", "severity", "label", "truncated")


@query("secret_severities_corpus", SQL["secret_severities_corpus"])
def secret_severities_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.by_severity(secrets.scan(corpus.files(spark)))


@query("secret_gate_corpus", SQL["secret_gate_corpus"])
def secret_gate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.blocked(secrets.scan(corpus.files(spark)))


@query("markers_corpus", SQL["markers_corpus"])
def markers_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale.with_blame(stale.markers(corpus.files(spark)), corpus.blame(spark), corpus.NOW)


def _commented(spark: SparkSession) -> DataFrame:
    return stale.with_blame(stale.commented_code(corpus.files(spark)), corpus.blame(spark), corpus.NOW)


@query("commented_code_corpus", SQL["commented_code_corpus"])
def commented_code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commented(spark).withColumn("lines", F.array_join("lines", "\n"))


@query("comment_ages_corpus", SQL["comment_ages_corpus"])
def comment_ages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many markers and commented blocks there are of each age."""
    return stale.age_histogram(markers_corpus(spark, sf_dir).select("staleness").unionByName(_commented(spark).select("staleness")))


def _nodes(spark: SparkSession) -> DataFrame:
    """Facts of the tree's Python files, staged: each file is parsed once a query."""
    return stage(pyfacts.ast_nodes(corpus.files(spark)), "ast-nodes")


@query("function_complexity_corpus", SQL["function_complexity_corpus"])
def function_complexity_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.ranked(complexity.python_functions(_nodes(spark)), top=None)


@query("function_ranking_corpus", SQL["function_ranking_corpus"])
def function_ranking_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five functions of highest score, of complexity 2 and above: a top-k report."""
    return complexity.ranked(complexity.python_functions(_nodes(spark)), threshold=2, top=5)


@query("complexity_histogram_corpus", SQL["complexity_histogram_corpus"])
def complexity_histogram_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.histogram(complexity.python_functions(_nodes(spark)))


@query("complexity_summary_corpus", SQL["complexity_summary_corpus"])
def complexity_summary_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.summary(complexity.python_functions(_nodes(spark)))


@query("error_audit_corpus", SQL["error_audit_corpus"])
def error_audit_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.audit(corpus.files(spark), _nodes(spark)).select("path", "line", "severity", "title", F.array_join("code_lines", "\n").alias("excerpt"))


@query("error_severities_corpus", SQL["error_severities_corpus"])
def error_severities_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.by_severity(errors.issues(_nodes(spark)))


@query("dependency_edges_corpus", SQL["dependency_edges_corpus"])
def dependency_edges_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.python_edges(corpus.files(spark), _nodes(spark))


@query("dead_files_corpus", SQL["dead_files_corpus"])
def dead_files_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.dead_files(corpus.files(spark), _nodes(spark))


@query("reference_counts_corpus", SQL["reference_counts_corpus"])
def reference_counts_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.reference_counts(corpus.files(spark), _nodes(spark))


def _matlab_nodes(spark: SparkSession) -> DataFrame:
    return stage(pyfacts.ast_nodes(corpus.matlab_files(spark)), "ast-nodes")


@query("dead_files_matlab", SQL["dead_files_matlab"])
def dead_files_matlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.dead_files(corpus.matlab_files(spark), _matlab_nodes(spark))


@query("references_matlab", SQL["references_matlab"])
def references_matlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.references(corpus.matlab_files(spark), _matlab_nodes(spark)).where("source <> target")


@query("dead_report_matlab", SQL["dead_report_matlab"])
def dead_report_matlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.dead_report(corpus.matlab_files(spark), _matlab_nodes(spark))


@query("matlab_spans", SQL["matlab_spans"])
def matlab_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matlab.function_spans(matlab.matlab_lines(corpus.matlab_files(spark)))


@query("matlab_functions", SQL["matlab_functions"])
def matlab_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matlab.matlab_functions(corpus.matlab_files(spark))


@query("matlab_issues", SQL["matlab_issues"])
def matlab_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matlab.matlab_issues(corpus.matlab_files(spark))


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    edges = graph.edge_table(spark, EDGES)
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct(), edges


_EDGES_SQL = "WITH RECURSIVE e AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + ") AS t(source, target)), n AS (SELECT source AS node FROM e UNION SELECT target FROM e)"
_REACH_SQL = _EDGES_SQL + ", r AS (SELECT node AS a, node AS b FROM n UNION SELECT a, target FROM r JOIN e ON b = source)"
_CYCLE_SQL = (
    _EDGES_SQL
    + """, p AS (SELECT source AS head, target AS tail, [source, target] AS path FROM (SELECT DISTINCT * FROM e) WHERE source < target
    UNION ALL SELECT head, target, list_append(path, target) FROM p JOIN (SELECT DISTINCT * FROM e) d ON tail = d.source WHERE target > head AND NOT list_contains(path, target))
    SELECT DISTINCT array_to_string(path, '>') AS cycle FROM p JOIN e ON e.source = tail AND e.target = head
    UNION SELECT source FROM e WHERE source = target AND NOT EXISTS (SELECT 1 FROM p JOIN e x ON x.source = p.tail AND x.target = p.head WHERE list_contains(p.path, e.source))"""
)


@query("graph_fan", _EDGES_SQL + " SELECT node, (SELECT count(DISTINCT source) FROM e WHERE target = node) AS fan_in, (SELECT count(DISTINCT target) FROM e WHERE source = node) AS fan_out FROM n")
def graph_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan(*_graph(spark))


@query("graph_strong_components", _REACH_SQL + " SELECT x.a AS node, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(*_graph(spark))


@query("graph_cycles", _CYCLE_SQL)
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(*_graph(spark)).select(F.array_join("path", ">").alias("cycle"))


@query(
    "graph_layer_violations",
    _EDGES_SQL
    + ", y AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', {b})" for a, b in LAYERS)
    + ") AS t(node, level)) SELECT source, target, s.level AS source_level, t.level AS target_level, CASE WHEN s.level < t.level THEN 'upward' ELSE 'skip' END AS violation FROM e JOIN y s ON s.node = source JOIN y t ON t.node = target WHERE s.level < t.level OR s.level - t.level > 1",
)
def graph_layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layer_violations(_graph(spark)[1], spark.createDataFrame(LAYERS, "node string, level int"))


@query("dependency_tree_corpus", SQL["dependency_tree_corpus"])
def dependency_tree_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(deps.python_edges(corpus.files(spark), _nodes(spark)), "edges")
    roots = graph.tree_roots(corpus.files(spark).where("ext = '.py'").select(F.col("path").alias("node")), edges)
    return graph.tree(edges, roots).select("root", "depth", F.array_join("path", " > ").alias("path"), "is_cycle")

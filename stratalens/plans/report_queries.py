"""Registered queries of views, reports and sources: the tree as files, blame, graph views, the roll-up; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import audit, deps, duplicates, graph, stale
from stratalens.plans import code_sql, corpus, flow_queries, matlab_sql, queries
from stratalens.plans.corpus import sql_value
from stratalens.plans.staging import shared_dir, stage
from stratalens.registry import query
from stratalens.sources import blame, files, pyfacts

# The tree as files.

#: A tree with what collecting is about: skipped folders, hidden and binary files, odd bytes.
TREE = {
    "a/one.py": b"x = 1\r\n", "a/__init__.py": b"", "a/.env": b"A=1\n", "a/conf.env": b"B=2\n", "a/+pkg/two.m": b"y = 2;\n", "a/@Box/three.m": b"z = 3;\n", "a/env/four.py": b"1\n",
    "a/.hid/five.py": b"5\n", "a/build/six.py": b"6\n", "a/x.egg-info/seven.py": b"7\n", "a/late.py": b"#" * 2000 + b"\0\n", "a/soon.py": b"\0\n", "a/odd.py": b"s = '\xff'\n", "a/b+c/eight.m": b"8;\n", "a/notes.txt": b"no\n",
}


def written(spark: SparkSession) -> str:
    """The tree, written once a session to the shared folder; its place."""
    root = f"{shared_dir(spark)}/tree (1)+"
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for path, content in TREE.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        if not system.exists(at):
            out = system.create(at)
            out.write(bytearray(content))
            out.close()
    return root


_TREE = "WITH t(path, ext, nul) AS (VALUES " + ", ".join(f"({sql_value(p)}, {sql_value('.' + p.split('/')[-1].rsplit('.', 1)[1] if '.' in p.split('/')[-1][1:] else '')}, {c.find(0)})" for p, c in TREE.items()) + ")"


def _collected_sql() -> str:
    parts = []
    for name, (kinds, names, letters, head, file_too) in files.COLLECTED.items():
        folders = "string_split(path, '/')" + ("" if file_too else "[:-2]")
        skip = " OR ".join([f"x IN ({', '.join(map(sql_value, names)) or 'NULL'})", *(f"starts_with(x, '{c}')" for c in letters), *(["ends_with(x, '.egg-info')"] if name == "dead files" else [])])
        parts.append(f"SELECT {sql_value(name)} AS analysis, path FROM t WHERE ext IN ({', '.join(map(sql_value, kinds))}) AND (nul < 0 OR nul >= {head}) AND len(list_filter({folders}, lambda x: coalesce({skip}, false))) = 0")
    return _TREE + " " + " UNION ALL ".join(parts)


@query("tree_files", _collected_sql())
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a written tree each analysis reads."""
    root, out = written(spark), None
    for name in files.COLLECTED:
        rows = files.tree_of_analysis(spark, root, name).select(F.lit(name).alias("analysis"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("tree_counts", _TREE + " SELECT ext, count(*) AS n FROM t WHERE ext IN ('.py', '.m') GROUP BY ext")
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.counts(files.tree(spark, written(spark), (), 0))


# Blame.

_PORCELAIN = "WITH o(path, output) AS (VALUES " + ", ".join(f"({sql_value(p)}, {sql_value(t)})" for p, t in corpus.PORCELAIN.items()) + """),
    l AS (SELECT path, unnest(range(len(string_split(output, chr(10))))) AS k, unnest(string_split(output, chr(10))) AS x FROM o),
    h AS (SELECT path, k, regexp_extract(x, '^([0-9a-f]{40}) \\d+ (\\d+)', 1) AS sha, regexp_extract(x, '^([0-9a-f]{40}) \\d+ (\\d+)', 2)::INTEGER AS line FROM l WHERE regexp_matches(x, '^[0-9a-f]{40} \\d+ \\d+( |$)')),
    i AS (SELECT l.path, l.x, arg_max(h.sha, h.k) AS sha FROM l JOIN h ON h.path = l.path AND h.k <= l.k GROUP BY l.path, l.x, l.k),
    c AS (SELECT path, sha, max(CASE WHEN starts_with(x, 'author ') THEN trim(x[8:]) END) AS author, max(CASE WHEN starts_with(x, 'author-time ') THEN x[13:]::BIGINT END) AS ts_epoch FROM i GROUP BY ALL),
    bl AS (SELECT path, line, coalesce(author, 'unknown') AS author, coalesce(ts_epoch, 0) AS ts_epoch FROM h JOIN c USING (path, sha))"""


@query("blame_lines", _PORCELAIN + " SELECT * FROM bl")
def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who changed each line last, from the porcelain output of git."""
    return blame.porcelain(spark.createDataFrame(list(corpus.PORCELAIN.items()), "path string, output string"))


_LISTED = code_sql._STALE + ", ls AS (SELECT path, line, keyword AS kind, text, age_seconds, staleness FROM markers UNION ALL SELECT path, start_line, 'COMMENTED CODE', line_count::VARCHAR, age_seconds, staleness FROM blocks)"


@query("stale_comments_by_age", _LISTED + " SELECT row_number() OVER (ORDER BY coalesce(age_seconds, 0) DESC, path, line) AS place, * FROM ls WHERE staleness IN ('STALE', 'ANCIENT')")
def stale_comments_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale markers and commented code, the oldest first, with their place in that order."""
    found = stale.listed(queries.markers_corpus(spark, sf_dir), queries._commented(spark), stale_only=True)
    rows = found.agg(F.collect_list(F.struct(*found.columns)).alias("rows"))  # a report of a screen or two, as sorted
    return rows.select(F.posexplode("rows").alias("k", "r")).select((F.col("k") + 1).cast("long").alias("place"), "r.*")


@query("stale_summary", code_sql._STALE + """ SELECT (SELECT count(*) FROM markers) AS markers, (SELECT count(*) FROM markers WHERE staleness IN ('STALE', 'ANCIENT')) AS stale_markers, (SELECT count(*) FROM blocks) AS blocks, (SELECT sum(line_count)::BIGINT FROM blocks) AS block_lines,
    (SELECT count(*) FROM blocks WHERE staleness IN ('STALE', 'ANCIENT')) AS stale_blocks, (SELECT count(DISTINCT path) FROM (SELECT path FROM markers UNION SELECT path FROM blocks)) AS files""")  # fmt: skip
def stale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stale.summary(queries.markers_corpus(spark, sf_dir), queries._commented(spark))


# Graph views.


def _project(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(files, edges) of the MATLAB tree with its Python files."""
    tree = corpus.matlab_files(spark)
    return tree, stage(deps.project_edges(tree, pyfacts.ast_nodes(tree)), "project-edges")


#: pe: the edges of both languages; the tree's Python files import nothing.
_PROJECT = matlab_sql._EDGES + ", pe AS (SELECT *, false AS cross_language FROM me UNION ALL SELECT *, true FROM xe), nodes AS (SELECT path AS node FROM fl WHERE path LIKE '%.py' OR path LIKE '%.m' UNION SELECT source FROM pe UNION SELECT target FROM pe)"


@query("graph_stats_matlab", _PROJECT + " SELECT count(*) AS files, count(*) FILTER (path LIKE '%.py') AS py_files, count(*) FILTER (path LIKE '%.m') AS m_files, (SELECT count(*) FROM pe) AS edges, (SELECT count(*) FROM pe WHERE cross_language) AS cross_language FROM fl WHERE path LIKE '%.py' OR path LIKE '%.m'")
def graph_stats_matlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(*_project(spark))


@query("graph_cross_language_matlab", _PROJECT + " SELECT source, target, raw FROM pe WHERE cross_language")
def graph_cross_language_matlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark)[1].where("cross_language").select("source", "target", "raw")


@query("graph_one_file_matlab", _PROJECT + " SELECT 'out' AS direction, source, target FROM pe WHERE ends_with(source, 'start.m') UNION ALL SELECT 'in', source, target FROM pe WHERE ends_with(target, 'start.m')")
def graph_one_file_matlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.one_file(_project(spark)[1], "start.m")


@query("graph_fan_threshold_matlab", _PROJECT + " SELECT greatest(1, count(*) // 10) AS threshold FROM nodes")
def graph_fan_threshold_matlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, edges = _project(spark)
    return graph.fan_threshold(tree.where("ext in ('.py', '.m')").select(F.col("path").alias("node")).union(edges.select("source")).union(edges.select("target")))


_FANS = _PROJECT + ", fans AS (SELECT node, (SELECT count(DISTINCT source) FROM pe WHERE target = node) AS fan_in, (SELECT count(DISTINCT target) FROM pe WHERE source = node) AS fan_out FROM nodes)"
_EXPORT = (
    _FANS
    + """ SELECT 'nodes' AS section, '{"node":"' || node || '","fan_in":' || fan_in || ',"fan_out":' || fan_out || '}' AS json FROM fans
    UNION ALL SELECT 'edges', '{"source":"' || source || '","target":"' || target || '","type":"' || type || '","raw":"' || replace(raw, '"', '\\"') || '","cross_language":' || cross_language || '}' FROM pe"""
)


@query("graph_export_matlab", _EXPORT)
def graph_export_matlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges, cycles and clusters as JSON; this tree has no cycle."""
    tree, edges = _project(spark)
    return graph.exported(tree.where("ext in ('.py', '.m')").select(F.col("path").alias("node")), edges)


@query("graph_clusters", queries._REACH_SQL + " SELECT scc, count(*) AS size FROM (SELECT x.a AS node, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) GROUP BY scc HAVING count(*) > 1")
def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of more than one node."""
    return graph.clusters(graph.strong_components(*queries._graph(spark)))


_LAYERS = (
    queries._REACH_SQL
    + """, sc AS (SELECT x.a AS node, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), f AS (SELECT DISTINCT x.scc AS s, y.scc AS t FROM e JOIN sc x ON x.node = source JOIN sc y ON y.node = target WHERE x.scc <> y.scc),
    d AS (SELECT DISTINCT scc, 0 AS depth FROM sc UNION SELECT t, depth + 1 FROM d JOIN f ON s = scc), m AS (SELECT scc, max(depth) AS depth FROM d GROUP BY scc)
    SELECT node, ((SELECT max(depth) FROM m) - depth)::INTEGER AS level FROM sc JOIN m USING (scc)"""
)


@query("graph_inferred_layers", _LAYERS)
def graph_inferred_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inferred_layers(*queries._graph(spark))


_DRAWN = code_sql._TREE + """ SELECT row_number() OVER (ORDER BY path) AS place, repeat('    ', len(path) - 1) || CASE WHEN is_cycle THEN '[CYCLE -> ' || path[-1] || ']' ELSE path[-1] END AS text FROM tr"""


@query("dependency_tree_text", _DRAWN)
def dependency_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency tree drawn as lines, with their place."""
    edges = stage(deps.python_edges(corpus.files(spark), queries._nodes(spark)), "edges")
    roots = graph.tree_roots(corpus.files(spark).where("ext = '.py'").select(F.col("path").alias("node")), edges)
    lines = graph.drawn(graph.tree(edges, roots)).agg(F.collect_list("text").alias("lines"))  # a drawing, as sorted
    return lines.select(F.posexplode("lines").alias("k", "text")).select((F.col("k") + 1).cast("long").alias("place"), "text")


# Duplicates of whole tables.

_STAR = (
    queries._WINDOWS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT path, start_line AS s, end_line AS e, digest, row_number() OVER (PARTITION BY path ORDER BY start_line) AS i FROM b SEMI JOIN g USING (digest)),
    h AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY path, s) AS r FROM n),
    p AS (SELECT x.path AS f1, x.s AS s1, x.e AS e1, x.i AS i1, y.path AS f2, y.s AS s2, y.e AS e2, y.i AS i2 FROM h x JOIN h y USING (digest) WHERE x.r = 1 AND y.r > 1 AND NOT (x.path = y.path AND x.e >= y.s)),
    k AS (SELECT *, i1 - row_number() OVER (PARTITION BY f1, f2, i2 - i1 ORDER BY i1) AS island FROM p)
    SELECT f1, min(s1) AS s1, max(e1) AS e1, f2, min(s2) AS s2, max(e2) AS e2, count(*) AS n_blocks FROM k GROUP BY f1, f2, i2 - i1, island"""
)


@query("dup_regions_documents", _STAR)
def dup_regions_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of equal lines: each place of a block against its first one, joined into the longest runs."""
    return duplicates.region_pairs(duplicates.matched_blocks(queries.documents(spark, sf_dir), normal=False), star=True)


@query("dup_previews_corpus", "SELECT * FROM (VALUES (6, 'def total(rows):' || chr(10) || '    s = 0  # running' || chr(10) || '    for r in rows:' || chr(10) || '        if r > 10:' || chr(10) || '            s += r * 2' || chr(10) || '    print(\"done\", s)')) AS t(line_count, preview)")
def dup_previews_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of each group of regions."""
    groups = duplicates.region_groups(duplicates.duplicate_regions(corpus.files(spark)))
    return duplicates.previews(groups, corpus.files(spark)).select("line_count", F.array_join("preview", "\n").alias("preview"))


@query("dup_gate_documents", queries._WINDOWS_SQL + " SELECT count(*) > 0 AS failed FROM g")
def dup_gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.gate(duplicates.duplicate_groups(queries.documents(spark, sf_dir)))


# The roll-up.

CHOSEN = [a for a in audit.ANALYSES if a.name != "variable flow (MATLAB)"]
_CYCLES = (
    code_sql._EDGES
    + """, u AS (SELECT DISTINCT source, target FROM e), cp AS (SELECT source AS head, target AS tip, [source, target] AS path FROM u WHERE source < target UNION ALL SELECT head, target, list_append(path, target) FROM cp JOIN u ON tip = source WHERE target > head AND NOT list_contains(path, target)),
    cy AS (SELECT DISTINCT path FROM cp JOIN u ON source = tip AND target = head) SELECT 'MEDIUM' AS severity, path[1] AS path, 1 AS line, array_to_string(path, ' > ') AS title FROM cy UNION ALL SELECT 'MEDIUM', source, 1, source FROM u WHERE source = target AND NOT EXISTS (SELECT 1 FROM cy WHERE list_contains(path, source))"""
)


def _windows(texts: dict[str, str]) -> str:
    return f"""WITH l AS (SELECT path, line, trim(raw, ' ') AS text FROM {code_sql.rows_of(texts)}), w AS (SELECT path, line, lead(line, 4) OVER o AS e, md5(concat_ws(chr(10), text, lead(text, 1) OVER o, lead(text, 2) OVER o, lead(text, 3) OVER o, lead(text, 4) OVER o)) AS d FROM l WHERE text <> '' WINDOW o AS (PARTITION BY path ORDER BY line)),
    f AS (SELECT d, min((path, line)) AS p FROM w WHERE e IS NOT NULL GROUP BY d HAVING count(DISTINCT path) >= 2) SELECT 'MEDIUM' AS severity, p[1] AS path, p[2] AS line, d AS title FROM f"""


_PARTS = {
    "complexity": code_sql._FUNCTIONS + " SELECT risk AS severity, path, line, name AS title FROM fn WHERE complexity >= 11",
    "variable flow": flow_queries.sql(corpus.TEXTS) + " SELECT 'LOW' AS severity, path, line, name AS title FROM dead",
    "errors": code_sql._ISSUES + " SELECT severity, path, line, title FROM iss",
    "dead files": code_sql._references(corpus.TEXTS) + " SELECT 'LOW' AS severity, path, 1 AS line, 'no reference' AS title FROM dead",
    "secrets": code_sql._SECRETS + " SELECT severity, path, line, label AS title FROM shown",
    "dependencies": _CYCLES,
    "duplicates": _windows(corpus.TEXTS),
    "stale": code_sql._STALE + " SELECT 'LOW' AS severity, path, line, keyword AS title FROM markers UNION ALL SELECT 'LOW', path, start_line, 'commented-out code' FROM blocks",
}
#: The reports are shown over these.
FEW = [a for a in CHOSEN if a.name in ("complexity", "errors", "secrets", "stale")]


def _found_sql(chosen: list[audit.Analysis]) -> str:
    return "WITH fo AS (" + " UNION ALL ".join(f"SELECT {sql_value(a.name)} AS category, severity, path, line::INTEGER AS line, title FROM ({_PARTS[a.name]})" for a in chosen) + ")"


_FOUND, _FEW = _found_sql(CHOSEN), _found_sql(FEW)
_NAMES = ", ".join(f"({sql_value(a.name)})" for a in CHOSEN)
_MARKS = "CASE WHEN n > 0 THEN n || ' issues' ELSE 'CLEAN' END AS status, n::BIGINT AS n, CASE WHEN n > 10 THEN '!!' WHEN n > 0 THEN '!' ELSE '' END AS mark"


def _found(spark: SparkSession, chosen: list[audit.Analysis]) -> DataFrame:
    return stage(audit.findings(corpus.files(spark), queries._nodes(spark), chosen), "findings")


@query("audit_findings_corpus", _FOUND + " SELECT * FROM fo")
def audit_findings_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, CHOSEN)


@query("audit_scorecard_corpus", _FOUND + f", k AS (SELECT category, (SELECT count(*) FROM fo WHERE fo.category = a.category) AS n FROM (VALUES {_NAMES}) AS a(category)) SELECT category, {_MARKS} FROM k UNION ALL SELECT NULL, {_MARKS} FROM (SELECT sum(n) AS n FROM k)")
def audit_scorecard_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scorecard(_found(spark, CHOSEN), CHOSEN)


@query("audit_top_corpus", _FEW + " SELECT category, severity, path, line, title, rank FROM (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY list_position(['CRITICAL', 'VERY HIGH', 'HIGH', 'MEDIUM', 'MODERATE', 'LOW'], severity), path, line, title))::INTEGER AS rank FROM fo) WHERE rank <= 3")
def audit_top_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three gravest findings of each analysis: a top-k report."""
    return audit.top_findings(_found(spark, FEW), 3)


@query("audit_summary_corpus", _FEW + " SELECT category, string_agg(severity || ': ' || n, ' | ' ORDER BY severity) AS summary FROM (SELECT category, severity, count(*) AS n FROM fo GROUP BY ALL) GROUP BY category")
def audit_summary_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary_lines(_found(spark, FEW))


@query("audit_text_corpus", _FEW + " SELECT '[' || category || '] ' || severity || ' ' || path || ':' || line || ' ' || title AS text FROM fo")
def audit_text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.text_report(_found(spark, FEW))


@query("audit_json_corpus", _FEW + " SELECT category, '{\"severity\":\"' || severity || '\",\"path\":\"' || path || '\",\"line\":' || line || ',\"title\":\"' || title || '\"}' AS json FROM fo")
def audit_json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(_found(spark, FEW))


@query("audit_run_corpus", _FOUND + f" SELECT category, CASE WHEN n > 0 THEN n || ' issues' ELSE 'CLEAN' END AS status, n FROM (SELECT category, (SELECT count(*) FROM fo WHERE fo.category = a.category) AS n FROM (VALUES {', '.join(f'({sql_value(a.name)})' for a in CHOSEN if not a.slow)}) AS a(category))")
def audit_run_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick analyses, each by itself, with its status."""
    tree = corpus.files(spark)
    return audit.run(spark, tree, queries._nodes(spark), [a for a in audit.selected(tree, quick=True) if a in CHOSEN])

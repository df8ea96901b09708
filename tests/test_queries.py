"""Registered queries against their DuckDB SQL, and against rows worked out by hand."""

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratalens.operators import audit, graph
from stratalens.registry import ORACLES, QUERIES
from stratalens.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"create view {name} as select * from '/root/testdata/sf0.01/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got
    assert got == sorted(repr(tuple(r)) for r in duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, "").select(*columns).collect())


def test_entry(spark):
    assert entry.entry(spark).count() == 66


def test_complexity(spark):
    got = {r[0]: r[1:] for r in rows(spark, "function_complexity_corpus", "name", "complexity", "max_depth", "length")}
    assert got["Shape.area"] == (6, 4, 7)
    assert got["Shape.Inner.wait"] == (5, 1, 3)
    assert got["outer"] == (6, 2, 10)
    assert got["inner"] == (2, 0, 1)
    assert got["flat"] == (1, 0, 1)
    assert "hidden" not in got


def test_errors(spark):
    got = rows(spark, "error_audit_corpus", "path", "line", "title")
    assert got == [
        ("errors.py", 6, "Bare except"), ("errors.py", 6, "Swallowed exception"), ("errors.py", 10, "Unguarded I/O"), ("errors.py", 13, "Broad except"),
        ("errors.py", 13, "Empty except body"), ("errors.py", 15, "Generic raise"), ("errors.py", 17, "Inconsistent return"), ("errors.py", 22, "Inconsistent return"),
    ]


def test_dependencies(spark):
    got = rows(spark, "dependency_edges_corpus", "source", "target", "type")
    assert ("pkg/__init__.py", "pkg/a.py", "relative_import") in got
    assert ("pkg/a.py", "pkg/c.py", "from_import") in got and ("pkg/a.py", "pkg/__init__.py", "from_import") in got
    assert ("tool.py", "plugins/fast.py", "dynamic_import") in got
    assert len(got) == 9


def test_dead_files(spark):
    got = [r[0] for r in rows(spark, "dead_files_corpus", "path")]
    assert "plugins/unused.py" in got and "orphan.py" in got
    assert not {"plugins/fast.py", "plugins/slow.py", "scripts/helper.py", "metrics.py", "test_tool.py", "pkg/__init__.py"} & set(got)


def test_stale(spark):
    assert rows(spark, "markers_corpus", "path", "line", "keyword", "staleness") == [("stale.m", 1, "XXX", "STALE"), ("stale.py", 1, "TODO", "FRESH"), ("stale.py", 4, "HACK", "STALE")]
    assert rows(spark, "commented_code_corpus", "path", "start_line", "end_line", "author", "staleness") == [("stale.m", 1, 5, "cid", "STALE"), ("stale.py", 6, 9, "bob", "ANCIENT")]


def test_secrets(spark):
    got = rows(spark, "secret_scan_corpus", "line", "severity", "truncated")
    assert [r[:2] for r in got] == [(1, "HIGH"), (2, "HIGH"), (3, "HIGH"), (4, "LOW"), (5, "MEDIUM"), (6, "CRITICAL")]
    assert all(len(r[2]) <= 11 for r in got)


def test_duplicate_regions(spark):
    assert rows(spark, "dup_regions_corpus", "line_count", "copy_count", "total_duplicate_lines") == [(6, 2, 6)]


def test_inferred_layers(spark):
    assert rows(spark, "graph_inferred_layers", "node", "level") == [("a", 2), ("b", 2), ("c", 2), ("d", 1), ("e", 1), ("f", 0), ("g", 3), ("h", 3)]


def test_long_cycle_and_deep_tree(spark):
    """No depth is cut: a ring of 60 nodes is a cycle, a chain of 60 a branch."""
    ring = [(f"n{k:02}", f"n{(k + 1) % 60:02}") for k in range(60)]
    edges = graph.edge_table(spark, ring)
    nodes = edges.select(F.col("source").alias("node"))
    assert [len(r.path) for r in graph.cycles(nodes, edges).collect()] == [60]
    line = graph.edge_table(spark, ring[:-1])
    assert graph.tree(line, graph.tree_roots(nodes, line)).agg(F.max("depth")).first()[0] == 59
    assert [r.node for r in graph.tree_roots(nodes, edges).collect()] == ["n00"]


def test_cycles_of_a_dense_component_stop(spark):
    edges = graph.edge_table(spark, [(f"n{a}", f"n{b}") for a in range(9) for b in range(9) if a != b])
    found = graph.cycles(edges.select(F.col("source").alias("node")).distinct(), edges).collect()
    assert len(found) == 100 and max(len(r.path) for r in found) == 3


def test_audit_run(spark):
    def of(name, files, nodes):
        if name == "secrets":
            raise ValueError("broken")
        if name == "errors":
            return spark.range(10**13).selectExpr("sum(sin(id)) s").where("s > 2")
        return spark.range(3 if name == "stale" else 0)

    chosen = [a for a in audit.ANALYSES if a.name in ("secrets", "errors", "stale", "dead files")]
    got = {r.category: (r.status, r.n) for r in audit.run(spark, None, None, chosen, seconds=3.0, of=of).collect()}
    assert got == {"secrets": ("SKIP (ValueError)", 0), "errors": ("SKIP (timeout)", 0), "stale": ("3 issues", 3), "dead files": ("CLEAN", 0)}


def test_selection(spark):
    python, both = files.literal(spark, {"a.py": ""}), files.literal(spark, {"a.py": "", "b.m": ""})
    assert not {a.lang for a in audit.selected(python)} & {"matlab"} and len(audit.selected(both)) == len(audit.ANALYSES)
    assert not any(a.slow for a in audit.selected(both, quick=True)) and not {a.lang for a in audit.selected(both, python=False)} & {"python"}

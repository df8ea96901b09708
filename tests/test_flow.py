"""Variable flow against rows worked out by hand."""

from stratalens.operators import flow
from stratalens.plans import corpus
from stratalens.plans.flow_queries import graph
from stratalens.sources import files, flowfacts


def edges_of(spark, text):
    tree = files.literal(spark, {"m.py": text})
    nodes, edges = flow.flow_graph(tree, flowfacts.flow_events(tree))
    names = {r.id: f"{r.name}@{r.line}" for r in nodes.collect()}
    return sorted((names[r.src], names[r.dst], r.kind, r.transform, r.sink) for r in edges.collect())


def test_assignment_binds_before_it_reads(spark):
    assert edges_of(spark, "x = 1\nx = f(x)\ny = x\n") == [("x@2", "y@3", "ASSIGN", None, None)]


def test_scopes(spark):
    text = "v = 1\ndef g(v):\n    def h():\n        return v\n    return v\nw = v\n"
    assert edges_of(spark, text) == [("v@1", "w@6", "ASSIGN", None, None), ("v@2", "<return>@4", "RETURN", None, None), ("v@2", "<return>@5", "RETURN", None, None)]


def test_loops_and_comprehensions(spark):
    assert edges_of(spark, "x = 1\nfor x in x:\n    pass\n") == [("x@2", "x@2", "ASSIGN", None, None)]
    # A comprehension's target binds in the scope around it, at line 0.
    assert edges_of(spark, "rows = 1\na = [k for k in rows]\nb = k\n") == [("k@0", "b@3", "ASSIGN", None, None), ("rows@1", "a@2", "ASSIGN", None, None), ("rows@1", "k@0", "ASSIGN", None, None)]


def test_sinks_and_transforms(spark):
    got = edges_of(spark, "q = 1\ns = q.encode()\nprint(s, end=q)\nd.get(q)\nclient.get(q)\n")
    assert got == [("q@1", "<sink:get>@5", "CALL_ARG", None, "get"), ("q@1", "<sink:print>@3", "CALL_ARG", None, "print"), ("q@1", "s@2", "ASSIGN", "encode", None), ("s@2", "<sink:print>@3", "CALL_ARG", None, "print")]


def test_attributes(spark):
    assert edges_of(spark, "a = 1\no.p = a\no.q.r = a\nt = r\no.s = nothing\n") == [("a@1", "r@3", "ATTR_ACCESS", None, None), ("a@1", "self.p@2", "ATTR_ACCESS", None, None), ("r@3", "t@4", "ASSIGN", None, None)]


def test_imports_meet_their_source(spark):
    nodes, edges = graph(spark)
    by = {r.id: r for r in nodes.collect()}
    found = sorted((by[r.src].path, by[r.src].line, by[r.dst].path, by[r.dst].name) for r in edges.where("kind = 'IMPORT'").collect())
    assert found == [("lib/__init__.py", 1, "app.py", "clean"), ("lib/base.py", 2, "app.py", "LIMIT"), ("lib/base.py", 2, "lib/__init__.py", "LIMIT"), ("lib/base.py", 4, "lib/__init__.py", "clean")]
    assert {r.name for r in by.values() if r.is_external} == {"json", "sys", "thing", "path"}


def test_unparsable_and_empty(spark):
    tree = files.literal(spark, {"bad.py": corpus.FLOW["bad.py"], "empty.py": ""})
    nodes, edges = flow.flow_graph(tree, flowfacts.flow_events(tree))
    assert nodes.count() == edges.count() == 0
    assert flow.summary(nodes, edges).first().total_nodes == 0
    assert flow.chains(nodes.select("id"), edges).count() == 0

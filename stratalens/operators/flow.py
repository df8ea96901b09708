"""Variable flow as a graph: which binding each name read refers to, and what follows from the edges.

nodes: (id, path, node, name, kind, scope, line, col, is_external); edges: (src, dst,
kind, transform, transform_category, sink, sink_category), a bag: a name read twice for a
node is two edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.plans.staging import drop, stage

TAGS = ("transform", "transform_category", "sink", "sink_category")


def node_id(path: str, node: str) -> Column:
    return F.concat(F.col(path), F.lit("#"), F.col(node).cast("string"))


def bindings(events: DataFrame) -> DataFrame:
    """The nodes of the graph, before imports are followed."""
    own = events.where("event = 'bind'")
    return own.select(node_id("path", "node").alias("id"), "path", "node", F.col("shown").alias("name"), "kind", "scope", "line", "col", "module", "imported", "level")


def resolved(events: DataFrame) -> DataFrame:
    """The edges within files: each read meets the last binding before it in the innermost scope around it that has one.

    An as-of join as one window: reads are repeated for each scope around them, lie among
    the bindings of (file, scope, name) in the order of events, and take the last of them.
    """
    binds = events.where("event = 'bind' and name is not null").select("path", F.element_at("scopes", -1).alias("own"), "name", "seq", F.col("node").alias("found"), F.lit(None).cast("int").alias("depth"))
    reads = events.where("event = 'read'").select("path", F.posexplode("scopes").alias("depth", "own"), "name", "seq", F.lit(None).cast("int").alias("found"))
    order = Window.partitionBy("path", "own", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    met = binds.unionByName(reads).withColumn("found", F.last("found", ignorenulls=True).over(order)).where("depth is not null and found is not null")
    met = met.groupBy("path", "seq").agg(F.max_by("found", "depth").alias("found"))
    every = events.where("event = 'read'").select("path", "seq", "node", "kind", "may_loop", *TAGS).join(met, ["path", "seq"])
    return every.where("may_loop or found <> node").select(node_id("path", "found").alias("src"), node_id("path", "node").alias("dst"), "kind", *TAGS)


def modules(files: DataFrame) -> DataFrame:
    """(module, target): the file of each dotted name; a package before a module of its name."""
    base = F.regexp_replace("path", r"\.py$", "")
    name = F.replace(F.regexp_replace(base, "/__init__$", ""), F.lit("/"), F.lit("."))
    rows = files.where("ext = '.py'").select(name.alias("module"), F.struct((~F.col("path").endswith("/__init__.py")).alias("late"), F.col("path").alias("target")).alias("t"))
    return rows.groupBy("module").agg(F.min("t").alias("t")).select("module", "t.target")


def import_targets(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, imported, target) of the imports whose module is a file of the tree.

    Absolute ones take the longest known prefix of the dotted name; relative ones climb
    from the file's folder and prefer a module to a package.
    """
    asked = nodes.where("kind = 'IMPORT'").select("id", "path", "module", "imported", "level")
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    plain = asked.where("level = 0 and module <> ''").select("id", "imported", F.explode(prefixes).alias("module")).join(modules(files), "module")
    plain = plain.groupBy("id", "imported").agg(F.max_by("target", F.length("module")).alias("target"))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - F.col("level"), F.lit(0)))
    inner = F.when(F.col("module") == "", F.array().cast("array<string>")).otherwise(parts)
    base = F.array_join(F.concat(folders, inner), "/")
    tried = F.array(F.struct(F.lit(0).alias("rank"), F.concat(base, F.lit(".py")).alias("path")), F.struct(F.lit(1).alias("rank"), F.concat_ws("/", F.when(base != "", base), F.lit("__init__.py")).alias("path")))
    near = asked.where("level > 0").select("id", "imported", F.explode(tried).alias("t")).select("id", "imported", "t.*").join(files.where("ext = '.py'").select("path"), "path")
    near = near.groupBy("id", "imported").agg(F.min_by("path", "rank").alias("target"))
    return plain.unionByName(near)


def flow_graph(files: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree: imported names lead from the last node of that name in their file; imports of no file are external."""
    nodes = bindings(events)
    found = import_targets(files, nodes)
    given = nodes.where("kind in ('ASSIGN', 'IMPORT', 'PARAM')").select(F.col("path").alias("target"), F.col("name").alias("imported"), "id", F.struct("line", -F.col("node")).alias("at"))
    last = given.groupBy("target", "imported").agg(F.max_by("id", "at").alias("src"))
    stitched = found.join(last, ["target", "imported"]).select("src", F.col("id").alias("dst"), F.lit("IMPORT").alias("kind"), *(F.lit(None).cast("string").alias(t) for t in TAGS))
    outside = nodes.where("kind = 'IMPORT'").select("id").join(found.select("id"), "id", "left_anti").withColumn("is_external", F.lit(True))
    nodes = nodes.drop("module", "imported", "level").join(outside, "id", "left").na.fill(False, ["is_external"])
    return nodes, resolved(events).unionByName(stitched)


def _unread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def dead_variables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing reads, but for returns, sinks, comprehensions, external imports, and names kept by habit."""
    name = F.col("name")
    constant = (F.col("kind") == "ASSIGN") & (F.upper(name) == name) & (F.lower(name) != name)
    habit = name.startswith("_") | name.isin("self", "cls") | name.startswith("self.") | constant
    return _unread(nodes.where(~F.col("kind").isin("RETURN", "CALL_RESULT", "COMPREHENSION") & ~F.col("is_external") & ~habit), edges)


def unused_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _unread(nodes.where("kind = 'IMPORT'"), edges)


def unused_parameters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    name = F.col("name")
    return _unread(nodes.where((F.col("kind") == "PARAM") & ~name.isin("self", "cls") & ~name.startswith("_") & ~name.startswith("*")), edges)


def _ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with name, path and line of both ends."""
    of = lambda side: nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("path").alias(f"{side}_path"), F.col("line").alias(f"{side}_line"))
    return edges.join(of("src"), "src").join(of("dst"), "dst")


def transformations(nodes: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """Edges on which data changes its form; name: only those that begin or end at it."""
    rows = _ends(edges.where("transform_category is not null"), nodes)
    return rows if name is None else rows.where((F.col("src_name") == name) | (F.col("dst_name") == name))


def sinks(nodes: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """Edges into sinks; name: only those that data of it reaches, along any edges."""
    rows = _ends(edges.where("sink_category is not null"), nodes)
    if name is None:
        return rows
    return rows.join(reached(nodes.where(F.col("name") == name).select("id"), edges).select(F.col("id").alias("src")), "src", "left_semi")


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the starts and what can be reached from them; each round follows only what is new."""
    steps = stage(edges.select("src", "dst").distinct(), "flow-steps")
    seen = new = stage(starts.select("id").distinct(), "flow-reached")
    while True:
        new = stage(steps.join(new, steps.src == new.id, "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "flow-new")
        if new.isEmpty():
            drop(steps, new)
            return seen
        seen = stage(seen.unionByName(new), "flow-reached")


def chains(starts: DataFrame, edges: DataFrame, forward: bool = True, deepest: int = 50) -> DataFrame:
    """(start, chain): every path of distinct nodes from a start (id) to a node without further edges; backward ones end at the start.

    Paths that meet themselves or go on beyond ``deepest`` steps, a fixed value, are no
    chains.  As many rows as there are paths: a way to look at single variables.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    steps = stage(edges.select(F.col(a).alias("at"), F.col(b).alias("to")), "flow-steps")
    more = steps.select("at").distinct()
    paths, out = starts.select(F.col("id").alias("start"), F.array("id").alias("chain"), F.col("id").alias("at")), None
    for depth in range(deepest + 1):
        paths = stage(paths, "flow-paths")
        ended = paths.join(more, "at", "left_anti").select("start", "chain")
        out = ended if out is None else out.unionByName(ended)
        if depth == deepest or paths.isEmpty():
            break
        paths = paths.join(steps, "at").where(~F.array_contains("chain", F.col("to"))).select("start", F.concat("chain", F.array("to")).alias("chain"), F.col("to").alias("at"))
    return out if forward else out.select("start", F.reverse("chain").alias("chain"))


def by_name(nodes: DataFrame, name: str, path: str | None = None) -> DataFrame:
    rows = nodes.where(F.col("name") == name)
    return (rows if path is None else rows.where(F.col("path") == path)).orderBy("path", "line", "node")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of eight counts."""
    n = F.count("*")
    counts = [
        nodes.agg(n.alias("total_nodes"), F.count_distinct("path").alias("files")),
        edges.agg(n.alias("total_edges"), F.count("transform_category").alias("transforms"), F.count("sink_category").alias("sinks")),
        dead_variables(nodes, edges).agg(n.alias("dead_variables")),
        unused_imports(nodes, edges).agg(n.alias("unused_imports")),
        unused_parameters(nodes, edges).agg(n.alias("unused_params")),
    ]
    out = counts[0]
    for more in counts[1:]:  # one row each
        out = out.join(F.broadcast(more), F.lit(True))
    return out.select("total_nodes", "total_edges", "files", "dead_variables", "unused_imports", "unused_params", "transforms", "sinks")


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, json): one row a finding, and the summary."""
    row = lambda df, section, *columns: df.select(F.lit(section).alias("section"), F.to_json(F.struct(*columns)).alias("json"))
    at = ("name", "path", "line", "scope")
    ends = ("src_name", "dst_name", "dst_path", "dst_line")
    parts = [
        row(dead_variables(nodes, edges), "dead_variables", *at),
        row(unused_imports(nodes, edges), "unused_imports", *at),
        row(unused_parameters(nodes, edges), "unused_params", *at),
        row(transformations(nodes, edges), "transformations", *ends, "transform", "transform_category"),
        row(sinks(nodes, edges), "sinks", *ends, "sink", "sink_category"),
        row(summary(nodes, edges), "summary", "*"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

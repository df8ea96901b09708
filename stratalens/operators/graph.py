"""Graphs as edge tables (source, target): degrees, components, cycles, layers.

Iterative ones write each round to the shared folder and read it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.plans.staging import drop, stage


def fan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) by distinct neighbours, of every node."""
    once = edges.select("source", "target").distinct()
    into = once.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("fan_in"))
    out = once.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("fan_out"))
    return nodes.select("node").distinct().join(into, "node", "left").join(out, "node", "left").na.fill(0, ["fan_in", "fan_out"])


def components(links: DataFrame) -> DataFrame:
    """(v, c): the least vertex linked with v, for links (a, b) taken both ways.

    Least labels of the neighbours, then one jump to the label's label, until nothing changes.
    """
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    held = labels = stage(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "near").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("far"))
        after = stage(lower.join(jump, "c").select("v", "was", F.least("c", "far").alias("c")), "labels")
        drop(held)
        held, labels = after, after.select("v", "c")
        if after.where("c <> was").isEmpty():
            drop(edges)
            return labels


def _reached(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along the edges: (node, label)."""
    held = labels = stage(labels, "reach")
    while True:
        step = edges.join(labels, edges.source == labels.node).groupBy(edges.target.alias("node")).agg(F.min("label").alias("near"))
        after = stage(labels.join(step, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "reach")
        drop(held)
        held, labels = after, after.select("node", "label")
        if after.where("label < was").isEmpty():
            return labels


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scc): scc is a node of the component.

    Colouring: each round, the least node that reaches a node is its colour; what reaches
    the colour back within it is a component and leaves the graph.
    """
    edges = stage(edges.select("source", "target").where("source <> target").distinct(), "scc-edges")
    left = stage(nodes.select("node").distinct(), "scc-nodes")
    done: DataFrame | None = None
    while True:
        colours = _reached(edges, left.select("node", F.col("node").alias("label")))
        tinted = edges.join(colours.select(F.col("node").alias("source"), F.col("label").alias("x")), "source").join(colours.select(F.col("node").alias("target"), F.col("label").alias("y")), "target").where("x = y")
        back = stage(tinted.select(F.col("target").alias("source"), F.col("source").alias("target"), "x"), "scc-back")
        found = stage(colours.where("node = label"), "scc-found")
        while True:
            more = back.join(found, back.source == found.node).select(back.target.alias("node"), F.col("x").alias("label")).distinct()
            more = stage(more.join(found, "node", "left_anti"), "scc-more")
            if more.isEmpty():
                break
            found = stage(found.unionByName(more), "scc-found")
        named = found.select("node", F.col("label").alias("scc"))
        done = named if done is None else done.unionByName(named)
        left = stage(left.join(found, "node", "left_anti"), "scc-nodes")
        if left.isEmpty():
            return done
        alive = lambda name: left.select(F.col("node").alias(name))
        edges = stage(edges.join(alive("source"), "source", "left_semi").join(alive("target"), "target", "left_semi"), "scc-edges")


def clusters(components_: DataFrame) -> DataFrame:
    """(scc, size) of the components of more than one node."""
    return components_.groupBy("scc").agg(F.count("*").alias("size")).where("size > 1")


def cycles(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """Simple cycles: (scc, path), the least node first; of each component the first ``most`` by length and path.

    Paths start at the least node of their cycle, stay in its component and grow by one node
    a round, so a component that has its ``most`` cycles, all no longer than what is to
    come, leaves the search.  Self-loops are cycles of single-node components.
    """
    labels = stage(strong_components(nodes, edges), "cycle-scc")
    once = edges.select("source", "target").distinct()
    own = once.join(labels.select(F.col("node").alias("source"), "scc"), "source").join(labels.select(F.col("node").alias("target"), F.col("scc").alias("other")), "target").where("scc = other")
    inner = stage(own.where("source <> target").select("source", "target", "scc"), "cycle-edges")
    single = labels.groupBy("scc").agg(F.count("*").alias("n")).where("n = 1")
    order = Window.partitionBy("scc").orderBy(F.size("path"), "path")
    found = own.where("source = target").join(single, "scc", "left_semi").select("scc", F.array("source").alias("path"))
    paths = held = stage(inner.where("source < target").select("scc", F.array("source", "target").alias("path")), "cycle-paths")
    while not paths.isEmpty():
        ahead = paths.withColumn("source", F.element_at("path", -1)).join(inner.drop("scc"), "source")
        closed = stage(ahead.where(F.col("target") == F.col("path")[0]).select("scc", "path"), "cycles")
        found = found.unionByName(closed)
        full = found.groupBy("scc").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        onward = (F.col("target") > F.col("path")[0]) & ~F.array_contains("path", F.col("target"))
        paths = stage(ahead.where(onward).join(full, "scc", "left_anti").select("scc", F.array_append("path", F.col("target")).alias("path")), "cycle-paths")
        drop(held)
        held = paths
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("scc", "path")


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """layers (node, level), 0 at the bottom: edges that go upward, or down by more than one level."""
    up, down = layers.select(F.col("node").alias("source"), F.col("level").alias("a")), layers.select(F.col("node").alias("target"), F.col("level").alias("b"))
    kind = F.when(F.col("a") < F.col("b"), "upward").when(F.col("a") - F.col("b") > 1, "skip")
    return edges.select("source", "target").join(up, "source").join(down, "target").withColumn("violation", kind).where("violation is not null").select("source", "target", F.col("a").alias("source_level"), F.col("b").alias("target_level"), "violation")


def inferred_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): roots on top, by the longest path from a root over the condensed graph."""
    labels = stage(strong_components(nodes, edges), "layer-scc")
    name = lambda column: labels.select(F.col("node").alias(column), F.col("scc").alias(column + "_scc"))
    flat = edges.join(name("source"), "source").join(name("target"), "target").where("source_scc <> target_scc")
    flat = stage(flat.select(F.col("source_scc").alias("source"), F.col("target_scc").alias("target")).distinct(), "layer-edges")
    depth = stage(labels.select(F.col("scc").alias("node"), F.lit(0).alias("depth")).distinct(), "layer-depth")
    while True:
        step = flat.join(depth, flat.source == depth.node).groupBy(flat.target.alias("node")).agg((F.max("depth") + 1).alias("near"))
        after = stage(depth.join(step, "node", "left").select("node", F.col("depth").alias("was"), F.greatest("depth", F.coalesce("near", F.lit(0))).alias("depth")), "layer-depth")
        depth = after.select("node", "depth")
        if after.where("depth > was").isEmpty():
            break
    top = depth.agg(F.max("depth")).first()[0] or 0
    return labels.join(depth.select(F.col("node").alias("scc"), "depth"), "scc").select("node", (F.lit(top) - F.col("depth")).cast("int").alias("level"))


def tree_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): those without incoming edges but with outgoing ones; if there are none, the first of largest fan-out."""
    degrees = stage(fan(nodes, edges), "tree-fan")
    tops = degrees.where("fan_in = 0 and fan_out > 0").select("node")
    widest = degrees.where("fan_out > 0").orderBy(F.desc("fan_out"), "node").limit(1).select("node")
    return widest if tops.isEmpty() else tops


def tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the dependency tree: (root, depth, path, is_cycle); a node met again above it ends its branch."""
    once = stage(edges.select("source", "target").distinct(), "tree-edges")
    level = out = stage(roots.select(F.col("node").alias("root"), F.array("node").alias("path"), F.lit(False).alias("is_cycle")), "tree-level")
    while not level.isEmpty():
        ahead = level.where("not is_cycle").withColumn("source", F.element_at("path", -1)).join(once, "source")
        level = stage(ahead.select("root", F.array_append("path", F.col("target")).alias("path"), F.array_contains("path", F.col("target")).alias("is_cycle")), "tree-level")
        out = out.unionByName(level)
    return out.select("root", (F.size("path") - 1).alias("depth"), "path", "is_cycle")


def drawn(rows: DataFrame) -> DataFrame:
    """The tree as text lines in order: (text)."""
    own = F.element_at("path", -1)
    text = F.concat(F.repeat(F.lit("    "), F.col("depth")), F.when(F.col("is_cycle"), F.concat(F.lit("[CYCLE -> "), own, F.lit("]"))).otherwise(own))
    return rows.orderBy("path").select(text.alias("text"))


def graph_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files of both languages, edges, and edges between languages."""
    kinds = files.where("ext in ('.py', '.m')").agg(F.count("*").alias("files"), F.count_if(F.col("ext") == ".py").alias("py_files"), F.count_if(F.col("ext") == ".m").alias("m_files"))
    return kinds.join(F.broadcast(edges.agg(F.count("*").alias("edges"), F.count_if("cross_language").alias("cross_language"))), F.lit(True))  # one row each


def fan_threshold(nodes: DataFrame) -> DataFrame:
    """One row: the fan from which a file is shown, a tenth of the files, at least 1."""
    return nodes.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count_distinct("node") / 10)).alias("threshold"))


def one_file(edges: DataFrame, name: str) -> DataFrame:
    """Edges into and out of the nodes whose path ends with ``name``."""
    own = lambda c: F.col(c).endswith(name)
    out = edges.where(own("source")).select(F.lit("out").alias("direction"), "source", "target")
    return out.unionByName(edges.where(own("target")).select(F.lit("in").alias("direction"), "source", "target"))


def exported(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, json): nodes with their fans, edges, cycles and clusters."""
    row = lambda df, section, value: df.select(F.lit(section).alias("section"), F.to_json(value).alias("json"))
    every = nodes.select("node").union(edges.select("source")).union(edges.select("target")).distinct()
    labels = stage(strong_components(every, edges), "export-scc")
    groups = labels.groupBy("scc").agg(F.sort_array(F.collect_list("node")).alias("files")).where(F.size("files") > 1)
    parts = [row(fan(every, edges), "nodes", F.struct("node", "fan_in", "fan_out")), row(edges, "edges", F.struct("source", "target", "type", "raw", "cross_language")), row(cycles(every, edges), "cycles", F.struct("path")), row(groups, "clusters", F.struct("files"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def edge_table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "source string, target string")

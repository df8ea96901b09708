"""Variable flow of MATLAB sources, by patterns over logical lines, as the same events and graph as Python's.

A statement's events (names bound, names read) are arrays made by expressions; their
order within a file is (line, place in the statement), and operators.flow finds what each
read refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators import flow
from stratalens.sources.files import lines, stem

# What statements look like, once comments and the insides of strings are gone.
FUNCTION = r"(?U)^\s*function\s+(?:(?:\[([^\]]*)\]|(\w+))\s*=\s*)?(\w+)\s*(?:\(([^)]*)\))?\s*$"
END = r"(?U)^\s*(?:end|endfunction)\s*;?\s*$"
DECLARED = r"(?U)^\s*(global|persistent)\s+(.+?)\s*;?\s*$"
LOAD = r"(?U)^\s*load\s*\(?['\"]?([^'\")\s;]+)['\"]?\)?\s*(.*?)\s*;?\s*$"
FOR = r"(?U)^\s*for\s+(\w+)\s*=\s*(.+?)\s*$"
ASSIGN = r"(?U)^\s*(?:\[([^\]]*)\]|(\w[\w.]*(?:\{[^}]*\}|\([^)]*\))*))\s*=\s*(.+)\s*;?\s*$"
CALL = r"(?U)^\s*(\w+)\s*\(([^)]*)\)\s*;?\s*$"
CALLS = r"(?U)(\w+)\s*\(([^)]*)\)"
IDENTIFIER = r"(?U)\b([a-zA-Z_]\w*)\b"
# Names that are no variables.
RESERVED = tuple("true false pi inf Inf nan NaN eps i j end if else elseif while for switch case otherwise try catch return break continue function classdef properties methods events enumeration arguments".split())
# Calls that change the form of data, by category.
TRANSFORMS = {
    "type_cast": "double single int8 int16 int32 int64 uint8 uint16 uint32 uint64 logical char string cell struct num2str str2num str2double mat2str cell2mat cell2struct struct2cell num2cell table2array array2table table2struct struct2table",
    "case_transform": "lower upper",
    "sanitization": "strtrim strip strrep regexprep replace erase",
    "splitting": "extractBefore extractAfter extractBetween split strsplit",
    "joining": "strjoin join strcat",
    "formatting": "sprintf compose",
    "math": "abs sqrt log log2 log10 exp round floor ceil fix mod rem sign real imag conj",
    "linalg": "transpose inv pinv eig svd qr lu chol norm det rank null orth",
    "reshaping": "reshape permute squeeze repmat repelem flip fliplr flipud rot90 circshift cat horzcat vertcat",
    "sorting": "sort sortrows",
    "filtering": "unique intersect union setdiff find nonzeros",
    "signal": "fft ifft fft2 ifft2 filter conv conv2 deconv",
    "interpolation": "interp1 interp2 interp3 griddata",
    "encoding": "base64encode base64decode unicode2native native2unicode typecast",
    "statistics": "mean median std var cov corrcoef min max sum prod cumsum cumprod histogram histcounts",
}
# Calls that data leaves the program through, by category.
SINKS = {
    "console": "disp display printf warning error msgbox errordlg warndlg",
    "file": "save fwrite fprintf writematrix writetable writecell csvwrite dlmwrite xlswrite writestruct jsonencode saveas print exportgraphics imwrite audiowrite videoWriter",
    "plot": "plot plot3 scatter scatter3 bar barh histogram pie area stem stairs surf mesh contour contourf imagesc imshow heatmap pcolor quiver streamline fill patch line text title xlabel ylabel zlabel legend annotation subplot polarplot semilogx semilogy loglog",
    "database": "exec execute sqlwrite insert update",
    "network": "webwrite websave ftp sendmail",
    "system": "system dos unix eval evalc feval assignin evalin",
    "environment": "setenv setpref setappdata",
}
#: Events of one statement are numbered below this.
ROOM = 1_000_000
_EVENT = "array<struct<event:string,at:int,own:int,name:string,shown:string,kind:string,transform:string,transform_category:string,sink:string,sink_category:string,may_loop:boolean>>"


def _table(kinds: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(v) for kind, names in kinds.items() for name in names.split() for v in (name, kind)))


def logical_lines(files: DataFrame) -> DataFrame:
    """(path, line, text): lines joined at ``...``, numbered by their first, without comments, strings emptied, none blank."""
    rows = lines(files.where("ext = '.m'"), wide=True).withColumn("goes_on", F.col("raw").rlike(r"(?U)\.\.\.\s*$"))
    order = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("starts", F.coalesce(~F.lag("goes_on").over(order), F.lit(True)).cast("int"))
    rows = rows.withColumn("group", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.regexp_replace(F.when(F.col("starts") == 1, F.col("raw")).otherwise(F.trim(F.col("raw"))), r"(?U)\.\.\.\s*$", "")
    joined = rows.groupBy("path", "group").agg(F.min("line").alias("line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", piece.alias("p")))), lambda x: x["p"]), " ").alias("text"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"%.*$", ""), '"[^"]*"', '""'), "'[^']*'", "''")
    return joined.select("path", "line", F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "").alias("text")).where("text <> ''")


def _listed(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def _names(text: Column) -> Column:
    """Variables of an expression, in order, as often as they stand there."""
    return F.filter(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1)), lambda x: ~x.isin(*RESERVED))


def statements(files: DataFrame) -> DataFrame:
    """Logical lines with ``kind``, the first that fits: function, end, global, persistent, load, for, assign, call or other."""
    text = F.col("text")
    kind = (
        F.when(text.rlike(FUNCTION), "function").when(text.rlike(END), "end").when(text.rlike(DECLARED), F.regexp_extract(text, DECLARED, 1))
        .when(text.rlike(LOAD), "load").when(text.rlike(FOR), "for").when(text.rlike(ASSIGN), "assign").when(text.rlike(CALL), "call").otherwise("other")
    )
    part = lambda pattern, k: F.regexp_extract("text", pattern, k)
    targets = F.when(part(ASSIGN, 1) != "", _listed(part(ASSIGN, 1), ",")).otherwise(F.array(F.trim(part(ASSIGN, 2))))
    rows = logical_lines(files).withColumn("kind", kind)
    # A function's scope lasts until the next header.
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("kind") == "function", part(FUNCTION, 3))
    rows = rows.withColumn("number", F.sum((F.col("kind") == "function").cast("int")).over(order)).withColumn("function", F.last(head, ignorenulls=True).over(order))
    bound = (
        F.when(F.col("kind").isin("global", "persistent"), F.filter(F.split(part(DECLARED, 2), r"(?U)\s+"), lambda x: x != ""))
        .when(F.col("kind") == "load", F.filter(F.transform(F.split(part(LOAD, 2), r"(?U)\s+"), lambda x: F.regexp_replace(x, "^['\"]+|['\"]+$", "")), lambda x: x.rlike(r"(?U)^[a-zA-Z_]\w*\b")))
        .when(F.col("kind") == "for", F.array(part(FOR, 1)))
        .when(F.col("kind") == "assign", F.transform(F.filter(targets, lambda x: x != "~"), lambda x: F.regexp_extract(x, r"^([^.{(]*)", 1)))
    )
    inputs, single = _listed(part(FUNCTION, 4), ","), F.filter(F.array(part(FUNCTION, 2)), lambda x: x != "")
    rows = rows.withColumn("bound", bound).withColumn("inputs", F.when(F.col("kind") == "function", inputs)).withColumn("outputs", F.when(F.col("kind") == "function", F.concat(_listed(part(FUNCTION, 1), ","), single)))
    right = F.when(F.col("kind") == "for", part(FOR, 2)).when(F.col("kind") == "assign", part(ASSIGN, 3)).otherwise("")
    called = F.col("kind").isin("assign", "call", "other")
    rows = rows.withColumn("right", F.regexp_replace(right, r"[;\s]+$", "")).withColumn("reads", _names(F.col("right")))
    source = F.when(F.col("kind") == "assign", F.col("right")).otherwise(text)
    calls = F.zip_with(F.regexp_extract_all(source, F.lit(CALLS), F.lit(1)), F.regexp_extract_all(source, F.lit(CALLS), F.lit(2)), lambda n, a: F.struct(n.alias("name"), _names(a).alias("args")))
    return rows.withColumn("calls", F.when(called, F.filter(calls, lambda c: ~c["name"].isin(*RESERVED))))


def _event(event: str, at: Column, own: Column, name: Column, shown: Column, kind: Column, transform=None, sink=None, may_loop: bool = False) -> Column:
    none = F.lit(None).cast("string")
    pair = lambda t, table: (t, F.try_element_at(_table(table), t)) if t is not None else (none, none)
    (t, tc), (s, sc) = pair(transform, TRANSFORMS), pair(sink, SINKS)
    return F.struct(F.lit(event).alias("event"), at.cast("int").alias("at"), own.cast("int").alias("own"), name.alias("name"), shown.alias("shown"), kind.alias("kind"), t.alias("transform"), tc.alias("transform_category"), s.alias("sink"), sc.alias("sink_category"), F.lit(may_loop).alias("may_loop"))


def _no_events() -> Column:
    return F.array().cast(_EVENT)


def flow_events(files: DataFrame) -> DataFrame:
    """Events as of sources.flowfacts, of ``.m`` files: (path, seq, event, node, name, shown, kind, scope, scopes, line, .., may_loop)."""
    none = F.lit(None).cast("string")
    of = lambda table: F.when(F.size("calls") > 0, F.try_element_at(F.filter(F.transform("calls", lambda c: c["name"]), lambda n: n.isin(*_every(table))), F.lit(-1)))
    rows = statements(files).withColumn("transform", of(TRANSFORMS)).withColumn("sink", of(SINKS))
    named = {"global": "GLOBAL_DECL", "persistent": "PERSISTENT_DECL", "load": "LOAD_TARGET", "for": "FOR_TARGET", "assign": "ASSIGN"}
    node_kind = F.lit(None).cast("string")
    for kind, node in named.items():
        node_kind = F.when(F.col("kind") == kind, F.lit(node)).otherwise(node_kind)
    step = F.size("reads") + 1
    bind = lambda x, i: _event("bind", i * step, i * step, x, x, node_kind)
    tag = lambda c: F.when(F.col("kind") == "assign", F.col(c))
    read = lambda r, j, i: _event("read", i * step + j + 1, i * step, r, none, F.lit("ASSIGN"), tag("transform"), tag("sink"))
    written = F.flatten(F.transform("bound", lambda x, i: F.concat(F.array(bind(x, i)), F.transform("reads", lambda r, j: read(r, j, i)))))
    parameter = lambda c, kind, shift: F.transform(c, lambda x, i: _event("bind", i + shift, i + shift, x, x, F.lit(kind)))
    header = F.concat(parameter("inputs", "INPUT_PARAM", F.lit(0)), parameter("outputs", "OUTPUT_PARAM", F.size("inputs")))
    gone = F.filter("calls", lambda c: c["name"].isin(*_every(SINKS)))
    given = lambda c, i: F.concat(F.array(_event("bind", i * 10_000, i * 10_000, none, F.concat(F.lit("<sink:"), c["name"], F.lit(">")), F.lit("FUNCTION_CALL_RESULT"))), F.transform(c["args"], lambda a, j: _event("read", i * 10_000 + j + 1, i * 10_000, a, none, F.lit("CALL_ARG"), None, c["name"], True)))
    left = F.flatten(F.transform(gone, given))
    events = F.when(F.col("kind") == "function", header.cast(_EVENT)).when(F.col("bound").isNotNull(), written.cast(_EVENT)).when(F.col("kind").isin("call", "other"), left.cast(_EVENT)).otherwise(_no_events())
    scopes = F.when(F.col("number") > 0, F.array(F.lit(0), F.col("number").cast("int"))).otherwise(F.array(F.lit(0)))
    scope = F.concat_ws(">", stem(F.col("path")), "function")
    each = rows.select("path", "line", scopes.alias("scopes"), scope.alias("scope"), F.explode(events).alias("e"))
    place = lambda c: (F.col("line").cast("long") * ROOM + F.col(f"e.{c}"))
    return each.select(
        "path", place("at").alias("seq"), "e.event", place("own").alias("node"), "e.name", "e.shown", "e.kind", "scope", "scopes", "line", F.lit(0).alias("col"),
        "e.transform", "e.transform_category", "e.sink", "e.sink_category", "e.may_loop", none.alias("module"), none.alias("imported"), F.lit(None).cast("int").alias("level"),
    )


def _every(table: dict[str, str]) -> list[str]:
    return [name for names in table.values() for name in names.split()]


def call_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the arguments of call statements to the parameters of the functions, of whatever file, that they name.

    Of equally named functions the last counts; an argument is the caller's last node of
    that name up to the line of the call.
    """
    rows = statements(files)
    heads = rows.where("kind = 'function'").groupBy(F.col("function").alias("called")).agg(F.max(F.struct("path", "line", "inputs")).alias("f")).select("called", F.col("f.path").alias("target"), "f.inputs")
    sent = rows.where((F.col("kind") == "call") & ~F.regexp_extract("text", CALL, 1).isin(*_every(SINKS))).select(F.col("path").alias("caller"), F.col("line").alias("call_line"), F.regexp_extract("text", CALL, 1).alias("called"), _names(F.regexp_extract("text", CALL, 2)).alias("args"))
    met = sent.join(heads, "called")
    pairs = met.select("caller", "call_line", "called", "target", F.posexplode(F.arrays_zip(F.slice("args", F.lit(1), F.size("inputs")), F.slice("inputs", F.lit(1), F.size("args")))).alias("k", "p"))
    pairs = pairs.select("caller", "call_line", "called", "target", "k", F.col("p").getField("0").alias("arg"), F.col("p").getField("1").alias("param"))
    own = nodes.select(F.col("path").alias("caller"), F.col("name").alias("arg"), F.col("id").alias("src"), "line", "node")
    binding = pairs.join(own, ["caller", "arg"]).where("line <= call_line").groupBy("caller", "call_line", "called", "target", "k", "param").agg(F.max_by("src", F.struct("line", -F.col("node"))).alias("src"))
    params = nodes.where("kind = 'INPUT_PARAM'").select(F.col("path").alias("target"), F.col("name").alias("param"), F.col("id").alias("dst"), "scope", "node")
    found = binding.join(params, ["target", "param"]).groupBy("caller", "call_line", "called", "target", "k", "src").agg(F.min_by("dst", F.struct((F.instr(F.col("scope"), F.col("called")) == 0).alias("other"), "node")).alias("dst"))
    return found.select("src", "dst", F.lit("CROSS_FILE").alias("kind"), *(F.lit(None).cast("string").alias(t) for t in flow.TAGS))


def flow_graph(files: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), as of Python sources."""
    nodes = flow.bindings(events).drop("module", "imported", "level").withColumn("is_external", F.lit(False))
    return nodes, flow.resolved(events).unionByName(call_edges(files, nodes))


def _unread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def dead_variables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    name = F.col("name")
    kept = F.col("kind").isin("OUTPUT_PARAM", "FUNCTION_CALL_RESULT", "GLOBAL_DECL", "PERSISTENT_DECL") | name.startswith("<") | name.startswith("~") | name.isin("ans", "nargin", "nargout", "varargin", "varargout")
    return _unread(nodes.where(~kept), edges)


def unused_inputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _unread(nodes.where((F.col("kind") == "INPUT_PARAM") & ~F.col("name").isin("varargin", "nargin", "nargout")), edges)


def unused_outputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Outputs that nothing in their function assigns and nothing flows into."""
    assigned = nodes.where("kind = 'ASSIGN'").select("path", "scope", "name")
    outputs = nodes.where("kind = 'OUTPUT_PARAM' and name <> 'varargout'").join(assigned, ["path", "scope", "name"], "left_anti")
    return outputs.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select(nodes.columns)


def shared_names(nodes: DataFrame) -> DataFrame:
    """Global and persistent declarations."""
    return nodes.where("kind in ('GLOBAL_DECL', 'PERSISTENT_DECL')")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of nine counts."""
    n = F.count("*")
    out = nodes.agg(n.alias("total_nodes"), F.count_distinct("path").alias("files"))
    more = [
        edges.agg(n.alias("total_edges"), F.count("transform_category").alias("transforms"), F.count("sink_category").alias("sinks")),
        dead_variables(nodes, edges).agg(n.alias("dead_variables")), unused_inputs(nodes, edges).agg(n.alias("unused_inputs")),
        unused_outputs(nodes, edges).agg(n.alias("unused_outputs")), shared_names(nodes).agg(n.alias("globals_persistents")),
    ]
    for each in more:  # one row each
        out = out.join(F.broadcast(each), F.lit(True))
    return out

"""DuckDB SQL of MATLAB dependencies and variable flow, over the tree's VALUES."""

from __future__ import annotations

from stratalens.operators import matlab_deps, matlab_flow
from stratalens.plans import corpus
from stratalens.plans.code_sql import plain
from stratalens.plans.corpus import sql_value

_IN = lambda names: "(" + ", ".join(map(sql_value, names)) + ")"
_BOTH = r"""^((?:[^'"%]|'[^']*'|"[^"]*")*(?:'[^']*$|"[^"]*$)?)"""
_ALL = lambda c, p, k=1: f"regexp_extract_all({c}, {plain(p)}, {k})"
#: RE2 can't look behind: delimiters are doubled instead, so that each match leaves one for the next.
_AFTER = r"(?:^|[\s;,=({\[])"


def _places(kind: str, rule: int, found: str) -> str:
    return f"SELECT path AS source, {sql_value(kind)} AS type, {rule} AS rule, unnest(range(len({found}))) AS pos, unnest({found}) AS raw FROM mt"


_EDGES = f"""WITH RECURSIVE fl AS (SELECT path, text FROM {corpus.values_sql(corpus.MATLAB)}),
    mt AS (SELECT path, text, code, regexp_replace(code, '([\\s;,=({{\\[])', '\\1\\1', 'g') AS twice FROM (SELECT path, text, array_to_string(list_transform(string_split(regexp_replace(text, '(?s)%\\{{.*?%\\}}', '', 'g'), chr(10)), lambda x: regexp_extract(x, {sql_value(_BOTH)}, 1)), chr(10)) AS code FROM fl WHERE path LIKE '%.m')),
    ms AS (SELECT regexp_extract(path, '([^/]*)\\.m$', 1) AS raw, min(path) AS target FROM fl WHERE path LIKE '%.m' GROUP BY 1),
    ix AS (SELECT * FROM ms UNION ALL SELECT name, min(target) FROM (SELECT regexp_extract(target, '(?:^|/)@([^/]*)/', 1) AS name, target FROM ms) WHERE name <> '' AND name NOT IN (SELECT raw FROM ms) GROUP BY name),
    cl AS ({_places("function_call", 1, f"regexp_extract_all(twice, {sql_value('(?m)' + _AFTER + '([a-zA-Z][A-Za-z0-9_]*)[ ]*[(]')}, 1)")}),
    cs AS ({_places("class_usage", 5, f"regexp_extract_all(twice, {sql_value('(?m)' + _AFTER + '([A-Z][A-Za-z0-9_]*)[ ]*[(]')}, 1)")}),
    rs AS ({_places("run", 2, _ALL("code", matlab_deps.RUN))} UNION ALL {_places("run", 3, f"list_filter(list_transform({_ALL('code', matlab_deps.RUN_BARE)}, lambda x: rtrim(x, ';')), lambda x: x NOT IN {_IN(matlab_deps.BUILTINS)})")}),
    rt AS (SELECT *, CASE WHEN raw LIKE '%.m' THEN raw ELSE raw || '.m' END AS script FROM rs),
    fd AS (SELECT source, target, type, rule, pos, raw FROM cl JOIN ix USING (raw) WHERE raw NOT IN {_IN(matlab_deps.BUILTINS)} AND lower(raw) NOT IN {_IN(matlab_deps.BUILTINS)}
      UNION ALL SELECT source, target, type, rule, pos, raw FROM cs JOIN ix USING (raw) WHERE raw NOT IN {_IN(matlab_deps.BUILTINS)}
      UNION ALL SELECT source, coalesce((SELECT path FROM fl WHERE path = regexp_extract(source, '^(.*/)', 1) || script), (SELECT path FROM fl WHERE path = script)), type, rule, pos, raw FROM rt),
    once AS (SELECT source, target, arg_min(type, rule * 100000 + pos) AS type, arg_min(raw, rule * 100000 + pos) AS raw FROM fd WHERE target IS NOT NULL AND source <> target GROUP BY ALL),
    me AS (SELECT * FROM once UNION ALL SELECT source, raw, type, raw FROM ({_places("addpath", 4, _ALL("code", matlab_deps.ADDPATH))})),
    xq AS ({_places("py_dot", 1, _ALL("text", matlab_deps.PY_DOT))} UNION ALL {_places("pyrun_import", 3, _ALL("text", matlab_deps.PYRUN_IMPORT))} UNION ALL {_places("pyrun_from", 4, _ALL("text", matlab_deps.PYRUN_FROM))}),
    xf AS ({_places("pyrunfile", 2, _ALL("text", matlab_deps.PYRUNFILE))}),
    xm AS (SELECT q.source, q.type, rule, pos, q.raw, (SELECT path FROM fl WHERE path IN (m || '.py', m || '/__init__.py') ORDER BY path = m || '.py' DESC LIMIT 1) AS hit, k FROM (SELECT *, array_to_string(string_split(raw, '.')[1:k], '/') AS m FROM (SELECT *, unnest(range(1, len(string_split(raw, '.')) + 1)) AS k FROM xq)) q),
    xr AS (SELECT source, type, rule, pos, raw, coalesce(arg_max(hit, k) FILTER (hit IS NOT NULL), raw) AS target FROM xm GROUP BY source, type, rule, pos, raw),
    xe0 AS (SELECT source, target, CASE type WHEN 'pyrun_from' THEN 'pyrun_import' ELSE type END AS type, rule, pos, CASE type WHEN 'py_dot' THEN 'py.' || raw WHEN 'pyrun_import' THEN 'pyrun(''import ' || raw || ''')' ELSE 'pyrun(''from ' || raw || ' import ...'')' END AS raw FROM xr
      UNION ALL SELECT source, coalesce((SELECT path FROM fl WHERE path = regexp_extract(source, '^(.*/)', 1) || xf.raw), (SELECT path FROM fl WHERE path = xf.raw), raw), type, rule, pos, 'pyrunfile(''' || raw || ''')' FROM xf),
    xe AS (SELECT source, target, arg_min(type, rule * 100000 + pos) AS type, arg_min(raw, rule * 100000 + pos) AS raw FROM xe0 GROUP BY ALL)"""

_KIND = f"""CASE WHEN regexp_matches(text, {plain(matlab_flow.FUNCTION)}) THEN 'function' WHEN regexp_matches(text, {plain(matlab_flow.END)}) THEN 'end' WHEN regexp_matches(text, {plain(matlab_flow.DECLARED)}) THEN regexp_extract(text, {plain(matlab_flow.DECLARED)}, 1)
      WHEN regexp_matches(text, {plain(matlab_flow.LOAD)}) THEN 'load' WHEN regexp_matches(text, {plain(matlab_flow.FOR)}) THEN 'for' WHEN regexp_matches(text, {plain(matlab_flow.ASSIGN)}) THEN 'assign' WHEN regexp_matches(text, {plain(matlab_flow.CALL)}) THEN 'call' ELSE 'other' END"""
_PART = lambda p, k: f"regexp_extract(text, {plain(p)}, {k})"
_LIST = lambda x: f"list_filter(list_transform(string_split({x}, ','), lambda v: trim(v)), lambda v: v <> '')"
_WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda v: v <> '')"
_NAMES = lambda x: f"list_filter({_ALL(x, matlab_flow.IDENTIFIER)}, lambda v: v NOT IN {_IN(matlab_flow.RESERVED)})"
_RULES = lambda table: ", ".join(f"({sql_value(n)}, {sql_value(kind)})" for kind, names in table.items() for n in names.split())
_FLOW = f"""WITH RECURSIVE tr(name, kind) AS (VALUES {_RULES(matlab_flow.TRANSFORMS)}), sk(name, kind) AS (VALUES {_RULES(matlab_flow.SINKS)}),
    src AS (SELECT path, unnest(range(1, len(r) + 1)) AS line, unnest(r) AS raw FROM (SELECT path, string_split(rtrim(text, chr(10)), chr(10)) AS r FROM {corpus.values_sql(corpus.MATLAB)} WHERE path LIKE '%.m')),
    go AS (SELECT *, coalesce(lag(regexp_matches(raw, '\\.\\.\\.\\s*$')) OVER (PARTITION BY path ORDER BY line), false) AS more FROM src),
    gr AS (SELECT *, sum((NOT more)::INT) OVER (PARTITION BY path ORDER BY line) AS g FROM go),
    ll AS (SELECT path, min(line) AS line, string_agg(regexp_replace(CASE WHEN more THEN trim(raw) ELSE raw END, '\\.\\.\\.\\s*$', ''), ' ' ORDER BY line) AS text FROM gr GROUP BY path, g),
    tx AS (SELECT path, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '%.*$', ''), '"[^"]*"', '""', 'g'), '''[^'']*''', '''''', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM ll),
    sn AS (SELECT *, {_KIND} AS kind FROM tx WHERE text <> ''),
    sf AS (SELECT *, sum((kind = 'function')::INT) OVER o AS number, last_value(CASE WHEN kind = 'function' THEN {_PART(matlab_flow.FUNCTION, 3)} END IGNORE NULLS) OVER o AS fname FROM sn WINDOW o AS (PARTITION BY path ORDER BY line)),
    sr AS (SELECT *, regexp_replace(CASE kind WHEN 'for' THEN {_PART(matlab_flow.FOR, 2)} WHEN 'assign' THEN {_PART(matlab_flow.ASSIGN, 3)} ELSE '' END, '[;\\s]+$', '') AS rhs,
      CASE WHEN kind IN ('global', 'persistent') THEN {_WORDS(_PART(matlab_flow.DECLARED, 2))} WHEN kind = 'load' THEN list_filter({_WORDS(_PART(matlab_flow.LOAD, 2))}, lambda v: regexp_matches(v, '^[a-zA-Z_]\\w*\\b')) WHEN kind = 'for' THEN [{_PART(matlab_flow.FOR, 1)}]
        WHEN kind = 'assign' THEN list_transform(list_filter(CASE WHEN {_PART(matlab_flow.ASSIGN, 1)} <> '' THEN {_LIST(_PART(matlab_flow.ASSIGN, 1))} ELSE [trim({_PART(matlab_flow.ASSIGN, 2)})] END, lambda v: v <> '~'), lambda v: regexp_extract(v, '^([^.{{(]*)', 1)) ELSE [] END AS bound FROM sf),
    s AS (SELECT *, path || '|' || line AS sid, {_NAMES("rhs")} AS reads, CASE kind WHEN 'assign' THEN rhs ELSE text END AS body, line::BIGINT * 1000000 AS base, concat_ws('>', regexp_extract(path, '([^/]*)\\.m$', 1), fname) AS scope, CASE WHEN number > 0 THEN [0, number] ELSE [0] END AS scopes FROM sr),
    cn AS (SELECT sid, unnest(range(len({_ALL("body", matlab_flow.CALLS)}))) AS k, unnest({_ALL("body", matlab_flow.CALLS, 1)}) AS name, unnest({_ALL("body", matlab_flow.CALLS, 2)}) AS args FROM s WHERE kind IN ('assign', 'call', 'other')),
    lt AS (SELECT sid, arg_max(cn.name, k) AS transform, arg_max(tr.kind, k) AS transform_category FROM cn JOIN tr ON tr.name = cn.name GROUP BY sid), ls AS (SELECT sid, arg_max(cn.name, k) AS sink, arg_max(sk.kind, k) AS sink_category FROM cn JOIN sk ON sk.name = cn.name GROUP BY sid),
    bn AS (SELECT path, sid, base + unnest(range(len(bound))) * (len(reads) + 1) AS node, unnest(bound) AS name, CASE kind WHEN 'global' THEN 'GLOBAL_DECL' WHEN 'persistent' THEN 'PERSISTENT_DECL' WHEN 'load' THEN 'LOAD_TARGET' WHEN 'for' THEN 'FOR_TARGET' ELSE 'ASSIGN' END AS kind, scope, scopes, line FROM s
      UNION ALL SELECT path, sid, base + unnest(range(len(ins))), unnest(ins), 'INPUT_PARAM', scope, scopes, line FROM (SELECT *, {_LIST(_PART(matlab_flow.FUNCTION, 4))} AS ins FROM s WHERE kind = 'function')
      UNION ALL SELECT path, sid, base + len(ins) + unnest(range(len(outs))), unnest(outs), 'OUTPUT_PARAM', scope, scopes, line FROM (SELECT *, {_LIST(_PART(matlab_flow.FUNCTION, 4))} AS ins, list_concat({_LIST(_PART(matlab_flow.FUNCTION, 1))}, list_filter([{_PART(matlab_flow.FUNCTION, 2)}], lambda v: v <> '')) AS outs FROM s WHERE kind = 'function')),
    sc AS (SELECT s.path, s.sid, base + (row_number() OVER (PARTITION BY s.sid ORDER BY k) - 1) * 10000 AS node, cn.name, args, sk.kind AS sink_category, scope, scopes, line FROM s JOIN cn USING (sid) JOIN sk ON sk.name = cn.name WHERE s.kind IN ('call', 'other')),
    n AS (SELECT path || '#' || node AS id, path, node, name, kind, scope, line FROM bn UNION ALL SELECT path || '#' || node, path, node, '<sink:' || name || '>', 'FUNCTION_CALL_RESULT', scope, line FROM sc),
    rd AS (SELECT b.path, node AS own, node + unnest(range(1, len(reads) + 1)) AS seq, unnest(reads) AS name, 'ASSIGN' AS kind, s.scopes, CASE s.kind WHEN 'assign' THEN transform END AS transform, CASE s.kind WHEN 'assign' THEN transform_category END AS transform_category,
        CASE s.kind WHEN 'assign' THEN sink END AS sink, CASE s.kind WHEN 'assign' THEN sink_category END AS sink_category FROM bn b JOIN s USING (sid) LEFT JOIN lt USING (sid) LEFT JOIN ls USING (sid) WHERE b.kind NOT IN ('INPUT_PARAM', 'OUTPUT_PARAM')
      UNION ALL SELECT path, node, node + unnest(range(1, len({_NAMES("args")}) + 1)), unnest({_NAMES("args")}), 'CALL_ARG', scopes, NULL, NULL, name, sink_category FROM sc),
    dx AS (SELECT path, seq, name, unnest(scopes) AS scope, generate_subscripts(scopes, 1) AS depth FROM rd),
    fd AS (SELECT d.path, d.seq, depth, max(b.node) AS found FROM dx d JOIN bn b ON b.path = d.path AND b.name = d.name AND b.scopes[-1] = d.scope AND b.node < d.seq GROUP BY ALL),
    pk AS (SELECT path, seq, arg_max(found, depth) AS found FROM fd GROUP BY ALL),
    w AS (SELECT path || '#' || found AS src, path || '#' || own AS dst, kind, transform, transform_category, sink, sink_category FROM rd JOIN pk USING (path, seq) WHERE kind = 'CALL_ARG' OR found <> own),
    hd AS (SELECT fname AS called, arg_max(path, path || lpad(line::VARCHAR, 9, '0')) AS target, arg_max({_LIST(_PART(matlab_flow.FUNCTION, 4))}, path || lpad(line::VARCHAR, 9, '0')) AS ins FROM s WHERE kind = 'function' GROUP BY fname),
    cs AS (SELECT path, line, called, target, unnest(range(1, least(len(args), len(ins)) + 1)) AS k, args, ins FROM (SELECT path, line, {_PART(matlab_flow.CALL, 1)} AS called, {_NAMES(_PART(matlab_flow.CALL, 2))} AS args FROM s WHERE kind = 'call') JOIN hd USING (called) WHERE called NOT IN (SELECT name FROM sk)),
    ce AS (SELECT (SELECT id FROM n WHERE n.path = cs.path AND n.name = args[k] AND n.line <= cs.line ORDER BY n.line DESC, node LIMIT 1) AS src, (SELECT id FROM n WHERE n.path = target AND n.name = ins[k] AND n.kind = 'INPUT_PARAM' ORDER BY NOT contains(n.scope, called), node LIMIT 1) AS dst FROM cs),
    e AS (SELECT * FROM w UNION ALL SELECT src, dst, 'CROSS_FILE', NULL, NULL, NULL, NULL FROM ce WHERE src IS NOT NULL AND dst IS NOT NULL),
    unread AS (SELECT * FROM n WHERE id NOT IN (SELECT src FROM e)),
    dead AS (SELECT * FROM unread WHERE kind NOT IN ('OUTPUT_PARAM', 'FUNCTION_CALL_RESULT', 'GLOBAL_DECL', 'PERSISTENT_DECL') AND name NOT IN ('ans', 'nargin', 'nargout', 'varargin', 'varargout')),
    inputs AS (SELECT * FROM unread WHERE kind = 'INPUT_PARAM' AND name NOT IN ('varargin', 'nargin', 'nargout')),
    outputs AS (SELECT * FROM n o WHERE kind = 'OUTPUT_PARAM' AND name <> 'varargout' AND NOT EXISTS (SELECT 1 FROM n a WHERE a.kind = 'ASSIGN' AND a.path = o.path AND a.scope = o.scope AND a.name = o.name) AND id NOT IN (SELECT dst FROM e)),
    shared AS (SELECT * FROM n WHERE kind IN ('GLOBAL_DECL', 'PERSISTENT_DECL')),
    ends AS (SELECT e.*, x.name AS src_name, y.name AS dst_name, y.line AS dst_line FROM e JOIN n x ON x.id = src JOIN n y ON y.id = dst),
    fwd AS (SELECT id AS start, [id] AS chain, id AS tip FROM n WHERE name = 'x' UNION ALL SELECT start, list_append(chain, dst), dst FROM fwd JOIN e ON src = tip WHERE NOT list_contains(chain, dst))"""
_AT = "name, path, line, scope, kind"

SQL = {
    "matlab_edges": _EDGES + " SELECT * FROM me",
    "matlab_python_edges": _EDGES + " SELECT * FROM xe",
    "matlab_statements": _FLOW + " SELECT path, line, text, kind FROM s",
    "matlab_flow_nodes": _FLOW + " SELECT id, name, kind, scope, line FROM n",
    "matlab_flow_edges": _FLOW + " SELECT * FROM e",
    "matlab_flow_dead_variables": _FLOW + f" SELECT {_AT} FROM dead",
    "matlab_flow_unused_inputs": _FLOW + f" SELECT {_AT} FROM inputs",
    "matlab_flow_unused_outputs": _FLOW + f" SELECT {_AT} FROM outputs",
    "matlab_flow_shared_names": _FLOW + f" SELECT {_AT} FROM shared",
    "matlab_flow_transformations": _FLOW + " SELECT src_name, dst_name, dst_line, transform, transform_category FROM ends WHERE transform_category IS NOT NULL",
    "matlab_flow_sinks": _FLOW + " SELECT src_name, dst_name, dst_line, sink, sink_category FROM ends WHERE sink_category IS NOT NULL",
    "matlab_flow_chains_of_x": _FLOW + " SELECT start, array_to_string(chain, ' > ') AS chain FROM fwd WHERE tip NOT IN (SELECT src FROM e)",
    "matlab_flow_summary": _FLOW + """ SELECT (SELECT count(*) FROM n) AS total_nodes, (SELECT count(DISTINCT path) FROM n) AS files, (SELECT count(*) FROM e) AS total_edges, (SELECT count(transform_category) FROM e) AS transforms, (SELECT count(sink_category) FROM e) AS sinks,
      (SELECT count(*) FROM dead) AS dead_variables, (SELECT count(*) FROM inputs) AS unused_inputs, (SELECT count(*) FROM outputs) AS unused_outputs, (SELECT count(*) FROM shared) AS globals_persistents""",
}

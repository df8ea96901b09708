"""DuckDB SQL of the queries on the small trees: the same rules as in the operators, over VALUES.

Syntax trees can't be built in SQL, so their facts (sources.pyfacts) are given as rows;
everything that is asked of them is SQL.
"""

from __future__ import annotations

from stratalens.operators import duplicates, errors, matlab, matlab_flow, secrets, stale
from stratalens.plans import corpus
from stratalens.plans.corpus import rows_sql, sql_value
from stratalens.sources import pyfacts


def plain(pattern: str) -> str:
    """A pattern as RE2 reads it, as a SQL literal: without Java's Unicode flag and possessive marks."""
    for a, b in (("(?U)", ""), ("(?Um)", "(?m)"), ("(?iU)", "(?i)"), ("++", "+"), ("*+", "*")):
        pattern = pattern.replace(a, b)
    return sql_value(pattern)


def facts(texts: dict[str, str]) -> str:
    return rows_sql([row for path, text in sorted(texts.items()) if path.endswith(".py") for row in pyfacts.facts(path, text)], pyfacts.SCHEMA)


def rows_of(texts: dict[str, str]) -> str:
    """(path, ext, line, raw); a text that ends with a line end has no line after it."""
    return f"""(SELECT path, CASE WHEN path LIKE '%.py' THEN '.py' WHEN path LIKE '%.m' THEN '.m' ELSE '' END AS ext, unnest(range(1, len(r) + 1)) AS line, unnest(r) AS raw
    FROM (SELECT path, CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS r FROM {corpus.values_sql(texts)}))"""


_IN = lambda names: "(" + ", ".join(map(sql_value, names)) + ")"
_ND = f"WITH RECURSIVE nd AS {facts(corpus.TEXTS)}"
_RISK = "CASE WHEN complexity <= 5 THEN 'LOW' WHEN complexity <= 10 THEN 'MODERATE' WHEN complexity <= 20 THEN 'HIGH' ELSE 'VERY HIGH' END AS risk"
_NEST = _IN(pyfacts.NESTING)
_FUNCTIONS = (
    _ND
    + f""", i AS (SELECT path, unnest(above) AS pre, CASE WHEN kind IN ('BoolOp', 'comprehension') THEN n WHEN kind IN ('If', 'For', 'AsyncFor', 'While', 'ExceptHandler', 'With', 'AsyncWith', 'Assert', 'IfExp') THEN 1 ELSE 0 END AS w,
      CASE WHEN kind IN {_NEST} THEN nest ELSE 0 END AS deep FROM nd),
    g AS (SELECT path, pre, sum(w) AS w, max(deep) AS deep FROM i GROUP BY ALL),
    fn0 AS (SELECT name, path, line, CAST(1 + coalesce(w, 0) AS INTEGER) AS complexity, CAST(greatest(coalesce(deep - nest, 0), 0) AS INTEGER) AS max_depth, code_lines AS length
      FROM nd LEFT JOIN g USING (path, pre) WHERE kind IN ('FunctionDef', 'AsyncFunctionDef') AND listed),
    fn AS (SELECT *, complexity * greatest(max_depth, 1) + length / 10.0::DOUBLE AS score, {_RISK} FROM fn0)"""
)
_HISTOGRAM = """ SELECT risk, n, CASE WHEN total > 0 THEN round(100 * n / total, 1) ELSE 0 END::DOUBLE AS share, repeat('#', round(n * 20 / total)::INTEGER) AS bar
    FROM (SELECT r.risk, count(fn.name) AS n, (SELECT count(*) FROM fn) AS total FROM (VALUES ('LOW'), ('MODERATE'), ('HIGH'), ('VERY HIGH')) AS r(risk) LEFT JOIN fn ON fn.risk = r.risk GROUP BY r.risk)"""
_SUMMARY = " SELECT count(DISTINCT path) AS files, count(*) AS functions, round(avg(complexity), 1) AS average, max(complexity) AS highest FROM fn"

_TEST = "(regexp_extract(path, '([^/]*)$', 1) LIKE 'test\\_%' ESCAPE '\\' OR path LIKE '%\\_test.py' ESCAPE '\\' OR regexp_extract(path, '([^/]*)$', 1) = 'conftest.py' OR path LIKE '%/tests/%' OR path LIKE '%/test/%')"
_ISSUES = (
    _ND
    + f""", t AS (SELECT * FROM nd WHERE NOT {_TEST}), h AS (SELECT * FROM t WHERE kind = 'ExceptHandler' AND parent_kind = 'Try'),
    rt AS (SELECT path, pre, max(n) AS most, min(n) AS least FROM (SELECT path, unnest(above) AS pre, n FROM t WHERE kind = 'Return') GROUP BY ALL),
    mixed AS (SELECT f.* FROM (SELECT *, string_split(name, '.')[-1] AS own FROM t WHERE kind IN ('FunctionDef', 'AsyncFunctionDef')) f JOIN rt USING (path, pre)
      WHERE NOT regexp_matches(own, '^(test_|_test)') AND own NOT IN {_IN(errors.NO_VALUE)} AND most = 1 AND (least = 0 OR value NOT IN ('Return', 'Raise', 'If', 'Try'))),
    iss AS (SELECT path, line, 'HIGH' AS severity, 'Bare except' AS title FROM h WHERE n = 0
      UNION ALL SELECT path, line, 'MEDIUM', 'Broad except' FROM h WHERE name IN ('Exception', 'BaseException')
      UNION ALL SELECT path, line, 'HIGH', 'Swallowed exception' FROM h WHERE value = 'pass'
      UNION ALL SELECT path, line, 'HIGH', 'Empty except body' FROM h WHERE value = 'empty'
      UNION ALL SELECT path, line, 'LOW', 'Generic raise' FROM t WHERE kind = 'Raise' AND name = 'Exception'
      UNION ALL SELECT path, line, 'MEDIUM', 'Unguarded I/O' FROM t WHERE kind = 'Call' AND NOT guarded AND (name = 'open' OR name LIKE '%.%' AND string_split(name, '.')[1] IN {_IN(errors.IO_MODULES)})
      UNION ALL SELECT path, line, 'LOW', 'Inconsistent return' FROM mixed),
    src AS {rows_of(corpus.TEXTS)}"""
)
_ISSUES_OUT = " SELECT i.path, i.line, severity, title, (SELECT array_to_string(list(raw ORDER BY s.line), chr(10)) FROM src s WHERE s.path = i.path AND s.line >= i.line AND s.line < i.line + CASE WHEN title = 'Inconsistent return' THEN 1 ELSE 2 END) AS excerpt FROM iss i"
_SEVERITIES = " SELECT severity, count(*) AS n FROM iss GROUP BY severity"

_FILES = f"fl AS (SELECT path, text FROM {corpus.values_sql()}), py AS (SELECT path, text FROM fl WHERE path LIKE '%.py')"
_ALIAS = "al AS (SELECT path, parent AS pre, pre AS pos, name AS alias FROM nd WHERE kind = 'alias')"
_EDGES = (
    _ND
    + f""", {_FILES}, {_ALIAS},
    st AS (SELECT path AS source, pre AS pos, 'import' AS type, name AS raw FROM nd WHERE kind = 'alias' AND parent_kind = 'Import'
      UNION ALL SELECT path, pre, 'from_import', value FROM nd WHERE kind = 'ImportFrom' AND n = 0 AND value IS NOT NULL
      UNION ALL SELECT nd.path, al.pos, 'from_import', value || '.' || alias FROM nd JOIN al USING (path, pre) WHERE kind = 'ImportFrom' AND n = 0 AND value IS NOT NULL
      UNION ALL SELECT path, pre, 'dynamic_import', value FROM nd WHERE kind = 'Call' AND name IN ('importlib.import_module', 'import_module') AND value IS NOT NULL),
    ab AS (SELECT source, coalesce((SELECT path FROM py WHERE path = replace(raw, '.', '/') || '/__init__.py'), (SELECT path FROM py WHERE path = replace(raw, '.', '/') || '.py')) AS target, type, raw FROM st),
    rl AS (SELECT nd.path, n, coalesce(value, alias) AS module, array_to_string(list_concat(string_split(nd.path, '/')[1:len(string_split(nd.path, '/')) - n], string_split(coalesce(value, alias), '.')), '/') AS base
      FROM nd LEFT JOIN al ON nd.value IS NULL AND al.path = nd.path AND al.pre = nd.pre WHERE kind = 'ImportFrom' AND n > 0),
    e AS (SELECT source, target, type, raw FROM ab WHERE target IS NOT NULL UNION ALL SELECT rl.path, py.path, 'relative_import', repeat('.', n) || module FROM rl JOIN py ON py.path IN (base || '.py', base || '/__init__.py'))"""
)
_TREE = _EDGES + """, d AS (SELECT DISTINCT source, target FROM e), roots AS (SELECT DISTINCT source AS root FROM e WHERE source NOT IN (SELECT target FROM e)),
    tr AS (SELECT root, [root] AS path, false AS is_cycle FROM roots UNION ALL SELECT root, list_append(path, target), list_contains(path, target) FROM tr JOIN d ON source = path[-1] WHERE NOT is_cycle)"""


def _references(texts: dict[str, str]) -> str:
    """CTEs up to rf: distinct (source, target) of both languages."""
    scripts = r"""(?:^|[^A-Za-z0-9_])run\s*\(\s*['"]([^'"]+)['"]\s*\)"""
    return f"""WITH RECURSIVE nd AS {facts(texts)}, fl AS (SELECT path, text FROM {corpus.values_sql(texts)}), {_ALIAS},
    ix0 AS (SELECT path AS target, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS dotted, regexp_extract(path, '([^/]*)\\.py$', 1) AS stem FROM fl WHERE path LIKE '%.py'),
    ix AS (SELECT dotted AS key, target FROM ix0 UNION ALL SELECT stem, min(target) FROM ix0 WHERE stem NOT IN (SELECT dotted FROM ix0) GROUP BY stem),
    bad AS (SELECT path, text FROM fl SEMI JOIN (SELECT path FROM nd WHERE kind = 'SyntaxError') USING (path)),
    q AS (SELECT path, name AS asked FROM nd WHERE kind = 'alias' AND parent_kind = 'Import'
      UNION SELECT path, value FROM nd WHERE kind = 'ImportFrom' AND value IS NOT NULL
      UNION SELECT nd.path, value || '.' || alias FROM nd JOIN al USING (path, pre) WHERE kind = 'ImportFrom' AND value IS NOT NULL
      UNION SELECT path, value FROM nd WHERE kind = 'Call' AND name IN ('importlib.import_module', '__import__', 'import_module') AND value IS NOT NULL
      UNION SELECT path, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+([\\w.]+)', 1)) FROM bad UNION SELECT path, unnest(regexp_extract_all(text, '(?m)^\\s*from\\s+([\\w.]+)\\s+import', 1)) FROM bad),
    im AS (SELECT path AS source, arg_max(target, length(key) * 2 + (NOT key LIKE '%.\\_\\_init\\_\\_' ESCAPE '\\')::INT - CASE WHEN key LIKE '%.\\_\\_init\\_\\_' ESCAPE '\\' AND asked NOT LIKE '%\\_\\_init\\_\\_' ESCAPE '\\' THEN 18 ELSE 0 END) AS target
      FROM q JOIN ix ON asked = key OR starts_with(asked, key || '.') OR key = asked || '.__init__' OR (key LIKE '%.\\_\\_init\\_\\_' ESCAPE '\\' AND starts_with(asked, key[:-9])) GROUP BY path, asked),
    tk AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[''"]([a-zA-Z_][\\w./]*)[''"]', 1)) AS token FROM fl WHERE path LIKE '%.py' AND path NOT IN (SELECT path FROM bad)),
    lt AS (SELECT path AS source, target FROM tk JOIN ix ON (token LIKE '%.%' AND token NOT LIKE '%.py' AND replace(token, '/', '.') = key)
      OR (token LIKE '%.py' AND key IN (replace(regexp_replace(token, '\\.py$', ''), '/', '.'), regexp_extract(token, '([^/]*)\\.py$', 1)))),
    mt AS (SELECT path, list_transform(string_split(regexp_replace(text, '(?s)%\\{{.*?%\\}}', '', 'g'), chr(10)), lambda x: regexp_extract(x, {plain(r"^((?:[^'%]|'[^']*')*(?:'[^']*$)?)")}, 1)) AS r FROM fl WHERE path LIKE '%.m'),
    m AS (SELECT path, array_to_string(r, chr(10)) AS code FROM mt), ms AS (SELECT regexp_extract(path, '([^/]*)\\.m$', 1) AS key, min(path) AS target FROM fl WHERE path LIKE '%.m' GROUP BY 1),
    mr AS (SELECT m.path AS source, target FROM (SELECT path, unnest(regexp_extract_all(code, '[a-zA-Z_]\\w*')) AS key FROM m UNION SELECT path, regexp_replace(regexp_extract(s, '([^/]*)$', 1), '\\.m$', '') FROM (SELECT path, unnest(regexp_extract_all(code, {plain(scripts)}, 1)) AS s FROM m)) AS m JOIN ms USING (key)),
    pr AS (SELECT path, unnest(regexp_extract_all(code, 'pyrun\\s*\\(\\s*[''"]([^''"]+)[''"]', 1)) AS s FROM m), pf AS (SELECT path, unnest(regexp_extract_all(code, 'pyrunfile\\s*\\(\\s*[''"]([^''"]+)[''"]', 1)) AS s FROM m),
    mp AS (SELECT k.path AS source, target FROM (SELECT path, unnest(regexp_extract_all(code, '\\bpy\\.(\\w+)', 1)) AS key FROM m UNION SELECT path, unnest(regexp_extract_all(s, '\\b(?:import|from)\\s+(\\w+)', 1)) FROM pr
      UNION SELECT path, unnest([regexp_extract(regexp_replace(s, '\\.py$', ''), '([^/]*)$', 1), regexp_replace(replace(s, '/', '.'), '\\.py$', '')]) FROM pf) AS k JOIN ix USING (key)),
    rf AS (SELECT DISTINCT source, target FROM (SELECT * FROM im UNION ALL SELECT * FROM lt UNION ALL SELECT * FROM mr UNION ALL SELECT * FROM mp) WHERE source <> target),
    sm AS (SELECT path, text, regexp_extract(path, '([^/]*)\\.(?:py|m)$', 1) AS stem, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '%'))[1] AS first FROM fl WHERE path LIKE '%.py' OR path LIKE '%.m'),
    ep AS (SELECT path, CASE WHEN path LIKE '%.py' THEN stem IN ('__init__', '__main__', 'setup', 'conftest', 'manage', 'wsgi', 'asgi', 'fabfile', 'tasks', 'noxfile', 'SConstruct', 'SConscript') OR starts_with(stem, 'test_') OR starts_with(stem, 'tests_') OR ends_with(stem, '_test')
      ELSE coalesce(NOT starts_with(trim(first), 'function') AND NOT starts_with(trim(first), 'classdef'), true) END AS entry FROM sm),
    dead AS (SELECT path FROM ep WHERE NOT entry AND path NOT IN (SELECT target FROM rf))"""


_COUNTS = " SELECT path, count(DISTINCT source) AS \"references\" FROM sm LEFT JOIN rf ON target = path GROUP BY path"
_DEAD_REPORT = " SELECT (SELECT count(*) FROM ep) AS files, (SELECT count(*) FROM ep WHERE entry) AS entry_points, (SELECT count(*) FROM dead) AS dead, (SELECT '[\"' || string_agg(path, '\",\"' ORDER BY path) || '\"]' FROM dead) AS paths, (SELECT count(*) FROM dead) > 0 AS failed"

_AGE = "CASE WHEN age < 2592000 THEN 'FRESH' WHEN age < 15552000 THEN 'AGING' WHEN age < 31536000 THEN 'STALE' WHEN age IS NOT NULL THEN 'ANCIENT' ELSE 'UNKNOWN' END"
_AGE_TEXT = "CASE WHEN age // 86400 < 1 THEN 'today' WHEN age // 86400 < 30 THEN (age // 86400) || ' day' || CASE WHEN age // 86400 = 1 THEN '' ELSE 's' END || ' ago' WHEN age // 86400 < 360 THEN (age // 2592000) || ' month' || CASE WHEN age // 2592000 = 1 THEN '' ELSE 's' END || ' ago' WHEN age IS NOT NULL THEN (age // 31536000) || ' year' || CASE WHEN age // 31536000 = 1 THEN '' ELSE 's' END || ' ago' END"
_BLAME = f"bl AS (SELECT path, line, author, {corpus.NOW} - ts_epoch AS age FROM {rows_sql(corpus.BLAME, 'path string, line int, author string, ts_epoch long')})"
_TRIPLE = "(length(raw) - length(replace(raw, d, ''))) // 3 = 1"
_STALE = f"""WITH RECURSIVE src AS (SELECT *, trim(raw) AS s FROM {rows_of(corpus.TEXTS)} WHERE ext IN ('.py', '.m')), {_BLAME},
    q AS (SELECT path, ext, line, raw, s, NULL::VARCHAR AS was, CASE WHEN ext <> '.py' THEN NULL WHEN {_TRIPLE.replace("d,", "'" + '"' * 3 + "',")} THEN '{'"' * 3}' WHEN {_TRIPLE.replace("d,", "repeat(chr(39), 3),")} THEN repeat(chr(39), 3) END AS now FROM src WHERE line = 1
      UNION ALL SELECT n.path, n.ext, n.line, n.raw, n.s, q.now, CASE WHEN q.now IS NOT NULL THEN CASE WHEN contains(n.raw, q.now) THEN NULL ELSE q.now END WHEN n.ext <> '.py' THEN NULL
        WHEN {_TRIPLE.replace("d,", "'" + '"' * 3 + "',").replace("raw", "n.raw")} THEN '{'"' * 3}' WHEN {_TRIPLE.replace("d,", "repeat(chr(39), 3),").replace("raw", "n.raw")} THEN repeat(chr(39), 3) END FROM q JOIN src n ON n.path = q.path AND n.line = q.line + 1),
    mk AS (SELECT path, line, upper(regexp_extract(s, {plain(stale.MARKER)}, 1)) AS keyword, trim(regexp_extract(s, {plain(stale.MARKER)}, 2)) AS text FROM q WHERE (was IS NOT NULL OR starts_with(s, CASE ext WHEN '.m' THEN '%' ELSE '#' END)) AND regexp_matches(s, {plain(stale.MARKER)})),
    markers AS (SELECT mk.*, author, age AS age_seconds, {_AGE_TEXT} AS age_text, {_AGE} AS staleness FROM mk LEFT JOIN bl USING (path, line)),
    cm AS (SELECT path, ext, line, raw, s[2:] AS body, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM src WHERE starts_with(s, CASE ext WHEN '.m' THEN '%' ELSE '#' END) AND NOT starts_with(s, CASE ext WHEN '.m' THEN '%%!' ELSE '##!' END)),
    cc AS (SELECT *, trim(body) <> '' AND NOT regexp_matches(body, {plain(stale.MARKER)}) AS counted, CASE ext WHEN '.m' THEN regexp_matches(body, {plain(stale.CODE[".m"])}) ELSE regexp_matches(body, {plain(stale.CODE[".py"])}) END AS code FROM cm),
    rn AS (SELECT path, min(line) AS start_line, max(line) AS end_line, count(*)::INTEGER AS line_count, array_to_string(list(raw ORDER BY line), chr(10)) AS lines FROM cc GROUP BY path, run HAVING count(*) >= 3 AND count(*) FILTER (counted) > 0 AND count(*) FILTER (counted AND code) > 0.5 * count(*) FILTER (counted)),
    blocks0 AS (SELECT rn.*, (SELECT max(age) FROM bl WHERE bl.path = rn.path AND bl.line BETWEEN start_line AND end_line) AS age FROM rn),
    blocks AS (SELECT path, start_line, end_line, line_count, lines, (SELECT author FROM bl WHERE bl.path = b.path AND bl.line BETWEEN start_line AND end_line AND bl.age = b.age) AS author, age AS age_seconds, {_AGE_TEXT} AS age_text, {_AGE} AS staleness FROM blocks0 b)"""
_AGES = " SELECT n.staleness, count(x.staleness) AS n FROM (VALUES ('FRESH'), ('AGING'), ('STALE'), ('ANCIENT'), ('UNKNOWN')) AS n(staleness) LEFT JOIN (SELECT staleness FROM markers UNION ALL SELECT staleness FROM blocks) x ON x.staleness = n.staleness GROUP BY n.staleness"

_RULES = ", ".join(f"({sql_value(s)}, {sql_value(label)}, {plain(p)}, {only})" for rules, only in ((secrets.RULES, "false"), (secrets.MATLAB_RULES, "true")) for label, s, p in rules)
_SECRETS = f"""WITH src AS {rows_of(corpus.TEXTS)}, r(severity, label, pat, m) AS (VALUES {_RULES}),
    lits AS (SELECT row_number() OVER () AS id, path, line, raw, substr(v, 2, length(v) - 2) AS value FROM (SELECT path, line, raw, unnest(regexp_extract_all(raw, '''[^''\\n]{{12,}}''|"[^"\\n]{{12,}}"')) AS v FROM src)),
    ch AS (SELECT id, ch, count(*)::DOUBLE AS k FROM (SELECT id, unnest(string_split(value, '')) AS ch FROM lits) GROUP BY ALL),
    en AS (SELECT id, -sum(k / n * log2(k / n)) AS entropy FROM ch JOIN (SELECT id, sum(k) AS n FROM ch GROUP BY id) USING (id) GROUP BY id),
    found AS (SELECT path, line, severity, label, regexp_extract(raw, pat) AS matched_text FROM src, r WHERE (NOT m OR ext = '.m') AND regexp_matches(raw, pat)
      UNION ALL SELECT path, line, 'MEDIUM', 'High-entropy string near ''' || regexp_extract(raw, {plain(secrets.CONTEXT)}) || '''', value FROM lits JOIN en USING (id) WHERE entropy > 4.5 AND regexp_matches(raw, {plain(secrets.CONTEXT)})
        AND NOT ({" OR ".join(f"regexp_matches(value, {plain(p)})" for p in secrets.HARMLESS)})),
    shown AS (SELECT *, CASE WHEN length(matched_text) > 8 THEN matched_text[:8] || '...' ELSE matched_text END AS truncated FROM found)"""

# Duplicates: a token is blanked unless it is kept, in place of the look-ahead that RE2 lacks.
_DOUBLE, _SINGLE = r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'"


def _kept(names) -> str:
    return "[" + ", ".join(map(sql_value, sorted({*names, "_STR_", "_VAR_"}))) + "]"


def _normal(line: str, kept: str) -> str:
    for number in (r"\b\d+\.\d+(?:[eE][+-]?\d+)?\b", r"\b0[xXoObB][\da-fA-F_]+\b", r"\b\d+\b"):
        line = f"regexp_replace({line}, {sql_value(number)}, '_VAR_', 'g')"
    line = f"trim(regexp_replace({line}, '\\s+', ' ', 'g'))"
    return f"array_to_string(list_transform(regexp_extract_all({line}, '[A-Za-z_]\\w*|[^A-Za-z_]+'), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_]') AND NOT list_contains({kept}, x) THEN '_VAR_' ELSE x END), '')"


def _literals(line: str, comment: str) -> str:
    line = f"regexp_replace({line}, {sql_value(comment)}, '\\1')"
    for literal in (_DOUBLE, _SINGLE):
        line = f"regexp_replace({line}, {sql_value(literal)}, '\"_STR_\"', 'g')"
    return line


_DUP = f"""WITH RECURSIVE nl AS (SELECT path, line, CASE ext WHEN '.py' THEN {_normal(_literals("raw", f"^((?:{_DOUBLE}|{_SINGLE}|[^#\"'])*)#.*$"), _kept([*duplicates.PYTHON_KEPT, *dir(dict)]))}
      WHEN '.m' THEN {_normal(_literals("raw", "^((?:'[^']*'|[^%'])*)%.*$"), _kept(duplicates.MATLAB_KEPT))} ELSE {_normal("raw", _kept([]))} END AS text FROM {rows_of(corpus.TEXTS)}),
    w AS (SELECT path, line AS s, lead(line, 4) OVER o AS e, md5(concat_ws(chr(10), text, lead(text, 1) OVER o, lead(text, 2) OVER o, lead(text, 3) OVER o, lead(text, 4) OVER o)) AS digest FROM nl WHERE text <> '' WINDOW o AS (PARTITION BY path ORDER BY line)),
    b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s) AS i FROM w WHERE e IS NOT NULL AND digest IN (SELECT digest FROM w WHERE e IS NOT NULL GROUP BY digest HAVING count(DISTINCT path) >= 2)),
    p AS (SELECT x.path AS f1, x.s AS s1, x.e AS e1, x.i AS i1, y.path AS f2, y.s AS s2, y.e AS e2, y.i AS i2 FROM b x JOIN b y USING (digest) WHERE (x.path < y.path OR x.path = y.path AND x.s < y.s) AND NOT (x.path = y.path AND x.e >= y.s)),
    k AS (SELECT *, i1 - row_number() OVER (PARTITION BY f1, f2, i2 - i1 ORDER BY i1) AS island FROM p),
    g AS (SELECT f1, f2, min(s1) AS s1, max(e1) AS e1, min(s2) AS s2, max(e2) AS e2 FROM k GROUP BY f1, f2, i2 - i1, island),
    u AS (SELECT * FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.f1 = x.f1 AND y.f2 = x.f2 AND (y.e1 - y.s1 + y.e2 - y.s2) > (x.e1 - x.s1 + x.e2 - x.s2) AND (y.s1 <= x.s1 AND x.e1 <= y.e1 AND y.s2 <= x.s2 AND x.e2 <= y.e2 OR x.f1 = x.f2 AND y.s2 <= x.s1 AND x.e1 <= y.e2 AND y.s1 <= x.s2 AND x.e2 <= y.e1))),
    l AS (SELECT [f1, s1::VARCHAR, e1::VARCHAR] AS a, [f2, s2::VARCHAR, e2::VARCHAR] AS b FROM u UNION SELECT [f2, s2::VARCHAR, e2::VARCHAR], [f1, s1::VARCHAR, e1::VARCHAR] FROM u),
    r AS (SELECT a AS v, a AS c FROM l UNION SELECT v, b FROM r JOIN l ON a = c), m AS (SELECT v, min(c) AS c FROM r GROUP BY v),
    z AS (SELECT c, v[1] AS path, v[2]::INTEGER AS s, v[3]::INTEGER AS e FROM m)
    SELECT max(e - s + 1)::INTEGER AS line_count, count(*) AS copy_count, (max(e - s + 1) * (count(*) - 1))::BIGINT AS total_duplicate_lines, string_agg(path || ':' || s || '-' || e, ' ' ORDER BY path, s) AS regions FROM z GROUP BY c HAVING count(*) >= 2"""

# MATLAB: functions and their measures, try blocks, statements.
_BEFORE = r"""^((?:[^'"%]|'[^']*'|"[^"]*")*(?:'[^']*$|"[^"]*$)?)"""
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, {plain(p)}))"
_M = f"""WITH RECURSIVE src AS (SELECT * FROM {rows_of(corpus.MATLAB)} WHERE ext = '.m'),
    ml AS (SELECT path, line, raw, regexp_replace(regexp_replace(regexp_extract(raw, {sql_value(_BEFORE)}, 1), '''[^'']*''', '''''', 'g'), '"[^"]*"', '""', 'g') AS code FROM src),
    mc AS (SELECT *, regexp_extract(code, {plain(matlab.HEADER)}, 1) AS name, {_COUNT("code", matlab.OPENER)} AS opened, {_COUNT("code", matlab.END)} AS closed FROM ml),
    hd AS (SELECT path, name, line, lead(line) OVER (PARTITION BY path ORDER BY line) AS next FROM mc WHERE name <> ''),
    -- One walk a function, line by line, as a reader would count.
    wk AS (SELECT path, line AS head, line AS pos, 1 AS depth, NULL::BIGINT AS last FROM hd UNION ALL
      SELECT w.path, w.head, c.line, w.depth + c.opened + (c.name <> '')::INT - c.closed, CASE WHEN c.name <> '' AND w.depth = 1 THEN c.line - 1 WHEN w.depth + c.opened + (c.name <> '')::INT - c.closed <= 0 THEN c.line END
      FROM wk w JOIN mc c ON c.path = w.path AND c.line = w.pos + 1 WHERE w.last IS NULL),
    sp AS (SELECT hd.path, name, line, coalesce((SELECT last FROM wk WHERE wk.path = hd.path AND head = line AND last IS NOT NULL), next - 1, (SELECT max(line) FROM mc WHERE mc.path = hd.path)) AS last FROM hd),
    fb AS (SELECT sp.path, sp.line AS head, last, c.line AS pos, {_COUNT("c.code", matlab.DECISION)} AS decisions, c.opened, c.closed, NOT regexp_matches(c.raw, '^\\s*(%|$)') AS counts FROM sp JOIN mc c ON c.path = sp.path AND c.line > sp.line AND c.line <= last),
    dp AS (SELECT path, line AS head, line AS pos, 0 AS depth, 0 AS deepest FROM sp UNION ALL
      SELECT f.path, f.head, f.pos, greatest(0, d.depth + f.opened - f.closed), greatest(d.deepest, CASE WHEN f.opened > 0 THEN d.depth + f.opened ELSE 0 END) FROM dp d JOIN fb f ON f.path = d.path AND f.head = d.head AND f.pos = d.pos + 1),
    fn0 AS (SELECT name, sp.path, line, (1 + coalesce((SELECT sum(decisions) FROM fb WHERE fb.path = sp.path AND head = line), 0))::INTEGER AS complexity, (SELECT max(deepest) FROM dp WHERE dp.path = sp.path AND head = line)::INTEGER AS max_depth,
      coalesce((SELECT count(*) FILTER (counts) FROM fb WHERE fb.path = sp.path AND head = line), 0)::INTEGER AS length FROM sp),
    mfn AS (SELECT *, complexity * greatest(max_depth, 1) + length / 10.0::DOUBLE AS score, {_RISK} FROM fn0)"""
_UNGUARDED = " UNION ALL ".join(f"SELECT path, line, {sql_value(severity)}, replace({sql_value(title)}, '$', regexp_extract(raw, {plain(p)}, 1)) FROM fr WHERE regexp_matches(raw, {plain(p)})" for p, severity, title in matlab.UNGUARDED)
_M_ISSUES = f"""WITH RECURSIVE src AS (SELECT * FROM {rows_of(corpus.MATLAB)} WHERE ext = '.m' AND NOT regexp_matches(path, '(^|/)(test_|Test)[^/]*$|(^|/)tests?/')),
    kd AS (SELECT path, line, raw, CASE WHEN regexp_matches(raw, '^\\s*(try|for|while|if|switch|parfor)\\b') THEN 'open' WHEN regexp_matches(raw, '^\\s*end\\b') THEN 'close' WHEN regexp_matches(raw, '^\\s*catch\\b') THEN 'catch' ELSE 'line' END AS kind FROM src),
    -- One walk a try, until its own end.
    wk AS (SELECT path, line AS try_line, line AS pos, 1 AS depth, 'try' AS kind, raw FROM kd WHERE regexp_matches(raw, '^\\s*try\\s*(%.*)?$') UNION ALL
      SELECT w.path, w.try_line, k.line, w.depth + CASE k.kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END, k.kind, k.raw FROM wk w JOIN kd k ON k.path = w.path AND k.line = w.pos + 1 WHERE w.depth > 0),
    ct AS (SELECT path, try_line, min(pos) AS first, max(pos) AS catch_line, nullif(regexp_extract(arg_max(raw, pos), '^\\s*catch\\s+(\\w+)', 1), '') AS ident FROM wk WHERE kind = 'catch' AND depth = 1 GROUP BY ALL),
    bk AS (SELECT ct.*, (SELECT pos FROM wk WHERE wk.path = ct.path AND wk.try_line = ct.try_line AND depth = 0) AS end_line,
      coalesce((SELECT list(raw) FROM wk WHERE wk.path = ct.path AND wk.try_line = ct.try_line AND kind = 'line' AND depth = 1 AND pos > first), []) AS body FROM ct),
    fr AS (SELECT * FROM src s WHERE NOT regexp_matches(raw, '^\\s*%') AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.path = s.path AND s.line BETWEEN try_line AND coalesce(end_line, 999999))),
    fo AS (SELECT *, regexp_extract(raw, '(\\w+)\\s*=\\s*fopen\\s*\\(', 1) AS v FROM fr),
    iss AS (SELECT path, catch_line AS line, 'MEDIUM' AS severity, 'Empty catch block' AS title FROM bk WHERE len(list_filter(body, lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\\s*%'))) = 0
      UNION ALL SELECT path, catch_line, 'LOW', 'Catch without identifier' FROM bk WHERE ident IS NULL
      UNION ALL SELECT path, catch_line, 'MEDIUM', 'Catch-and-ignore' FROM bk WHERE ident IS NOT NULL AND NOT contains(array_to_string(list_transform(body, lambda x: regexp_replace(x, '%.*$', '')), chr(10)), ident)
      UNION ALL SELECT path, line, 'HIGH', 'Unchecked fopen' FROM fo WHERE v <> '' AND NOT EXISTS (SELECT 1 FROM src s WHERE s.path = fo.path AND s.line > fo.line AND s.line <= fo.line + 4
        AND (regexp_matches(s.raw, 'if\\s+.*\\b' || v || '\\s*(==\\s*-1|<\\s*0|~=\\s*-1)') OR regexp_matches(s.raw, 'assert\\s*\\(\\s*' || v)))
      UNION ALL {_UNGUARDED})"""

SQL = {
    "function_complexity_corpus": _FUNCTIONS + " SELECT * FROM fn",
    "complexity_histogram_corpus": _FUNCTIONS + _HISTOGRAM,
    "complexity_summary_corpus": _FUNCTIONS + _SUMMARY,
    "function_ranking_corpus": _FUNCTIONS + " SELECT * FROM fn WHERE complexity >= 2 ORDER BY score DESC, path, line, name LIMIT 5",
    "error_audit_corpus": _ISSUES + _ISSUES_OUT,
    "error_severities_corpus": _ISSUES + _SEVERITIES,
    "dependency_edges_corpus": _EDGES + " SELECT * FROM e",
    "dependency_tree_corpus": _TREE + " SELECT root, len(path) - 1 AS depth, array_to_string(path, ' > ') AS path, is_cycle FROM tr",
    "dead_files_corpus": _references(corpus.TEXTS) + " SELECT path FROM dead",
    "reference_counts_corpus": _references(corpus.TEXTS) + _COUNTS,
    "dead_files_matlab": _references(corpus.MATLAB) + " SELECT path FROM dead",
    "references_matlab": _references(corpus.MATLAB) + " SELECT * FROM rf",
    "dead_report_matlab": _references(corpus.MATLAB) + _DEAD_REPORT,
    "markers_corpus": _STALE + " SELECT * FROM markers",
    "commented_code_corpus": _STALE + " SELECT * FROM blocks",
    "comment_ages_corpus": _STALE + _AGES,
    "secret_scan_corpus": _SECRETS + " SELECT path, line, severity, label, truncated FROM shown",
    "secret_severities_corpus": _SECRETS + " SELECT severity, count(*) AS n FROM shown GROUP BY severity",
    "secret_gate_corpus": _SECRETS + " SELECT coalesce(bool_or(severity IN ('HIGH', 'CRITICAL')), false) AS blocked FROM shown",
    "dup_regions_corpus": _DUP,
    "matlab_spans": _M + " SELECT path, name, line, last::INTEGER AS last FROM sp",
    "matlab_functions": _M + " SELECT * FROM mfn",
    "matlab_issues": _M_ISSUES + " SELECT * FROM iss",
}

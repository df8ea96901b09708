"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force.

Learned models (1, 2, 5, 7), raking to convergence (6), tokenisers (9), hashes that DuckDB
lacks (3) and broken markup (4) have none.
"""

from __future__ import annotations

from stratalens.llm.secrets import RULES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets() -> str:
    rules = ", ".join(f"({k}, {_text(r.kind)}, {_text(r.pattern)}, {r.least}, {str(r.base).lower()})" for k, r in enumerate(RULES))
    # A pattern has to be a constant: one branch a rule.
    found = " UNION ALL ".join(
        f"SELECT id, {k} AS ord, regexp_extract_all(text, {_text(r.pattern)}) AS hits, regexp_extract_all(text, {_text(r.pattern)}, {r.group}) AS held, regexp_split_to_array(text, {_text(r.pattern)}) AS gaps FROM d"
        for k, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = {_text(r.kind)}) AS n_{r.kind}" for r in RULES if r.base)
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    r AS (SELECT * FROM (VALUES {rules}) AS t(ord, kind, pattern, least, base)), m AS ({found}),
    e AS (SELECT id, ord, unnest(hits) AS hit, unnest(held) AS held, unnest(range(1, len(hits) + 1)) AS k, hits, gaps FROM m),
    s AS (SELECT id, ord, held, length(hit) AS n, coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS pos FROM e),
    f AS (SELECT id, kind, base, ord, pos, kind || ':' || pos::BIGINT || ':' || (pos + n)::BIGINT AS span FROM s JOIN r USING (ord) WHERE length(held) >= least),
    g AS (SELECT id, {counts}, string_agg(span, ',' ORDER BY pos, ord) FILTER (base) AS base_spans, string_agg(span, ',' ORDER BY pos, ord) AS spans FROM f GROUP BY id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN g USING (id)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    t AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) > 1 THEN list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]) ELSE words END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

ORACLES: dict[str, str] = {"op8_secret_ledger": _secrets(), "op10_near_duplicates": _NEAR}

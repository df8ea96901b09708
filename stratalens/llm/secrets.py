"""Operator 8: secret scans over an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by its SHA-256.  The ledger lists the
(blob, rule version) pairs that were scanned; a run scans only blobs without an entry
for the current rules, once each however many paths hold them, and joins the findings
back to all paths by the address.  A rule is ``regexp_extract_all`` for the matches and
``split`` for what lies between them: both walk the same leftmost non-overlapping
matches, so cumulated lengths give spans in code points.

Rules: ``assign``, ``access`` and ``hex`` (base), and added ones: ``pem`` private key
headers, ``jwt``, ``forge`` (prefixed platform tokens).  Nulls: a null text counts as
empty; a null id keeps its row and spans.  Repeated rows return repeatedly.  Very long
texts are scanned whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.base import read


@dataclass(frozen=True)
class Rule:
    """pattern: walked leftmost first; group: what must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: In the order in which spans of the same start are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"(?:gh[pousr]_|glpat-|xox[abprs]-)[A-Za-z0-9_-]{16,}"),
)


#: Parts that the paths of one blob are dealt over.
SALTS = 32


def rule_version(rules=RULES) -> str:
    """Names a rule set by its content."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blobs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, blob) of every row, whole texts."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))


def _found(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,ord,kind,end>> of one rule's matches that hold."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), held.alias("held"))
    kind = "struct<at:int,out:array<struct<start:int,ord:int,kind:string,end:int>>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        out = F.when(F.length(x["2"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out")).cast(kind)

    # Positional field names keep the struct independent of the function's naming of its inputs.
    zipped = zipped.cast("array<struct<`0`:string,`1`:string,`2`:string>>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>").alias("out")).cast(kind)
    found = F.aggregate(zipped, start, step)["out"]
    return F.when(text.rlike(rule.pattern), found).otherwise(start["out"])


def scan(texts: DataFrame, rules=RULES, text_column: str = "text") -> DataFrame:
    """Adds ``found``: array<struct<start,ord,kind,end>> by start, then rule order."""
    parts = [_found(F.col(text_column), rule, k) for k, rule in enumerate(rules)]
    return texts.withColumn("found", F.array_sort(F.concat(*parts)))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Ledger rows (blob, rules, found) for blobs without an entry for these rules.

    docs: (doc_id, text, blob).  One copy of each blob is kept by a partial aggregation
    before the shuffle, so a text that fills a third of the rows reaches a task once per
    mapper.
    """
    version = rule_version(rules)
    todo = docs.select("blob", "text")
    if ledger is not None:
        seen = ledger.where(F.col("rules") == version).select("blob").distinct()
        todo = todo.join(seen, "blob", "left_anti")
    once = todo.groupBy("blob").agg(F.first("text").alias("text"))
    return scan(once, rules).select("blob", F.lit(version).alias("rules"), "found")


def scan_history(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger's new rows): old entries serve for seen blobs."""
    version = rule_version(rules)
    fresh = scan_unseen(docs, ledger, rules)
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rules") == version).dropDuplicates(["blob"]))
    # Few blobs have findings, but one of them may have a third of all paths: findings are
    # repeated for each salt, and a blob's paths are dealt over the salts.
    hits = known.where(F.size("found") > 0).select("blob", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    salt = F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(SALTS)).cast("int")
    paths = docs.select("doc_id", "blob").withColumn("salt", salt).join(hits, ["blob", "salt"], "left").drop("salt").withColumn("found", F.coalesce("found", empty))
    return paths, fresh


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against the current rules and an empty ledger."""
    paths, _ = scan_history(blobs(read(spark, sf_dir, "documents")))
    n_base = sum(r.base for r in RULES)
    base = F.filter("found", lambda x: x["ord"] < n_base)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.select("doc_id", *(count(r.kind) for r in RULES if r.base), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "blob")

"""Operator 6: mixing sources to target weights by iterative proportional fitting.

Tokens (words) of all documents are added up into cells of source, language and topic.
Raking multiplies the cells, one margin after the other, until the margins of all three
meet their targets; a document's sampling probability is proportional to its cell's
fitted over its observed tokens, scaled so that the expected tokens are ``fraction`` of
all.  No probability may pass 1, so a cell counts with its own tokens at most in every
step (raking with bounds), and the fraction is lowered to the largest that still meets
the targets within ``NEAR`` of all tokens; a group too small to matter there is taken whole.  Targets that contradict each other (a topic that is one source, say) can't
all be met: then the later margin holds, the source last, and the fraction is the largest
that comes as near.  A document is drawn by a hash of its id against its probability:
repeatable, without order or state.  ``report`` shows target, expected and drawn shares.

Targets are tables (group, share) of a margin where given; without one the observed
shares tempered by ``source_power``, ``lang_power`` and ``topic_power``: below 1 they raise
small groups.  Every source and language is a margin group of its own.  Given shares count
in proportion, over the groups that have tokens; a group the table lacks gets none.
Topics are clusters of hashed, idf-weighted words (spherical k-means over all documents,
texts of equal word shares and language as one), numbered from 0; the mean of a text's
language is taken off first, so that topics are not languages under another name.  Sums
are of whole numbers, so the order of rows and partitions changes nothing; the driver
holds the sums only, 4 KB for each language and topic.  Up to ``here`` cells are raked on the driver, more by the same
steps as joins and aggregates over the table of cells, each round staged.

Nulls: a null source or language is a group of its own; a null text has no tokens and
the last topic; documents without tokens get the probability of their cell.  Null ids
share one draw, repeated ids too.  An empty table gives no rows.
Columns named as the added ones are replaced by them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import textnum
from stratalens.llm.base import as_bytes, drop, read, stage, tune

BITS = 9
NONE = "\x00null"


def word_counts(raw: bytes | None) -> np.ndarray:
    """Numbers of hashed words."""
    h = textnum.word_hashes(raw.lower()) if raw else np.zeros(0, np.uint64)
    return np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)


def word_vector(raw: bytes | None) -> tuple[np.ndarray, int]:
    """(square roots of hashed word shares, number of words)."""
    counts = word_counts(raw)
    return textnum.unit_sqrt(counts), int(counts.sum())


#: One in the sums of vectors, which are of whole numbers.
ONE = 1 << 24


class Topics:
    """What a text's words tell beyond its language: vectors less the mean of their language's rows, and their centres."""

    def __init__(self, idf: np.ndarray, means: dict, centres: np.ndarray):
        self.idf, self.means, self.centres = idf, means, centres

    @staticmethod
    def _unit(y: np.ndarray) -> np.ndarray:
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def weighted(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x * self.idf)

    def scaled(self, x: np.ndarray, langs: list) -> np.ndarray:
        zero = np.zeros(1 << BITS, np.float32)
        names = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        table = np.array([self.means.get(lang, zero) for lang in names], np.float32).reshape(-1, 1 << BITS)
        less = table[[names[lang] for lang in langs]] if langs else table
        return self._unit(self.weighted(x) - less)

    def nearest(self, y: np.ndarray) -> np.ndarray:
        return np.einsum("ij,kj->ik", y, self.centres).argmax(1)  # a row's sums don't depend on its batch, as those of @ do

    def of(self, x: np.ndarray, langs: list) -> np.ndarray:
        return np.where(x.any(1), self.nearest(self.scaled(x, langs)), len(self.centres) - 1)


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of packed word counts."""
    counts = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, 1 << BITS)
    return np.sqrt(counts / counts.sum(1, keepdims=True, dtype=np.int64), dtype=np.float32)


def summed(rows: DataFrame, part) -> dict[str, np.ndarray]:
    """Sums by key over all rows (lang, x); part(langs, vectors) gives (key, whole numbers, of one length) pairs."""

    def work(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, v in part(batch.column(0).to_pylist(), unpacked(batch.column(1))):
                held[key] = held[key] + v if key in held else v
            if len(held) > 256:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["key", "v"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["key", "v"])

    parts = rows.mapInArrow(work, "key string, v array<long>").groupBy("key").agg(F.collect_list("v").alias("v"))
    both = F.aggregate(F.slice("v", 2, F.size("v")), F.col("v")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    got = parts.select("key", both.alias("v")).toArrow()
    return {key.as_py(): np.array(v.values) for key, v in zip(got["key"], got["v"], strict=True)}


def learned_topics(docs: DataFrame, n: int, turns: int = 20) -> Topics:
    """Spherical k-means of all docs (text, lang), by passes over their staged vectors; it starts at the n rows of least hash."""

    def packed(batches):
        for batch in batches:
            counts = [word_counts(raw) for raw in as_bytes(batch.column(0))]
            some = [c.any() for c in counts]
            # Of equal shares, equal bytes.
            x = [(c // np.gcd.reduce(c)).astype(np.uint32).tobytes() for c, ok in zip(counts, some, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(some, pa.bool_())), pa.array(x, pa.binary())], ["lang", "x"])

    def by(keys: list, y: np.ndarray):
        """Sums of the rows of each key, and their number."""
        names = {key: k for k, key in enumerate(dict.fromkeys(keys))}
        own = np.zeros((len(names), len(y)))
        own[[names[key] for key in keys], np.arange(len(y))] = 1
        sums = own @ np.rint(y.astype(np.float64) * ONE)  # exact: whole numbers below 2**53
        return [(key, np.append(sums[k], own[k].sum()).astype(np.int64)) for key, k in names.items()]

    rows = stage(docs.select("text", F.coalesce(F.col("lang"), F.lit(NONE)).alias("lang")).mapInArrow(packed, "lang string, x binary").distinct(), "mix-vectors")
    has = summed(rows, lambda langs, x: [("", np.append((x > 0).sum(0), len(x)))]).get("", np.zeros((1 << BITS) + 1, np.int64))
    model = Topics((np.log((1 + has[-1]) / (1 + has[:-1])) + 0.1).astype(np.float32), {}, np.zeros((1, 1 << BITS), np.float32))
    model.means = {lang: (v[:-1] / ONE / v[-1]).astype(np.float32) for lang, v in summed(rows, lambda langs, x: by(langs, model.weighted(x))).items()}
    first = rows.orderBy(F.xxhash64(F.lit("centre"), "lang", "x"), "lang", "x").limit(n).toArrow()
    if first.num_rows:
        model.centres = model.scaled(unpacked(first["x"]), first["lang"].to_pylist())

    def nearest(langs, x):
        y = model.scaled(x, langs)
        return by([str(k) for k in model.nearest(y)], y)

    for _ in range(turns):
        after = model.centres.copy()
        for k, v in summed(rows, nearest).items():
            after[int(k)] = Topics._unit(v[None, :-1] / ONE)[0]
        same, model.centres = np.array_equal(after, model.centres), after
        if same:
            break
    drop(rows)
    return model


def rake(cells: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray], cap: np.ndarray | float = np.inf, rounds: int = 300, close: float = 1e-9) -> tuple[np.ndarray, float]:
    """(fitted cells, farthest share from its target): margins[m][c] is the group of cell c in margin m, targets[m] the shares.

    No cell counts for more than ``cap``.
    """
    free = cells / max(cells.sum(), 1e-300)
    if not len(cells):
        return free, 0.0
    gap = np.inf
    for _ in range(rounds):
        for group, target in zip(margins, targets, strict=True):
            have = np.bincount(group, np.minimum(free, cap), minlength=len(target))
            free = np.minimum(free * np.divide(target, have, out=np.zeros_like(have), where=have > 0)[group], 1e12)
        fitted = np.minimum(free, cap)
        gap, before = max(float(np.abs(np.bincount(g, fitted, minlength=len(t)) - t).max(initial=0)) for g, t in zip(margins, targets, strict=True)), gap
        if gap < close or abs(before - gap) < close:
            break
    return fitted, gap


#: How far, in share, a margin may be from its target at the fraction that is taken.
NEAR = 5e-4


def largest(fraction: float, gap_at, best: float, steps: int) -> float:
    """The largest fraction up to the wanted one whose gap is that of the unbounded fit, by bisection."""
    if gap_at(fraction) <= best + NEAR:
        return fraction
    low, high = 0.0, fraction
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if gap_at(middle) <= best + NEAR else (low, middle)
    return low


def tempered(share: np.ndarray, power: float) -> np.ndarray:
    out = np.where(share > 0, share, 0) ** power * (share > 0)
    return out / max(out.sum(), 1e-300)


#: In the order of raking: of targets that contradict each other the last holds.
MARGINS = ("topic", "lang", "source")


def goals(cells: DataFrame, powers: dict[str, float], given: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    """For each margin (its group, target): shares that add up to 1 over the groups with tokens."""
    out = {}
    for name in MARGINS:
        have = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("tokens"))
        if given.get(name) is None:
            total = have.agg(F.sum("tokens").alias("whole"))
            raw = have.crossJoin(F.broadcast(total)).select(name, F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("whole"), F.lit(powers[name]))).otherwise(0.0).alias("raw"))
        else:
            group, share = given[name].columns[:2]
            own = F.col(group).cast("int") if name == "topic" else F.coalesce(F.col(group).cast("string"), F.lit(NONE))
            table = given[name].groupBy(own.alias(name)).agg(F.sum(F.greatest(F.col(share).cast("double"), F.lit(0.0))).alias("share"))
            raw = have.join(table, name, "left").select(name, F.when(F.col("tokens") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("raw"))
        raw = stage(raw, f"mix-{name}")
        whole = raw.agg(F.sum("raw")).first()[0] or 1.0
        out[name] = raw.select(name, (F.col("raw") / whole).alias("target"))
    return out


def fit_here(cells: DataFrame, goal: dict[str, DataFrame], fraction: float) -> DataFrame:
    """(source, lang, topic, mix_weight, mix_probability) of every cell, raked on the driver."""
    table = sorted(cells.collect(), key=lambda r: (r["source"], r["lang"], r["topic"]))
    observed = np.array([r["tokens"] for r in table], float)
    margins, targets = [], []
    for name in MARGINS:
        rows = sorted((r[name], r["target"]) for r in goal[name].collect())
        at = {group: k for k, (group, _) in enumerate(rows)}
        margins.append(np.array([at[r[name]] for r in table], int))
        targets.append(np.array([t for _, t in rows], float))
    _, best = rake(observed, margins, targets)
    cap = lambda f: observed / max(f * observed.sum(), 1e-300)
    got = largest(fraction, lambda f: rake(observed, margins, targets, cap(f))[1], best, 12) if observed.sum() else fraction
    fitted, _ = rake(observed, margins, targets, cap(got) if got else np.inf)
    weights = np.divide(fitted * observed.sum(), observed, out=np.ones_like(fitted), where=observed > 0)
    chances = np.where(observed > 0, np.clip(weights * got, 0, 1), got)
    rows = [(r["source"], r["lang"], r["topic"], float(w), float(p)) for r, w, p in zip(table, weights, chances, strict=True)]
    return cells.sparkSession.createDataFrame(rows, "source string, lang string, topic int, mix_weight double, mix_probability double")


def raked_table(cells: DataFrame, goal: dict[str, DataFrame], total: float, fraction: float | None, rounds: int = 300, close: float = 1e-9) -> tuple[DataFrame, float]:
    """As ``rake``, by joins and aggregates: cells with ``fitted``, and the gap; only sums come to the driver."""
    cap = F.col("tokens") / F.lit(max((fraction or 0.0) * total, 1e-300)) if fraction else F.lit(float("inf"))
    held = stage(cells.withColumn("free", F.col("tokens") / F.lit(max(total, 1e-300))), "mix-raked")
    fitted, gap = F.least("free", cap), float("inf")
    for _ in range(rounds):
        for name in MARGINS:
            have = held.groupBy(name).agg(F.sum(fitted).alias("have")).join(goal[name], name)
            step = have.select(name, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0).alias("factor"))
            after = stage(held.join(step, name).select(*MARGINS, "tokens", F.least(F.col("free") * F.col("factor"), F.lit(1e12)).alias("free")), "mix-raked")
            drop(held)
            held = after
        before, gap = gap, 0.0
        for name in MARGINS:
            off = held.groupBy(name).agg(F.sum(fitted).alias("have")).join(goal[name], name).agg(F.max(F.abs(F.col("have") - F.col("target")))).first()[0]
            gap = max(gap, off or 0.0)
        if gap < close or abs(before - gap) < close:
            break
    return held.select(*MARGINS, "tokens", fitted.alias("fitted")), gap


def fit_table(cells: DataFrame, goal: dict[str, DataFrame], fraction: float, steps: int = 6) -> DataFrame:
    """As ``fit_here``, over tables."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    _, best = raked_table(cells, goal, total, None)
    got = largest(fraction, lambda f: raked_table(cells, goal, total, f)[1], best, steps) if total else fraction
    fitted, _ = raked_table(cells, goal, total, got)
    weight = F.when(F.col("tokens") > 0, F.col("fitted") * total / F.col("tokens")).otherwise(1.0)
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), weight * got)).otherwise(got)
    return fitted.select(*MARGINS, weight.alias("mix_weight"), chance.alias("mix_probability"))


def report(mixed: DataFrame, **how) -> DataFrame:
    """(margin, name, observed, target, expected, drawn): shares of tokens, of the output of ``mix`` called with the same targets."""
    known = lambda name: F.coalesce(F.col(name), F.lit(NONE))
    sums = [F.sum("mix_tokens").alias("tokens"), F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("expected"), F.sum(F.when(F.col("mix_kept"), F.col("mix_tokens")).otherwise(0)).alias("drawn")]
    cells = stage(mixed.groupBy(known("source").alias("source"), known("lang").alias("lang"), F.col("mix_topic").alias("topic")).agg(*sums), "mix-report")
    goal, whole, out = wanted(cells, **how), cells.agg(*(F.sum(c) for c in ("tokens", "expected", "drawn"))).first(), None
    share = lambda c, n: (F.sum(c) / F.lit(float(n or 1))).alias({"tokens": "observed"}.get(c, c))
    for name in MARGINS:
        each = cells.groupBy(name).agg(*(share(c, n) for c, n in zip(("tokens", "expected", "drawn"), whole, strict=True))).join(goal[name], name)
        rows = each.select(F.lit(name).alias("margin"), F.col(name).cast("string").alias("name"), "observed", "target", "expected", "drawn")
        out = rows if out is None else out.unionByName(rows)
    return out


def wanted(cells: DataFrame, source_power: float = 0.8, lang_power: float = 0.8, topic_power: float = 0.8, source_target: DataFrame | None = None, lang_target: DataFrame | None = None, topic_target: DataFrame | None = None) -> dict[str, DataFrame]:
    return goals(cells, {"source": source_power, "lang": lang_power, "topic": topic_power}, {"source": source_target, "lang": lang_target, "topic": topic_target})


def mix(docs: DataFrame, fraction: float = 0.8, topics: int = 8, here: int = 100_000, **how) -> DataFrame:
    """All columns of docs (doc_id, text, lang, source, ..), and mix_topic, mix_tokens, mix_weight, mix_probability, mix_kept.

    how: powers and targets, see ``wanted``.
    """
    tune(docs.sparkSession)

    docs = docs.drop("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_kept")
    model = learned_topics(docs, topics)

    def label(batches):
        for batch in batches:
            found = [word_vector(raw) for raw in as_bytes(batch.column(batch.schema.get_field_index("text")))]
            langs = [NONE if v is None else v for v in batch.column(batch.schema.get_field_index("lang")).to_pylist()]
            own = model.of(np.stack([x for x, _ in found]), langs) if found else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([k for _, k in found], pa.int64())], [*batch.schema.names, "mix_topic", "mix_tokens"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    narrow = docs.select("text", "source", "lang").mapInArrow(label, "text string, source string, lang string, mix_topic int, mix_tokens long")
    known = lambda name: F.coalesce(F.col(name), F.lit(NONE))
    cells = stage(narrow.groupBy(known("source").alias("source"), known("lang").alias("lang"), F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens")), "mix-cells")
    goal = wanted(cells, **how)
    found = (fit_here if cells.count() <= here else fit_table)(cells, goal, fraction)
    found = found.select(F.col("source").alias("mix_source"), F.col("lang").alias("mix_lang"), F.col("topic").alias("mix_topic"), "mix_weight", "mix_probability")

    labelled = docs.mapInArrow(label, f"{kinds}, mix_topic int, mix_tokens long").withColumn("mix_source", known("source")).withColumn("mix_lang", known("lang"))
    drawn = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 53)) / float(1 << 53) < F.col("mix_probability")
    out = labelled.join(found, ["mix_source", "mix_lang", "mix_topic"]).withColumn("mix_kept", drawn)
    return out.select(*docs.columns, "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its cell, weight and probability, and whether it is drawn."""
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))

"""Operator 5: a quality classifier by co-training.

Two views of a document.  Content: its words and byte trigrams, hashed, and how often
words repeat.  Metadata: source, language and character count, and the layout figures
that come with a page: lines, their lengths, and the shares of capitals, digits, blanks
and signs; it reads no word.  A logistic model per view is fitted on labelled rows.  For some rounds each model labels the unlabelled pool, and of each label the
rows it is surest of, a ``share`` of the pool split as the labels are, are handed to the
other view as pseudo-labels.  Rank decides, not an absolute confidence, so a view that
is less sharp hands over rows as well.  At the end both views are calibrated and their
logits combined by a third logistic model, on labelled rows that neither view was
fitted on; every document gets the combined score, and is kept from ``threshold`` on.

All labelled documents are learned from, and all others are the pool.  Rows are dealt by
a hash of the id to shards of ``most`` / 2 labelled rows or more; each shard is trained by an
executor, its pool in blocks of ``pool`` rows, and the logits are the mean of those of all
blocks (a mixture of weights).  The mean is of whole numbers, so partitions change nothing;
the driver sees only sums.  Few labels (up to ``FEW``) are repeated over more shards.  A block
whose labels are all of one kind, or fewer than ten, has no say.

Nulls: a null text counts as empty, null metadata as a value of its own; null labels are
not learned from and a null id is scored like any other.  Without labels of both kinds
all documents score 1 and are kept.  Repeated rows score alike; whole texts are read.
Columns named as the added ones are replaced by them.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm import textnum
from stratalens.llm.base import read, tune

WORD_BITS, GRAM_BITS = 11, 10
TEXT_WIDTH = (1 << WORD_BITS) + (1 << GRAM_BITS) + 4
META_WIDTH = 128 + 32 + 24 + 24


def text_view(raw: bytes | None) -> np.ndarray:
    raw = raw or b""
    words = textnum.word_hashes(raw)
    _, counts = np.unique(words, return_counts=True)
    cells = np.bincount((words >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS)
    n = max(1, len(words))
    extra = np.array([len(counts) / n, counts.max(initial=0) / n, np.log1p(n) / 15, float(not raw)], np.float32)
    return np.concatenate([textnum.unit_sqrt(cells), textnum.unit_sqrt(textnum.ngram_counts(raw, GRAM_BITS, (3,))), extra])


#: Kinds of bytes: other signs, small letters and longer code points, capitals, digits, blanks, line ends.
KIND = np.zeros(256, np.int64)
KIND[97:123] = KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[[32, 9]] = 4
KIND[[10, 13]] = 5


def layout(raw: bytes) -> np.ndarray:
    """Shares of kinds of bytes, and of eight ranges of line lengths, and how many lines there are and differ."""
    kinds = np.zeros(6, np.int64)
    for at in range(0, len(raw), textnum.STRETCH):
        kinds += np.bincount(KIND[np.frombuffer(raw[at : at + textnum.STRETCH], np.uint8)], minlength=6)
    rows = raw.split(b"\n")
    lengths = np.log2(np.array([len(r) for r in rows]) + 1)
    bands = np.bincount(np.minimum(lengths / 2, 7).astype(int), minlength=8) / len(rows)
    figures = [np.log1p(len(rows)) / 10, len(set(rows)) / len(rows), lengths.mean() / 20, lengths.std() / 5]
    return np.concatenate([textnum.unit_sqrt(kinds), bands, figures]).astype(np.float32)


def meta_view(raw: bytes | None, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_WIDTH, np.float32)
    out[zlib.crc32(("s" + source).encode("utf-8", "replace")) % 127 + 1 if source is not None else 0] = 1
    out[128 + (zlib.crc32(("l" + lang).encode("utf-8", "replace")) % 31 + 1 if lang is not None else 0)] = 1
    out[160 + (1 + min(22, int(np.log2(max(n_chars, 0) + 1))) if n_chars is not None else 0)] = 1
    out[:184] /= 3  # the layout is the larger part
    out[184 : 184 + 18] = layout(raw or b"")
    return out


def _calibrated(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scale and shift of a view's logit over rows it was not fitted on."""
    z = (x @ w[:-1] + w[-1])[:, :1]
    spread = float(z.std()) + 1e-6
    a = textnum.fit_logistic(z / spread, y, ridge=1e-3, steps=200)
    return float(a[0, 0]) / spread, float(a[1, 0])


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    calibration: tuple
    mixed: np.ndarray
    handed: tuple = (0, 0)  # pseudo-labels given to each view

    def logits(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        (a, b), (c, d) = self.calibration
        return np.hstack([a * (t @ self.text[:-1] + self.text[-1]) + b, c * (m @ self.meta[:-1] + self.meta[-1]) + d])

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(t, m), -12, 12)
        return textnum.sigmoid(z @ self.mixed[:-1] + self.mixed[-1])[:, 0]


def cotrain(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, rounds: int = 4, share: float = 0.05) -> Model | None:
    """Labelled rows (t, m, y) and a pool; a quarter of the labelled rows is kept for calibration and combination."""
    if len(y) < 10 or not 0 < y.mean() < 1:
        return None
    order = np.random.default_rng(3).permutation(len(y))
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        own = order[y[order] == label]
        held[own[: max(1, len(own) // 4)]] = True
    views, pools = (t, m), (pool_t, pool_m)
    added: list[dict] = [{}, {}]  # per view: row of the pool -> pseudo-label handed to it
    fitted: list = [None, None]
    for step in range(rounds + 1):
        for v in (0, 1):
            rows = np.array(sorted(added[v]), int)
            x = np.vstack([views[v][~held], pools[v][rows]]) if len(rows) else views[v][~held]
            target = np.concatenate([y[~held], [added[v][r] for r in rows]])
            n_one = max(target.sum(), 1)
            weight = np.where(target == 1, 0.5 / n_one, 0.5 / max(len(target) - n_one, 1)) * np.concatenate([np.ones((~held).sum()), np.full(len(rows), 0.5)])
            fitted[v] = textnum.fit_logistic(x, target, weight, ridge=1e-5, steps=200)
        if step == rounds or not len(pool_t):
            break
        for v in (0, 1):
            z = (pools[v] @ fitted[v][:-1] + fitted[v][-1])[:, 0]
            free = np.array([r for r in range(len(z)) if r not in added[1 - v]], int)
            for label, part in ((1, y.mean()), (0, 1 - y.mean())):
                best = free[np.argsort(-z[free] if label else z[free], kind="stable")][: max(1, int(share * part * len(z)))]
                added[1 - v].update({int(r): label for r in best if (z[r] > 0) == label})
    calibration = tuple(_calibrated(fitted[v], views[v][held], y[held]) for v in (0, 1))
    model = Model(fitted[0], fitted[1], calibration, np.zeros((3, 1), np.float32), tuple(len(a) for a in added))
    model.mixed = textnum.fit_logistic(np.clip(model.logits(t[held], m[held]), -12, 12).astype(np.float32) / 4, y[held], ridge=1e-3, steps=300)
    model.mixed[:-1] /= 4
    return model


def both_views(texts: list, langs: list, sources: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    raws = [x.encode("utf-8", "replace") if x else None for x in texts]
    t, m = [text_view(r) for r in raws], [meta_view(r, s, lang, n) for r, lang, s, n in zip(raws, langs, sources, sizes, strict=True)]
    return np.array(t, np.float32).reshape(-1, TEXT_WIDTH), np.array(m, np.float32).reshape(-1, META_WIDTH)


#: Labels that are broadcast; more are met in the shuffle of the documents.
FEW = 100_000
#: One in the sums of weights, which are of whole numbers.
ONE = 1 << 32


def shards(docs: DataFrame, labels: DataFrame, most: int, pool: int) -> DataFrame:
    """(shard, quality or null, text, lang, source, n_chars) of all docs, by shards, labelled rows first."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    base, n_known, fields = docs.select("doc_id", "text", "lang", "source", "n_chars"), known.count(), ("text", "lang", "source", "n_chars")
    n = max(1, n_known // max(1, most // 2))
    own = F.coalesce(F.xxhash64(F.lit("shard"), F.col("doc_id")), F.lit(0)) if n_known > FEW else F.xxhash64(F.lit("shard"), F.col("doc_id"), F.col("text"))
    if n_known > FEW:
        # Documents and labels of an id go to one shard, so whole texts are shuffled once; rows without an id go by text.
        own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("shard"), "text")).otherwise(own)
        docs_ = base.select(F.pmod(own, F.lit(n)).alias("shard"), "*", F.lit(None).cast("int").alias("quality"), F.lit(True).alias("own"))
        empty = [F.lit(None).cast(base.schema[name].dataType).alias(name) for name in fields]
        labels_ = known.select(F.pmod(F.xxhash64(F.lit("shard"), F.col("doc_id").cast(base.schema["doc_id"].dataType)), F.lit(n)).alias("shard"), "doc_id", *empty, "quality", F.lit(False).alias("own"))
        rows = docs_.unionByName(labels_).repartition("shard").withColumn("quality", F.max("quality").over(Window.partitionBy("shard", "doc_id"))).where("own")
    else:
        n = max(n, docs.count() // (8 * max(1, pool)))
        times = min(n, -(-n * (most // 2) // max(1, n_known))) if n > 1 else 1
        turns = F.sequence(F.lit(0), F.when(F.col("quality").isNull(), 0).otherwise(times - 1))
        rows = base.join(F.broadcast(known), "doc_id", "left").withColumn("turn", F.explode(turns))
        rows = rows.withColumn("shard", F.pmod(F.pmod(own, F.lit(n)) + F.col("turn"), F.lit(n))).repartition("shard")
    order = ("shard", F.col("quality").isNull(), F.xxhash64("doc_id", "text"), "doc_id", "text", "lang", "source", "n_chars")
    return rows.sortWithinPartitions(*order).select("shard", "quality", *fields)


def joint(model: Model) -> np.ndarray:
    """A model's logit as weights of both views and one shift."""
    (a, b), (c, d) = model.calibration
    p, q, shift = (float(v) for v in model.mixed[:, 0])
    return np.concatenate([p * a * model.text[:, 0], q * c * model.meta[:, 0], [p * b + q * d + shift]]).astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame, most: int = 4000, pool: int = 2000, **how) -> Model | None:
    """The co-trained model of docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality)."""
    size = TEXT_WIDTH + META_WIDTH + 3

    def work(batches):
        total, shard, has, spare, seen, fitted = np.zeros(size + 3, np.int64), None, [], [], set(), False
        stack = lambda some, k, w: np.stack([r[k] for r in some]).astype(np.float32) if some else np.zeros((0, w), np.float32)

        def fit():
            y = np.array([r[2] for r in has], float)
            model = cotrain(stack(has, 0, TEXT_WIDTH), stack(has, 1, META_WIDTH), y, stack(spare, 0, TEXT_WIDTH), stack(spare, 1, META_WIDTH), **how)
            if model:
                total[:size] += np.rint(joint(model) * ONE).astype(np.int64)
                total[size:] += np.array([1, *model.handed])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, m = both_views(*(batch.column(k).to_pylist() for k in range(2, 6)))
            t, m = t.astype(np.float16), m.astype(np.float16)
            for k, (at, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if at != shard:
                    if has and (spare or not fitted):
                        fit()
                    shard, has, spare, seen, fitted = at, [], [], set(), False
                mark = hashlib.blake2b(repr(label).encode() + t[k].tobytes() + m[k].tobytes(), digest_size=16).digest()
                if mark in seen:
                    continue
                seen.add(mark)
                if label is not None:
                    if len(has) >= 2 * most:  # an id of many texts
                        fit()
                        has = []
                    has.append((t[k].copy(), m[k].copy(), label))
                elif has:
                    spare.append((t[k].copy(), m[k].copy()))
                    if len(spare) >= pool:
                        fit()
                        spare, fitted = [], True
        if has and (spare or not fitted):
            fit()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    sums = shards(docs, labels, most, pool).mapInArrow(work, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(size + 3, np.int64)
    for r in sums:
        total[r["at"]] = r["v"]
    if not total[size]:
        return None
    mean = (total[:size] / ONE / total[size]).astype(np.float32)[:, None]
    text, meta = mean[: TEXT_WIDTH + 1], mean[TEXT_WIDTH + 1 : -1]
    return Model(text, meta, ((1.0, 0.0), (1.0, 0.0)), np.array([[1], [1], mean[-1]], np.float32), tuple(int(v) for v in total[size + 1 :]))


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = 4000, pool: int = 2000, threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars, ..): all its columns, and quality_score and quality_predicted."""
    tune(docs.sparkSession)
    docs = docs.drop("quality_score", "quality_predicted")
    model = learn(docs, labels, most, pool)
    kept = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)

    def score(batches):
        for batch in batches:
            take = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
            p = np.ones(batch.num_rows)
            if model and batch.num_rows:
                p = model.score(*both_views(*map(take, ("text", "lang", "source", "n_chars"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(float)), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "quality_score", "quality_predicted"])

    return docs.mapInArrow(score, f"{kept}, quality_score double, quality_predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its score and whether it is kept."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    out = quality_scores(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))

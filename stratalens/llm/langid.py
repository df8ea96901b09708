"""Operator 2: language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits.  One binary n-gram classifier per bit is
fitted on square-root shares of hashed byte n-grams of the lowered text (orders 1 to 3,
everything but letters as a space).  Decoding is loss-weighted: each bit's logistic
loss against a codeword counts by that bit's training accuracy above chance, and the
codeword of least loss wins.  The score is the softmax share of the winner; a text is
``ambiguous`` if the runner-up is closer than ``margin``.

Fitted on a bounded sample: about ``per_lang`` rows of each language, chosen by a hash
of the row, about ``most`` rows in all, of which every language gets an equal part; with
more languages than ``most`` those without a row drawn can't be predicted.  Rows of the held-out quarter, rows without
language and rows without text are never learned from.

Nulls: a null text, or one without a letter, is ``und`` with score 0.  A null id is
scored like any other.  Without learned languages every text is ``und``.  Repeated rows
are scored alike; whole texts are read, in stretches.  Columns named as the added ones
are replaced by them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import textnum
from stratalens.llm.base import crc_mod, read, stage, tune

BITS = 11
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(b if not textnum.NOT_LETTERS[b] else 32 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """A vector of length 1, or zeros for a text without letters."""
    if not text or not _LETTER.search(text):
        return np.zeros(1 << BITS, np.float32)
    return textnum.unit_sqrt(textnum.ngram_counts(text.lower().encode("utf-8", "replace").translate(_KEEP), BITS))


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1, far apart: the exhaustive code up to 5 languages, else the best of random ones."""
    if n <= 5:
        columns = [c for c in product((1, -1), repeat=n) if c[0] == 1 and -1 in c] or [(1,) * n]
        return np.array(columns, np.float32).T
    rng, best, least = np.random.default_rng(5), None, -1
    width = max(15, int(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([1.0, -1.0], np.float32), (n, width))
        code = code[:, (np.abs(code.sum(0)) < n)]
        apart = int(((code.shape[1] - code @ code.T) / 2 + np.eye(n) * width).min())
        if apart > least:
            best, least = code, apart
    return best


@dataclass
class Model:
    langs: list
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    sharpness: float = 1.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        out = np.zeros((len(x), len(self.langs)))
        for k, word in enumerate(self.code):
            out[:, k] = np.logaddexp(0, -np.clip(z * word, -30, 30)) @ self.trust
        return out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(winner, its share, lead over the runner-up)."""
        loss = self.losses(x)
        share = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        ranked = np.sort(loss, axis=1)
        lead = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return loss.argmin(1), share.max(1), lead


def fit(x: np.ndarray, langs: list) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    code = codewords(len(names))
    y = np.array([names.index(v) for v in langs])
    target = (code[y] > 0).astype(np.float32)
    share = np.bincount(y, minlength=len(names))
    weights = textnum.fit_logistic(x, target, weight=1.0 / share[y], ridge=1e-5)
    right = (((x @ weights[:-1] + weights[-1]) > 0) == (target > 0)).mean(0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(names, code, weights, trust / trust.sum(), sharpness=float(code.shape[1]))


def sample(docs: DataFrame, per_lang: int, most: int, here: int = 100_000) -> DataFrame:
    """(lang, text) of about per_lang rows a language, or most / languages if that is less: a hash threshold from its count.

    The counts of up to ``here`` languages are a broadcast side, so texts are not shuffled.
    """
    counts = stage(docs.groupBy("lang").count(), "langs")
    n = counts.count()
    per = min(float(per_lang), most / max(n, 1))
    cut = counts.select("lang", (F.lit(per) / F.col("count")).alias("cut"))
    drawn = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(cut) if n <= here else cut, "lang").where(drawn < F.col("cut")).select("lang", "text")


def identify(docs: DataFrame, train: DataFrame, per_lang: int = 600, most: int = 6000, margin: float = 0.05) -> DataFrame:
    """docs (doc_id, text, ..): adds lang_pred, score, ambiguous; train (doc_id, lang, text) is learned from."""
    spark = docs.sparkSession
    tune(spark)

    def vectors(batches):
        for batch in batches:
            found = [(lang, features(text).astype(np.float16).tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text and _LETTER.search(text)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], ["lang", "x"])

    picked = sample(train.where(F.col("lang").isNotNull()), per_lang, most)
    got = sorted(picked.mapInArrow(vectors, "lang string, x binary").distinct().collect())
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, 1 << BITS), np.float32)
    model = fit(x, [r["lang"] for r in got])

    docs = docs.drop("lang_pred", "score", "ambiguous")
    names = [n for n in docs.columns if n != "text"]

    def score(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
            pred, share, near = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
            if model and found.any():
                win, p, lead = model.decode(np.stack([features(t) for t, ok in zip(texts, found, strict=True) if ok]))
                pred[found], share[found], near[found] = np.array(model.langs, object)[win], p, lead < margin
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(pred, pa.string()), pa.array(share), pa.array(near)], [*names, "lang_pred", "score", "ambiguous"])

    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n in names)
    return docs.mapInArrow(score, f"{kept}, lang_pred string, score double, ambiguous boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``; learned from rows whose crc32 modulo 4 is not 2."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    return identify(docs.select("doc_id", "held_out", "text"), docs.where("not held_out").select("doc_id", "lang", "text"))

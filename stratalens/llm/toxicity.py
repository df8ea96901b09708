"""Operator 7: toxicity by a counterfactual-regularised classifier.

Features of a text: which words and word beginnings (3 to 7 bytes) it holds, and maybe
holds often and densely, hashed, so inflected forms of a stem count together and a single
chance occurrence in a long text need not count like a text full of them.  Which of these
forms to use is chosen by cross-validation over the learned rows alone.  The most telling
features of the labelled sample (by a two-proportion z score) make a logistic model.
Its penalty: each labelled text that mentions an identity term, and each neutral template
sentence, is also read with the term swapped for another of the same kind; squared
differences of the two scores are added to the loss, and the neutral templates are
learned as not toxic.  So a group's name alone cannot carry a score.

Learned from at most about ``most`` labelled rows outside the held-out third, chosen by
a hash of the id; equal ids with several labels count as toxic if one label is.  Only
text enters a score.

Nulls: null and empty texts get the score of a text without telling features.  A null
id is scored like any other; null labels are not learned from.  Repeated rows are scored
alike.  Without labels of both kinds every score is the share of toxic labels (0 without
any).  Whole texts are read, in stretches.  Columns named as the added ones are replaced
by them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import textnum
from stratalens.llm.base import crc_mod, read, tune

CELLS = 1 << 18
BEGINNINGS = (3, 4, 5, 6, 7)

#: Terms of one row may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "locals", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)
_NEXT = {row[k]: row[(k + 1) % len(row)] for row in IDENTITY for k in range(len(row))}
_TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")\b", re.I)
TEMPLATES = ("{} live in this town", "the meeting was open to {}", "a book about {} and their work", "some {} came to the market", "{}", "my neighbours are {}")


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by the next of its kind; None without any."""
    out, n = _TERM.subn(lambda m: _NEXT[m[0].lower()], text)
    return out if n else None


def marks(text: str | None, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct cells of words and word beginnings of a whole text, how often each occurs, and the number of words.

    wanted: for each cell whether to return it.
    """
    found, counts, n_words = [], [], 0
    for a in textnum.stretches((text or "").lower().encode("utf-8", "replace"), textnum.NOT_LETTERS):
        starts, ends = textnum.spans(a, textnum.NOT_LETTERS)
        sums, length = textnum.prefix_sums(a), ends - starts
        own = [textnum.span_hashes(sums, starts, ends) & np.uint64(CELLS - 1)]
        for n in BEGINNINGS:
            at = starts[length >= n]
            own.append((textnum.span_hashes(sums, at, at + n) + np.uint64(n * 7919)) & np.uint64(CELLS - 1))
        own = np.concatenate(own).astype(np.int64)
        cell, count = np.unique(own if wanted is None else own[wanted[own]], return_counts=True)
        found.append(cell)
        counts.append(count)
        n_words += len(starts)
    if len(found) == 1:
        return found[0], counts[0], n_words
    # The stretches of a long text are added up.
    cell, back = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_inverse=True)
    return cell, np.bincount(back, np.concatenate([np.zeros(0), *counts])).astype(np.int64), n_words


#: (least occurrences, least share of words): form f of a cell is held by texts with so many of it; its number is f * CELLS + cell.
FORMS = ((1, 0.0), (2, 0.0), (4, 0.0), (2, 1 / 100), (2, 1 / 30))
#: What cross-validation may choose from: so many of the forms.
CHOICES = (1, 2, 3, 5)


def cells(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the features of a whole text, sorted."""
    cell, count, n_words = marks(text, wanted)
    return np.concatenate([cell[count >= max(least, share * n_words)] + f * CELLS for f, (least, share) in enumerate(FORMS)])


@dataclass
class Model:
    chosen: np.ndarray  # sorted numbers of features
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.wanted = np.zeros(CELLS, bool)
        self.wanted[self.chosen % CELLS] = True

    def logit(self, own: np.ndarray) -> float:
        return float(self.weights[np.isin(self.chosen, own, assume_unique=True)].sum() + self.intercept)

    def score(self, text: str | None) -> float:
        return float(textnum.sigmoid(np.float64(self.logit(cells(text, self.wanted)))))


def fit(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], columns: int = 1024, pair_weight: float = 4.0, forms: int = len(FORMS), steps: int = 300) -> Model:
    """rows: features of labelled texts; pairs: those of a text and of its counterfactual; forms: how many are used."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    width = forms * CELLS
    count = lambda some: np.bincount(np.concatenate([*(r[r < width] for r in some), np.zeros(0, np.int64)]), minlength=width).astype(np.float64)
    bad, good = count([r for r, t in zip(rows, y, strict=True) if t]), count([r for r, t in zip(rows, y, strict=True) if not t])
    n_bad, n_good = y.sum(), len(y) - y.sum()
    p, q, both = bad / n_bad, good / n_good, (bad + good) / len(y)
    z = np.abs(p - q) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n_bad + 1 / n_good))
    z[(bad + good < 4)] = 0
    best = np.argsort(-z, kind="stable")[:columns]
    best = np.sort(best[z[best] > 4])
    at = np.full(width, -1, np.int64)
    at[best] = np.arange(len(best))

    def matrix(some) -> np.ndarray:
        out = np.zeros((len(some), len(best)), np.float32)
        for k, r in enumerate(some):
            own = at[r[r < width]]
            out[k, own[own >= 0]] = 1
        return out

    neutral = [cells(t.format(term)) for row in IDENTITY for term in row for t in TEMPLATES]
    told = [(a, cells(swapped(t.format(term)))) for row in IDENTITY for term in row for t in TEMPLATES for a in [cells(t.format(term))]]
    x = matrix([*rows, *neutral])
    target = np.concatenate([y, np.zeros(len(neutral))])
    weight = np.concatenate([np.ones(len(rows)), np.full(len(neutral), 0.05 * len(rows) / len(neutral))])
    apart = matrix([a for a, _ in [*pairs, *told]]) - matrix([b for _, b in [*pairs, *told]])
    w = textnum.fit_logistic(x, target, weight, ridge=2e-4, steps=steps, pairs=apart, pair_weight=pair_weight)
    return Model(best, w[:-1, 0], float(w[-1, 0]))


def best_forms(rows: list[np.ndarray], y: np.ndarray, folds: int = 3, most: int = 3000, steps: int = 120) -> int:
    """How many of the forms give the least logistic loss on rows left out, over folds of at most ``most`` learned rows."""
    order = np.random.default_rng(4).permutation(len(rows))[:most]
    if y[order].sum() < 2 * folds or (1 - y[order]).sum() < 2 * folds:
        return len(FORMS)
    losses = []
    for forms in CHOICES:
        loss = 0.0
        for k in range(folds):
            model = fit([rows[i] for j, i in enumerate(order) if j % folds != k], y[[i for j, i in enumerate(order) if j % folds != k]], [], forms=forms, steps=steps)
            out = order[k::folds]
            z = np.array([model.logit(rows[i]) for i in out])
            loss += float(np.logaddexp(0, np.where(y[out] > 0, -z, z)).sum())
        losses.append(loss)
    return CHOICES[int(np.argmin(losses))]


def learn(labelled: DataFrame, **how) -> Model:
    """The model of labelled (text, toxic), a bounded sample."""

    def read_cells(batches):
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = [cells(t).astype(np.int32).tobytes() for t in texts]
            other = [cells(s).astype(np.int32).tobytes() if t and (s := swapped(t)) else None for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(own, pa.binary()), pa.array(other, pa.binary())], ["toxic", "own", "other"])

    got = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(read_cells, "toxic int, own binary, other binary").distinct().collect()
    got.sort(key=lambda r: (r["toxic"], r["own"]))
    of = lambda raw: np.frombuffer(raw, np.int32).astype(np.int64)
    rows, y = [of(r["own"]) for r in got], np.array([r["toxic"] for r in got], float)
    return fit(rows, y, [(own, of(r["other"])) for own, r in zip(rows, got, strict=True) if r["other"] is not None], forms=best_forms(rows, y), **how)


def toxicity(docs: DataFrame, labelled: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text, ..): adds score and predicted; labelled (doc_id, text, toxic), a bounded sample, is learned from."""
    tune(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = [n for n in docs.columns if n != "text"]
    model = learn(labelled)

    def score(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            p = np.array([model.score(t) for t in texts], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n in names)
    return docs.mapInArrow(score, f"{kept}, score double, predicted int")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """The columns of docs and <column>, of at most about ``most`` labelled documents.

    The ids are chosen by a hash from the narrow label table, so at most 2 * ``most`` of
    them: a bounded side to broadcast, and texts are not shuffled.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias(column))
    n = known.count()
    chance = F.pmod(F.xxhash64(F.lit("label"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    some = known.where(chance < most / max(n, 1)).limit(2 * most)
    return docs.join(F.broadcast(some), "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str, most: int = 8000) -> DataFrame:
    """Every text of ``documents``; learned from labels whose crc32 modulo 3 is not 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 3) == 1).alias("held_out"))
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    return toxicity(docs.select("doc_id", "held_out", "text"), labelled_sample(docs, labels, "toxic", most))

"""Operator 10: near-duplicate groups by MinHash with tensored banding.

Tensored banding: two collections of ``side`` sketches, each sketch ``rows`` minimum
hashes; table (i, j) keys on the pair of sketch i of the first and sketch j of the
second.  side**2 tables come from 2*side*rows minimum hashes instead of
side**2*2*rows.  At likeness s a pair shares no table with probability
1 - (1 - (1 - s**rows)**side)**2: 0.0007 at 0.8 and 0.00006 at 0.85 for rows 3, side 11.

Equal shingle sets are one class from the start, so copies never meet in a table.
Candidates are confirmed on full shingle sets.  A bucket is verified as a star around
one leader (linear in the bucket), links are joined into components, and the leader,
which has met all others, leaves the bucket.  After ``rounds`` rounds, documents that
still share a bucket with another component meet exactly: through their rarest shingles
(see ``_rare_pairs``).  Within a component further links change nothing, so the
components are those of all candidate pairs, without emitting all pairs of a bucket.

Nulls, empty and wordless texts: empty set, linked with nothing, kept.  A null id
counts in the class of its set but never names a component; alone it has a null
component and is kept.  Rows repeated with the same id form one class with that id and
are all marked alike.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm import textnum
from stratalens.llm.base import as_bytes, drop, read, stage, tune
from stratalens.operators.graph import components

#: Random multipliers and shifts of the minimum hashes, fixed.
_SEEDS = np.random.default_rng(77).integers(1, 2**63, (2, 1024), dtype=np.uint64) | np.uint64(1)


#: Parts that the holders of one shingle are dealt over.
SALTS = 16
#: Most common shingles that are broadcast, of 16 bytes each; beyond it they are shuffled as well.
HOT_SHINGLES = 1_000_000


def sketch_values(shingles: np.ndarray, rows: int, side: int) -> np.ndarray:
    """2*side sketches, each a hash of ``rows`` minimum hashes, of a non-empty set."""
    n = 2 * side * rows
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096] * _SEEDS[0, :n, None]
        part ^= part >> np.uint64(29)
        part *= _SEEDS[1, :n, None]
        np.minimum(low, (part >> np.uint64(1)).min(axis=1), out=low)
    low = low.reshape(2 * side, rows)
    out = np.arange(1, 2 * side + 1, dtype=np.uint64)
    for r in range(rows):
        out = textnum.mix(out * np.uint64(0x9DDFEA08EB382D69) + low[:, r])
    return out


def sketches(docs: DataFrame, words: int, rows: int, side: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, m0..): set size, two sums that name the set, the sketches."""
    names = [f"m{k}" for k in range(2 * side)]

    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0), as_bytes(batch.column(1))
            out = np.zeros((len(texts), 3 + 2 * side), np.uint64)
            for k, raw in enumerate(texts):
                found = textnum.shingle_set(raw, words)
                if len(found):
                    out[k, 0] = len(found)
                    out[k, 1] = found.sum(dtype=np.uint64)
                    out[k, 2] = textnum.mix(found * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                    out[k, 3:] = sketch_values(found, rows, side)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in out.view(np.int64).T.copy())], ["doc_id", "n_shingles", "s1", "s2", *names])

    schema = "doc_id long, n_shingles long, s1 long, s2 long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def _alike(n: str, m: str, percent: int):
    """Sizes that allow the likeness: the smaller at least ``percent`` of the larger."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the likeness; texts: (id, text)."""

    def work(batches):
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = np.zeros(len(a), bool)
            lead, other = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            for k, (i, x, y) in enumerate(zip(a.to_pylist(), lead, other, strict=True)):
                if i != last:
                    last, held = i, textnum.shingle_set(x, words)
                more = textnum.shingle_set(y, words)
                both = np.concatenate([held, more])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * common >= percent * (len(both) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after links between the vertices (a, b) of ``more``; a vertex without a label is its own."""
    of = lambda side: labels.select(F.col("v").alias(side), F.col("c").alias(f"c{side}"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    joined = stage(joined, "relabel")
    ends = joined.select(F.col("a").alias("v"), F.col("ca").alias("c")).union(joined.select("b", "cb"))
    every = labels.union(ends).distinct()
    low = components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("v").alias("c"), F.col("c").alias("low"))
    out = stage(every.join(low, "c", "left").select("v", F.coalesce("low", "c").alias("c")), "labels")
    drop(joined, labels)
    return out


def _rare_pairs(rest: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of rest (id, n, c) that can meet the likeness; none that does is missing.

    Two sets as alike as that share one of their n - ceil(n * likeness) + 1 first shingles in
    any common order; the rarest first here, so what only holds a common passage in common
    does not meet.
    """

    def work(batches):
        for batch in batches:
            found = [textnum.shingle_set(raw, words) for raw in as_bytes(batch.column(1))]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            h = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h)], ["id", "h"])

    tokens = stage(texts.join(rest, "id", "left_semi").select("id", "text").mapInArrow(work, "id long, h long"), "tokens")
    common = stage(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "common")
    # A shingle of more than a thousandth of the documents is looked up by broadcast: there are at most a thousand times a
    # mean document's shingles of them.  The rest meets by shuffle.
    cut = max(1000, rest.count() // 1000)
    hot = common.where(F.col("df") > cut)
    if hot.count() <= HOT_SHINGLES:
        hot = F.broadcast(hot)
        counted = tokens.join(hot, "h").unionByName(tokens.join(hot.select("h"), "h", "left_anti").join(common.where(F.col("df") <= cut), "h"))
    else:
        counted = tokens.join(common, "h")
    own = Window.partitionBy("id")
    placed = counted.select("id", "h", F.row_number().over(own.orderBy("df", "h")).alias("at"), F.count("*").over(own).alias("held"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = placed.join(rest, "id").select("id", "n", "c", "h", (F.col("n") - F.col("held") + F.col("at")).alias("p"))
    kept = stage(kept.where(F.col("p") <= first), "prefixes")
    mixed = kept.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("h")
    # Sizes that allow the likeness lie in neighbouring bands, so a common shingle's holders meet by bands, the smaller set in
    # its own, the larger in those below too (two, against rounding).
    band = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")
    # All of a large group of near copies hold its shingles: they are dealt over salts.
    salts = mixed.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id"), F.lit(SALTS)).cast("int"))
    kept = stage(salted.join(salts, ["h", "salt"], "left_semi").drop("salt").withColumn("band", band.cast("int")), "prefixes")
    other = kept.select("h", F.explode(F.sequence(F.col("band") - 2, F.col("band"))).alias("band"), F.col("id").alias("y"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("p").alias("q"))
    smaller = F.struct("n", "id") < F.struct(F.col("m").alias("n"), F.col("y").alias("id"))
    # From the first shingle shared on, the sets must have enough places left for the likeness.
    room = (100 + percent) * (1 + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q"))) >= percent * (F.col("n") + F.col("m"))
    return kept.join(other, ["h", "band"]).where(smaller & (F.col("c") != F.col("d"))).where(_alike("n", "m", percent) & room).select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 3, side: int = 11, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stage(sketches(docs, words, rows, side), "sketches")
    names = [c for c in sketched.columns if c[0] == "m"]
    key = ["s1", "s2", "n_shingles"]
    classes = sketched.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("id"), *(F.min(m).alias(m) for m in names))
    classes = stage(classes.where(F.col("id").isNotNull()), "classes")

    tables = F.array(*(F.xxhash64(F.lit(i * side + j), F.col(f"m{i}"), F.col(f"m{side + j}")) for i in range(side) for j in range(side)))
    keyed = classes.select("id", F.col("n_shingles").alias("n"), F.explode(tables).alias("bucket"))
    # Counts are added up before their shuffle; a join that a large bucket skews is split at run time, a window would not be.
    held = keyed.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    shared = stage(keyed.join(held, "bucket").select("bucket", "id", "n", "held"), "buckets")
    # What shares most places with others is likeliest the original of a group of copies: it leads first.
    degrees = shared.groupBy("id").agg(F.sum("held").alias("degree"))
    texts = docs.join(degrees.select("id"), docs.doc_id == F.col("id")).join(classes.select(F.col("id").alias("doc_id"), *key), "doc_id").select("id", "text", *key)
    # One row for each id, even if ids repeat: any row of the class has the same set.
    texts = stage(_of_class(texts, words).select("id", "text").dropDuplicates(["id"]), "texts")
    members = left = stage(shared.join(degrees, "id").select("bucket", "id", "n", "degree"), "members")
    drop(shared)

    labels = spark.createDataFrame([], "v long, c long")
    for turn in range(rounds):
        held = left.join(labels, left.id == labels.v, "left").select("bucket", "id", "n", "degree", F.coalesce("c", "id").alias("c"))
        # One member of each component of a bucket, and of these the leader: the best linked, then one of the smallest component.
        per = held.groupBy("bucket", "c").agg(F.count("*").alias("k"), F.max(F.struct("degree", F.xxhash64("id").alias("o"), "id", "n")).alias("one"))
        size = F.lit(0) if turn == 0 else -F.col("k")
        leads = per.groupBy("bucket").agg(F.max(F.struct(size.alias("k"), "one", "c")).alias("lead"), F.count("*").alias("held")).where("held > 1")
        leads = leads.select("bucket", F.col("lead.one.id").alias("lead"), F.col("lead.one.n").alias("lead_n"), F.col("lead.c").alias("lead_c"))
        open_ = stage(held.join(leads, "bucket").where(F.col("id") != F.col("lead")), "members")
        found = open_.where("c <> lead_c").where(_alike("n", "lead_n", percent)).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        links = stage(_verified(stage(found.distinct(), "pairs"), texts, words, percent), "links")
        if not links.isEmpty():
            labels = _relabelled(labels, links)
        drop(members, links)
        members = open_
        left = open_.select("bucket", "id", "n", "degree")  # the leader has met all others

    rest = left.select("id", "n").distinct().join(labels, F.col("id") == labels.v, "left").select("id", "n", F.coalesce("c", "id").alias("c"))
    rest = stage(rest, "rest")
    drop(members)
    if not rest.isEmpty():
        links = stage(_verified(stage(_rare_pairs(rest, texts, words, percent), "pairs"), texts, words, percent), "links")
        if not links.isEmpty():
            labels = _relabelled(labels, links)

    named = classes.join(labels, classes.id == labels.v, "left").select(*key, F.coalesce("c", "id").alias("component"))
    out = sketched.select("doc_id", *key).join(named, key, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _of_class(rows: DataFrame, words: int) -> DataFrame:
    """Rows whose text really has the class's set: ids may repeat with other texts."""

    def work(batches):
        for batch in batches:
            s1, s2 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(len(s1), bool)
            for k, raw in enumerate(as_bytes(batch.column(1))):
                found = textnum.shingle_set(raw, words)
                sums = found.sum(dtype=np.uint64), textnum.mix(found * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                keep[k] = (np.int64(np.array(sums[0], np.uint64).view(np.int64)), np.array(sums[1], np.uint64).view(np.int64)) == (s1[k], s2[k])
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns], batch.schema.names)

    return rows.mapInArrow(work, rows.schema)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: two-word shingles, likeness of 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)

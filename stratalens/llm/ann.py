"""Operator 1: nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: vectors are lengthened by one component so that all have the largest norm (then
the largest inner product is the least angle), centred, projected on their principal
directions and turned by iterative-quantisation rotations, as many as give ``bits``
signs; the signs are the code.  Mean, directions and rotations are fitted on a
bounded hash sample of rows; every row is indexed.

Index: a code is split into 8-bit substrings, each with a table of 256 buckets.  Of two
codes within Hamming radius r = m * t + a (m substrings) either one of the first a + 1
substrings differs in t bits at most or one of the others in t - 1 at most (pigeonhole),
so the buckets so near hold every code within r.  A row goes to its bucket of each
table, a query to the buckets it probes; both are dealt by shards of buckets, and a
bucket larger than a shard is divided by a hash of the row, with the query sent to each
part.  Pairs within r leave from the first substring that finds them, so none leaves
twice; they meet their vectors in blocks of rows and are reranked by inner products in
double precision.

Each query has a radius of its own, in which about ``enough`` codes of the table are
expected: its distances to the sample's codes are close to normal, so their mean and
spread say where that share of all codes ends, at any size of the table.  A radius is
no cap: every code within it is reranked.  Queries that find fewer than k rows are asked
again with twice the radius, up to the length of the code, where every row is found.

Copies: equal vectors are one entry of the index, of which the k + 1 least ids can
matter to a query; so a group of copies is met once, however large.

Left out: null, empty and zero vectors, vectors with null or non-finite components, rows
with a null id.  A shorter vector counts as filled up with zeros.  Rows of a query's own
id are never its candidates; a repeated query id counts once (its least vector), a
repeated candidate row as often as it occurs.  Ties go to the smaller vec_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.base import drop, read, stage

POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
DISTANCE = POPCOUNT[np.bitwise_xor.outer(np.arange(256), np.arange(256))]
#: Pairs of codes compared at a time.
PAIRS = 1 << 20


@dataclass
class Codes:
    mean: np.ndarray
    turn: np.ndarray  # directions times rotations
    norm: float
    sample: np.ndarray | None = None  # the sample's codes

    def radii(self, code: np.ndarray, share: float) -> np.ndarray:
        """For each query code the distance within which a share of all codes is expected."""
        bits = 8 * code.shape[1]
        if share >= 1 or len(self.sample) < 20:
            return np.full(len(code), bits)
        apart = hamming(code, self.sample).astype(float)
        return np.clip(np.floor(apart.mean(1) + apart.std(1) * NormalDist().inv_cdf(share)), 0, bits).astype(int)

    def of(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of bytes; queries are neither lengthened nor centred."""
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1), 0))
        long = np.hstack([v, extra[:, None]])
        return np.packbits((long if query else long - self.mean) @ self.turn > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b; rows hold whole 64-bit words."""
    x, y = (np.ascontiguousarray(c).view(np.uint64) for c in (a, b))
    out = np.zeros((len(x), len(y)), np.uint16)
    for j in range(x.shape[1]):
        out += np.bitwise_count(x[:, j, None] ^ y[None, :, j])
    return out


def fit(v: np.ndarray, norm: float, bits: int, turns: int = 25) -> Codes:
    """v: sampled rows."""
    extra = np.sqrt(np.maximum(norm**2 - (v * v).sum(1), 0))
    long = np.hstack([v, extra[:, None]])
    mean = long.mean(0)
    _, _, axes = np.linalg.svd(long - mean, full_matrices=False)
    low, rng, turned, width = (long - mean) @ axes.T, np.random.default_rng(11), [], len(axes)
    for _ in range(-(-bits // width)):
        rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(turns):  # iterative quantisation
            u, _, w = np.linalg.svd(np.sign(low @ rotation).T @ low)
            rotation = (u @ w).T
        turned.append(axes.T @ rotation)
    codes = Codes(mean, np.hstack(turned)[:, :bits], norm)
    codes.sample = codes.of(v)
    return codes


def reaches(radius: np.ndarray, m: int) -> np.ndarray:
    """For each radius and each of m substrings the distance to probe, -1 for none: what holds every code within the radius."""
    t, a = np.divmod(np.asarray(radius)[:, None], m)
    return np.where(np.arange(m) <= a, t, t - 1)


@dataclass
class Shards:
    """Where buckets lie: number[j, value] is the first shard of a bucket, parts[j, value] how many it has."""

    number: np.ndarray
    parts: np.ndarray
    table: np.ndarray  # shard: its substring

    @classmethod
    def of(cls, sizes: np.ndarray, rows: int) -> Shards:
        """sizes[j, value]; neighbouring buckets of a table share a shard of about ``rows``."""
        number, parts, table, at = np.zeros_like(sizes), np.ones_like(sizes), [], -1
        for j, own in enumerate(sizes):
            held = rows + 1  # a table begins with a shard of its own
            for value, size in enumerate(own):
                if size > rows:
                    parts[j, value] = -(-size // rows)
                    number[j, value] = at + 1
                    at += int(parts[j, value])
                    table += [j] * int(parts[j, value])
                    held = rows + 1
                    continue
                if held + size > rows:
                    at, held = at + 1, 0
                    table.append(j)
                number[j, value] = at
                held += size
        return cls(number, parts, np.array(table))


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): rows that take part, of any length."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of numbers as rows of d doubles, filled up with zeros."""
    if not len(column):
        return np.zeros((0, d))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def raw_codes(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def code_rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def candidates(index: DataFrame, asked: DataFrame, shards: Shards, m: int) -> DataFrame:
    """(query_id, cid) of all pairs within the query's radius; index (cid, code), asked (query_id, code, radius)."""

    def rows(batches):
        for batch in batches:
            ids, code = batch.column(0).to_numpy(zero_copy_only=False), code_rows(batch.column(1), m)
            j = np.arange(m)
            spread = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            shard = shards.number[j, code] + spread[:, None] % shards.parts[j, code]
            yield dealt_batch(shard.ravel(), np.full(shard.size, -1), np.repeat(ids, m), batch.column(1).take(pa.array(np.repeat(np.arange(len(ids)), m))))

    def questions(batches):
        for batch in batches:
            ids, code, radius = batch.column(0).to_numpy(zero_copy_only=False), code_rows(batch.column(1), m), batch.column(2).to_numpy(zero_copy_only=False)
            shard, at, reach = [], [], reaches(radius, m)
            for k, own in enumerate(code):
                for j in range(m):
                    if reach[k, j] >= 0:
                        near = np.flatnonzero(DISTANCE[own[j]] <= reach[k, j])
                        first, parts = shards.number[j, near], shards.parts[j, near]
                        hit = np.unique(np.concatenate([first, *(np.arange(f, f + p) for f, p in zip(first[parts > 1], parts[parts > 1], strict=True))]))
                        shard.append(hit)
                        at.append(np.full(len(hit), k))
            shard, at = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (shard, at))
            yield dealt_batch(shard, radius[at], ids[at], batch.column(1).take(pa.array(at)))

    def dealt_batch(shard, radius, ids, code):
        """Rows of the index have no radius: -1."""
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(radius, pa.int32()), pa.array(ids, pa.int64()), code], ["shard", "radius", "id", "code"])

    schema = "shard int, radius int, id long, code binary"
    dealt = index.select("cid", "code").mapInArrow(rows, schema).unionByName(asked.select("query_id", "code", "radius").mapInArrow(questions, schema))
    dealt = dealt.repartition(min(len(shards.table), 4096), "shard").sortWithinPartitions("shard", "radius")

    def met(j, ids, code, starts, query_ids, query_code, radius):
        """Pairs of a block of queries and the rows of one shard, sorted by their bucket."""
        reach = reaches(radius, m)
        for value in np.flatnonzero(np.diff(starts)):
            asks = np.flatnonzero(DISTANCE[value][query_code[:, j]] <= reach[:, j])
            a, b = starts[value], starts[value + 1]
            step = max(1, PAIRS // max(1, b - a))
            for at in range(0, len(asks), step):
                some = asks[at : at + step]
                q, r = np.nonzero(hamming(query_code[some], code[a:b]) <= radius[some, None])
                q, r = some[q], r + a
                # Found here first: no substring before this one is as near as it has to be.
                early = (POPCOUNT[query_code[q, :j] ^ code[r, :j]] <= reach[q, :j]).any(1)
                yield query_ids[q[~early]], ids[r[~early]]

    def work(batches):
        held, ids, codes, table = -1, [], [], None
        for batch in batches:
            shard, radius, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            code, asks = code_rows(batch.column(3), m), radius >= 0
            edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(own)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if shard[a] != held:
                    held, ids, codes, table = shard[a], [], [], None
                j = int(shards.table[held])
                if not asks[a]:
                    ids.append(own[a:b])
                    codes.append(code[a:b])
                    continue
                if not ids:
                    continue
                if table is None:
                    whole = np.vstack(codes)
                    order = np.argsort(whole[:, j], kind="stable")
                    table = np.concatenate(ids)[order], whole[order], np.searchsorted(whole[order, j], np.arange(257))
                for q, r in met(j, *table, own[a:b], code[a:b], radius[a:b]):
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int64())], ["query_id", "cid"])

    return dealt.mapInArrow(work, "query_id long, cid long")


def reranked(found: DataFrame, classes: DataFrame, asked: DataFrame, n_blocks: int, d: int, k: int) -> DataFrame:
    """(query_id, cid, other, first, score): the best k + 1 classes of each query in each block of classes, at least.

    A class goes to its block once, a query to a block once however many of the classes
    there it is paired with; pairs travel as ids.
    """
    block = F.pmod(F.xxhash64(F.lit(2), "cid"), F.lit(n_blocks)).cast("int").alias("block")
    no = F.lit(None).cast("long")
    kind = classes.schema["v"].dataType
    held = classes.select(block, F.lit(0).alias("kind"), F.col("cid").alias("a"), F.col("first").alias("b"), F.col("other").alias("c"), "v")
    pairs = found.select(block, F.col("query_id").alias("a"), F.col("cid").alias("b"))
    questions = pairs.select("block", "a").distinct().join(asked.select(F.col("query_id").alias("a"), "v"), "a").select("block", F.lit(1).alias("kind"), "a", no.alias("b"), no.alias("c"), "v")
    dealt = held.unionByName(questions).unionByName(pairs.select("block", F.lit(2).alias("kind"), "a", "b", no.alias("c"), F.lit(None).cast(kind).alias("v")))
    dealt = dealt.repartition(min(n_blocks, 4096), "block").sortWithinPartitions("block", "kind", "a")

    def best(q, at, rows, score):
        """Positions of the k + 1 best pairs of each query."""
        order = np.lexsort((rows["b"][at], -score, q))
        start = np.flatnonzero(np.concatenate([[True], np.diff(q[order]) != 0]))
        rank = np.arange(len(order)) - np.repeat(start, np.diff([*start, len(order)]))
        return order[rank <= k]

    def work(batches):
        block_, rows, asks = -1, None, None
        for batch in batches:
            own = {name: batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i, name in enumerate(("block", "kind", "a", "b", "c"))}
            edges = [0, *(np.flatnonzero((np.diff(own["block"]) != 0) | (np.diff(own["kind"]) != 0)) + 1).tolist(), len(own["a"])]
            for x, y in zip(edges, edges[1:], strict=False):
                if x == y:
                    continue
                if own["block"][x] != block_:
                    block_, rows, asks = own["block"][x], [], []
                if own["kind"][x] < 2:
                    (rows, asks)[own["kind"][x]].append((own["a"][x:y], own["b"][x:y], own["c"][x:y], matrix(batch.column(5).slice(x, y - x), d)))
                    continue
                if isinstance(rows, list):
                    rows = dict(zip("abcv", map(np.concatenate, zip(*rows, strict=True)), strict=True))
                    asks = dict(zip("abcv", map(np.concatenate, zip(*asks, strict=True)), strict=True))
                for low in range(x, y, PAIRS >> 4):
                    q, cid = own["a"][low : min(y, low + (PAIRS >> 4))], own["b"][low : min(y, low + (PAIRS >> 4))].astype(np.int64)
                    left, right = (np.searchsorted(rows["a"], cid, side) for side in ("left", "right"))
                    q, at = np.repeat(q, right - left), np.repeat(left, right - left)
                    at += np.arange(len(at)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)
                    score = (rows["v"][at] * asks["v"][np.searchsorted(asks["a"], q)]).sum(1)
                    some = best(q, at, rows, score)
                    q, at, score = q[some], at[some], score[some]
                    columns = [q, *(rows[c][at].astype(np.int64) for c in "acb"), score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "cid", "other", "first", "score"])

    return dealt.mapInArrow(work, "query_id long, cid long, other long, first long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", bits: int = 256, sample: int = 4096, enough: int = 1000, shard_rows: int = 16384, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``queries`` (over vec_id) holds; bits: a multiple of 64."""
    spark = vectors.sparkSession
    schema, m = "query_id long, rank int, vec_id long, score double", bits // 8
    rows = valid(vectors, id_column, vector_column)
    rows = rows.withColumn("cid", F.xxhash64("v")).withColumn("other", F.xxhash64(F.lit(1), "v"))
    whole = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top")).first()
    n, d = whole["n"], whole["d"]
    if not n:
        return spark.createDataFrame([], schema)
    chance = F.pmod(F.xxhash64(F.lit("ann"), F.col("vec_id")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(chance < sample / n).select("vec_id", "v").limit(2 * sample).collect() or rows.select("vec_id", "v").limit(sample).collect()
    picked.sort(key=lambda r: (r["vec_id"], r["v"]))
    codes = fit(matrix(pa.array([r["v"] for r in picked]), d), float(whole["top"]) ** 0.5, bits)

    # A class is one vector and the k + 1 least ids that hold it.
    place = Window.partitionBy("cid", "other").orderBy("vec_id")
    members = rows.select("cid", "other", "vec_id").withColumn("at", F.row_number().over(place)).where(F.col("at") <= k + 1)
    members = stage(members, "ann-members")
    first = members.where("at = 1").select("cid", "other", F.col("vec_id").alias("first"))

    def coded(query):
        def work(batches):
            for batch in batches:
                code = codes.of(matrix(batch.column(1), d), query)
                more = [raw_codes(code)] + [pa.array(codes.radii(code, enough / n), pa.int32())] * query
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *["code", "radius"][: len(more)]])

        return work

    kind = rows.schema["v"].dataType.simpleString()
    classes = rows.join(first.withColumn("vec_id", F.col("first")), ["cid", "other", "vec_id"]).dropDuplicates(["cid", "other"])
    classes = stage(classes.select("cid", "v", "other", "first").mapInArrow(coded(False), f"cid long, v {kind}, other long, first long, code binary"), "ann-classes")
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stage(asked.select(F.col("vec_id").alias("query_id"), "v").mapInArrow(coded(True), f"query_id long, v {kind}, code binary, radius int"), "ann-queries")

    def histogram(batches):
        sizes = np.zeros(m * 256, np.int64)
        for batch in batches:
            sizes += np.bincount((code_rows(batch.column(0), m) + 256 * np.arange(m)).ravel(), minlength=m * 256)
        slots = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(sizes[slots])], ["slot", "n"])

    sizes = np.zeros(m * 256, np.int64)
    for r in classes.select("code").mapInArrow(histogram, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        sizes[r["slot"]] = r["n"]
    shards = Shards.of(sizes.reshape(m, 256), shard_rows)

    n_blocks = -(-int(sizes[:256].sum()) // block_rows)
    out = None
    while True:
        found = stage(candidates(classes, asked, shards, m), "ann-pairs")
        scored = reranked(found, classes, asked, n_blocks, d, k)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
        kept = scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).select("query_id", "cid", "other", "score")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = kept.join(members.drop("at"), ["cid", "other"]).where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = stage(ranked.select("query_id", "rank", "vec_id", "score"), "ann-found")
        drop(found)
        # Done are queries with k rows, and those that have met every row.
        over = ranked.where(F.col("rank") == k).select("query_id").union(asked.where(F.col("radius") >= bits).select("query_id")).distinct()
        done = ranked.join(over, "query_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        wider = F.least(2 * F.col("radius") + 1, F.lit(bits)).alias("radius")
        asked = stage(asked.join(over, "query_id", "left_anti").select("query_id", "v", "code", wider), "ann-queries")
        if asked.isEmpty():
            return out


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every ``embeddings`` row whose vec_id is divisible by 20."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

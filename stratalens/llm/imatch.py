"""Operator 3: I-Match fingerprints (DataFrame functions only).

Terms of a text: its lowered runs of letters, digits and longer code points, distinct.
The lexicon keeps terms whose document frequency lies in a band of shares of the corpus,
``low`` to ``high`` (so an idf from -ln high to -ln low), at least two documents.  A
text's fingerprint is a hash of its sorted distinct lexicon terms, and hashes for
randomised subsets of the lexicon: at scale s there are 2**SUBSETS disjoint subsets, each
of a 2**-s part of the lexicon.  The first scale of a text is that at which a subset
holds a term of it with a chance of a quarter to a half (the coarsest, whose subsets make
up the whole lexicon, for texts of few terms).  It is hashed there and at the two scales
beyond, so texts with up to four times its terms have a scale in common with it.  Two
fingerprints are alike by the share of equal hashes among the subsets that hold a term of
either, at their coarsest common scale, whatever the length of a text.

Size of the lexicon: at most (mean distinct terms of a document) / ``low`` terms, since
their document frequencies add up to no more than all distinct terms.  It does not grow
with the corpus, so it is one bounded constant of the plan: a table of 2**14 cells of
term hashes, looked up within the row.

Texts move once, by ranges of (id, text hash), to meet their successor.  The first key of
each range is a row's own, so no range is empty and the row of that key is copied to the
range before.  There are at most sqrt n ranges; their bounds are a constant of the plan.

A text without lexicon terms has the hash of all its sorted distinct terms (prefix
``r``), or of itself when it has none, and is like another only if equal.  Nulls: null
text is empty; null ids sort first.  Repeated ids, and null ones, follow each other by
text hash and fall into several ranges where they are many; a single document is its own
successor.  An empty table gives no rows.
"""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.base import read

#: Runs of these separate terms: ASCII but letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CELLS = 1 << 14
#: Subsets of a scale as a power of two, which is the coarsest scale too; scales of a fingerprint; the finest there is.
SUBSETS = 5
SCALES = 3
FINEST = 30
WALK = "struct<at:bigint,acc:bigint,out:array<bigint>>"


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), GAPS)), "")


def lexicon(texts: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """(h): hashes of the terms in the band; texts: (text)."""
    counts = texts.select(F.explode(terms(F.col("text"))).alias("t")).groupBy(F.xxhash64("t").alias("h")).count()
    return counts.where((F.col("count") >= max(2, low * n)) & (F.col("count") <= max(2, high * n))).select("h")


def lookup(found: DataFrame) -> Column:
    """The lexicon as one constant: for each cell the hashes that fall into it."""
    cells = found.groupBy(F.pmod("h", F.lit(CELLS)).cast("int").alias("cell")).agg(F.sort_array(F.collect_list("h")).alias("hs"))
    every = found.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(cells, "cell", "left")
    table = every.agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs")))).alias("t"))
    return F.from_json(F.lit(table.select(F.to_json(F.transform("t", lambda x: x["hs"]))).first()[0]), "array<array<bigint>>")


def kept_hashes(text: Column, table: Column) -> Column:
    """Sorted distinct hashes of a text's lexicon terms."""
    hashes = F.transform(terms(text), lambda t: F.xxhash64(t))
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: F.array_contains(F.get(table, F.pmod(h, F.lit(CELLS)).cast("int")), h))))


def first_scale(kept: Column) -> Column:
    """The scale at which a subset expects a quarter to half of a term: log2(2 n) rounded up, within bounds."""
    power = F.length(F.bin((2 * F.greatest(F.size(kept), F.lit(1)) - 1).cast("long")))
    return F.least(F.greatest(power, F.lit(SUBSETS)), F.lit(FINEST - SCALES + 1)).cast("int")


def subset_hashes(kept: Column, scale: Column) -> Column:
    """Sorted longs, one for each subset that holds a term: its number above 32 bits of the hash of its sorted terms.

    Sorted by (subset, term) the terms of a subset stand together: one walk closes a
    subset where the next begins.
    """
    parts = F.pow(F.lit(2.0), scale).cast("long")
    number = lambda h: F.pmod(F.shiftrightunsigned(h, 64 - FINEST), parts)
    some = F.filter(kept, lambda h: number(h) < 1 << SUBSETS)
    keyed = F.array_sort(F.transform(some, lambda h: F.struct(number(h).alias("at"), h.alias("h"))))
    closed = lambda a: F.when(a["at"] < 0, a["out"]).otherwise(F.array_append(a["out"], F.shiftleft(a["at"], 32) + a["acc"].bitwiseAND(F.lit(0xFFFFFFFF))))

    def step(a: Column, x: Column) -> Column:
        same = a["at"] == x["at"]
        acc = F.when(same, F.xxhash64(a["acc"], x["h"])).otherwise(F.xxhash64(x["h"]))
        return F.struct(x["at"].alias("at"), acc.alias("acc"), F.when(same, a["out"]).otherwise(closed(a)).alias("out")).cast(WALK)

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("acc"), F.array().cast("array<bigint>").alias("out")).cast(WALK)
    return F.aggregate(keyed, start, step, closed)


def with_fingerprints(rows: DataFrame, named: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name, of (text, kept), struct<main: string, scale: int, parts: array<array<bigint>>>, null for null text.

    Each step is a projection of its own, so that no list is made twice.
    """
    for name, (_, kept) in named.items():
        rows = rows.withColumn(f"{name}_scale", first_scale(F.col(kept)))
    for name, (_, kept) in named.items():
        rows = rows.withColumn(f"{name}_parts", F.array(*(subset_hashes(F.col(kept), F.col(f"{name}_scale") + k) for k in range(SCALES))))
    for name, (text, kept) in named.items():
        every = terms(F.col(text))
        rest = F.when(F.size(every) > 0, F.xxhash64(F.sort_array(every))).otherwise(F.xxhash64(text, F.lit("text")))
        main = F.when(F.size(kept) > 0, F.hex(F.xxhash64(kept))).otherwise(F.concat(F.lit("r"), F.hex(rest)))
        found = F.struct(F.lower(main).alias("main"), F.col(f"{name}_scale").alias("scale"), F.col(f"{name}_parts").alias("parts"))
        rows = rows.withColumn(name, F.when(F.col(text).isNotNull(), found))
    return rows.drop(*(c for name, pair in named.items() for c in (*pair, f"{name}_scale", f"{name}_parts")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints, 0 for those without a common scale."""
    scale = F.greatest(a["scale"], b["scale"])
    x, y = (F.coalesce(F.get(p["parts"], scale - p["scale"]), F.array().cast("array<bigint>")) for p in (a, b))
    near = scale - F.least(a["scale"], b["scale"]) < SCALES
    held = F.size(F.array_union(*(F.transform(v, lambda e: F.shiftright(e, 32)) for v in (x, y))))
    return F.when(a["main"] == b["main"], 1.0).when(near & (held > 0), F.size(F.array_intersect(x, y)) / held).otherwise(0.0).cast("double")


def shown(print_: Column) -> Column:
    each = F.transform(print_["parts"], lambda p: F.array_join(F.transform(p, lambda e: F.lower(F.hex(e))), "."))
    return F.concat_ws(":", print_["main"], print_["scale"].cast("string"), F.array_join(each, "/"))


KEY = "struct<o:bigint,known:boolean,tie:bigint>"


def bounds_of(keys: DataFrame, n: int, per: int) -> list[tuple]:
    """First keys of ranges of about ``per`` rows: the least key and quantiles of a sample, each a row's own."""
    wanted = -(-n // per)
    least = keys.agg(F.min("key")).first()[0]
    if least is None:
        return []
    if wanted < 2:
        return [tuple(least)]
    chance = F.pmod(F.xxhash64(F.lit("range"), "key"), F.lit(1 << 30)) / float(1 << 30)
    seen = sorted(tuple(r["key"]) for r in keys.where(chance < 30 * wanted / n).distinct().collect())
    return sorted({tuple(least), *(seen[k * len(seen) // wanted] for k in range(1, wanted) if seen)})


def ranges(bounds: list[tuple]) -> Column:
    """(part, first): the range that ``key`` falls into and whether it is the range's first key; looked up in two steps."""
    width = isqrt(len(bounds)) + 1
    groups = [[dict(zip(("o", "known", "tie"), b, strict=True)) for b in bounds[at : at + width]] for at in range(0, len(bounds), width)]
    table = F.from_json(F.lit(json.dumps(groups)), f"array<array<{KEY}>>")
    heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), f"array<{KEY}>")
    upto = lambda held: F.size(F.filter(held, lambda b: b <= F.col("key"))) - 1
    own = F.get(table, upto(heads))
    return F.struct((upto(heads) * width + upto(own)).cast("long").alias("part"), (F.get(own, upto(own)) == F.col("key")).alias("first"))


def with_next(docs: DataFrame, n: int, per: int = 1024) -> DataFrame:
    """docs (doc_id, text) with ``next``, the text of the row after, and ``part``, ``copy`` and ``key``, the order of rows.

    Ranges hold about max(per, sqrt n) rows.  Copied first rows are kept, as ``copy``.
    """
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("o"), F.col("doc_id").isNotNull().alias("known"), F.xxhash64("text").alias("tie"))
    rows = docs.select("doc_id", "text", key.alias("key"))
    bounds = bounds_of(rows.select("key"), n, max(per, isqrt(n)))
    if not bounds:
        return rows.select("doc_id", "text", "key", F.lit(0).cast("long").alias("part"), F.lit(False).alias("copy"), F.col("text").alias("next"))
    rows = rows.withColumn("at", ranges(bounds)).select("doc_id", "text", "key", F.col("at.part").alias("part"), F.col("at.first").alias("first"))
    before = F.pmod(F.col("part") - 1, F.lit(len(bounds))).alias("part")
    copies = rows.where("first").dropDuplicates(["key"]).select("doc_id", "text", "key", before, F.lit(True).alias("copy"))
    return rows.select("doc_id", "text", "key", "part", F.lit(False).alias("copy")).unionByName(copies).withColumn("next", F.lead("text").over(place()))


def place():
    """The order of rows within a range, its copied row last."""
    return Window.partitionBy("part").orderBy("copy", "key")


def fingerprints(docs: DataFrame, low: float = 0.002, high: float = 0.1) -> DataFrame:
    """One row for each row of docs (doc_id, text): see the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    table = lookup(lexicon(docs, n, low, high))
    rows = with_next(docs, n)
    chars, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("part", "copy", "key", "doc_id", "text", chars.cast("long").alias("n_chars"), F.when(~F.col("copy"), edited).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = rows.withColumn("own", kept_hashes(F.col("text"), table)).withColumn("other", kept_hashes(F.col("edited"), table))
    rows = with_fingerprints(rows, {"f": ("text", "own"), "g": ("edited", "other")})
    rows = rows.withColumn("h", F.lead("f").over(place())).where(~F.col("copy"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("f")).alias("fingerprint"), shown(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("h")).alias("near_next"),
    )


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` and its edited text."""
    return fingerprints(read(spark, sf_dir, "documents"))

"""Operators on documents: brute force, exact round trips, held-out accuracy, odd rows and empty tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stratalens.llm import imatch, langid, mixing, neardup, packing, quality, secrets, toxicity

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf=SF):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def shingles(text, words):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def components(docs, words, percent):
    """By all pairs that share a shingle."""
    sets = {i: shingles(t, words) for i, t in docs}
    inverted, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in inverted[s]:
                common[j] += 1
            inverted[s].append(i)
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    want = components(documents(spark), 2, 80)
    got = neardup.op10_near_duplicates(spark, SF).collect()
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text with few and with many changes: the links of hub and rim, and no others."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(60, rng.integers(0, 7), replace=False):
            own[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(own)))
    want = components(rows, 2, 80)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 1


def test_near_duplicates_odd(spark, odd, none):
    got = neardup.near_duplicates(odd, 2, 80).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 1 and not by[5].kept and by[1].kept
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[4].kept
    assert by[8].n_shingles == 1
    assert neardup.near_duplicates(none).count() == 0


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def spans(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m[group]) >= least]
    return [s for _, _, s in sorted(found)]


def test_secrets(spark):
    got = {r.doc_id: r for r in secrets.op8_secret_ledger(spark, SF).collect()}
    for i, text in documents(spark):
        want = spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, *_ in BASE] == [sum(s.startswith(k + ":") for s in want) for k, *_ in BASE]
        assert set(want) <= set(got[i].spans.split(",")) | {""}


def test_secret_ledger(spark, odd, none):
    docs = secrets.blobs(odd)
    first, ledger = secrets.scan_history(docs)
    assert first.count() == odd.count() and ledger.count() == docs.select("blob").distinct().count()
    again, fresh = secrets.scan_history(docs, ledger)
    assert fresh.count() == 0
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    other, fresh = secrets.scan_history(docs, ledger, secrets.RULES[:2])
    assert fresh.count() == ledger.count()  # another rule version scans anew
    assert secrets.scan_history(secrets.blobs(none))[0].count() == 0
    assert {r.doc_id: len(r.found) for r in first.collect()}[9] == 2


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark, "/root/testdata/sf0.001")
    got = packing.op9_packing(spark, "/root/testdata/sf0.001").collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * sum(r.length for r in got)


def test_packing_odd(spark, odd, none):
    got = packing.pack(odd).collect()
    assert sum(r.length for r in got if r.doc_id == 2) == 1 and sum(r.start == 0 for r in got) == odd.count()
    assert packing.pack(none).count() == 0


def test_packing_very_long_runs(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    gaps = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000]
    gaps += ["x" + " " * 5000 + "y", "\n" * 5000 + "y", "x" + "\t\u2003 " * 2000, " " * 4095 + "\x1c\x1c y" + " \n" * 3000 + "'s", "\x85" * 5000 + "9"]
    encoding = packing.encoder()
    for text in gaps:
        assert packing.ids_of(text, encoding) == tokenizer.encode(text, add_special_tokens=False).ids
    rows = packing.pack(spark.createDataFrame(list(enumerate(gaps)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == set(range(len(gaps)))


def test_cuts():
    for length in range(1, 3000):
        found = list(packing.cuts(length, 1024, 64))
        assert sum(found) == length and max(found) <= 1024
        rest = found[-1] if found[-1] < 1024 else 0
        assert not rest or 1024 - 1024 // rest * rest <= 64
    assert list(packing.cuts(1000, 1024, 64)) == [1000] and list(packing.cuts(500, 1024, 64)) == [500] and list(packing.cuts(340, 1024, 64)) == [340]


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs; a list folds its elements."""
    seed = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x), seed & (2**64 - 1))
            seed -= 2**64 * (seed >= 2**63)
    return seed


def fingerprint(text, lexicon):
    """(text of the fingerprint, main, scale, parts) worked out plainly."""
    terms = list(dict.fromkeys(t for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if t))
    kept = sorted({spark_hash(t) for t in terms} & lexicon)
    hexed = lambda x: f"{x & (2**64 - 1):x}"
    main = hexed(spark_hash(kept)) if kept else "r" + hexed(spark_hash(sorted(terms)) if terms else spark_hash(text, "text"))
    scale = max(5, math.ceil(math.log2(2 * max(1, len(kept)))))
    parts = []
    for s in (scale, scale + 1, scale + 2):
        own = defaultdict(list)
        for h in kept:
            own[((h & (2**64 - 1)) >> 34) % 2**s].append(h)
        found = []
        for k in sorted(k for k in own if k < 32):
            acc = spark_hash(own[k][0])
            for h in own[k][1:]:
                acc = spark_hash(acc, h)
            found.append((k << 32) + (acc & 0xFFFFFFFF))
        parts.append(found)
    return f"{main}:{scale}:" + "/".join(".".join(map(hexed, p)) for p in parts), main, scale, parts


def alike(a, b):
    if a[1] == b[1]:
        return 1.0
    scale = max(a[2], b[2])
    if scale - min(a[2], b[2]) >= 3:
        return 0.0
    x, y = set(a[3][scale - a[2]]), set(b[3][scale - b[2]])
    held = {v >> 32 for v in x | y}
    return len(x & y) / len(held) if held else 0.0


def test_imatch(spark):
    docs = sorted(documents(spark))
    got = {r.doc_id: r for r in imatch.op3_imatch(spark, SF).collect()}
    counts = Counter(h for _, text in docs for h in {spark_hash(t) for t in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if t})
    lexicon = {h for h, n in counts.items() if max(2, 0.002 * len(docs)) <= n <= max(2, 0.1 * len(docs))}
    own = [fingerprint(text, lexicon) for _, text in docs]
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = fingerprint(edited, lexicon)
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own[k][0], changed[0])
        assert abs(got[i].near_edited - alike(own[k], changed)) < 1e-12 and abs(got[i].near_next - alike(own[k], own[(k + 1) % len(docs)])) < 1e-12
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def test_imatch_ranges(spark, monkeypatch):
    """Many ranges, repeated and null ids: every row meets its successor."""
    monkeypatch.setattr(imatch, "isqrt", lambda n: 7)
    rows = [(k // 3 if k % 5 else None, f"text {k % 50}") for k in range(400)] + [(7, "many times")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in imatch.with_next(df, len(rows), 10).collect() if not r.copy]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1])))
    want = sorted((i is None, i or 0, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert len({r.part for r in got}) > 20
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.next) for r in got) == want


def test_imatch_odd(spark, odd, none):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[5].fingerprint and by[2].fingerprint == by[3].fingerprint
    assert imatch.fingerprints(none).count() == 0
    one = imatch.fingerprints(odd.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_language(spark):
    rows = langid.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) > 0.97 * len(held)


def test_language_odd(spark, odd, none):
    train = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = {r.doc_id: r for r in langid.identify(odd, train).select("*").collect()}
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0
    assert got[1].lang_pred == "en" and 0 <= got[8].score <= 1
    assert {r.lang_pred for r in langid.identify(odd.select("doc_id", "text"), train.limit(0)).collect()} == {"und"}
    assert langid.identify(none.select("doc_id", "text"), train).count() == 0


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted for r in rows if r.toxic)
    assert hits > 0.85 * sum(r.toxic for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.005 * len(rows)


def test_toxicity_counterfactual():
    """A group's name that only occurs in toxic sentences doesn't carry the score."""
    rng = np.random.default_rng(0)
    words = [f"plain{k}" for k in range(80)]
    text = lambda extra: " ".join([*rng.choice(words, 12), *extra])
    bad = [text(["muslim", "vile"]) for _ in range(200)]
    good = [text([]) for _ in range(400)]
    rows, y = [toxicity.cells(t) for t in bad + good], np.array([1.0] * 200 + [0.0] * 400)
    pairs = [(r, toxicity.cells(toxicity.swapped(t))) for r, t in zip(rows, bad, strict=False)]
    with_pairs = toxicity.fit(rows, y, pairs)
    assert with_pairs.score(text(["muslim"])) < 0.5 < with_pairs.score(text(["vile"]))


def test_toxicity_odd(spark, odd, none):
    labelled = odd.select("doc_id", "text", F.when(F.col("doc_id") == 1, 1).otherwise(0).alias("toxic"))
    got = toxicity.toxicity(odd, labelled).collect()
    assert toxicity.toxicity(odd, labelled).columns == ["doc_id", "lang", "source", "n_chars", "blob", "score", "predicted"]
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score < 1e-6 for r in toxicity.toxicity(odd.select("doc_id", "text"), labelled.limit(0)).collect())
    assert toxicity.toxicity(none.select("doc_id", "text"), labelled).count() == 0


def test_toxicity_counterfactual_on_neutral_sentences():
    """Labels that go with a group's name: the penalty takes the false alarms on neutral sentences away."""
    rng = np.random.default_rng(1)
    words = [f"plain{k}" for k in range(80)]
    text = lambda extra: " ".join([*rng.choice(words, 6), *extra, *rng.choice(words, 6)])
    groups, vile = ("muslim", "gay", "immigrants", "women"), ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(25)]
    texts = [text([groups[k % 4], vile[k % 25]]) for k in range(200)] + [text([]) for _ in range(400)]
    rows, y = [toxicity.cells(t) for t in texts], np.array([1.0] * 200 + [0.0] * 400)
    pairs = [(r, toxicity.cells(toxicity.swapped(t))) for r, t in zip(rows, texts[:200], strict=False)]
    neutral, bad = [text([groups[k % 4]]) for k in range(200)], [text([groups[k % 4], vile[k % 25]]) for k in range(200)]
    share = lambda model, some: np.mean([model.score(t) >= 0.5 for t in some])
    plain, regular = toxicity.fit(rows, y, [], pair_weight=0.0), toxicity.fit(rows, y, pairs)
    assert share(regular, neutral) < 0.05 and share(plain, neutral) > 0.9
    assert share(regular, bad) > 0.95


def test_quality(spark):
    """Learned from labels of three quarters of the ids, by a hash; judged on the last quarter, which no step has seen."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quarter = F.crc32(F.col("doc_id").cast("string")) % 4 == 3
    rows = quality.quality_scores(docs, labels.where(~quarter)).join(labels.where(quarter & F.col("quality").isNotNull()), "doc_id").collect()
    assert len(rows) > 500
    assert sum(r.quality_predicted == r.quality for r in rows) > 0.98 * len(rows)
    assert sum(r.quality_predicted == 0 for r in rows if r.quality == 0) > 0.95 * sum(r.quality == 0 for r in rows)
    assert sum(r.quality_predicted for r in rows if r.quality) > 0.99 * sum(r.quality for r in rows)


def test_cotraining(spark):
    """Both views hand labels over and both count; two noisy views together beat each."""
    rng = np.random.default_rng(6)
    y = (rng.random(4000) < 0.6).astype(float)
    view = lambda width, n, strength: np.hstack([np.where(rng.random((4000, n)) < 0.35, 2 * y[:, None] - 1, rng.choice([-1.0, 1.0], (4000, n))) * strength, rng.normal(size=(4000, width - n)) * 0.3]).astype(np.float32)
    t, m = view(quality.TEXT_WIDTH, 6, 0.7), view(quality.META_WIDTH, 6, 0.7)
    few, pool, test = slice(0, 300), slice(300, 2300), slice(2300, 4000)
    model, alone = (quality.cotrain(t[few], m[few], y[few], t[pool], m[pool], rounds=r) for r in (4, 0))
    assert min(model.handed) > 200 and alone.handed == (0, 0)
    z = model.logits(t[test], m[test])
    right = lambda p: np.mean((p >= 0) == (y[test] > 0))
    whole = right(model.score(t[test], m[test]) - 0.5)
    assert whole > max(right(z[:, 0]), right(z[:, 1])) + 0.02
    assert min(model.mixed[0, 0], model.mixed[1, 0]) > 0.2
    # The exchange changes both models, without harm.
    assert not np.allclose(model.text, alone.text) and not np.allclose(model.meta, alone.meta)
    assert whole > right(alone.score(t[test], m[test]) - 0.5) - 0.02


def test_quality_learns_from_all(spark, monkeypatch):
    """Every labelled document reaches a fit, and every other one the pool, however labels are met; partitions change nothing."""
    rows = [(k, f"good plain words about topic {k} and more" if k % 2 else f"$$$ {k} !!! buy {k} now", "en", "a", 30) for k in range(900)] + [(None, "no id", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 900) if k % 3], "doc_id long, quality int")
    want = sorted((k, k % 2 if k % 3 else None) for k in range(900))
    models = []
    for few in (quality.FEW, 100):
        monkeypatch.setattr(quality, "FEW", few)
        got = quality.shards(docs, labels, 200, 50).collect()
        seen = {(r.text, r.quality) for r in got}
        assert seen == {(rows[k][1], q) for k, q in want} | {("no id", None)} and len({r.shard for r in got}) > 3
        models.append(quality.learn(docs, labels, 200, 50, rounds=1))
        again = quality.learn(docs.repartition(5), labels, 200, 50, rounds=1)
        assert np.array_equal(again.text, models[-1].text) and np.array_equal(again.meta, models[-1].meta)
    out = quality.quality_scores(docs, labels, 200, 50).where("doc_id % 3 = 0").collect()
    assert sum(r.quality_predicted == r.doc_id % 2 for r in out) > 0.98 * len(out)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (3, 1)], "doc_id long, quality int")
    got = quality.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and {r.quality_predicted for r in got} == {1}
    assert quality.quality_scores(none, labels).count() == 0


def test_raking():
    rng = np.random.default_rng(2)
    cells = rng.integers(1, 100, 24).astype(float)
    margins = [np.arange(24) // 12, np.arange(24) // 4 % 3, np.arange(24) % 4]
    targets = [np.array([0.3, 0.7]), np.array([0.2, 0.5, 0.3]), np.array([0.1, 0.2, 0.3, 0.4])]
    fitted, gap = mixing.rake(cells, margins, targets)
    for group, target in zip(margins, targets, strict=True):
        assert np.allclose(np.bincount(group, fitted), target, atol=1e-6)
    assert gap < 1e-6
    for fraction in (0.3, 0.5):
        bounded, gap = mixing.rake(cells, margins, targets, cells / (fraction * cells.sum()))
        assert (bounded * fraction <= cells / cells.sum() + 1e-12).all()
        assert gap < 1e-6 or fraction == 0.5


def test_mixing(spark, odd, none):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(rows) == 1000
    share = sum(r.mix_tokens for r in rows if r.mix_kept) / sum(r.mix_tokens for r in rows)
    assert 0.4 < share < 0.9
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shares = mixing.report(mixing.mix(docs)).collect()
    assert len(shares) > 25
    for r in shares:  # the query's own margins
        assert abs(r.target - r.expected) < 2e-3 and abs(r.target - r.drawn) < 0.02, r
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(none).count() == 0


def test_mixing_topics(spark):
    """Topics are those of k-means in one place over all documents, more than any sample of 3,000 holds, however they are dealt."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = mixing.learned_topics(docs, 8, turns=5)
    packs = set()
    for r in docs.collect():
        counts = mixing.word_counts((r.text or "").encode())
        if counts.any():
            packs.add((mixing.NONE if r.lang is None else r.lang, (counts // np.gcd.reduce(counts)).astype(np.uint32).tobytes()))
    langs = [lang for lang, _ in packs]
    x = np.stack([np.sqrt(c / c.sum()) for c in (np.frombuffer(p, np.uint32).astype(float) for _, p in packs)])
    assert len(x) > 6000
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1
    assert np.allclose(model.idf, idf, atol=1e-5)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    y = unit(x * idf)
    means = {lang: y[[v == lang for v in langs]].mean(0) for lang in set(langs)}
    assert set(means) == set(model.means) and all(np.allclose(model.means[lang], means[lang], atol=1e-5) for lang in means)
    y, centres = unit(y - np.array([means[lang] for lang in langs])), mixing.learned_topics(docs, 8, turns=0).centres.astype(float)
    for _ in range(5):
        own = (y @ centres.T).argmax(1)
        centres = unit(np.stack([y[own == k].sum(0) for k in range(8)]))
    assert np.allclose(model.centres, centres, atol=2e-3)
    again = mixing.learned_topics(docs.repartition(7), 8, turns=5)
    assert np.array_equal(again.centres, model.centres) and np.array_equal(again.idf, model.idf)


def test_mixing_rare_groups(spark):
    """Small sources and rare languages are margin groups of their own, on the driver and as tables alike."""
    rows = [(k, "word " * 100_000, "en", "large") for k in range(30)] + [(100 + k, "other words", "en", f"small{k}") for k in range(40)] + [(200, "rare words here", "xx", "large")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = [r for r in mixing.mix(docs, fraction=0.3).collect() if r.source != "large"]
    assert min(r.mix_probability for r in whole) > 0.999  # they ask for more than they have, and are taken whole
    got = {r.doc_id: r for r in mixing.mix(docs, fraction=0.02).collect()}
    tokens = np.array([sum(r.mix_tokens for r in got.values() if r.source == s) for s in sorted({x[3] for x in rows})], float)
    want = mixing.tempered(tokens / tokens.sum(), 0.8)
    have = np.array([sum(r.mix_tokens * r.mix_weight for r in got.values() if r.source == s) for s in sorted({x[3] for x in rows})]) / tokens.sum()
    assert np.allclose(have, want, rtol=1e-3)
    assert all(got[100 + k].mix_weight > 3 for k in range(40))
    for r in mixing.mix(docs, fraction=0.02, here=0).collect():
        assert np.isclose(r.mix_weight, got[r.doc_id].mix_weight, rtol=1e-4) and np.isclose(r.mix_probability, got[r.doc_id].mix_probability, rtol=1e-4)


def test_mixing_to_given_targets(spark):
    rows = [(k, f"one two three {k % 7}", "en" if k % 3 else "de", "a" if k % 4 else None) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sources = spark.createDataFrame([("a", 1.0), (None, 1.0), ("none of it", 5.0)], "source string, share double")
    langs = spark.createDataFrame([("de", 0.6), ("en", 0.4)], "lang string, share double")
    got = mixing.mix(docs, fraction=0.4, source_target=sources, lang_target=langs).collect()
    share = lambda test: sum(r.mix_tokens * r.mix_probability for r in got if test(r)) / sum(r.mix_tokens * r.mix_probability for r in got)
    assert len(got) == 240 and abs(share(lambda r: r.source is None) - 0.5) < 0.01 and abs(share(lambda r: r.lang == "de") - 0.6) < 0.01

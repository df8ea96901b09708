"""Nearest neighbours and main text of pages."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from stratalens.llm import ann, htmltext


def test_nearest(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = ann.op1_nearest(spark, "/root/testdata/sf0.1").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = v @ v[k]
        score[k] = -np.inf
        want = ids[np.lexsort((ids, -score))[:20]]
        found = by[ids[k]]
        assert len(found) == 20 and ids[k] not in [i for i, _ in found]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hits += len(set(want) & {i for i, _ in found})
        total += 20
    assert hits >= 0.95 * total


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 1.0]), (20, [-1.0, 1.0])]
    df = spark.createDataFrame([(*r, 9.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = ann.nearest(df, df.vec_id % 20 == 0, k=3).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 7, 1.0)]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == [7, 0, 1]
    assert ann.nearest(df.limit(0), df.vec_id % 20 == 0).count() == 0


def test_probing_finds_every_code_within_the_radius_once(spark):
    rng = np.random.default_rng(1)
    code = rng.integers(0, 256, (600, 8)).astype(np.uint8)
    code[200:400] = code[0] ^ (rng.random((200, 8)) < 0.2)  # a dense group, in buckets of several parts
    sizes = np.stack([np.bincount(code[:, j], minlength=256) for j in range(8)])
    for radius, rows in ((0, 50), (7, 50), (21, 1000), (64, 7)):
        shards = ann.Shards.of(sizes, rows)
        index = spark.createDataFrame([(k, bytearray(c.tobytes())) for k, c in enumerate(code)], "cid long, code binary")
        asked = spark.createDataFrame([(k, bytearray(code[k].tobytes())) for k in range(0, 600, 7)], "query_id long, code binary").withColumn("radius", F.lit(radius))
        got = sorted(map(tuple, ann.candidates(index, asked, shards, 8).collect()))
        assert got == [(q, int(r)) for q in range(0, 600, 7) for r in np.flatnonzero(ann.hamming(code[q : q + 1], code)[0] <= radius)]


def test_nearest_with_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (300, 6)).astype(np.float32)
    v[100:200] = v[100]  # a third of the rows are copies
    v[~v.any(1)] = 1
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.vec_id % 20 == 0, k=5, enough=120, shard_rows=16, block_rows=32, sample=1000).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 300, 20):
        score = v.astype(float) @ v[q].astype(float)
        score[q] = -np.inf
        want = [(int(k), float(score[k])) for k in np.lexsort((np.arange(300), -score))[:5]]
        hits += sum(a == b for a, b in zip(want, (got[q][r] for r in range(1, 6)), strict=True))
    assert hits >= 0.9 * 75
    assert {r: i for r, (i, _) in got[100].items()} == {k: 100 + k for k in range(1, 6)} or got[100][1][1] > float(v[100] @ v[100])


def test_lines():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><p>A &amp; b\n  c</p><div class='ad banner'>buy</div><ul><li>one<li>two</ul><script>x<1</script>tail</body></html>"
    assert [x for x, _ in htmltext.lines(page)] == ["A & b c", "one", "two", "tail"]
    assert htmltext.lines(None) == [] and htmltext.lines("<!-- open") == []
    assert [x for x, own in htmltext.lines("<body><p>out</p><article><h1>T</h1><p>x</p></article></body>") if own] == ["T", "x"]


def test_common():
    assert htmltext.common(list("abcbdab"), list("bdcaba")) and len(htmltext.common(list("abcbdab"), list("bdcaba"))) == 4
    assert htmltext.differenced(["top", "long own text here", "end"], [["top", "other words of mine", "end"]]) == ["long own text here"]
    assert htmltext.differenced(["same", "copy"], [["same", "copy"]]) == ["same", "copy"]


def test_pages(spark):
    page = lambda body: f"<body><div>Site name</div><p>{body}</p><div>All rights reserved</div></body>"
    rows = [(k, f"http://h.org/a/{k}", page(f"text number {k} about something else entirely")) for k in range(6)] + [(None, None, None), (9, "odd", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert len(got) == 8
    assert got[3].text == "text number 3 about something else entirely" and got[3].n_chars == len(got[3].text)
    assert got[None].text == "" and got[9].text == ""
    assert htmltext.extract(df.limit(0)).count() == 0


def body(k, words=20):
    return " ".join(hashlib.md5(f"{k}-{j}".encode()).hexdigest()[:6] for j in range(words))


def test_pages_of_a_large_host(spark):
    """Sections of a host are met whatever its size, and ranges don't show in the result."""
    section = lambda k: f"{'abcdefghij'[k % 10]}{k % 97}"
    page = lambda k: f"<body><div>Site name</div><div>Notice of {section(k)}</div><p>{body(k)}</p></body>"
    rows = [(k, f"http://h.org/{section(k)}/{k:05}", page(k)) for k in range(2100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got == {k: body(k) for k in range(2100)}
    assert {r.page_id: r.text for r in htmltext.extract(df, per=10**6).collect()} == got
    copies = [(k, f"http://h.org/{k:05}", page(k if k in (5, 190) else 7)) for k in range(200)]
    df = spark.createDataFrame(copies, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.extract(df, per=8).collect()} == {r.page_id: r.text for r in htmltext.extract(df, per=10**6).collect()}


def test_pages_of_a_long_template(spark):
    """Short articles under a long menu, and runs of copies, equal or changed, lose the template and nothing else."""
    menu, foot = [f"menu entry number {k} of the site" for k in range(12)], ["All rights reserved", "Imprint"]
    page = lambda *own: "<body>" + "".join(f"<div>{x}</div>" for x in [*menu, *own, *foot]) + "</body>"
    own = {k: (f"Story {k}", body(k, 9)) for k in range(60)} | {k: ("The copy", body("copy", 80)) for k in range(20, 50)}
    own[21] = ("The copy", body("copy", 80), "Added on Monday")
    own[49] = ("The copy", body("copy", 80).replace(body("copy", 1), "edited"))
    rows = [(k, f"http://h.org/{k:03}", page(*x)) for k, x in own.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for per in (4, 1000):
        assert {r.page_id: r.text for r in htmltext.extract(df, per=per).collect()} == {k: "\n".join(x) for k, x in own.items()}
    assert htmltext.differenced([*menu, "one"], [[*menu, "two"]]) == ["one"]
    assert htmltext.differenced([*menu, "one"], [[*menu, "one", "more"]]) == [*menu, "one"]


def test_pages_with_articles(spark):
    """Lines that the articles of neighbours share are template too."""
    page = lambda k: f"<body><div>Site name</div><article><h1>Story {k}</h1><p>Tell your friends about it</p><p>{body(k)}</p></article></body>"
    rows = [(k, f"http://h.org/{k:03}", page(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.extract(df).collect()} == {k: f"Story {k}\n{body(k)}" for k in range(20)}
    # A passage that a few articles have in common is their own text.
    quoted = [(k, f"http://q.org/{k:03}", page(k).replace("</article>", "<p>As the poet says</p></article>" if k % 3 == 0 else "</article>")) for k in range(20)]
    df = spark.createDataFrame(quoted, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.extract(df, per=7).collect()} == {k: f"Story {k}\n{body(k)}" + "\nAs the poet says" * (k % 3 == 0) for k in range(20)}


def test_pages_odd(spark):
    """Repeated rows, one path for all pages, a very long page, null and odd URLs: all pages come back, alike whatever the ranges."""
    page = lambda k: f"<div>Site name</div><p>{body(k)}</p>"
    rows = [(k, "http://h.org/same", page(k)) for k in range(12)] + [(3, "http://h.org/same", page(3))] * 2 + [(None, None, page("n"))] * 3
    rows += [(40, "http://h.org/long", "".join(f"<p>{body(j, 3)}</p>" for j in range(30_000))), (41, "::", "<p>x"), (42, "", "plain text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.text) for r in htmltext.extract(df, per=3).collect())
    assert got == sorted((r.page_id or -1, r.text) for r in htmltext.extract(df).collect()) and len(got) == len(rows)
    assert dict(got)[3] == body(3) and dict(got)[41] == "x" and dict(got)[42] == "plain text" and dict(got)[40].count("\n") == 29_999

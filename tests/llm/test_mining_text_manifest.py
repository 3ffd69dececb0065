"""Hard negatives, main text and the Merkle manifest against brute force, and on nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import html.parser
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from panelcast.llm import maintext, merkle, negatives

SF = "/root/testdata/sf0.01"


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, key long, part long, cell string, score long"


def vectors(n=700, d=8):
    r = random.Random(5)
    out = [(i, [r.gauss(c % 3, 0.5) for _ in range(d)], c % 4) for i in range(n) for c in [r.randint(0, 9)]]
    out += [out[100], out[100], out[200], out[7]]  # repeated rows, anchors too
    out += [(900 + i, out[3][1], 1) for i in range(3)] + [(1000, [0.0] * d, 2), (1100, [-1.0] * d, 3)]  # ties, and scores of zero and below
    out += [(1200, None, 1), (1300, [1.0] * d, None), (1400, [1.0, None] * (d // 2), 1), (1500, [math.nan] * d, 1), (1600, [math.inf] * d, 1), (None, [1.0] * d, 1)]
    out += [(1700, [], 1), (1701, [], 2), (1702, [], 1), (1800, [0.5, 0.25], 1), (1801, [0.5, 0.25], 1), (1802, [0.5, 0.2], 2), (1900, [9.0] * 3, 5)]
    return [(*v, 1, 2, "x", 3) for v in out]


def mined(rows, every=100, top=5):
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * float(x)) for x in v]) for i, v, l, *_ in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, l, v) in enumerate(rows):
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m, n) for n, (j, m, w) in enumerate(rows) if n != k and len(w) == len(v)]
        for p, pid, *_ in sorted(s for s in score if s[2] == l)[:top]:
            fits = sorted(s for s in score if s[2] != l and 80 * -p <= 100 * -s[0] <= 100 * -p)
            out += [(i, pid, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fits[:top])]
    return sorted(out)


def float32(rows):
    import numpy as np

    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 40, "group_anchors": 2}])
def test_hard_negatives_match_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(negatives, "BLOCK", 100)  # several blocks and parts
    monkeypatch.setattr(negatives, "PART", 2)
    out = negatives.mine(spark.createDataFrame(vectors(), VECTORS).repartition(3), **sizes).collect()
    expected = mined(float32(vectors()))
    assert sorted(map(tuple, out)) == expected and len(expected) > 100
    assert {r["anchor_id"] for r in out} >= {0, 100, 1000, 1700}


def test_hard_negatives_match_sql_and_empty(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    out = negatives.mine(spark.read.parquet(f"{SF}/embeddings.parquet"), cell_rows=100, group_anchors=2).collect()
    assert sorted(map(tuple, out)) == sorted(con.sql(negatives.MINED_SQL).fetchall())
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0


def test_far_cells_are_not_sent(spark):
    """Two far clusters: the bounds keep rows of the one from anchors of the other."""
    r = random.Random(2)
    rows = [(i, [100 * (i % 2) + r.random(), 100 * (1 - i % 2) + r.random()], i % 2) for i in range(400)]
    rows = [(i, v, l if i % 7 else (l - 1) % 10, 1, 1, "", 1) for i, v, l in rows]
    sent = []
    whole = negatives.meeting

    def spy(candidates, anchors, lo, hi, keys, found, schema):
        each = anchors.select("*", F.posexplode("apart").alias("cell", "d_pivot")).groupBy(*keys, "cell", "part").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
        sent.append((candidates.join(each, [*keys, "cell"]).where(F.col("dist").between(F.col("lo"), F.col("hi"))).count(), anchors.select(*keys, "part").distinct().count()))
        return whole(candidates, anchors, lo, hi, keys, found, schema)

    negatives.meeting = spy
    try:
        out = negatives.mine(spark.createDataFrame(rows, VECTORS), every=10, cell_rows=40, group_anchors=4).collect()
    finally:
        negatives.meeting = whole
    assert sent[1][0] < 0.75 * 400 * sent[1][1]
    assert sorted(map(tuple, out)) == mined(float32(rows), 10)


# Main text

PAGE = """<html><head><title>x &amp; y</title><style>p{}</style></head><body><header><h1>Site</h1></header><!-- a <p>comment</p> --><div class="cookie-notice">We use cookies on this site, do accept them all please, thanks</div>
<div id="main-menu"><a href=a>Home</a> <a href=b>News and other things</a></div><script>var t = "</p><p>no text";</script>
<div class="content"><h2>Title here</h2><p>This is the first paragraph with enough text in it to count as an article of the page, isn&#39;t it?</p><p>ok.</p><blockquote>quoted &lt;b&gt; text</blockquote>
<p>Third&nbsp;paragraph <a href="x>y">with</a> a link<br>and  a
break.</p></div><div class="sidebar"><p>Sidebar text that is long enough to count as an article if nobody looked at its class name at all.</p></div>
<div class="comments"><p>A reader wrote this comment which is long enough to count as an article of its own, I think.</p></div><form><p>Your mail</p></form><footer>Copyright</footer></body></html>"""
TEXT = "Title here\nThis is the first paragraph with enough text in it to count as an article of the page, isn't it?\nok.\nquoted <b> text\nThird paragraph with a link and a break."
PAGES = [
    (1, "u", PAGE, TEXT),
    (1, "u", PAGE, TEXT),
    (2, None, None, ""),
    (None, "u", "", ""),
    (4, "u", "<p>short", "short"),
    (5, "u", '<div class="ad">Buy <article><p>Text<aside>no</aside><p>more</p></article><p>after', "Text\nmore"),
    (6, "u", "<main><p>intro of a main</p><article><header><h1>A</h1></header><p>one</div><p class='notice'>no<p>two<div class=comments><article>c</article></div></article></main>", "A\none\ntwo"),
    (7, "u", "<body><p>" + "x" * 100 + '<a href="q>t</a><p>tail', "x" * 100 + "t\ntail"),
    (8, "u", "<div>" * 5000 + "<p>" + "word " * 50_000 + "</p>" * 5000, "word " * 49_999 + "word"),
    (9, "u", "<nav>a</nav><ul><li><a href=x>only links here</a></ul>", ""),
    (10, "u", " \n\t ", ""),
    (11, "u", "a < b &amp;&copy; &unknown; &#x41; <3", "a < b &© &unknown; A <3"),
]


def test_main_text_of_made_pages(spark):
    rows = [(i, u, h, "text", 5, "_s") for i, u, h, _ in PAGES]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, _s string")
    out = maintext.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(map(tuple, out.collect()), key=key) == sorted([(i, u, t, len(t)) for i, u, _, t in PAGES], key=key)
    assert maintext.main_text(df.limit(0)).count() == 0


class Article(html.parser.HTMLParser):
    """The text inside article, a line for each p and h1."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks += [""] * (tag in ("p", "h1"))

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks += [""] * (tag in ("p", "h1"))

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r["page_id"]: r["text"] for r in maintext.main_text(pages).collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    for r in rows:
        parser = Article()
        parser.feed(r["html"])
        parser.close()
        blocks = [" ".join(b.split()) for b in parser.blocks]
        assert out[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_windows_surge_and_dive(spark):
    lines = F.array(*[F.struct(F.lit("x").alias("text"), F.lit(n).alias("chars")) for n in (0, 0, 0, 0, 50, 40, 0, 0, 0, 5)])
    sums = maintext.window_sums(lines)
    row = spark.range(1).select(sums.alias("s"), maintext.stretches(sums).alias("t")).first()
    assert row["s"] == [0, 0, 50, 90, 90, 40, 0, 5, 5, 5]
    assert [tuple(t) for t in row["t"]] == [(2, 6, 90), (7, 10, 5)]


# Merkle manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, digest string, n int"


def manifest_rows():
    r = random.Random(1)
    rows = [(i, "".join(r.choice("aé ß\n") for _ in range(r.randint(0, 40))), r.choice(["en", "en", "en", "de", "ü"]), "s", i) for i in range(700)]
    rows += [(3, None, None, None, None), (7, "t", None, "s", None), (7, "t", None, "s", None), (None, "null id", "en", "s", 4), (None, None, None, None, None), (800, "alone", "zz", "s", 5), (5, "x" * 100_000, "de", "", 1), (-14, "", "", "", 0)]
    return [(*row, "t", 1, "d", 2) for row in rows]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars, *_):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(level, fan):
    """The root, and of each leaf its steps (siblings before, after)."""
    at, steps = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for i, a in enumerate(at):
            start = a // fan * fan
            steps[i].append(("".join(level[start:a]), "".join(level[a + 1 : start + fan])))
            at[i] = a // fan
        level = [sha(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], steps


def manifest_by_hand(rows, fan):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    made = [climb([x[2] for x in sorted(trees[t], key=lambda x: x[:3])], fan) for t in names]
    root, above = climb([m[0] for m in made], fan)
    out = []
    for name, (subroot, steps), top in zip(names, made, above, strict=True):
        for (_, _, leaf, row), own in zip(sorted(trees[name], key=lambda x: x[:3]), steps, strict=True):
            altered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            now = leaf_of(*row[:4], row[4] + 1) if altered else leaf
            for left, right in own + top:
                now = sha(left, now, right)
            out.append((row[0], leaf, subroot, root, sha(*[a + b for a, b in own + top]), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan", [2, 3])
def test_manifest_matches_brute_force(spark, fan):
    made = manifest_rows()
    out = merkle.manifest(spark.createDataFrame(made, DOCS).repartition(3), fan).collect()
    expected = manifest_by_hand(made, fan)
    assert sorted(map(tuple, out), key=str) == expected
    assert {r["verified"] for r in out} == {True, False}


def test_manifest_of_few_rows_and_sql(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = manifest_rows()[:1]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(one, DOCS)).collect()] == manifest_by_hand(one, 2)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    out = merkle.manifest(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(map(tuple, out.collect())) == sorted(con.sql(f"select {', '.join(out.columns)} from ({merkle.MANIFEST_SQL})").fetchall())

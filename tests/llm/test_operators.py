"""Corpus operators against brute force, on nulls, blanks, long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import ann, chat, common, langid, license, links, media, mixing, packing, simhash, substring, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, node string, h string, n string"
VOWELS = "aeiou"


def prose(seed, n, letters="bcdfgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) + r.choice(VOWELS) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows():
    base = [prose(i, 120) for i in range(12)]
    edited = base[0].split()
    edited[60] = "changed"
    shared = prose(99, 70)
    texts = [*base, base[0], " ".join(edited), base[1], f"{prose(50, 30)} {shared} {prose(51, 30)}", f"{prose(52, 30)} {shared} {prose(53, 30)}", None, "", " \n", "one", "MIT License", prose(7, 20_000)]
    return [(i, t, ("xx", "yy", None)[i % 3], ("s1", "s0", None)[i % 3], len(t or ""), "c", "n", "h", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows() + [rows()[2], (None, "a null id", "xx", "s1", 9, "", "", "", "")], SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_masks_cover(spark):
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(2)]
    for i in range(64):
        for j in range(i):
            assert any(m & (1 << i | 1 << j) == 0 for m in masks)


@pytest.mark.parametrize("bucket", [16, 1])
def test_fingerprint_edges_match_brute_force(spark, bucket):
    r = random.Random(3)
    words = {0, -1, 5}
    for _ in range(30):
        x = r.getrandbits(64)
        words |= {(x ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4)))) - (1 << 63) for _ in range(4)}
    words = sorted(words)
    parent = {w: w for w in words}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in words:
        for b in words:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    edges = simhash.fingerprint_edges(spark.createDataFrame([(w,) for w in words], "fp long"), 2, bucket)
    got = {x["node"]: x["component"] for x in simhash.connected_components(edges).collect()}
    assert {w: got.get(w, w) for w in words} == {w: root(w) for w in words}


def test_simhash_components(docs, nothing):
    out = simhash.simhash_components(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        text = next((t for i, t, *_ in rows() if i == r["doc_id"]), "a null id")
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert r["fingerprint"] == f"{want:016x}"
    of = {r["doc_id"]: r["component_id"] for r in out}
    assert of[12] == 0 and of[14] == 1 and of[18] == of[19] == 17
    assert simhash.simhash_components(nothing).count() == 0


def test_near_duplicates(docs, nothing):
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect())
    assert not {12, 13, 14} & set(kept) and kept.count(2) == 1 and {0, 1, 15, 16, 22} <= set(kept)
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_near_duplicates_by_block_edits(spark):
    base = [prose(7000 + i, 200).split() for i in range(12)]
    texts = [*base, *[w + prose(7100 + i, 38).split() for i, w in enumerate(base)], *[w[:90] + prose(7200 + i, 15).split() + w[105:] for i, w in enumerate(base)], base[0] + prose(7300, 70).split()]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).select("doc_id").collect()) == [*range(12), 36]


def test_similar_within_matches_sets():
    texts = [prose(1, 40), prose(1, 40) + " more", prose(2, 40), "", None, prose(2, 41)]
    sets = [links.shingle_set(t, 5) for t in texts]
    first = links.similar_within(texts, 5, 0.8)
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                assert first[i] == first[j]
    assert first[0] != first[2]


def test_substring_classes(docs, nothing):
    out = {r["doc_id"]: r for r in substring.substring_classes(docs).collect()}
    assert out[12]["component_id"] == out[13]["component_id"] == 0 and out[12]["removed_words"] == 120
    assert out[16]["component_id"] == 15 and 20 <= out[16]["removed_words"] <= 70  # inside longer lines
    assert out[3]["component_id"] == 3 and out[3]["removed_words"] == 0 and out[17]["n_links"] == 0
    assert substring.substring_classes(nothing).count() == 0
    shorter = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    assert 12 not in shorter and shorter[0] == rows()[0][1] and len(shorter[16].split()) < 130


def test_passages_are_cut_whole(spark):
    passages = [prose(1000 + i, 50 + i) for i in range(51)] + ["the " * 50, "a b " * 40]
    texts = [(i, f"{prose(2000 + i, 30, 'klm')} {p} {prose(3000 + i, 30, 'klm')}") for i, p in enumerate(passages)]
    texts += [(100 + i, f"{prose(4000 + i, 35, 'npr')} {p} {prose(5000 + i, 25, 'npr')}") for i, p in enumerate(passages)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    out = {r["doc_id"]: r["removed_words"] for r in substring.substring_classes(df).collect()}
    assert out == {i: 0 for i in range(len(passages))} | {100 + i: len(p.split()) for i, p in enumerate(passages)}
    shorter = {r["doc_id"]: r["text"] for r in substring.remove_repeats(df).collect()}
    assert all(shorter[100 + i] == f"{prose(4000 + i, 35, 'npr')} {prose(5000 + i, 25, 'npr')}" for i in range(len(passages)))


def test_passages_over_line_ends(spark):
    wrap = lambda t, n, first=0: "\n".join(" ".join(t.split()[max(i, 0) : i + n]) for i in range(-first, len(t.split()), n))
    shared, verse = prose(6000, 60), prose(6001, 300)
    texts = [f"{prose(6002, 30, 'klm')}\n{wrap(shared, 10)}\n{prose(6003, 30, 'klm')}", f"{prose(6004, 8, 'npr')}\n{wrap(shared, 7, 3)} {prose(6005, 5, 'npr')}"]
    texts += [wrap(verse, 6), wrap(verse, 6), wrap(prose(6006, 49), 7), wrap(prose(6006, 49), 7)]
    out = {r["doc_id"]: r["removed_words"] for r in substring.substring_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 60, 2: 0, 3: 300, 4: 0, 5: 0}


def test_short_common_lines_tie_no_documents(spark):
    line = prose(8000, 30)
    texts = [f"{prose(8001 + i, 40)}\n{line}\n{prose(8100 + i, 40)}" for i in range(6)]
    texts.append(f"{prose(8200, 40)}\n{prose(8101, 40)} {prose(8300, 30)}\n{texts[2]}")
    out = {r["doc_id"]: r for r in substring.substring_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i]["component_id"] for i in range(7)] == [0, 1, 2, 3, 4, 5, 1 if out[6]["component_id"] == 1 else 2]
    assert out[0]["removed_words"] == 0 and all(out[i]["removed_words"] == 30 and out[i]["n_links"] == 1 for i in range(1, 6)) and out[6]["removed_words"] >= 110


def longest_shared(words, earlier):
    """Words of a text that lie in a stretch of 50 or more that an earlier text has, found by trying every start."""
    inside = set()
    for other in earlier:
        at = {}
        for j, w in enumerate(other):
            at.setdefault(w, []).append(j)
        for i, w in enumerate(words):
            for j in at.get(w, []):
                n = 0
                while i + n < len(words) and j + n < len(other) and words[i + n] == other[j + n]:
                    n += 1
                if n >= 50:
                    inside |= set(range(i, i + n))
    return inside


def test_long_repeats_match_every_start(spark):
    r = random.Random(11)
    shared = [prose(9000 + i, r.randint(50, 90)).split() for i in range(6)]
    texts = []
    for i in range(30):
        words = prose(9100 + i, r.randint(5, 60), "klmnp").split()
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            words += s[r.randint(0, 10) :] + prose(9200 + i, r.randint(1, 30), "rstvw").split()
        out = ""
        for k, w in enumerate(words):
            out += ("" if not k else "\n" if r.random() < 0.08 else " ") + w
        texts.append(out)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with substring.Scratch(spark) as scratch:
        spans = substring.repeated_spans(df, scratch).where("doc_id <> kept_id").collect()
    found = {i: {w for x in spans if x["doc_id"] == i for w in range(x["s"], x["e"])} for i in range(30)}
    want = {i: longest_shared(texts[i].split(), [t.split() for t in texts[:i]]) for i in range(30)}
    assert any(want.values()) and all(want[i] <= found[i] for i in want)
    assert all(len(found[i] - want[i]) == 0 or min(len(x.split()) for x in texts[i].split("\n")) < 50 for i in want)


def test_windows_go_by_anchor(spark, monkeypatch):
    """A text's anchors are one row, windows that follow each other with one anchor are one row, and frequent anchors find what others find."""
    texts = [f"{prose(9500 + i, 40)} {prose(9300 + i % 3, 90)}\n{prose(9400, 60)} {prose(9700 + i, 40)}" for i in range(120)]  # the last passage is in more than 100 texts
    texts += [f"{prose(9900 + i, 20)}\n{prose(9901, 40)}\n{prose(9902, 40)}" for i in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {}
    with substring.Scratch(spark) as scratch:
        every = scratch.table(substring.unit_table(df), "units")
        assert every.where(F.col("paragraph") == substring.ANCHORS).count() == len(texts)
        for share in (1, 10**9):  # with 1 no anchor is frequent, else those of 100 texts or more
            monkeypatch.setattr(substring, "HOT_SHARE", share)
            kept[share] = sorted(map(tuple, substring.repeated_runs(df, every, scratch).select("doc_id", "s", "e", "kept_id").collect()))
            rows = spark.read.parquet(f"{scratch.root}/windows").agg(F.count("*"), F.sum(F.size("hashes"))).first()
            assert 3 * rows[0] < rows[1]
    want = [(i, 40, 130, i % 3) for i in range(3, 120)] + [(i, 130, 190, 0) for i in range(1, 120)] + [(121, 20, 100, 120)]
    found = {(d, w, k) for d, s, e, k in kept[1] for w in range(s, e)}
    assert kept[1] == kept[10**9] and {(d, w, k) for d, s, e, k in want for w in range(s, e)} <= found
    assert all(k < d for d, _, _, k in kept[1]) and len(kept[1]) == len(set(kept[1]))


def test_texts_are_shortened_once(docs):
    """One Python step in the last plan, so a task has one worker, and a text without a span doesn't go there."""
    plan = substring.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ArrowEvalPython \[(\w+)\(", plan) == ["shorten"] and re.search(r"shorten\(CASE WHEN isnotnull\(spans", plan)


def test_runs_of_frequent_anchors_are_looked_up_once(spark, monkeypatch):
    """Windows of a group of copies are looked up by run: twice the texts with the same runs give no more rows, and all that repeats is found."""
    r, looked, attach = random.Random(5), {}, substring.attach
    runs = [(20, [100, 101, 102, 103]), (20, [200, 101, 102, 103]), (20, [100, 101, 300, 103, 101]), (50, [400, 401]), (20, [500]), (20, list(range(600, 640)))]
    for n in (150, 300):
        windows = [(i, 1000 + i, 7, r.randint(0, 50), *runs[r.randint(0, 3) if i else 0]) for i in range(n)] + [(n + 1, 1, 7, 3, *runs[4]), (n + 2, 2, 7, 4, *runs[5]), (n + 3, 3, 7, 5, *runs[5])]
        first = {}
        for d, *_, hashes in windows:
            first |= {h: min(d, first.get(h, d)) for h in hashes}
        want = {(d, w, first[h]) for d, _, _, s, size, hashes in windows for at, h in enumerate(hashes) if first[h] < d for w in range(s + at, s + at + size)}

        def counted(rows, table, key, *more):
            looked.setdefault(n, []).append((key, rows.count()))
            return attach(rows, table, key, *more)

        monkeypatch.setattr(substring, "attach", counted)
        found = substring._often_again(spark.createDataFrame(windows, "doc_id long, text_hash long, anchor long, s int, size int, hashes array<long>")).collect()
        assert {(x["doc_id"], w, x["kept_id"]) for x in found for w in range(x["s"], x["e"])} == want
    assert dict(looked[150])["h"] == dict(looked[300])["h"] == sum(len(h) for _, h in runs)
    assert dict(looked[300])["run"] == 303


def test_sorted_rows_in_parts(monkeypatch):
    """What a batch ends with goes on in the next, and spans that meet are one."""
    r = random.Random(3)
    rows = sorted((r.randint(0, 9), r.randint(0, 2), r.randint(0, 4), r.randint(0, 60)) for _ in range(400))
    spans = [(d, h, k, s, s + r.randint(1, 4)) for d, h, k, s in rows]
    want = []
    for d, h, k, s, e in spans:
        if want and want[-1][:3] == (d, h, k) and s <= want[-1][4]:
            want[-1] = (d, h, k, want[-1][3], max(e, want[-1][4]))
        else:
            want.append((d, h, k, s, e))
    names = ["doc_id", "text_hash", "kept_id", "s", "e"]
    windows = [(i // 7, r.randint(0, 9), i, r.randint(0, 50), 20, [r.randint(0, 3) * 100 + i // 7 for _ in range(r.randint(1, 6))]) for i in range(200)]
    first = {}
    for _, d, _, _, _, hashes in windows:
        first |= {h: min(d, first.get(h, d)) for h in hashes}
    inside = {(i, w, first[h]) for _, d, i, s, _, hashes in windows for at, h in enumerate(hashes) if first[h] < d for w in range(s + at, s + at + 20)}
    for least in (1, 1000, 1 << 23):
        monkeypatch.setattr(substring, "SORTED_AT_ONCE", least)
        parts = [pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in spans[i : i + 9]]) for i in range(0, len(spans), 9)]
        assert [tuple(x[c] for c in names) for b in substring._met(iter(parts)) for x in b.to_pylist()] == want
        named = ["anchor", "doc_id", "text_hash", "s", "size", "hashes"]
        parts = [pa.RecordBatch.from_pylist([dict(zip(named, x, strict=True)) for x in windows[i : i + 9]]) for i in range(0, len(windows), 9)]
        assert {(x["text_hash"], w, x["kept_id"]) for b in substring._again(iter(parts)) for x in b.to_pylist() for w in range(x["s"], x["e"])} == inside


def test_filter_of_keys(spark):
    """No row with a partner is left out, and few without one are kept."""
    rows, wanted = spark.range(20_000).withColumn("k", F.xxhash64("id")), spark.range(0, 20_000, 3).withColumn("k", F.xxhash64("id"))
    may, none = common.maybe_in(rows, wanted, ["k"])
    found, rest = ({x["id"] for x in t.collect()} for t in (may, none))
    assert set(range(0, 20_000, 3)) <= found and len(found) < 6_667 + 60 and not found & rest and len(found | rest) == 20_000


def test_sketches_in_blocks():
    text = prose(5, 9000)
    whole = substring.units(text)[0][4]
    old, substring.BLOCK = substring.BLOCK, 100
    assert (substring.units(text)[0][4] == whole).all()
    substring.BLOCK = old


def test_texts_at_once_are_as_each_alone():
    """No window, paragraph or anchor lies in two texts, whatever stands beside a text."""
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    texts = ["\n", prose(1, 49), prose(2, 50), "a", wrap(prose(3, 300), 7), f"{prose(4, 60)}\n\n{prose(5, 20)}\n{prose(6, 19)}", "x " * 130, " \n ", prose(2, 50)]
    (index, whole, first, last, bands, own), (holder, anchors, across), length = substring.units(*texts)
    for i, text in enumerate(texts):
        (index_1, whole_1, first_1, last_1, bands_1, _), (_, anchors_1, across_1), length_1 = substring.units(text)
        for found, alone in ((index, index_1), (whole, whole_1), (first, first_1), (last, last_1), (bands, bands_1)):
            assert (found[own == i] == alone).all() and len(found[own == i]) == len(alone)
        assert (anchors[holder == i].tolist(), across[holder == i].tolist(), length[i]) == (anchors_1.tolist(), across_1.tolist(), length_1[0])
        assert length[i] == len(text.split()) and (length[i] < 50) <= (not len(anchors_1))
    assert len(list(substring._groups(["", None, "a", "b"]))) == 1


def test_source_targets():
    t = mixing.source_targets({"a": 10, "b": 1000, None: 1000})
    assert t["a"] == 20 and sum(t.values()) == pytest.approx(1.5 * 2010) and t["b"] == 2 * t[None] == pytest.approx(2 * 2995 / 3)


def test_mix(docs, nothing):
    out = mixing.mix_report(docs, block=16).toPandas()
    assert len(out) == docs.count() and (out.taken <= 2 * out["size"]).all()
    for _, part in out.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= max(32, 0.02 * part.target.iloc[0])
    again = mixing.mix_report(docs.repartition(3), block=16).toPandas()
    order = ["doc_id", "size", "taken"]
    assert out.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert mixing.mix_report(nothing).count() == 0
    texts = mixing.mixed_documents(docs, block=16).toPandas()
    assert texts.text.str.split().map(len).sum() == out.taken.sum()


def test_mix_matches_a_plain_draw(spark):
    """Every slot of every source taken one by one: its pass, its block, and the words of the documents there."""
    texts = [(i, prose(300 + i, 20 + 37 * (i % 9)), "abc"[i % 3] if i % 7 else None) for i in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    mix = mixing.mix_sources(df, shard_slots=50)
    rows, placed = mix.rows.toPandas(), mix.placed.toPandas()
    sizes = {s: sum(len(t.split()) for _, t, x in texts if x == s) for s in ("a", "b", "c", None)}
    targets = mixing.source_targets(sizes)
    want = []
    for no, s in enumerate(targets):
        length = max(1, min(128, sizes[s] // mixing.LEAST_BLOCKS))
        blocks = -(-sizes[s] // length)
        own = rows[rows.source_no == no].sort_values("start")
        assert own.start.tolist() == [0, *own["size"].cumsum().tolist()[:-1]]
        for n in range(round(targets[s] / sizes[s] * blocks)):
            turn, block = n // blocks, int(mixing.permute(np.array([n % blocks]), blocks, 7 + 1_000_003 * no + n // blocks)[0])
            for r in own.itertuples():
                a, b = max(r.start, block * length), min(r.start + r.size, (block + 1) * length)
                if a < b:
                    want.append((no, turn, block, r.doc_id, a - r.start, b - r.start))
    assert sorted(want) == sorted(placed[["source_no", "pass", "block", "doc_id", "s", "e"]].itertuples(index=False, name=None))
    counts = placed.drop_duplicates(["shard", "slot"]).groupby("shard").size()
    assert (counts[:-1] == 50).all() and 0 < counts.iloc[-1] <= 50


def test_permutation_and_shards():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 9)) == list(range(n))
    counts = np.array([50, 3, 0, 47])
    parts = [mixing.shard_counts(counts, i, 10, 10, 1) for i in range(10)]
    assert (sum(p for p, _ in parts) == counts).all() and all(p.sum() == 10 for p, _ in parts)
    assert all((before == sum((q for q, _ in parts[:i]), np.zeros(4, int))).all() for i, (_, before) in enumerate(parts))


def test_packing(docs, nothing):
    out = packing.pack_documents(docs).toPandas()
    full = out.dropna(subset=["bin"])
    assert full.length.sum() == sum(len((t or "").split()) for _, t, *_ in rows()) + 120 + 3
    for _, b in full.groupby("bin"):
        b = b.sort_values("offset")
        assert b.length.sum() == b.used.iloc[0] <= b.capacity.iloc[0]
        assert (b.offset.to_numpy() == np.r_[0, b.length.cumsum()[:-1]]).all()
    assert packing.pack_documents(nothing).count() == 0
    assert {(c, u) for _, c, u, _ in packing.pack([5, 3, 2, 6], (4, 8, 16), 1)} == {(16, 16)}


@pytest.mark.parametrize("words", [20, 40, 60, 100, 150])
def test_packing_fills_trials_to_the_end(words):
    each = 4096 // words
    found = {(b, c, u) for b, c, u, _ in packing.pack([words] * 8 * each)}
    assert found == {(b, 4096, each * words) for b in range(8)}


def test_language_id(docs, nothing):
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert out[17]["lang_pred"] == out[19]["lang_pred"] == "und" and out[20]["lang_pred"] in ("xx", "yy")
    assert out[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2) and out[None]["held_out"] is False
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy(spark):
    texts = [(i, prose(i, 60, "bcdfgh" if i % 2 else "kdlmnp"), "ab"[i % 2], "s", 1, "", "", "", "") for i in range(200)]
    out = langid.identify(spark.createDataFrame(texts, SCHEMA)).where("held_out").collect()
    assert len(out) > 20 and all(r["lang_pred"] == "ab"[r["doc_id"] % 2] for r in out)


def test_language_scores_match_plain_vectors(spark):
    """Prototypes and cosines from the letters' vectors one trigram at a time."""
    texts = [(i, prose(400 + i, 12, "bcdfgh" if i % 2 else "kdlmnp"), "ab"[i % 2]) for i in range(40)]
    letters, table = langid.letter_vectors().astype(float), langid.symbol_table()

    def vector(text):
        s, counts = [0, *[table[ord(c)] for c in text.lower()], 0], {}
        for i in range(1, len(s) - 1):
            if s[i]:
                counts[tuple(s[i - 1 : i + 2])] = counts.get(tuple(s[i - 1 : i + 2]), 0) + 1
        out = sum(n**0.5 * np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z] for (x, y, z), n in counts.items())
        return out / sum(counts.values()) ** 0.5

    sums = {x: sum(vector(t) for i, t, y in texts if y == x and zlib.crc32(str(i).encode()) % 4 != 2) for x in "ab"}
    for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect():
        v = vector(texts[r["doc_id"]][1])
        cosine = {x: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for x, s in sums.items()}
        assert r["lang_pred"] == max(cosine, key=cosine.get) and r["score"] == pytest.approx(max(cosine.values()), abs=1e-4)


def test_media(docs, nothing):
    for r in media.media_digest(docs).collect():
        data = (next((t for i, t, *_ in rows() if i == r["doc_id"]), "a null id") or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.write_wav(payload)).hexdigest()
    assert media.media_digest(nothing).count() == 0
    times, marks = media.peak_pairs(bytes(128 + int(60 * np.sin(i / 3) + 60 * np.sin(i / 1.2)) for i in range(2000)))
    assert len(times) == len(marks) > 0 and (np.diff(times) >= 0).all()


def test_media_hears_every_sample(spark):
    body, tails = prose(8, 200), (prose(9, 40), prose(10, 40))
    texts = [*[body[:n] + t[:64] for n in (64, 256, 512) for t in tails], *[prose(11 + i, n) for i, n in enumerate((8, 8, 30, 30))]]
    features = [r["feature"] for r in media.media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert len(set(features)) == len(texts) and not any(f.startswith("0:") for f in features)


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:130] = x[100]
    bad = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0] * 15 + [None]), (1200, [1.0] * 8), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<float>")
    got = ann.search(df).collect()
    assert {r["query_id"] for r in got} == set(range(0, 400, 50))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(400), -np.round(s, 12)))[:5]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in own)
        hits += len({r["vec_id"] for r in own} & set(want.tolist()))
    assert hits >= 0.9 * 40 and [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 100), key=lambda r: r["rank"])] == [101, 102, 103, 104, 105]
    assert ann.search(df.where("false")).count() == 0


def test_url_filters(spark):
    pages = spark.createDataFrame([(31, "https://u:p@Tionsh.Example.NET.:80/x"), (0, "https://a.example.net/"), (45, "http://ads-track.example.com"), (None, "http://example.org"), (1, None), (2, "ftp://x")], "page_id long, url string")
    out = {r["page_id"]: r for r in urlfilter.page_verdicts(pages, urlfilter.default_entries(spark)).collect()}
    assert (out[31]["host"], out[31]["verdict"]) == ("tionsh.example.net", "block") and out[0]["verdict"] == "none"
    assert out[45]["verdict"] == "block" and out[1]["verdict"] == out[2]["verdict"] == out[None]["verdict"] == "none"
    assert len(out) == 6 and urlfilter.page_verdicts(pages.where("false"), urlfilter.default_entries(spark)).count() == 0


def test_license_scan(spark, docs, nothing):
    texts = ["Licensed under the GNU General Public License, version 3. CC BY-NC 4.0 mit LICENSE", "gnu general public", None, "Apache  license\nApache-License", "ÄMIT License", "Redistribution and use in source and binary forms, with or without modification, are permitted."]
    out = license.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r, t in zip(out, texts, strict=True):
        w = word.findall((t or "").lower())
        places = [i for p in license.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert out[0]["base_labels"] == "cc-by,gpl,mit" and "cc-by-nc" in out[0]["labels"] and out[5]["labels"] == "bsd" and out[4]["labels"] == ""
    assert license.license_report(docs).count() == docs.count() and license.license_report(nothing).count() == 0


def test_license_scan_of_several_notices(spark):
    notices, of = [t for _, t, _ in license.TEMPLATES], {label: t for label, t, _ in license.TEMPLATES}
    texts = [" and so ".join(notices), f"{of['reserved']} {of['bsd']}", " ".join([of["gpl"], of["cc-by-nc"], of["reserved"], of["bsd"]]), "redistribution binary permitted " * 9 + of["reserved"]]
    out = license.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    labels = [r["labels"] for r in out]
    assert labels[0] == ",".join(sorted({label for label, _, _ in license.TEMPLATES})) and labels[1] == "bsd,reserved" and labels[3] == "reserved"
    assert {"gpl", "cc-by-nc", "reserved", "bsd"} <= set(labels[2].split(","))


def test_license_labels_match_brute_force(spark):
    """Every window of every text tried for every template, with the IDF of the texts."""
    r = random.Random(4)
    notices = [t.split() for _, t, _ in license.TEMPLATES]
    texts = []
    for i in range(60):
        words = []
        for _ in range(r.randint(1, 4)):
            n = list(r.choice(notices))
            for _ in range(r.randint(0, 3)):
                n[r.randrange(len(n))] = r.choice(["foo", "license", "the", "rights"])
            words += n[r.randint(0, 2) :] + prose(100 + i, r.randint(0, 4)).split()
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = license.word_idf(df, "text", license.vocabulary())
    got = {x["doc_id"]: {(m["label"], m["at"], m["score"]) for m in x["matches"]} for x in license.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        w, want = text.split(), set()
        for label, template, key in license.TEMPLATES:
            t, k = template.split(), key.split()
            ahead = next(j for j in range(len(t)) if t[j : j + len(k)] == k)
            for at in range(-len(t), len(w)):
                if w[max(at + ahead, 0) : at + ahead + len(k)] == k and at + ahead >= 0:
                    score = min(round(sum(idf[x] for j, x in enumerate(t) if 0 <= at + j < len(w) and w[at + j] == x) / sum(idf[x] for x in t), 9), 1.0)
                    if score >= 0.6:
                        want.add((label, at, score))
        assert {(a, b, round(c, 6)) for a, b, c in got[i]} == {(a, b, round(c, 6)) for a, b, c in want}


def test_hypergeometric_draws():
    rng = np.random.default_rng(2)
    for good, bad, need in ((3, 5, 4), (1, 1, 1), (500, 20, 60), (10**6, 10**6, 1000), (10**12, 3 * 10**12, 10**6)):
        x = np.array([mixing.hypergeometric(good, bad, need, rng) for _ in range(4000)])
        total = good + bad
        mean, var = need * good / total, need * good / total * bad / total * (total - need) / max(total - 1, 1)
        assert x.min() >= max(0, need - bad) and x.max() <= min(good, need)
        assert abs(x.mean() - mean) < 5 * (var / len(x)) ** 0.5 + 1e-9 and abs(x.var() - var) < 0.12 * var + 0.02
    x = np.bincount([mixing.hypergeometric(3, 5, 4, rng) for _ in range(20_000)], minlength=4) / 20_000
    assert np.allclose(x, [5 / 70, 30 / 70, 30 / 70, 5 / 70], atol=0.015)


CLASH = SCHEMA + ", spans string, text_hash string, _found string, found string, _row string, pass string, block string"


def test_columns_of_any_name_are_kept(spark):
    one = [(*x, "u", "v", "w", "x", "y", "z", str(x[0])) for x in [*rows()[:17], rows()[2], (None, None, "xx", None, 0, "c", "n", "h", "x"), (None, prose(1, 60), "yy", "s0", 1, "c", "n", "h", "x")]]
    df = spark.createDataFrame(one, CLASH)
    for stage in (langid.keep_identified, simhash.drop_near_duplicates, substring.remove_repeats, lambda d: mixing.mixed_documents(d, block=16)):
        out = stage(df)
        assert out.columns == df.columns
        got = out.collect()
        assert got and all((r["spans"], r["text_hash"], r["_found"], r["found"], r["_row"], r["pass"]) == ("u", "v", "w", "x", "y", "z") and r["block"] == ("None" if r["doc_id"] is None else str(r["doc_id"])) for r in got)
        assert stage(df.where("false")).count() == 0
    assert packing.sequences(df).count() and media.media_digest(df).count() == license.license_report(df).count() == len(one)


def test_mixed_text_keeps_its_lines():
    text = " a b\n\nc  d e\tf "
    span = lambda *x: [{"s": a, "e": b} for a, b in x]
    assert mixing.pieces(text, span((0, 6))) == "a b\n\nc  d e\tf"
    assert mixing.pieces(text, span((4, 6), (0, 1), (1, 3))) == "a b\n\nc\ne\tf"


def test_pieces_name_their_row(spark):
    texts = [prose(i, 700) for i in range(9)]
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    found = {(r["doc_id"], r["text_hash"], r["copy"]): [] for r in packing.pack_documents(df).collect()}
    assert len(found) == 10
    for r in packing.sequences(df).collect():
        for row in zip(r["doc_ids"], r["text_hashes"], r["copies"], r["starts"], r["lengths"], strict=True):
            found[row[:3]].append(row[3:])
    assert all(sum(n for _, n in parts) == 700 and len({s for s, _ in parts}) == len(parts) for parts in found.values())


def test_packing_matches_plain_best_fit():
    """The trial fillings one item at a time."""
    def plain(lengths, capacities, overhead):
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        rooms, used = [], []
        for at, i in enumerate(order):
            fit = min((b for b in range(len(rooms)) if rooms[b] >= lengths[i]), key=lambda b: (rooms[b], b), default=None)
            if fit is None:
                price = []
                for c in (c for c in capacities if c >= lengths[i]):
                    left = c - lengths[i]
                    for j in order[at + 1 :]:
                        if lengths[j] <= left:
                            left -= lengths[j]
                    price.append(((c + overhead) / (c - left), c))
                rooms.append(min(price)[1])
                used.append(0)
                fit = len(rooms) - 1
            rooms[fit] -= lengths[i]
            used[fit] += lengths[i]
        return sorted((min(c for c in capacities if c >= u), u) for u in used)

    r = random.Random(6)
    for _ in range(30):
        lengths = [r.randint(1, 64) for _ in range(r.randint(1, 60))]
        got = packing.pack(lengths, (16, 32, 64), r.choice((0, 2, 8)) or 1)
        want = None
        for overhead in (1, 2, 8):
            if sorted({(b, c, u) for b, c, u, _ in packing.pack(lengths, (16, 32, 64), overhead)}) is not None:
                want = plain(lengths, (16, 32, 64), overhead)
                assert sorted((c, u) for _, c, u in {(b, c, u) for b, c, u, _ in packing.pack(lengths, (16, 32, 64), overhead)}) == want
        assert got


def test_peak_pairs_match_a_plain_transform():
    samples = bytes(128 + int(50 * np.sin(i / 3) + 40 * np.sin(i / 1.3)) for i in range(700))
    x = np.r_[np.frombuffer(samples, np.uint8) - 128.0, np.zeros(1024)]
    frames, peaks = -(-len(samples) // media.HOP), []
    for f in range(frames):
        part = x[f * media.HOP : f * media.HOP + media.WINDOW] * np.hanning(media.WINDOW)
        loud = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(media.WINDOW) / media.WINDOW))) for k in range(media.WINDOW // 2 + 1)]
        best = [max(range(a, b), key=lambda k: (loud[k], -k)) for a, b in media.BANDS]
        peaks.append([k if loud[k] > np.mean(loud[1:]) else 0 for k in best])
    want = sorted((f, peaks[f][i] << 11 | peaks[f + s][(i + 1) % 4] << 3 | s) for s in range(media.FAN + 1) for f in range(frames - s) for i in range(4) if peaks[f][i] and (peaks[f + s][(i + 1) % 4] or not s))
    assert list(zip(*map(list, media.peak_pairs(samples)), strict=True)) == want


def test_two_level_index():
    x = np.random.default_rng(1).normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    old, ann.FIRST_LEVEL = ann.FIRST_LEVEL, 4
    index = ann.Index.fit(x, 15, 4, 0.99, 5)
    ann.FIRST_LEVEL = old
    assert index.centres.shape == (16, 8)
    sizes = np.bincount(index.lists_of(x), minlength=16)
    assert all(len(v) >= min(index.probes, (sizes > 0).sum()) and sizes[v].sum() >= 9 for v in index.visits(x[:3], sizes, 9))
    assert all(sizes[v].sum() == 600 for v in index.visits(x[:3], sizes, 600))


def test_small_far_groups_have_all_their_neighbours(spark):
    """A query whose lists hold fewer rows than asked for goes on to others."""
    r = np.random.default_rng(11)
    for seed in range(3):
        centres = r.normal(size=(5, 16))
        rows = [(i, (centres[i % 5] + 0.4 * r.normal(size=16)).tolist()) for i in range(600)]
        rows += [(5000 + i, (-20 * centres.sum(axis=0) + 0.01 * r.normal(size=16)).tolist()) for i in range(3)]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
        per = {}
        for x in got:
            per.setdefault(x["query_id"], []).append(x["vec_id"])
        assert {len(v) for v in per.values()} == {5} and set(per) == {i for i, _ in rows if i % 50 == 0} and set(per[5000][:2]) == {5001, 5002}


@pytest.mark.parametrize("kind", ["far from the origin", "tight clusters", "queries unlike the rest", "huge"])
def test_search_on_other_rows(spark, kind):
    """Codes are too coarse to tell these rows apart, or the queries' neighbours lie in lists that other rows' don't."""
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 32))
    if kind == "far from the origin":
        x = np.abs(x) + 5
    elif kind == "tight clusters":
        x = r.normal(size=(10, 32))[r.integers(10, size=6000)] + 0.001 * x
    elif kind == "queries unlike the rest":
        x = x * (1 - 0.999 * (np.arange(6000) % 50 != 0))[:, None] + 1
    else:
        x *= 1e200
    got = {}
    for g in ann.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect():
        got.setdefault(g["query_id"], set()).add(g["vec_id"])
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.95 * 5 * 120


def test_many_dimensions(spark):
    rows = [(i, [1.0 + i % 7] + [float(j % 3) + 0.1 * i for j in range(i % 70)]) for i in range(700)] + [(0, [1.0, 2.0]), (50, None), (100, [0.0])]
    rows = [(i, v and [float(np.float32(x)) for x in v]) for i, v in rows]
    got = {}
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    use = [(i, np.array(v)) for i, v in rows if v and any(v)]
    for q, v in [(q, v) for q, v in use if q % 50 == 0 and (q, len(v)) != (0, 2)]:
        near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in use if i != q and len(w) == len(v))
        assert len(got.get(q, [])) == min(5, len(near)) and set(got.get(q, [])) <= {i for _, i in near}


def test_search_by_dimension(spark):
    df = spark.createDataFrame([(i, [float(i % 7 + 1), 1.0 + i, 2.0][: 2 + i % 2]) for i in range(0, 200, 5)] + [(50, [1.0, 1.0])], "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    got = ann.search(df).collect()
    assert {r["query_id"] for r in got} == {0, 50, 100, 150} and all((r["query_id"] - r["vec_id"]) % 2 == 0 for r in got) and len(got) == 20


def test_url_list_follows_the_pages(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.example.io/{i}") for i in range(400)] + [(i, None) for i in range(400, 700)], "page_id long, url string")
    entries = urlfilter.entries_of(pages)
    assert entries.count() > len(urlfilter.LIST_ENTRIES)
    out = urlfilter.page_verdicts(pages, entries).collect()
    assert len(out) == 700 and {r["verdict"] for r in out} == {"block", "allow", "none"}
    twice = urlfilter.filter_captures(pages.unionByName(pages).withColumn("fetch_date", F.to_date(F.lit("2024-12-31"))), entries)
    assert twice.count() == 1400


def test_tool_calls(spark):
    schemas = {"t": {"a": chat.Argument("integer", least=0), "b": chat.Argument("string", required=False)}}
    calls = [("c", "1", 0, "t", '{"b": "x", "a": 1}', None), ("c", "2", 2, "t", '{"a": -1}', "1"), ("c", "2", 3, "t", "{}", "1"), ("c", "3", 4, "t", '{"b": 1}', "2"), ("c", "4", 5, "u", "[1]", "5"), ("c", "5", 6, "t", "oops", "4"), ("c", None, 7, "t", "{}", None)]
    results = [("c", "1", 1, 'say "hi"\n'), ("c", "3", 2, "early"), ("c", "9", 3, None)]
    out = {r["call_id"]: r for r in chat.link_tool_calls(spark.createDataFrame(calls, "conv_id string, call_id string, turn long, name string, arguments string, parent_id string"), spark.createDataFrame(results, "conv_id string, call_id string, turn long, content string"), schemas).collect()}
    assert {k: (r["level"], r["status"]) for k, r in out.items()} == {"1": (0, "linked"), "2": (1, "pending"), "3": (2, "early"), "4": (None, "cycle"), "5": (None, "cycle"), "9": (None, "orphan")}
    assert {k: r["errors"] for k, r in out.items()} == {"1": "", "2": "least:a", "3": "missing:a,type:b", "4": "unknown_tool,not_an_object", "5": "not_an_object", "9": None}
    assert out["1"]["json"] == '{"arguments":{"a":1,"b":"x"},"call_id":"1","content":"say \\"hi\\"\\n","name":"t"}' and json.loads(out["5"]["json"])["arguments"] == "oops"
    assert out["2"]["n_calls"] == 2
    c, r = spark.createDataFrame(calls * 2, "conv_id string, call_id string, turn long, name string, arguments string, parent_id string"), spark.createDataFrame(results * 2, "conv_id string, call_id string, turn long, content string")
    again = {x["call_id"]: x for x in chat.link_tool_calls(c.withColumn("level", F.lit("x")), r.withColumn("status", F.lit("y")), schemas).collect()}
    assert {k: (x["level"], x["status"], x["json"]) for k, x in again.items()} == {k: (x["level"], x["status"], x["json"]) for k, x in out.items()}
    assert chat.link_tool_calls(c.where("false"), r.where("false"), schemas).count() == 0


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs.where("false").write.parquet(str(tmp_path / "no" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "no")).count() == 0
    ids = {i for r in out for i in r["doc_ids"]}
    assert out and not ids & {12, 13, 14, 17, 18, 19} and all(sum(r["lengths"]) == r["used"] <= r["capacity"] for r in out)


def test_languages_are_the_same_however_rows_are_dealt(spark):
    docs = spark.createDataFrame([(i, prose(i, 30, "bcdf" if i % 2 else "ghklm"), "xy"[i % 2], "s", 1) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    runs = [{tuple(r) for r in langid.identify(docs.repartition(n, "doc_id")).collect()} for n in (1, 2, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 300


def test_documents_without_any_label_stay(spark):
    docs = spark.createDataFrame([(1, "some words here", None, "s", 1, 5), (2, None, None, "s", 1, 5), (3, "12 !", None, "s", 1, 5)], "doc_id long, text string, lang string, source string, n_chars long, _none int")
    assert [r["doc_id"] for r in langid.keep_identified(docs).collect()] == [1]
    labelled = docs.union(spark.createDataFrame([(i, prose(i, 40), "xx", "s", 1, 6) for i in range(5, 30)], docs.schema))
    assert {r["_none"] for r in langid.keep_identified(labelled).collect() if r["doc_id"] > 4} == {6}

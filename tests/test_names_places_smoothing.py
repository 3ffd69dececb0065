"""Weighted ratios, the gram index, rings, nearest places and smoothing models against plain versions."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelcast.functions import scoring, similarity
from panelcast.operators import matching, smoothing, spatial
from panelcast.plans import catalog, matching_queries
from pyspark.sql import functions as F


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def part(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        return part(b, a)
    m, n = len(a), len(b)
    own = max(ratio(a, w) for w in [b[i : i + m] for i in range(n - m + 1)] + [b[:k] for k in range(1, m)] + [b[n - k :] for k in range(1, m)])
    return max(own, part_turned(b, a)) if m == n else own


def part_turned(a, b):
    m = len(a)
    return max(ratio(a, w) for w in [b] + [b[:k] for k in range(1, m)] + [b[m - k :] for k in range(1, m)])


def word_set(v, w):
    both, x, y = (" ".join(sorted(s)) for s in (set(v) & set(w), set(v) - set(w), set(w) - set(v)))
    if not v or not w:
        return 0.0
    if both and (not x or not y):
        return 100.0
    s, gap = len(both), int(bool(both))
    left, right = s + gap + len(x), s + gap + len(y)
    rest = 100 - 100 * (len(x) + len(y) - 2 * lcs(x, y)) / (left + right)
    return max(rest, 100 - 100 * (left - s) / (s + left), 100 - 100 * (right - s) / (s + right)) if s else rest


def part_words(v, w):
    if not v or not w:
        return 0.0
    if set(v) & set(w):
        return 100.0
    return max(part(" ".join(sorted(f(v))), " ".join(sorted(f(w)))) for f in (list, set))


def weighted(a, b):
    if not a or not b:
        return 0.0
    v, w = a.split(), b.split()
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * ratio(" ".join(sorted(v)), " ".join(sorted(w))), 0.95 * word_set(v, w))
    scale = 0.9 if longer <= 8 else 0.6
    return max(ratio(a, b), scale * part(a, b), 0.95 * scale * part_words(v, w))


def made_names(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("абвгae") for _ in range(r.randint(1, 6)))
    out = []
    for _ in range(n):
        name = " ".join(word() for _ in range(r.choice((1, 1, 2, 3))))
        out += [name, "".join(c for c in name if r.random() > 0.1) or "б", " ".join(reversed(name.split())), f"{name} {name.split()[0]}"]
    return [" ".join(n.split()) for n in out if n.strip()]


def test_weighted_ratio_matches_plain_version(spark):
    a, b = made_names(1, 60), made_names(1, 60)
    random.Random(3).shuffle(b)
    pairs = [*zip(a, b, strict=False), *zip(a, a[1:], strict=False), ("", ""), ("a", ""), (None, "a"), ("x" * 130 + "yz" * 20, "z" + "x" * 120), ("орск", "орске"), ("a" * 70, "b " + "a" * 61)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").withColumn("s", similarity.weighted_ratio("a", "b")).collect()
    for r in rows:
        expected = None if r["a"] is None else weighted(r["a"], r["b"])
        assert r["s"] == (expected if expected is None else pytest.approx(expected, abs=1e-9)), r


@pytest.mark.parametrize("cutoff", [75, 80, 88, 95])
def test_gram_index_loses_no_pair(spark, monkeypatch, cutoff):
    monkeypatch.setattr(matching, "POSTINGS", 3)  # frequent grams are dealt to blocks
    names, aliases = made_names(5, 40), made_names(5, 25) + made_names(6, 25)
    left = spark.createDataFrame([(i % 2, n) for i, n in enumerate(names)] + [(0, None), (1, " ")], "region_code int, name string")
    right = spark.createDataFrame([(i % 2, n) for i, n in enumerate(aliases)] * 2 + [(0, None)], "region_code int, alias string")
    found = {(r[0], r[1], r[2]): r[3] for r in matching.similar(left, right, cutoff).collect()}
    expected = {(i % 2, n, m): weighted(n, m) for i, n in enumerate(names) for j, m in enumerate(aliases) if i % 2 == j % 2}
    expected = {k: s for k, s in expected.items() if s >= cutoff - 1e-9}
    assert set(found) == set(expected) and len(expected) > 50


def test_gram_index_compares_few_pairs(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiouy") for _ in range(r.randint(3, 5)))
    words = [word() for _ in range(600)]
    names = spark.createDataFrame([(0, w[:-1] + "x") for w in words], "region_code int, name string")
    aliases = spark.createDataFrame([(0, w) for w in words], "region_code int, alias string")
    assert matching.met_pairs(names, aliases, 80).count() < 0.1 * 600 * 600


def test_scores_of_many_pairs_match_plain_version(monkeypatch):
    monkeypatch.setattr(scoring, "PAIRS", 50)
    a, b = made_names(1, 60), made_names(2, 60)
    pairs = [*zip(a, b, strict=False), *zip(a, a[1:], strict=False), ("", "a"), (" ", "a"), ("ab  c", "c ab"), ("x" * 130 + "yz" * 20, "z" + "x" * 120), ("a" * 70, "b " + "a" * 61), ("a" * 63, "b " + "a" * 64)]
    left, right = ([p[k] for p in pairs] for k in (0, 1))
    known, at = scoring.letters(left, right, [" "]), np.arange(len(pairs))
    assert scoring.weighted_ratio(scoring.Names(left, known), at, scoring.Names(right, known), at).tolist() == pytest.approx([weighted(*p) for p in pairs], abs=1e-9)


def test_most_similar_of_blocks(spark, monkeypatch):
    """A name's most similar aliases are found over blocks, and no block gives more of a name than are asked for."""
    monkeypatch.setattr(matching, "POSTINGS", 20)
    monkeypatch.setattr(matching, "NAMES", 7)
    names, aliases = sorted(set(made_names(5, 20))), sorted(set(made_names(6, 60)))
    left, right = spark.createDataFrame([(1, n) for n in names], "region_code int, name string"), spark.createDataFrame([(1, n) for n in aliases], "region_code long, alias string")
    expected = {(n, m) for n in names for m in sorted((m for m in aliases if weighted(n, m) >= 80), key=lambda m: (-weighted(n, m), m))[:3]}
    assert {(r["name"], r["alias"]) for r in matching.similar(left, right, 80, most=3).collect()} == expected
    index = matching.Index(aliases, 80)
    assert max(np.bincount(np.concatenate([p for p, _, _ in matching.most_similar(names, index, 3)]))) == 3


def test_rings_from_text(spark):
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1)), ((10 0, 12 0, 11 -2.5e0, 10 0)))"
    geo = '{"type": "MultiPolygon", "coordinates": [[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[1,3],[3,3],[3,1],[1,1]]],[[[10,0],[12,0],[11,-2.5],[10,0]]]]}'
    one = '{"type": "Polygon", "coordinates": [[[0,0],[2,0],[0,2]]]}'
    row = spark.createDataFrame([(wkt, geo, one, "POLYGON EMPTY", None)], "w string, g string, o string, e string, n string").select(
        spatial.rings_of_wkt(F.col("w")).alias("w"), spatial.rings_of_geojson(F.col("g")).alias("g"), spatial.rings_of_geojson(F.col("o")).alias("o"), spatial.rings_of_wkt(F.col("e")).alias("e"), spatial.rings_of_geojson(F.col("n")).alias("n")
    ).first()
    assert row["w"] == row["g"] and [len(r) for r in row["w"]] == [5, 5, 4] and len(row["o"][0]) == 3 and row["e"] == [] and row["n"] == []


@pytest.mark.parametrize("cell", [0.7, 1.0, 30.0])
def test_points_and_holes_and_edges(spark, cell):
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1)), ((10 0, 12 0, 11 -2, 10 0)))"
    points = [(0, 0.5, 0.5, 5), (1, 2.0, 2.0, None), (2, 0.0, 2.0, None), (3, 1.0, 2.0, None), (4, 11.0, -1.0, 5), (5, 11.0, 0.0, None), (6, 4.0, 4.0, None), (7, 3.5, 1.0, 5), (8, -1.0, 0.0, None), (9, 0.5, 3.0, 5)]
    shapes = spark.createDataFrame([(5, wkt), (9, "POLYGON ((0 0, 20 0, 20 0.25, 0 0.25))")], "territory_id int, wkt string").select("territory_id", spatial.rings_of_wkt(F.col("wkt")).alias("rings"))
    out = spatial.within(spark.createDataFrame([p[:3] for p in points], "id int, x double, y double"), shapes, "id", cell)
    assert {r["id"]: r["territory_id"] for r in out.collect()} == {p[0]: p[3] for p in points}


def test_nearest_places_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 4)
    r = random.Random(4)
    places = [(i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(150)] + [(200 + i, 1000.0 + i, -500.0) for i in range(3)] + [(300 + i, 0.5, 0.5) for i in range(9)]
    points = [(i, r.gauss(0, 2), r.gauss(0, 2)) for i in range(40)] + [(50, 900.0, -400.0), (51, -9e4, 0.0), (52, 0.5, 0.5)]
    p = spark.createDataFrame([*points, points[0], (60, None, 1.0)], "point_id long, x double, y double")
    q = spark.createDataFrame([*places, places[0], (None, 0.0, 0.0)], "place_id long, x double, y double")
    found = {}
    for row in spatial.nearest(p, q, 4).collect():
        found.setdefault(row["point_id"], {})[row["rank"]] = row["place_id"]
    for i, x, y in points:
        best = sorted(places, key=lambda s: (math.sqrt((x - s[1]) ** 2 + (y - s[2]) ** 2), s[0]))[:4]
        assert [found[i][k] for k in range(1, 5)] == [s[0] for s in best]
    assert len(found) == len(points)
    assert spatial.nearest(p, q.limit(0), 2).count() == 0 and spatial.nearest(p, q.where("place_id < 2"), 5).where("point_id = 3").count() == 2


def contexts(spark, series):
    rows = [(k, "a", dt.date(2020, 1, 1), dt.date(2000 + i // 12, i % 12 + 1, 1), v) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "territory_id int, category string, origin date, month date, z double")


def simple(x, alpha):
    level, sse = x[0], 0.0
    for v in x[1:]:
        sse, level = sse + (v - level) ** 2, level + alpha * (v - level)
    return sse, alpha, level


def test_smoothing_models_match_loops(spark):
    r = random.Random(7)
    series = {0: [5.0] * 20, 1: [1.0 + 0.5 * i for i in range(30)], 2: [r.gauss(0, 1) for _ in range(40)], 3: [0.1 * i + r.gauss(0, 0.1) for i in range(50)], 4: [1.0, 2.0], 5: [1.0, 3.0, 2.0]}
    df = contexts(spark, series)
    ses = {x["territory_id"]: x for x in smoothing.ses(df).collect()}
    theta = {x["territory_id"]: x for x in smoothing.theta(df).collect()}
    ets = {x["territory_id"]: x for x in smoothing.ets(df).collect()}
    assert set(ses) == set(theta) == set(ets) == {0, 1, 2, 3, 5}
    for k, x in series.items():
        if len(x) < 3:
            continue
        assert ses[k]["level"] == pytest.approx(min(simple(x, a) for a in smoothing.ALPHAS)[2], abs=1e-9)
        n = len(x)
        b = sum((i - (n - 1) / 2) * v for i, v in enumerate(x)) / sum((i - (n - 1) / 2) ** 2 for i in range(n))
        a = sum(x) / n - b * (n - 1) / 2
        second = min(simple([2 * v - (a + b * i) for i, v in enumerate(x)], s) for s in smoothing.ALPHAS)[2]
        assert theta[k]["level"] == pytest.approx(0.5 * (a + b * (n - 1)) + 0.5 * second, abs=1e-9) and theta[k]["drift"] == pytest.approx(b / 2, abs=1e-9)
    assert ets[0]["drift"] == 0 and ets[1]["drift"] == pytest.approx(0.5) and ets[1]["level"] == pytest.approx(15.5)


def test_raw_indices(spark):
    season = [10, 12, 9, 11, 10, 8, 12, 13, 9, 10, 11, 15]
    df = contexts(spark, {1: [float(season[i % 12]) for i in range(48)], 2: [float(season[i % 12]) for i in range(20)]})
    rows = smoothing.with_indices(df).collect()
    for row in rows:
        assert row["index"] == pytest.approx(season[row["moy"] - 1] * 12 / sum(season) if row["territory_id"] == 1 else 1.0)


def test_folds_match_plain_kernels(spark):
    """Change points and segments by folds against numpy loops; the scale against its definition."""
    import kernels
    import numpy as np

    from panelcast.operators import folds

    r = np.random.default_rng(1)
    series = [r.normal(size=n).tolist() for n in (1, 2, 6, 7, 30, 80)] + [[0.0] * 40, [1.0] * 20 + [9.0] * 20 + [2.0] * 21, (r.normal(size=61) + np.repeat([0, 5, -3], [20, 20, 21])).tolist()]
    df = spark.createDataFrame(list(enumerate(series)), "i int, x array<double>")
    rows = df.select("x", *[F.expr(e).alias(n) for n, e in (("p", folds.segment_score("x")), ("b", folds.segment_score("x", "binseg")), ("c", folds.change_probability("x")), ("s", folds.expanding_scale("x")))]).collect()
    assert max(max(row["p"]) for row in rows) == 32
    for row in rows:
        x = np.array(row["x"])
        assert np.allclose(kernels.segment_score(x), row["p"]) and np.allclose(kernels.segment_score(x, "binseg"), row["b"]) and np.allclose(kernels.bocpd(x), row["c"])
        for t, s in enumerate(row["s"]):
            assert s == (None if t < 4 else pytest.approx(max(0.01, 1.4826 * np.median(abs(x[:t] - np.median(x[:t]))))))


def test_folds_pass_over_missing_values(spark):
    from panelcast.operators import folds

    row = spark.createDataFrame([([1.0, None, 2.0, 4.0, 7.0, None, 9.0],)], "x array<double>").select(F.expr(folds.change_probability("x")).alias("c"), F.expr(folds.expanding_scale("x")).alias("s")).first()
    assert [v is None for v in row["c"]] == [False, True, False, False, False, True, False]
    assert row["s"] == [None] * 5 + [pytest.approx(1.4826 * 1.5)] * 2


def test_resampled_counts(spark, monkeypatch):
    """Counts of each draw sum to the number of clusters, whatever the blocks; ranks are each given once."""
    from panelcast.operators import evaluate

    monkeypatch.setattr(evaluate, "DRAWN", 7)
    monkeypatch.setattr(evaluate, "RANKED", 10)
    clusters = spark.createDataFrame([(h, t) for h in (1, 3) for t in range(40 + h)], "h int, territory_id int")
    ranked = evaluate.ranked_clusters(clusters, "h", "territory_id")
    assert sorted((r["h"], r["rank"]) for r in ranked.collect()) == [(h, k) for h in (1, 3) for k in range(40 + h)]
    counts = evaluate.resample_counts(ranked.select("h", "size").distinct(), "h", 50)
    sums = {(r["h"], r["draw"]): r["n"] for r in counts.groupBy("h", "draw").agg(F.sum("w").alias("n")).collect()}
    assert sums == {(h, d): 40 + h for h in (1, 3) for d in range(1, 51)}
    spread = counts.where("h = 1").groupBy("rank").agg((F.sum("w") / 50).alias("w")).collect()
    assert len(spread) == 41 and all(0.4 < r["w"] < 1.8 for r in spread)


def test_quantiles_of_large_groups(spark, monkeypatch):
    """Groups beyond the bound are searched by ranges: ties, negative and huge values, null keys and values."""
    import numpy as np

    from panelcast.operators import selection

    monkeypatch.setattr(selection, "GATHERED", 20)
    r = random.Random(9)
    groups = {"a": [r.gauss(0, 1) for _ in range(500)], "b": [5.0] * 90 + [6.0] * 91, "c": [1.0, 2.0], None: [r.choice([-1e300, 1e300, 0.0, 1e-9]) for _ in range(61)], "d": [float(i) for i in range(100)], "e": [], "f": [10.0 ** r.randint(-9, 9) for _ in range(300)]}
    rows = [(k, x) for k, v in groups.items() for x in [*v, None]]
    df = spark.createDataFrame(rows, "k string, x double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {x["k"]: x["v"] for x in selection.grouped_quantile(df, ["k"], "x", q, "v").collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert got[k] == (pytest.approx(float(np.quantile(v, q)), rel=1e-12) if v else None)
    assert selection.grouped_quantile(df, [], "x", 0.5, "v").first()["v"] == pytest.approx(float(np.median([x for _, x in rows if x is not None])))
    joined = selection.with_grouped_quantile(df, ["k"], "x", 0.5, "v")
    assert joined.count() == len(rows) and joined.columns == ["k", "x", "v"]


@pytest.mark.parametrize("before", [False, True])
def test_asof_join_matches_brute_force(spark, before):
    """A key with most rows, ties, keys without right rows, null keys and times; ranges are many more than keys."""
    from panelcast.operators.asof import asof_join

    r = random.Random(12)
    left = [(i, r.choice(["hot"] * 8 + ["b", "c", "none", None]), r.choice([None, *range(60)])) for i in range(400)]
    right = [(r.choice(["hot"] * 6 + ["b", "c", "far", None]), r.choice([None, *range(0, 60, 3)]), r.randint(0, 5), r.choice(["x", "y", None])) for _ in range(150)]
    a = spark.createDataFrame(left, "i int, k string, t int")
    b = spark.createDataFrame(right, "k string, u int, v int, w string")
    got = {x["i"]: (x["u"], x["v"], x["w"]) for x in asof_join(a, b, ["k"], "t", ["v", "w"], "u", before).collect()}
    rank = lambda x: (x[1], x[2], x[3] is not None, x[3] or "")
    for i, k, t in left:
        past = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and (x[1] < t if before else x[1] <= t)]
        assert got[i] == (max(past, key=rank)[1:] if past else (None, None, None))
    assert len(got) == len(left)
    assert asof_join(a, b.limit(0), ["k"], "t", ["v"], "u").count() == len(left) and asof_join(a.limit(0), b, ["k"], "t", ["v"], "u").count() == 0


def test_next_names_over_ranges_and_dealt_rows(spark):
    """The next row by key is found over several ranges, and rows that take long are dealt to tasks by their number."""
    rows = [(k, f"n{k}") for k in range(0, 900, 3)]
    random.Random(1).shuffle(rows)
    parts = spark.createDataFrame(rows, "k long, p string")
    found = {r["k"]: r["q"] for r in matching_queries.with_next(parts, "k", "p", "q", 40).collect()}
    assert found == {k: f"n{k + 3}" if k < 897 else None for k in range(0, 900, 3)}
    assert matching_queries.with_next(parts.where("false"), "k", "p", "q", 40).count() == 0
    assert matching.dealt(parts, 20).rdd.getNumPartitions() == 15


def test_next_names_put_rows_without_a_key_last(spark):
    parts = spark.createDataFrame([(None, "z"), *[(k, f"n{k}") for k in range(50)]], "k long, p string")
    found = {r["k"]: r["q"] for r in matching_queries.with_next(parts, "k", "p", "q", 10).collect()}
    assert found == {k: f"n{k + 1}" for k in range(49)} | {49: "z", None: None}


def test_all_ratios_of_many_pairs_match_plain_versions(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PAIRS", 50)
    a, b = made_names(1, 40), made_names(2, 40)
    pairs = [*zip(a, b, strict=False), *zip(a, a[1:], strict=False), ("", ""), ("", "a"), (" ", "a"), ("ab  c", "c ab"), ("b a", "a b b"), ("x" * 130 + "yz" * 20, "z" + "x" * 120), ("a" * 63, "b " + "a" * 64), (None, "a"), ("a", None), (None, None)]
    rows = matching.ratios(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs * 2)], "i int, a string, b string")).collect()
    assert sorted(r["i"] for r in rows) == list(range(2 * len(pairs)))
    for r in rows:
        x, y = r["a"], r["b"]
        if x is None or y is None:
            assert [r[k] for k in scoring.PARTS] == [None] * 6
            continue
        v, w = x.split(), y.split()
        want = ratio(x, y), ratio(" ".join(sorted(v)), " ".join(sorted(w))), word_set(v, w), part(x, y), part_words(v, w), weighted(x, y)
        assert [r[k] for k in scoring.PARTS] == pytest.approx(want, abs=1e-9), (x, y)


def test_similarity_of_odd_part_names_equals_the_sql(spark, tmp_path):
    """Names that are null, blank, empty, of one word or of words that repeat; scored in Arrow batches, as lambdas took 2 ms a pair."""
    rows = [(1, "red  big box", "B#1", "LARGE"), (2, None, "B#2", "SMALL"), (3, "solo", "B#3", "tiny"), (4, "", "B#4", "tiny"), (5, "Same same words", "B#5", None), (6, "words same same", "B#6", "x"), (7, " ", None, "y"), (8, None, "", ""), (9, "x", "", "")]
    pd.DataFrame(rows, columns=["p_partkey", "p_name", "p_brand", "p_type"]).to_parquet(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    made = catalog.QUERIES["name_similarity"](spark, str(tmp_path))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(tuple(r)) for r in made.collect()) == sorted(map(str, con.sql(catalog.ORACLE_SQL["name_similarity"]).fetchall()))


def test_nearest_meets_few_places(spark):
    """Cells hold few places where they are dense, so that a point meets some dozens whatever their number."""
    r = random.Random(2)
    places = [(i, r.random(), r.random()) for i in range(600)]
    p = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.0, 1.0)], "point_id long, x double, y double")
    found = {(x["point_id"], x["rank"]): x["place_id"] for x in spatial.nearest(p, spark.createDataFrame(places, "place_id long, x double, y double"), 3).collect()}
    for i, x, y in ((0, 0.5, 0.5), (1, 0.0, 1.0)):
        assert [found[i, k] for k in (1, 2, 3)] == [s[0] for s in sorted(places, key=lambda s: math.hypot(x - s[1], y - s[2]))[:3]]
    assert 9 * spatial.CROWD < 0.5 * len(places)

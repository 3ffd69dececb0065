"""Guards of the panel engine on hand-made frames, and queries against their SQL."""

import datetime as dt
import itertools
import math
import re

import duckdb
import kernels
import numpy as np
import pandas as pd
import pytest

from panelcast import config
from panelcast.functions import text
from panelcast.operators import detect, evaluate, expanding, forecast, learn, news, panel
from panelcast.plans import catalog, fixtures
from panelcast.sources.tables import read_export, read_labels
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)]
    value = lambda x: "" if pd.isna(x) else f"{float(x) + 0.0:.9g}" if isinstance(x, (int, float)) else str(x)[:19].replace(" 00:00:00", "")
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False))


CHECKED = """panel_monthly glue_weighted_mean interpolate_gaps snaive_growth_backtest stf_own_trend forecast_intervals cusum_reset conformal_score panel_regional shock_evaluation registry_hits
early_warning_table incident_chains anti_join_drop static_features points_in_polygons source_chat_export source_labels resolved_places exact_places news_accuracy quartile_lift
theta_forecast ets_raw_forecast closest_names points_in_parts nearest_places bocpd_score pelt_score binseg_score cluster_bootstrap shipments_asof_orders""".split()


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    made = plain(catalog.QUERIES[name](spark, SF).toPandas())
    assert made and made == plain(con.sql(catalog.ORACLE_SQL[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def months(n):
    return [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(n)]


def series(spark, values, **more):
    rows = [(1, 1, "a", m, None if v is None else float(v)) for m, v in zip(months(len(values)), values, strict=True)]
    return spark.createDataFrame(rows, "territory_id int, region_code int, category string, month date, e double")


def test_scale_needs_four_values_and_has_a_floor(spark):
    out = detect.with_scale(series(spark, [1, 1, 1, 1, 1, 9]), "e").orderBy("month").collect()
    assert [r["scale"] for r in out] == [None] * 4 + [0.01, 0.01]


def test_cusum_with_and_without_reset_differ(spark):
    z = series(spark, [0.1, -0.1, 0.1, -0.1, 3, 0, 0])
    a = [r["score"] for r in detect.cusum(z).orderBy("month").collect()]
    b = [r["score"] for r in detect.cusum_reset(z).orderBy("month").collect()]
    assert a[4] == pytest.approx(b[4]) and a[5] > b[5] == 0


def test_scores_do_not_look_ahead(spark):
    values = list(np.random.default_rng(0).normal(size=24))
    for f in (detect.cusum, detect.page_hinkley, detect.cusum_reset, detect.change_points):
        whole = [r["score"] for r in f(series(spark, values)).orderBy("month").collect()]
        cut = [r["score"] for r in f(series(spark, values[:15])).orderBy("month").collect()]
        assert [x if x is None or math.isnan(x) else round(x, 9) for x in whole[:15]] == [x if x is None or math.isnan(x) else round(x, 9) for x in cut] or np.allclose(np.array(whole[:15], float), np.array(cut, float), equal_nan=True)


def test_segmentation_finds_a_step():
    x = np.r_[np.zeros(10), np.full(6, 5.0)] + np.random.default_rng(1).normal(scale=0.1, size=16)
    for method in ("pelt", "binseg"):
        assert kernels.segment_score(x, method)[11] > 0
    assert kernels.bocpd(np.r_[np.zeros(12), 8.0])[12] > 0.5


def test_surge_needs_three_months(spark):
    df = spark.createDataFrame([(1, m, 1.0) for m in months(5)], "territory_id int, month date, x double")
    out = [r["s"] for r in df.select("month", panel.surge("x", ("territory_id",)).alias("s")).orderBy("month").collect()]
    assert out == [None, None, None, 0.0, 0.0]


def test_incidents_break_after_four_days_and_at_month_ends(spark):
    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 4, 23), dt.datetime(2024, 1, 8, 23), dt.datetime(2024, 1, 30), dt.datetime(2024, 2, 1)]
    rows = [("c", i, 1, 1, "fire", t, t.date(), 1) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "channel string, msg_id long, territory_id int, region_code int, event_type string, published timestamp_ntz, day date, severity int")
    assert sorted(r["msgs"] for r in news.incidents(df).collect()) == [1, 1, 1, 2]


def test_event_types(spark):
    cases = {"В Орске объявлена эвакуация из-за паводка": (["flood", "evacuation"], []), "Банк России сохранил ключевую ставку": ([], ["key_rate"]), "МЧС провело учения по тушению пожара": ([], []), "Лесной пожар": (["wildfire"], [])}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.local_types(F.col("t")).alias("a"), text.national_types(F.col("t")).alias("b"))
    assert {r["t"]: (r["a"], r["b"]) for r in df.collect()} == cases


def test_wilson(spark):
    low, high = evaluate.wilson(F.lit(161), F.lit(199))
    assert [round(x, 3) for x in spark.range(1).select(low, high).first()] == [0.749, 0.858]


def test_export(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"messages": [{"id": 1, "type": "message", "date_unixtime": "1704067200", "text_entities": [{"type": "plain", "text": "a"}, {"type": "link", "text": "b"}]}, {"id": 2, "type": "service"}]}')
    assert [tuple(r)[:3] for r in read_export(spark, str(tmp_path), "c").collect()] == [("c", 1, "a")]


def test_resolved_phrases(spark):
    """The phrases of the news tests: number of the territory, or of the region alone, or neither."""
    cases = {
        "Администрация Орска набирает добровольцев для эвакуации": {(1673, 56)},
        "В Туапсинском районе Краснодарского края четыре человека пропали": {(662, 23)},
        "Режим ЧС введен в Оренбургской области": {(None, 56)},
        "Пожар на рынке в Москве потушен": {(None, 77)},
        "Пожар в турецком порту Искендерун продолжается": set(),
        "В Донецке прозвучали взрывы": set(),
        "В Донецке Ростовской области обесточены дома": {(1795, 61)},
    }
    m = spark.createDataFrame([("c", i, t) for i, t in enumerate(cases)], "channel string, msg_id long, text string")
    found = news.resolve_places(news.name_tokens(m), fixtures.small_gazetteer(spark)).collect()
    assert [{(r["territory_id"], r["region_code"]) for r in found if r["msg_id"] == i} for i in range(len(cases))] == list(cases.values())


def test_change_point_probability_matches_all_segmentations():
    """Every way to cut a short series, weighed by hazard and the segments' marginal likelihoods."""
    z, hazard = np.array([0.3, -0.2, 0.1, 2.5, 2.2, -1.0]), 1 / 24

    def evidence(x):
        kappa, alpha = 1 + len(x), 1 + len(x) / 2
        beta = 1 + ((x - x.mean()) ** 2).sum() / 2 + len(x) * x.mean() ** 2 / (2 * kappa)
        return math.lgamma(alpha) - math.lgamma(1) - alpha * math.log(beta) - math.log(kappa) / 2 - len(x) / 2 * math.log(2 * math.pi)

    got = kernels.bocpd(z, hazard)
    for t in range(1, len(z)):
        total = recent = 0.0
        for cuts in itertools.product((0, 1), repeat=t + 1):  # a cut after value i; the last one is the run of length 0
            ends = [i + 1 for i in range(t + 1) if cuts[i]]
            parts = np.split(z[: t + 1], ends)
            weight = hazard ** len(ends) * (1 - hazard) ** (t + 1 - len(ends)) * math.exp(sum(evidence(p) for p in parts if len(p)))
            total += weight
            recent += weight * (len(parts[-1]) <= 1)
        assert got[t] == pytest.approx(recent / total)


def test_optimal_cuts_match_every_choice():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.r_[rng.normal(size=7), rng.normal(3, size=6), rng.normal(size=4)]
        cost, n = kernels.costs(x), len(x)
        for penalty in (0.5, 3.0, 12.0):
            def loss(cuts):
                ends = [0, *cuts, n]
                return sum(cost[a, b] for a, b in itertools.pairwise(ends)) + penalty * len(cuts)

            every = [c for k in range(4) for c in itertools.combinations((5, 10, 15), k) if all(b - a >= 2 for a, b in itertools.pairwise([0, *c, n]))]
            assert loss(sorted(kernels.optimal_cuts(cost, n, penalty))) == pytest.approx(min(map(loss, every)))
            assert set(kernels.binary_cuts(cost, n, penalty)) <= {5, 10, 15}


def test_gamma_table():
    nu = np.array([2.0, 5.0, 40.0])
    want = [math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - math.log(v * math.pi) / 2 - (v + 1) / 2 * math.log1p(0.49 / v) for v in nu]
    assert np.allclose(kernels.student_log_pdf(0.7, nu, np.zeros(3), np.ones(3)), want)


def test_expanding_quantiles_and_ranks_match_plain_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(m, c, float(np.round(rng.normal(), 1))) for m in months(9) for c in "ab" for _ in range(40)]
    df = spark.createDataFrame(rows, "month date, category string, x double")
    at = pd.DataFrame(rows, columns=["month", "category", "x"])
    for r in expanding.quantiles(df, 0.9, ["category"], False).collect():
        assert r["quantile"] == pytest.approx(at[(at.month < r["month"]) & (at.category == r["category"])].x.quantile(0.9))
    for r in expanding.ranks(df.select("month", "x")).collect():
        past = at[at.month <= r["month"]].x
        assert r["rank"] == pytest.approx((past <= r["x"]).mean())


def test_bootstrap_holds_the_mean(spark):
    rows = [(t, "a", dt.date(2000, 1, 1), 1, m, True, 10.0, 10.0 + e) for t in range(60) for m, e in (("x", 1 + t % 5), ("y", 2 + t % 7))]
    df = spark.createDataFrame(rows, "territory_id int, category string, origin date, h int, model string, complete boolean, y_true double, y_pred double")
    r = evaluate.cluster_bootstrap(df, "x", "y").first()
    mean = np.mean([(1 + t % 5) - (2 + t % 7) for t in range(60)])
    spread = 1.96 * np.std([(1 + t % 5) - (2 + t % 7) for t in range(60)]) / 60**0.5
    assert r["ci_low"] == pytest.approx(mean - spread, abs=0.25) and r["ci_high"] == pytest.approx(mean + spread, abs=0.25)


def test_settings_and_label_files(spark, tmp_path):
    assert config.load("stf")["k_level"] == 2 and len(config.load("ensemble")["damp"]) == 3
    (tmp_path / "more.toml").write_text("[stf]\nk_level = 4\n")
    assert config.load("stf", tmp_path / "more.toml") == config.load("stf") | {"k_level": 4}
    (tmp_path / "l.csv").write_bytes("\ufeffchannel;msg_id;row;place_ok;type_ok;comment\nc;1;0;1;;x\n".encode())
    assert [tuple(r) for r in read_labels(spark, str(tmp_path / "l.csv")).collect()] == [("c", 1, 0, "1", None, "x")]


def learning_panel(spark):
    """Series whose growth flips its sign with the category, which the base forecast doesn't know."""
    rng = np.random.default_rng(7)
    rows = []
    for s in range(24):
        y, sign = 100.0, 1 if s % 2 else -1
        for m in months(30):
            y *= math.exp(0.05 * sign + rng.normal(scale=0.005))
            rows.append((s, s % 3, "ab"[s % 2], m, y, True))
    return spark.createDataFrame(rows, "territory_id int, region_code int, category string, month date, y double, complete boolean")


def test_boosted_correction_learns_and_does_not_look_ahead(spark):
    d = learning_panel(spark).cache()
    base = forecast.naive(d, forecast.targets(d, "2000-08-01", "2002-06-01", (1, 3)))
    asked = ["2001-12-01", "2002-02-01"]
    run = lambda p, b: {(r["territory_id"], r["origin"], r["h"]): r["y_pred"] for r in learn.corrected(p, b, ["2002-01-01"], asked, trees=3).collect()}
    got = run(d, base)
    plain_ = {(r["territory_id"], r["origin"], r["h"]): r["y_pred"] for r in base.collect()}
    assert all(got[k] == plain_[k] for k in got if k[1] == dt.date(2001, 12, 1))  # before the first training
    assert len(got) == 24 * 4 and any(abs(got[k] / plain_[k] - 1) > 1e-6 for k in got)
    late = F.col("month") > "2002-02-01"
    changed = d.withColumn("y", F.when(late, F.col("y") * 9).otherwise(F.col("y")))
    assert run(changed, base) == pytest.approx(got)


def test_early_warning_ranks_shocks(spark):
    rng = np.random.default_rng(8)
    rows = [(t, m, float(x := rng.normal()), float(rng.normal()), float(x > 1)) for t in range(40) for m in months(20)]
    table = spark.createDataFrame(rows, "territory_id int, month date, score double, other double, y_next double")
    out = learn.early_warning(table, {"score": ["score"], "other": ["other"]}, "2001-01-01", "2001-02-01", trees=3).cache()
    area = lambda n: evaluate.auc(out.where(F.col("features") == n), "p", "y_next").first()["auc"]
    assert area("score") > 0.95 and abs(area("other") - 0.5) < 0.15


def test_detectors_take_the_greater_rank(spark):
    rng = np.random.default_rng(9)
    rows = [(s, s % 2, "a", m, float(rng.normal())) for s in range(8) for m in months(12)]
    df = spark.createDataFrame(rows, "territory_id int, region_code int, category string, month date, e double")
    out = detect.all_scores(df, ("panel", "bocpd", "panel_bocpd")).toPandas().pivot_table(index=["territory_id", "month"], columns="detector", values="score")
    for name in ("panel", "bocpd"):
        ranks = [(out[name][out.index.get_level_values("month") <= m].dropna() <= v).mean() if v == v else np.nan for (_, m), v in out[name].items()]
        out[f"{name}_rank"] = ranks
    want = np.fmax(out["panel_rank"], out["bocpd_rank"])
    assert np.allclose(out["panel_bocpd"], want, equal_nan=True)


def test_keep_first_takes_the_first_of_the_files(spark, tmp_path):
    """Line numbers repeat within an order: of such rows the first in the files counts, as in the SQL on one thread; Spark reads large files first."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for part, n in enumerate((60, 6000, 300)):
        rows = [(i % 20, 1 + i // 20 % 2, 10_000 * part + i, "AN"[i // 20 % 2]) for i in range(n)]
        pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"]).to_parquet(folder / f"part-{part:02}.parquet")
    con = duckdb.connect()
    con.sql(f"set threads = 1; create view lineitem as select * from '{folder}/*.parquet'")
    assert plain(catalog.QUERIES["keep_first"](spark, str(tmp_path)).toPandas()) == plain(con.sql(catalog.ORACLE_SQL["keep_first"]).df())


def test_keep_first_takes_a_line_without_a_number_last(spark, tmp_path):
    rows = [(1, None, 10, "A"), (1, 2, 11, "A"), (1, 1, 12, None), (1, None, 13, None), (2, None, 14, "A"), (2, None, 15, "A"), (None, None, 16, "A"), (None, 3, 17, "A")]
    pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"]).astype({"l_orderkey": "Int64", "l_linenumber": "Int64"}).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"set threads = 1; create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in catalog.QUERIES["keep_first"](spark, str(tmp_path)).collect()) == key(con.sql(catalog.ORACLE_SQL["keep_first"]).fetchall())


def test_a_frequent_name_meets_two_places_of_a_region(spark):
    """A name that many places share brings the first two of each region, whatever their number, and the right one wins."""
    places = [("мыс", "settlement", i, i % 3, None, 1000 + i) for i in range(900)] + [("край", "region", None, 1, None, None), ("даль", "region", None, None, None, None), ("мыс", "settlement", 1000, 1, None, 90_000), ("мыс", "mo", 1000, 1, None, None)]
    gazetteer = spark.createDataFrame(places, "alias string, level string, territory_id long, region_code int, region_name string, population long").withColumn("stem", F.col("alias"))
    names, leading = news.leaders(gazetteer, 50_000, 10)
    assert leading.count() == 6 and names.count() == 3
    tokens = spark.createDataFrame([("c", 1, "мыс", "ner"), ("c", 2, "мыс", "ner"), ("c", 2, "край", "ner"), ("c", 3, "край", "ner"), ("c", 4, "даль", "ner")], "channel string, msg_id long, token string, kind string")
    found = {r["msg_id"]: (r["territory_id"], r["region_code"], r["level"], r["confidence"]) for r in news.resolve_places(tokens, gazetteer).collect()}
    assert found == {1: (1000, 1, "mo", "high"), 2: (1000, 1, "mo", "high"), 3: (None, 1, "region", "high"), 4: (None, None, "region", "high")}


def test_a_message_stays_one_row_until_its_places_are_told(spark):
    """Names and regions of a message meet within a task: after the messages are dealt out nothing is shuffled."""
    tokens = spark.createDataFrame([("c", i, "краснодарскии краи", "ner") for i in range(20)], "channel string, msg_id long, token string, kind string")
    plan = news.resolve_places(tokens, fixtures.small_gazetteer(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and len(re.findall(r"\bExchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("known", [200_000, 0])
def test_places_of_odd_documents_equal_the_sql(spark, tmp_path, monkeypatch, known):
    """Ids that are null, repeat or have no name; a gazetteer that is sent to all tasks and one that is not."""
    monkeypatch.setattr(news, "KNOWN", known)
    words = ["Alpha", "Beta", "Gamma", "Delta", "Omega"]
    pages = pd.DataFrame([(i, f"<title>{words[i * i % 5]} {i}</title>") for i in range(90)], columns=["page_id", "html"])
    pages.assign(url="").to_parquet(tmp_path / "pages.parquet")
    docs = [(None if i % 11 == 0 else i // 2, " ".join(w for j, w in enumerate(words) if i >> j & 1) + " end", None if i % 7 == 0 else "ab"[i % 2]) for i in range(40)] + [(99, None, "a"), (98, "", "b")]
    pd.DataFrame(docs, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for name in ("document_places", "recognised_places"):
        key = lambda rows: sorted(map(str, rows))
        want = key(con.sql(catalog.ORACLE_SQL[name]).fetchall())
        assert want and key(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_regions_are_looked_up_in_place(spark):
    """Rows that name few regions aren't dealt out by those names."""
    places = fixtures.small_gazetteer(spark)
    rows = spark.createDataFrame([(i, ("", "", "", "краснодарский краи" if i % 2 else "ростовская область")) for i in range(40)], "place_id long, place struct<settlement:string,district:string,city:string,region:string>")
    coded = news.with_regions(rows, places)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert {(r["place_id"] % 2, r["region_code"]) for r in coded.collect()} == {(0, 61), (1, 23)}


def test_event_types_by_plain_searches(spark):
    """Types found by literals are those of the whole patterns."""
    words = ["паводком", "прорыв дамбы", "прорвало", "лесной пожар", "пал травы", "режим чс", "режима повышенной готовности", "дрон", "андрон", "отключена вода", "аэропорт временно закрыт", "аэропорт", "без света", "цены на бензин", "цен бензин", "ozon", "bozon", "учения", "главное за", "итоги дня", "движение по трассе закрыт", "простой на заводе", "", "МАССОВОЕ Отравление", "Ёж и карантин"]
    frame = spark.createDataFrame([(w,) for w in words] + [(f"{a} {b}",) for a, b in itertools.pairwise(words)], "text string")
    patterns = {**text.LOCAL_EVENTS, **text.NATIONAL_EVENTS, "none": text.NO_EVENT}
    t = text.folded(F.col("text"))
    whole = F.array_compact(F.array(*[F.when(t.rlike(f"(?iuU){p}"), F.lit(n)) for n, p in patterns.items()]))
    for r in frame.select(whole.alias("a"), text.types_of(F.col("text"), patterns).alias("b")).collect():
        assert r["a"] == r["b"]
    assert "RLIKE" not in str(text.found_in(F.col("text"), "паводк|наводнен"))

"""Insights, conclusions and metrics of small graphs; running sums by ranges; candidates and builders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ranges import running
from tidemark.operators import backtest, builders, candidates, intelligence, reasoning, validation

DAY = dt.date(2024, 5, 1)
SIMILAR = "a string, b string, cosine double, shared int"
DIVERGENCES = "asset string, factor string, regime string, beta_all double, beta_regime double, abs_change double, direction string"
BRIDGES = "factor string, n_classes int, n_assets int, n_edges int, classes array<string>"
SECTORS = "sector string, members int, stress double, breadth double, most_divergent string"
EVENTS = "asset string, event_date date, degree int, divergence double, bridges int, importance double, upcoming boolean, has_actuals boolean, surprise_pct double"
STATS = "scored long, mean_confidence double, mean_effective double, low long, reconfirmed long, mean_evidence double, stale long, expired long"


def analysis(spark, similar=(), divergences=(), bridges=(), ranking=(), sectors=(), events=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return reasoning.Analysis(make(similar, SIMILAR), make(divergences, DIVERGENCES), make(bridges, BRIDGES), make(ranking, "node string, degree int"), make(sectors, SECTORS), make(events, EVENTS))


@pytest.fixture(scope="module")
def now(spark):
    shifts = [(a, "f", "bear", 0.1, 0.1 + c, c, "amplified") for a, c in (("a", 0.3), ("b", 0.25), ("c", 0.2), ("d", 0.1))]
    return analysis(
        spark, [("a", "b", 0.95, 3), ("a", "c", 0.91, 2), ("b", "c", 0.90, 2)], shifts, [("f", 3, 5, 9, ["x", "y", "z"]), ("g", 2, 2, 2, ["x", "y"]), ("h", 1, 1, 1, ["x"])], [("f", 5), ("a", 2), ("b", 2)],
        [("s1", 4, 0.7, 1.0, "a"), ("s2", 2, 0.4, 0.5, None), ("s3", 2, 0.1, 0.0, None)],
        [("a", DAY, 3, 0.2, 1, 0.65, True, False, None), ("b", DAY, 3, 0.2, 1, 0.45, True, False, None), ("c", DAY, 3, 0.2, 1, 0.35, False, True, -7.0), ("d", DAY, 3, 0.2, 1, 0.9, False, True, 4.0), ("e", DAY, 3, 0.2, 1, 0.9, False, False, 9.0)],
    )


def kinds(df):
    return sorted((r.priority, r.kind, r.subject) for r in df.collect())


def test_insights_of_one_analysis(now):
    assert kinds(reasoning.insights(now)) == sorted(
        [
            (1, "crisis_exposure", "a/f/bear"), (1, "crisis_exposure", "b/f/bear"), (2, "crisis_exposure", "c/f/bear"), (1, "systemic_bridge", "f"), (3, "bridge_factor", "g"), (2, "structural_twin", "a/b"), (2, "structural_twin", "a/c"),
            (1, "sector_stress", "s1"), (2, "sector_stress", "s2"), (1, "earnings_catalyst", "a"), (2, "earnings_surprise", "c"),
        ]
    )


def test_insights_of_changes_oddities_and_evidence(spark, now):
    before = analysis(spark, divergences=[("a", "f", "bear", 0.1, 0.3, 0.2, "amplified"), ("b", "f", "bear", 0.1, 0.3, 0.2, "amplified")], bridges=[("f", 2, 3, 3, ["x", "y"]), ("k", 2, 2, 2, ["x", "y"]), ("h", 1, 1, 1, ["x"])])
    odd = spark.createDataFrame([("m", 3.5, "spike", "critical"), ("n", -2.1, "drop", "warning")], "metric string, z double, direction string, severity string")
    base = set(kinds(reasoning.insights(now)))
    more = lambda **x: sorted(set(kinds(reasoning.insights(now, **x))) - base)
    assert more(before=before) == [(1, "new_bridge", "g"), (1, "new_regime_exposure", "c/f/bear"), (1, "new_regime_exposure", "d/f/bear"), (2, "lost_bridge", "k")]
    assert more(odd=odd) == [(1, "structural_anomaly", "m"), (2, "structural_anomaly", "n")]
    stats = lambda *row: spark.createDataFrame([row], STATS)
    assert more(stats=stats(100, 0.5, 0.4, 50, 60, 2.0, 30, 11)) == [(2, "expired_edges", "graph"), (2, "weak_evidence_base", "graph"), (3, "stale_edges", "graph"), (3, "strong_reconfirmation", "graph")]
    assert more(stats=stats(100, 0.5, 0.5, 31, 50, 2.0, 25, 10)) == [(3, "many_weak_edges", "graph")]
    assert more(stats=stats(0, None, None, 0, 0, None, 0, 0)) == []


def test_conclusions(spark, now):
    stats = spark.createDataFrame([(100, 0.35, 0.4, 50, 25, 2.0, 30, 10)], STATS)
    got = {r.question: (r.subject, r.value) for r in reasoning.conclusions(now, stats).collect()}
    assert got["most_influential_factor"] == ("f", 3.0) and got["most_stressed_sector"] == ("s1", 0.7) and got["dominant_pattern"] == ("convergence", 3.0)
    assert got["most_exposed_asset"] == ("a", pytest.approx(0.3))
    health = (0.5 + 0.5 + 0.6 + 3 / 50 + 2 / 5) / 5
    assert got["structural_health"] == ("fair", pytest.approx(health))
    alone = {r.question: (r.subject, r.value) for r in reasoning.conclusions(now).collect()}
    assert alone["structural_health"] == ("poor", pytest.approx((3 / 50 + 2 / 5) / 2))


def test_an_empty_analysis(spark):
    none = analysis(spark)
    assert reasoning.insights(none, none).collect() == []
    assert {r.question: r.subject for r in reasoning.conclusions(none).collect()} == {"dominant_pattern": "none"}
    rows = {r.metric: (r.value, r.name) for r in reasoning.summary_metrics(none).collect()}
    assert len(rows) == 26 and rows["bridge_count"] == (0, None) and rows["regime_divergence_mean"] == (None, None) and rows["bridge_max_span"] == (0, None)


def test_metrics_and_their_changes(spark, now):
    rows = {r.metric: r.name if r.value is None else r.value for r in reasoning.summary_metrics(now).collect()}
    want = {
        "exposure_asset_count": 3, "exposure_factor_count": 1, "exposure_pair_count": 3, "exposure_sim_mean": 0.92, "exposure_sim_max": 0.95, "exposure_top_pair": "a/b", "regime_pairs_analyzed": 4, "regime_divergence_count": 4, "regime_divergence_mean": 0.2125,
        "regime_divergence_max": 0.3, "regime_amplified_pct": 1, "regime_top_shift": "a/f/bear", "bridge_total_factors": 3, "bridge_count": 2, "bridge_max_span": 3, "bridge_factor_ids": "f,g", "centrality_top_node": "f", "centrality_top_degree": 5, "centrality_mean_degree": 3,
        "sector_count": 3, "sector_stress_max": 0.7, "sector_stress_mean": 0.4, "sector_most_stressed": "s1", "earnings_upcoming": 2, "earnings_recent_actuals": 2, "earnings_high_impact": 3,
    }
    assert rows.keys() == want.keys() and all(rows[k] == (v if isinstance(v, str) else pytest.approx(v)) for k, v in want.items())
    before = reasoning.summary_metrics(analysis(spark, bridges=[("f", 2, 1, 1, ["x"]), ("k", 2, 1, 1, ["x"])], sectors=[("s2", 1, 0.1, 0.0, None)]))
    got = {r.metric: (r.change, r.changed) for r in reasoning.metric_changes(before, reasoning.summary_metrics(now)).collect()}
    assert got["bridge_factor_ids"] == (None, "+g,-k") and got["bridge_count"] == (0, None) and got["sector_most_stressed"] == (None, "s2 -> s1") and got["sector_count"] == (2, None)


@pytest.mark.parametrize("ranges", [1, 2, 5, 256])
def test_running_sums_by_ranges(spark, ranges):
    rows = [(g, float(v), (int(v) * 7 + len(g)) % 5) for g, n in (("a", 40), ("bb", 1), ("ccc", 13)) for v in ([0, 1e9] if n == 1 else range(n))]
    got = running(spark.createDataFrame(rows, "g string, v double, w int").repartition(4), "v", "w", ["g"], ranges).collect()
    want = {(g, v): sum(w for h, u, w in rows if h == g and u < v) for g, v, _ in rows}
    assert {(r.g, r.v): r.before for r in got} == want and len(got) == len(rows)
    alone = spark.createDataFrame([r[1:] for r in rows if r[0] == "a"], "v double, w int")
    assert {r.v: r.before for r in running(alone, "v", "w", ranges=ranges).collect()} == {v: b for (g, v), b in want.items() if g == "a"}


def test_area_and_quarters_of_outliers(spark):
    scored = [(int(i % 3 == 0), float(i % 7)) for i in range(60)] + [(1, 1e12), (0, -1e12)]
    pos, neg = [s for y, s in scored if y], [s for y, s in scored if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert validation.auc(spark.createDataFrame(scored, "label int, score double")).first().auc == pytest.approx(want)
    assert validation.auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first().auc == 0.5
    values = [0.1 * (i % 9) for i in range(41)]
    edges = spark.createDataFrame([("r", v) for v in values] + [("one", 0.5), ("r", None)], "rel_type string, confidence double")
    got = {r.rel_type: r for r in intelligence.confidence_stats(edges).collect()}
    assert (got["r"].n, got["r"].p25, got["r"].p75) == (41, sorted(values)[10], sorted(values)[30]) and got["one"].p25 == got["one"].p75 == 0.5


RAW = "source_id string, name string, url string, category string, asset_types array<string>, data_types array<string>, method string, cadence string, auth boolean, free boolean, official boolean, clarity int"


def test_candidates_in_one_form(spark):
    rows = [
        (None, "  My  Süd-Source (2)! ", " http://x ", "Other", [" ETF", "etf", None, "bond"], ["OHLCV", "news", "odd"], " SDK ", "EOD", None, None, None, 9), ("own", "n", "u", "MACRO", None, None, None, None, True, False, True, None), (None, "", "u", None, [], [], None, None, None, None, None, 0),
        (None, "x", None, None, ["nothing"], [], None, None, None, None, None, 2), (None, "a" * 90, "u", None, ["crypto"], [], None, "yearly", True, True, False, 2),
    ]
    made = candidates.normalised(spark.createDataFrame(rows, RAW))
    got = [tuple(r) for r in made.collect()]
    assert got[0] == ("my_s_d_source_2", "My  Süd-Source (2)!", "http://x", "price", "sdk", "daily", False, True, False, ["etf", "bond"], ["ohlcv", "news", "odd"], 5, None)
    assert got[1] == ("own", "n", "u", "macro", "api", "unknown", True, False, True, [], [], 3, None)
    assert (got[2][-1], got[3][-1], got[3][3], got[2][-2]) == ("no name", "no url", "unknown", 1)
    assert len(got[4][0]) == 64 and got[4][3] == "crypto" and got[4][5] == "yearly"
    told = {r.source_id: r for r in candidates.proposals(made.withColumn("score", F.lit(0.5))).collect()}
    assert len(told) == 3 and told["my_s_d_source_2"].fields == ["date", "open", "high", "low", "close", "volume", "published_at", "title", "url", "source", "field_odd"]
    assert told["own"].fields == ["date", "value"] and told["own"].access == "paid key OWN_API_KEY" and told["own"].schedule == "not known" and told["own"].priority == "medium"
    assert told["my_s_d_source_2"].access == "none" and len(told["my_s_d_source_2"].checks) == 4


def test_claims_have_their_tiers(spark):
    schema = "symbol string, model string, n_folds long, mean_accuracy double, std_accuracy double, n_beat long, overall boolean"
    rows = [("aa", "x", 5, 0.60, 0.07, 3, True), ("aa", "y", 5, 0.53, 0.01, 3, False), ("aa", "z", 4, 0.53, 0.01, 1, False), ("bb", "x", 3, 0.5, 0.01, 3, False)]
    got = {(r.subject, r.predicate): r for r in candidates.fold_claims(spark.createDataFrame(rows, schema)).collect()}
    conf = {s: r.confidence for (s, p), r in got.items() if p == "achieves_wf_mean_accuracy"}
    assert conf == {"model:x_on_AA": 0.7, "model:y_on_AA": 0.58, "model:z_on_AA": 0.42, "model:x_on_BB": 0.42}
    lead = got["model:x_on_AA", "leads_walk_forward_comparison"]
    assert lead.object == "vs:y+z" and lead.confidence == 0.6 and len(got) == 5
    assert len(got["model:x_on_AA", "achieves_wf_mean_accuracy"].counterpoints) == 1 and got["model:z_on_AA", "achieves_wf_mean_accuracy"].object == "acc:0.5300_folds:4"
    met = candidates.performance_claims(spark.createDataFrame([("m", "S", "d1", 0.6), ("m", "T", "d1", 0.5)], "model string, symbol string, dataset string, accuracy double"), "accuracy", 0.55).collect()
    assert [(r.subject, r.object) for r in met] == [("model:m_on_S", "metric:accuracy_threshold:0.5500_dataset:d1")]
    feature = candidates.feature_claims(spark.createDataFrame([("rsi", "m", "d1", 0.03, 1.7)], "feature string, model string, dataset string, gain double, confidence double")).first()
    assert (feature.subject, feature.object, feature.confidence) == ("feature:rsi", "model:m_dataset:d1", 1.0)


def test_probes_fall_back_to_get(spark):
    schema = "source_id string, http_status int, latency_ms double"
    heads = spark.createDataFrame([("a", 200, 5.0), ("b", 405, 1.0), ("c", 501, 1.0), ("d", 404, 3.0)], schema)
    gets = spark.createDataFrame([("a", 500, 9.0), ("b", 200, 9.0)], schema)
    got = {r.source_id: (r.http_status, r.method) for r in candidates.answered(heads, gets).collect()}
    assert got == {"a": (200, "HEAD"), "b": (200, "GET"), "c": (501, "HEAD"), "d": (404, "HEAD")}
    probes = spark.createDataFrame([(True, "HEAD", 10.0), (True, "NONE", 99.0), (True, "GET", 0.0), (False, "GET", 50.0)], "ok boolean, method string, latency_ms double")
    assert tuple(candidates.probe_summary(probes, 6).first()) == (6, 4, 3, 1, 2, 10.0, 0.75)
    assert tuple(candidates.probe_summary(probes.limit(0), 6).first()) == (6, 0, 0, 0, 6, None, None)


def test_builders(spark):
    pairs = spark.createDataFrame([("b", "a", 0.5), ("a", "b", -0.7), ("a", "a", 1.0), ("c", "a", None)], "a string, b string, r double")
    assert [tuple(r) for r in builders.correlated(pairs).collect()] == [("a", "b", -0.7, "CORRELATED_WITH")]
    assets = spark.createDataFrame([("x", "s", "i"), ("y", "s", None), ("z", None, "j")], "asset string, sector string, industry string")
    assert sorted((r.src, r.dst) for r in builders.classified(assets).collect()) == [("industry:i", "sector:s"), ("x", "industry:i"), ("x", "sector:s"), ("y", "sector:s"), ("z", "industry:j")]
    reports = spark.createDataFrame([("x", DAY, 1.0), ("x", DAY, 2.0), ("y", DAY, 3.0)], "symbol string, date date, eps double")
    nodes, links = builders.reported(reports, spark.createDataFrame([("x",)], "symbol string"))
    assert [(r.event_id, r.eps) for r in nodes.collect()] == [("earnings_x_2024-05-01", 2.0)] and links.count() == 1
    supplies = spark.createDataFrame([("s", "c", 0.2), ("s", "d", None), ("s", "e", 0.0)], "src string, dst string, share double")
    impacts, sectors = spark.createDataFrame([("m", "c")], "src string, dst string"), spark.createDataFrame([("c", "t")], "asset string, sector string")
    found = spark.createDataFrame([("a", "b", "leads", -0.5), ("a", "c", "inverse", -0.4)], "a string, b string, relationship_type string, r double")
    got = sorted((r.src, r.dst, r.rel, r.weight) for r in builders.knowledge(supplies, impacts, sectors, found).collect())
    assert got == sorted([("s", "c", "supplies_to", 0.2), ("c", "s", "supplies_to", 0.1), ("s", "d", "supplies_to", 0.1), ("d", "s", "supplies_to", 0.05), ("s", "e", "supplies_to", 0.1), ("e", "s", "supplies_to", 0.05), ("m", "c", "impacts", 1.0), ("c", "SECTOR:t", "belongs_to", 1.0), ("SECTOR:t", "c", "belongs_to", 1.0), ("a", "b", "leads", 0.5), ("a", "c", "inverse", 0.4), ("c", "a", "inverse", 0.4)])
    featured = spark.createDataFrame([(1, None, 2.00004, 3.0)], "k int, rsi_14 double, macd double, obv double")
    assert [(r.place, r.name, r.value) for r in builders.shown(featured, ["k"], 2).collect()] == [(1, "MACD", 2.0), (2, "OBV", 3.0)]


def test_short_positions_pay_once_for_a_turn(spark):
    closes = [100.0, 110.0, 99.0, 99.0, 108.9]
    prices = spark.createDataFrame([("A", DAY + dt.timedelta(i), c) for i, c in enumerate(closes)], "asset string, ts date, close double")
    signals = spark.createDataFrame([("A", DAY + dt.timedelta(i), s) for i, s in enumerate([0.0, 1.0, 0.0, 1.0, 1.0])], "asset string, ts date, score double")
    rows = backtest.positions(prices, signals, cost=0.01, delay=2, short=True).orderBy("ts").collect()
    assert [r.position for r in rows] == [0, -1, 1, -1, 1]
    assert [r.strategy_return for r in rows] == pytest.approx([0.0, -0.01, 0.1 - 0.01, -0.01, -0.1 - 0.01])

"""Edge cases on small tables."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import windows
from tidemark.operators import asof, backtest, discovery, features, graph, lifecycle, quality, validation
from tidemark.plans import governance, operations
from tidemark.sources import payloads, sinks, tables
from tidemark.streaming.bars import bucketed, stream_bars

DAY = dt.date(2024, 1, 1)


def prices(spark, closes, asset="A"):
    rows = [(asset, DAY + dt.timedelta(i), c, c + 1.0, c - 1.0, c, 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "asset string, ts date, open double, high double, low double, close double, volume double")


def test_roll_needs_the_full_window(spark):
    got = prices(spark, [1.0, 2.0, 3.0, 4.0]).select("ts", windows.roll(F.avg, "close", 3).alias("x")).orderBy("ts")
    assert [r.x for r in got.collect()] == [None, None, 2.0, 3.0]


def test_ewm_matches_pandas(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    got = windows.ewm(prices(spark, x), {"y": ("close", 0.3)}).orderBy("ts").collect()
    want = pd.Series(x).ewm(alpha=0.3, adjust=False).mean()
    assert [round(r.y, 12) for r in got] == [round(v, 12) for v in want]


def test_rsi_is_null_without_losses(spark):
    got = features.moving_averages(prices(spark, [float(i) for i in range(1, 31)])).collect()
    assert all(r.rsi_14 is None for r in got)


def test_constant_series_has_no_correlation(spark):
    got = prices(spark, [2.0] * 30).withColumn("other", F.col("close")).select(windows.rolling_corr("close", "other", 21).alias("r")).collect()
    assert all(r.r is None for r in got)


def test_features_of_an_empty_table(spark):
    empty = prices(spark, [1.0]).limit(0)
    assert features.base_features(empty).count() == 0


def test_asof_row_and_value(spark):
    left = spark.createDataFrame([("k", DAY + dt.timedelta(i)) for i in range(4)], "key string, ts date")
    right = spark.createDataFrame([("k", DAY, 1.0), ("k", DAY + dt.timedelta(2), None)], "key string, ts date, value double")
    get = lambda skip: [r.value for r in asof.asof(left, right, "key", "value", skip).orderBy("ts").collect()]
    assert get(True) == [1.0, 1.0, 1.0, 1.0]
    assert get(False) == [1.0, 1.0, None, None]


def test_open_trade_is_left_out(spark):
    p = prices(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    on = p.select("asset", "ts", F.lit(1.0).alias("score"))
    assert backtest.trades(backtest.positions(p, on)).count() == 0


def test_keep_latest_takes_new_rows(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 1, "old")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 2, "new"), (1, 3, "newer"), (3, 1, "new")], "k int, at int, v string")
    got = {r.k: r.v for r in quality.keep_latest(old, new, ["k"], ["at"]).collect()}
    assert got == {1: "newer", 2: "old", 3: "new"}


def test_hops_in_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")], "src string, dst string")
    got = {(r.node, r.hop) for r in graph.hops(edges, spark.createDataFrame([("a",)], "node string"), 5).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_auc_of_one_class(spark):
    assert validation.auc(spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")).first().auc == 0.5


def test_payloads(spark):
    raw = spark.createDataFrame([("BTC", "[[1704067200000, 1, 3, 0.5, 2]]")], "asset string, body string")
    assert payloads.ohlc_arrays(raw).first().close == 2.0
    raw = spark.createDataFrame([("X", '[{"date":"2024-01-01","value":"1,000.5"},{"date":"2024-01-02","value":"."}]')], "indicator string, body string")
    assert [r.value for r in payloads.observations(raw).collect()] == [1000.5]
    raw = spark.createDataFrame([("S", "<ns1:infoTable><ns1:nameOfIssuer>ACME</ns1:nameOfIssuer><ns1:value>1,200</ns1:value><ns1:sshPrnamt>7</ns1:sshPrnamt></ns1:infoTable>")], "symbol string, body string")
    assert tuple(payloads.info_tables(raw).first()) == ("S", "ACME", 1200.0, 7.0)
    raw = spark.createDataFrame([("A", '{"2024-01-02":{"open":"1","high":"2","low":"1","close":"2","volume":"9"},"2024-01-03":{"close":"0"}}')], "asset string, body string")
    assert payloads.daily_map(raw).count() == 1
    got = payloads.earnings(spark.createDataFrame([(1.5, 1.0), (None, 1.0)], "eps double, eps_estimate double")).collect()
    assert [r.eps_surprise_pct for r in got] == [50.0, None]


def test_stream_equals_batch(spark, tmp_path):
    events = tables.table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert run.awaitTermination(120)
    got, want = spark.table("bars_out"), bucketed(events)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_chi2_tail_of_known_values():
    # P(X > x) for 1, 2, 3 and 5 degrees of freedom
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (11.070498, 5, 0.05)):
        assert abs(discovery.chi2_tail(x, df) - p) < 1e-6


def test_granger_finds_the_planted_direction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = 0.8 * np.concatenate([[0], x[:-1]]) + 0.3 * rng.normal(size=400)
    assert discovery.granger_p(x, y) < 1e-6 < discovery.granger_p(y, x)
    assert discovery.granger_p(x[:20], y[:20]) is None


def test_discovery_queries(spark):
    d = "/root/testdata/sf0.001"
    p = governance.catalog()["granger"][0](spark, d).toPandas()
    assert len(p) > 0 and p[["p_a_causes_b", "p_b_causes_a"]].stack().between(0, 1).all()
    clusters = governance.catalog()["regime_clusters"][0](spark, d).toPandas()
    assert set(clusters["cluster"]) == {0, 1, 2}
    mixture = governance.catalog()["regime_mixture"][0](spark, d).toPandas()
    assert mixture["probability"].between(0.5, 1).all()
    factors = governance.catalog()["latent_factors"][0](spark, d).toPandas()
    assert len(factors) == 10 and abs((factors.groupby("component")["loading"].apply(lambda v: (v**2).sum()) - 1)).max() < 1e-4


def test_sinks(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "k int, at int, v string")
    one, two = str(tmp_path / "1"), str(tmp_path / "2")
    assert sinks.stored(spark, one) is None
    sinks.upsert(frame([(1, 1, "a"), (2, 1, "b")]), one, one + "x", ["k"], ["at"])
    sinks.upsert(frame([(2, 2, "c"), (3, 1, "d")]), one + "x", two, ["k"], ["at"])
    assert sorted(map(tuple, sinks.stored(spark, two).collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    bad = frame([(1, 1, "a")]).withColumnRenamed("v", "reason")
    for entry_id in ("e1", "e2"):
        sinks.quarantine(bad, one, entry_id, "s", "2024-01-01")
    done = spark.createDataFrame([("e1",)], "entry_id string")
    assert [tuple(r) for r in sinks.quarantine_summary(spark.read.parquet(one), done).collect()] == [("s", "a", 2, 2, 1)]


def test_registry_edge_cases(spark):
    registry = spark.createDataFrame([("a", "discovered"), ("b", "approved"), ("c", None)], "id string, status string")
    changes = spark.createDataFrame([("a", "sampled"), ("b", "sampled"), ("c", "sampled")], "id string, new_status string")
    got = {r.id: (r.status, r.accepted) for r in lifecycle.transitioned(registry, changes, "id").collect()}
    assert got == {"a": ("sampled", True), "b": ("approved", False), "c": (None, False)}
    log = [("x", i, i, a) for i, a in enumerate(["promote", "finish", "promote", "backtest", "promote", "promote", "archive"])]
    states = lifecycle.experiments(spark.createDataFrame(log[:6], "experiment_id string, at int, seq int, action string")).collect()
    assert [tuple(r) for r in states] == [("x", "promoted", True, 1, 3)]
    assert lifecycle.experiments(spark.createDataFrame(log, "experiment_id string, at int, seq int, action string")).first().status == "archived"


def test_top_k_of_a_table_of_queries(spark):
    from tidemark.operators import vectors

    rng = np.random.default_rng(4)
    points = rng.normal(size=(120, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    plan = vectors.top_k(rows, rows.selectExpr("vec_id as query_id", "embedding as query"), 7)
    assert repr(float(points[3][0])) not in plan.sparkSession._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "extended")  # queries are no literals
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = {(q, int(v), r + 1) for q in range(120) for r, v in enumerate(np.argsort(-np.round(unit @ unit[q], 9), kind="stable")[:7])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in plan.collect()} == want


def test_searches_start_from_all_rows(spark):
    d = "/root/testdata/sf0.001"
    found = {n: q for n, (q, _) in operations.catalog().items()}
    ids = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert {r.query_id for r in found["vector_top_k_of_twentieth"](spark, d).collect()} == ids
    assert found["graph_hops_of_all"](spark, d).where("hop = 0").count() == spark.read.parquet(f"{d}/part.parquet").count()


def test_merged_edges_need_both_ends_in_sql_too(spark, tmp_path):
    """Orders of customers that there are not make no new edge, in the query and in its SQL (which made them)."""
    import duckdb

    from tidemark.plans.operations import SPLIT

    d = "/root/testdata/sf0.001"
    spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 3 > 0").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{d}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    query, text = operations.catalog()["graph_merge_edges"]
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = ("src", "dst", "rel", "evidence", "first_seen", "last_seen")
    got, want = {tuple(r[c] for c in columns) for r in query(spark, str(tmp_path)).collect()}, set(con.sql(f"SELECT {', '.join(columns)} FROM ({text})").fetchall())
    assert got == want
    before = {r[0] for r in con.sql(f"SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderdate < DATE '{SPLIT}'").fetchall()}
    assert all(int(src) % 3 > 0 or src in before for src, *_ in got)


def test_hops_through_few_nodes_gather_no_node_in_a_task(spark):
    """20,000 origins, 400 nodes, then 2: the last join sorted all origins of one node in one task."""
    from tidemark.operators import graph

    links = [spark.range(40000).selectExpr("concat('P', id % 20000) as src", "concat('S', pmod(hash(id), 400)) as dst"), spark.range(400).selectExpr("concat('S', id) as src", "concat('N', id % 2) as dst"), spark.range(2).selectExpr("concat('N', id) as src", "'R' as dst")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        found = graph.hops(links[0].union(links[1]).union(links[2]), spark.range(20000).selectExpr("concat('P', id) as node"), 3)
        rows = {tuple(r) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Inner, BuildRight") >= 2, plan
    two = {(o, f"N{int(n[1:]) % 2}", 2) for o, n, k in rows if k == 1}
    assert {r for r in rows if r[2] == 2} == two and {r for r in rows if r[2] == 3} == {(o, "R", 3) for o, _, _ in two}

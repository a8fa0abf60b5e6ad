"""Queries over the other tables: quality, relations, graph, validation, vectors, text, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import lag
from tidemark.operators import graph, quality, relations, text, validation, vectors
from tidemark.plans.market import BENCHMARK, bars, rounded
from tidemark.plans.sql import BARS, STEP, S, picked
from tidemark.sources.tables import table
from tidemark.streaming.bars import bucketed, last_values

SPLIT, AS_OF = "1998-01-01", "2001-08-01"
BULL, BEAR = ["mit", "license", "version", "free"], ["token", "password", "secret", "key"]


def query(f):
    """A query of bars."""
    return lambda spark, sf_dir: f(bars(spark, sf_dir))


def series(prices: DataFrame) -> DataFrame:
    return prices.select("asset", "ts", F.ln(F.try_divide("close", lag("close"))).alias("ret"))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(line).alias("value"), F.lit(0).alias("at"))
    return rounded(quality.reconciled(a, b, "k"), ["k"], ["value", "diff"])


def _orders(spark, sf_dir, recent: bool) -> DataFrame:
    found = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= SPLIT) if recent else (F.col("o_orderdate") < SPLIT))
    return found.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep_latest(_orders(spark, sf_dir, False), _orders(spark, sf_dir, True), ["o_custkey"], ["day", "o_orderkey"])


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = series(bars(spark, sf_dir))
    bench = rets.where(F.col("asset") == BENCHMARK).select("ts", F.col("ret").alias("x"), F.when(relations.bear(), "bear").otherwise("bull").alias("regime"))
    rows = rets.where(F.col("asset") != BENCHMARK).withColumnRenamed("ret", "y").join(bench, "ts")
    return rounded(relations.exposures(rows, ["asset", "regime"], 40), ["asset", "regime", "n"], ["beta", "alpha", "r2", "se", "t"])


def _layers(spark, sf_dir) -> DataFrame:
    """part -> supplier -> nation -> region."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "lineitem").select(name("P", "l_partkey").alias("src"), name("S", "l_suppkey").alias("dst"))
    edges = edges.unionAll(table(spark, sf_dir, "supplier").select(name("S", "s_suppkey"), name("N", "s_nationkey")))
    return edges.unionAll(table(spark, sf_dir, "nation").select(name("N", "n_nationkey"), name("R", "n_regionkey"))).distinct()


LAYERS = "SELECT DISTINCT * FROM (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every part."""
    start = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"))
    return graph.hops(_layers(spark, sf_dir), start, 3)


HOPS = f"""WITH e AS ({LAYERS}), s AS (SELECT 'P' || p_partkey AS origin FROM part),
 one AS (SELECT DISTINCT origin, dst AS node FROM s JOIN e ON origin = src), two AS (SELECT DISTINCT origin, dst AS node FROM one JOIN e ON node = src),
 three AS (SELECT DISTINCT origin, dst AS node FROM two JOIN e ON node = src)
 SELECT origin, origin AS node, 0 AS hop FROM s UNION ALL SELECT origin, node, 1 FROM one UNION ALL SELECT origin, node, 2 FROM two UNION ALL SELECT origin, node, 3 FROM three"""


def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("class"))
    return graph.bridges(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).join(parts, "src"))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc("l_shipdate", "month")
    weights = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("node"), month.alias("factor")).agg((F.avg("l_discount") - 0.05).alias("beta"))
    return rounded(graph.profile_similarity(weights), ["node_a", "node_b"], ["cosine"])


def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.when(F.col("o_orderpriority") == "1-URGENT", "CAUSES").when(F.col("o_orderpriority") == "2-HIGH", "CORRELATED_WITH").when(F.col("o_orderpriority") == "3-MEDIUM", "SENSITIVE_TO").otherwise("OTHER")
    edges = table(spark, sf_dir, "orders").select("o_orderkey", relation.alias("rel"), F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate").alias("age"), (F.pmod("o_orderkey", F.lit(7)) + 1).alias("evidence"), F.lit(0.8).alias("confidence"))
    return edges.select("o_orderkey", (F.round(graph.decayed("confidence", "age", "evidence", "rel"), 6)).alias("confidence"), graph.staleness("age", "evidence").alias("staleness"))


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderstatus").alias("dst"), F.lit("HAS").alias("rel"), F.to_date("o_orderdate").alias("day"))
    old = orders.where(F.col("day") < SPLIT).groupBy("src", "dst", "rel").agg(F.count("*").alias("evidence"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node")).unionAll(orders.select(F.col("dst").alias("node")).distinct())
    return graph.merged_edges(old, orders.where(F.col("day") >= SPLIT), nodes, AS_OF)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lambda recent: _orders(spark, sf_dir, recent).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return graph.changes(counts(False), counts(True), ["o_custkey"], "n", 3)


def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = series(bars(spark, sf_dir))
    each = validation.sliced(rets, validation.folds(rets)).groupBy("asset", "fold", "part").agg(F.avg("ret").alias("value"))
    return rounded(validation.fold_summary(each, ["asset", "part"], "value"), ["asset", "part", "n_folds"], ["mean", "std", "min", "max"])


FOLDS = f"""SELECT asset, CAST(fold AS INT) AS fold, CAST(0 AS BIGINT) AS train_start, CAST(120 + fold * size AS BIGINT) AS train_end,
 CAST(120 + fold * size AS BIGINT) AS test_start, CAST(120 + fold * size + size AS BIGINT) AS test_end,
 CAST(120 + fold * size - greatest(floor((120 + fold * size) * 0.15), 1) AS BIGINT) AS val_start
 FROM (SELECT asset, count(*) AS n, greatest((count(*) - 120) // 5, 1) AS size FROM ({BARS}) GROUP BY asset), range(5) t(fold) WHERE 120 + fold * size + size <= n"""


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).cast("int").alias("predicted"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return rounded(validation.classification(docs.join(labels, "doc_id"), ["lang"]), ["lang", "tp", "fp", "tn", "fn"], ["accuracy", "precision", "recall", "f1"])


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return rounded(validation.auc(scored), [], ["auc"])


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all."""
    found = table(spark, sf_dir, "embeddings")
    asked = found.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(vectors.top_k(found, asked, 10), ["query_id", "vec_id", "rank"], ["score"])


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("doc_id", text.sentiment("text", BULL, BEAR).alias("sentiment"), text.relevance("text", "license token version").alias("relevance"))
    return scored.withColumn("label", text.sentiment_label("sentiment"))


TOP_K = picked("SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank, score FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) <= 10", ["query_id", "vec_id", "rank"], ["score"])


def _list(x: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in x) + "]"


RETS = f"SELECT asset, ts, lr AS ret FROM ({STEP})"
POINTS = f"SELECT a.asset AS a, b.asset AS b, a.ret AS x, b.ret AS y, row_number() OVER (PARTITION BY a.asset, b.asset ORDER BY a.ts) AS i FROM ({RETS}) a JOIN ({RETS}) b USING (ts) WHERE a.asset < b.asset AND a.ret IS NOT NULL AND b.ret IS NOT NULL"
SWEEP = f"""WITH p AS ({POINTS}), r AS (SELECT a.a, a.b, CAST(lag AS INT) AS lag, corr(a.x, c.y) AS r, count(*) AS n FROM p a, range(-20, 21) t(lag), p c
 WHERE c.a = a.a AND c.b = a.b AND c.i = a.i - lag GROUP BY 1, 2, 3)
 SELECT *, CASE WHEN lag > 0 THEN b WHEN lag < 0 THEN a END AS leader FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(abs(r), 9) DESC, lag) = 1"""
BEAR_DAYS = f"SELECT ts, lr AS x, CASE WHEN count(lr) OVER (ORDER BY ts ROWS 62 PRECEDING) = 63 AND sum(lr) OVER (ORDER BY ts ROWS 62 PRECEDING) < 0 THEN 'bear' ELSE 'bull' END AS regime FROM ({STEP}) WHERE asset = '{BENCHMARK}'"
FIT = f"SELECT asset, regime, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, regr_r2(y, x) AS r2, sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / ((count(*) - 2) * regr_sxx(y, x))) AS se, count(*) AS n FROM (SELECT asset, regime, lr AS y, x FROM ({STEP}) JOIN ({BEAR_DAYS}) USING (ts) WHERE asset <> '{BENCHMARK}') WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 40"
Z = f"SELECT asset, ts, close, volume, (close - avg(close) OVER p) / stddev_samp(close) OVER p AS zp, (volume - avg(volume) OVER p) / stddev_samp(volume) OVER p AS zv FROM ({BARS}) WINDOW p AS (PARTITION BY asset)"
REL = "CASE o_orderpriority WHEN '1-URGENT' THEN 45.0 WHEN '2-HIGH' THEN 60.0 WHEN '3-MEDIUM' THEN 180.0 ELSE 90.0 END"
CHECKS = f"SELECT asset, count(*) AS n, count(*) - count(DISTINCT ts) AS dup, count(*) FILTER (WHERE high < low OR close < low OR close > high OR volume < 0) AS insane, DATE '{AS_OF}' - max(ts) AS age FROM ({BARS}) GROUP BY asset"


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    order_counts = lambda op: f"SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate {op} DATE '{SPLIT}' GROUP BY 1"
    return {
        "quality_outliers": (query(lambda b: rounded(quality.flagged(b, 2, 2), ["asset", "ts", "reason"], ["z"])), picked(f"SELECT asset, ts, CASE WHEN abs(zp) > 2 THEN 'price_outlier' ELSE 'volume_spike' END AS reason, CASE WHEN abs(zp) > 2 THEN zp ELSE zv END AS z FROM ({Z}) WHERE abs(zp) > 2 OR zv > 2", ["asset", "ts", "reason"], ["z"])),
        "quality_checks": (query(lambda b: quality.checks(b, AS_OF)), f"""WITH c AS ({CHECKS}) SELECT asset, 'row_count' AS "check", 'ERROR' AS severity, n >= 10 AS passed, CAST(n AS DOUBLE) AS detail FROM c UNION ALL SELECT asset, 'duplicate_timestamps', 'ERROR', dup = 0, dup FROM c UNION ALL SELECT asset, 'null_rate', 'ERROR', true, 0 FROM c UNION ALL SELECT asset, 'price_sanity', 'ERROR', insane = 0, insane FROM c UNION ALL SELECT asset, 'stale_data', 'WARN', age <= 7, age FROM c"""),
        "reconcile": (reconcile, picked("SELECT *, abs(other - value) / abs(value) AS diff FROM (SELECT o_orderkey AS k, o_totalprice AS value, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS other FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) WHERE value <> 0 AND abs(other - value) / abs(value) > 0.005", ["k"], ["value", "diff"])),
        "upsert_keep_latest": (upsert, f"SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate >= DATE '{SPLIT}' DESC, o_orderdate DESC, o_orderkey DESC) = 1"),
        "lag_sweep": (query(lambda b: rounded(relations.lag_sweep(series(b)), ["a", "b", "lag", "n", "leader"], ["r"])), picked(SWEEP, ["a", "b", "lag", "n", "leader"], ["r"])),
        "correlation_matrix": (query(lambda b: rounded(relations.correlations(series(b)).drop("n").withColumn("strength", relations.strength()), ["a", "b", "strength"], ["r"])), picked(f"SELECT *, CASE WHEN abs(r) >= 0.65 THEN 'strong' WHEN abs(r) >= 0.45 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT a, b, corr(x, y) AS r FROM ({POINTS}) GROUP BY 1, 2)", ["a", "b", "strength"], ["r"])),
        "factor_exposures": (exposures, picked(f"SELECT *, beta / se AS t FROM ({FIT})", ["asset", "regime", "n"], ["beta", "alpha", "r2", "se", "t"])),
        "graph_degrees": (lambda s, d: graph.degrees(_layers(s, d)), f"WITH e AS ({LAYERS}) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1"),
        "graph_hops": (hops, HOPS),
        "graph_hops_of_all": (hops, HOPS),
        "graph_bridges": (bridges, "SELECT l_suppkey AS dst, count(DISTINCT p_brand) AS n_classes, count(DISTINCT l_partkey) AS n_sources, count(*) AS n_edges FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2"),
        "graph_similarity": (similarity, picked("WITH w AS (SELECT l_returnflag || l_linestatus AS node, date_trunc('month', l_shipdate) AS factor, avg(l_discount) - 0.05 AS beta FROM lineitem GROUP BY 1, 2), n AS (SELECT node, sqrt(sum(beta * beta)) AS norm FROM w GROUP BY 1) SELECT a.node AS node_a, b.node AS node_b, sum(a.beta * b.beta) / (any_value(na.norm) * any_value(nb.norm)) AS cosine FROM w a JOIN w b USING (factor) JOIN n na ON na.node = a.node JOIN n nb ON nb.node = b.node WHERE a.node < b.node GROUP BY 1, 2", ["node_a", "node_b"], ["cosine"])),
        "graph_decay": (decay, f"WITH e AS (SELECT o_orderkey, {REL} AS hl, DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS age, o_orderkey % 7 + 1 AS ev FROM orders) SELECT o_orderkey, round(CASE WHEN age <= 0 THEN 0.8 ELSE greatest(0.8 * pow(0.5, age / (hl * (1 + 0.2 * (ev - 1)))), 0.08) END, 6) AS confidence, CASE WHEN age <= 30 + 7 * least(ev - 1, 5) THEN 'fresh' WHEN age <= 90 + 7 * least(ev - 1, 5) THEN 'aging' WHEN age <= 180 + 7 * least(ev - 1, 5) THEN 'stale' ELSE 'expired' END AS staleness FROM e"),
        "graph_merge_edges": (merged_edges, f"WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS src, o_orderstatus AS dst, CAST(o_orderdate AS DATE) AS day FROM orders), old AS (SELECT src, dst, count(*) AS evidence, min(day) AS f, max(day) AS l FROM o WHERE day < DATE '{SPLIT}' GROUP BY 1, 2), new AS (SELECT DISTINCT src, dst FROM o WHERE day >= DATE '{SPLIT}' AND src IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) AND dst IN (SELECT dst FROM o)) SELECT src, dst, 'HAS' AS rel, coalesce(evidence, 0) + CAST(new.src IS NOT NULL AS BIGINT) AS evidence, coalesce(f, DATE '{AS_OF}') AS first_seen, CASE WHEN new.src IS NOT NULL THEN DATE '{AS_OF}' ELSE l END AS last_seen FROM old FULL JOIN new USING (src, dst)".replace("new.src IS NOT NULL", "new.mark = 1").replace("SELECT DISTINCT src, dst FROM o", "SELECT DISTINCT src, dst, 1 AS mark FROM o").replace("CAST(new.mark = 1 AS BIGINT)", "coalesce(new.mark, 0)")),
        "graph_changes": (changes, f"SELECT * FROM (SELECT o_custkey, a.n AS before, b.n AS after, CASE WHEN a.n IS NULL THEN 'gained' WHEN b.n IS NULL THEN 'lost' WHEN abs(b.n - a.n) >= 3 THEN 'shifted' END AS change FROM ({order_counts('<')}) a FULL JOIN ({order_counts('>=')}) b USING (o_custkey)) WHERE change IS NOT NULL"),
        "walk_forward_folds": (query(validation.folds), FOLDS),
        "walk_forward_summary": (fold_summary, picked(f"WITH f AS ({FOLDS}), r AS (SELECT *, row_number() OVER ({S}) - 1 AS i FROM ({RETS})), v AS (SELECT asset, fold, CASE WHEN i >= train_start AND i < val_start THEN 'train' WHEN i >= val_start AND i < train_end THEN 'val' WHEN i >= test_start AND i < test_end THEN 'test' END AS part, avg(ret) AS value FROM r JOIN f USING (asset) GROUP BY 1, 2, 3) SELECT asset, part, count(value) AS n_folds, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM v WHERE part IS NOT NULL GROUP BY 1, 2", ["asset", "part", "n_folds"], ["mean", "std", "min", "max"])),
        "classification_metrics": (classification, picked("SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM (SELECT *, (tp + tn) / (tp + fp + tn + fn + 1e-9) AS accuracy, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall FROM (SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars > 1000) AS fp, count(*) FILTER (WHERE quality = 0 AND n_chars <= 1000) AS tn, count(*) FILTER (WHERE quality = 1 AND n_chars <= 1000) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang))", ["lang", "tp", "fp", "tn", "fn"], ["accuracy", "precision", "recall", "f1"])),
        "auc": (auc, "WITH s AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), g AS (SELECT n_chars, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q FROM s GROUP BY 1), h AS (SELECT *, coalesce(sum(q) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(CAST(sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS DOUBLE), 6) AS auc FROM h"),
        "vector_top_k": (top_k, TOP_K),
        "vector_top_k_of_twentieth": (top_k, TOP_K),
        "text_scores": (text_scores, f"SELECT doc_id, sentiment, relevance, CASE WHEN sentiment > 0.1 THEN 'bullish' WHEN sentiment < -0.1 THEN 'bearish' ELSE 'neutral' END AS label FROM (SELECT doc_id, coalesce(round((u - d) / nullif(u + d, 0), 3), 0) AS sentiment, relevance FROM (SELECT doc_id, len(list_intersect(ws, {_list(BULL)})) AS u, len(list_intersect(ws, {_list(BEAR)})) AS d, round(len(list_filter(['license', 'token', 'version'], lambda q: contains(lower(text), q))) / 3, 3) AS relevance FROM (SELECT doc_id, text, list_distinct(regexp_split_to_array(lower(text), '\\W+')) AS ws FROM documents)))"),
        "stream_bars": (lambda s, d: bucketed(table(s, d, "events")), "SELECT event_type, date_trunc('day', ts) AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, round(sum(value), 4) AS volume, count(*) AS n FROM events GROUP BY 1, 2"),
        "stream_last_values": (lambda s, d: last_values(table(s, d, "events")), "SELECT *, round((last - first) / first * 100, 4) AS change_pct FROM (SELECT event_type, arg_max(value, row(ts, event_id)) AS last, arg_min(value, row(ts, event_id)) AS first, max(ts) AS ts FROM events GROUP BY 1)"),
        "strongest_sources": (lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "source"))), "SELECT *, CAST(row_number() OVER (ORDER BY n DESC, source) AS INT) AS rank FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS n_long FROM documents GROUP BY 1)"),
    }

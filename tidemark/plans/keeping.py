"""Queries of registers, logs, collections, and of what compares and limits them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import baseline, discovery, expanded, features, filters, mentions, pairwise, records, relations, validation, vector_index, walkforward
from tidemark.plans.discovery import returns
from tidemark.plans.market import BENCHMARK, bars, rounded
from tidemark.plans.modelling import BRAND_CLOSES, FILING_RELATIONS, brand_closes, filing_relations, fitted_folds
from tidemark.plans.sql import BARS, S, picked
from tidemark.sources.sinks import new_folder
from tidemark.sources.tables import table
from tidemark.streaming import sinks


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as candidates: known by their number, or by their address in another spelling."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), "url")
    registry = pages.where("page_id % 2 = 0").select(F.col("page_id").cast("string").alias("source_id"), F.concat(F.upper("url"), F.lit("/")).alias("url"))
    candidates = pages.select(F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise(F.concat(F.lit("new"), "page_id")).alias("source_id"), "url")
    return records.matched(candidates, registry)


MATCHED = """WITH r AS (SELECT CAST(page_id AS VARCHAR) AS id, regexp_replace(lower(trim(url)), '/+$', '') AS u FROM pages WHERE page_id % 2 = 0), b AS (SELECT u, min(id) AS by_url FROM r GROUP BY 1),
 c AS (SELECT CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'new' || page_id END AS source_id, url FROM pages)
 SELECT source_id, url, coalesce(r.id, by_url) AS known_id, CASE WHEN r.id IS NOT NULL THEN 'id' WHEN by_url IS NOT NULL THEN 'url' END AS by FROM c LEFT JOIN r ON r.id = source_id LEFT JOIN b ON b.u = regexp_replace(lower(trim(url)), '/+$', '')"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as experiments: the version of their priority, compared under that of their status."""
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model_type"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("dataset_version"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("comparison_version"))
    return records.groups_of_versions(made)


VERSIONS = "SELECT version, count(*) AS n, count(DISTINCT m) AS n_models, arg_min(k, (-p, k)) AS best FROM (SELECT o_orderkey AS k, o_custkey % 3 AS m, o_totalprice AS p, unnest([o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END]) AS version FROM orders) WHERE version IS NOT NULL GROUP BY 1"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entries of a log that an agent has kept."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.concat(F.lit("agent"), F.col("user_id") % 3).alias("agent"), F.col("event_type").alias("action"), F.col("ts").alias("created"), "value")
    return records.listed(log, "agent1", "purchase", 25).select("entry_id", "created", "value")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors kept by collection in a table that is written twice: all, then those of one label anew."""
    path, found = new_folder(spark, "vectors"), table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("label") % 2).alias("collection"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(1).alias("version"), "label")
    keys = ["collection", "id"]
    sinks.upsert_partitions(found, path, keys, ["version"], "collection")
    sinks.upsert_partitions(found.where("label = 2").withColumns({"version": F.lit(2), "vector": F.slice("vector", 1, 8)}), path, keys, ["version"], "collection")
    return records.collection_info(spark.read.parquet(path))


COLLECTIONS = "SELECT collection, CAST(sum(n) AS BIGINT) AS n_points, CAST(arg_max(d, (n, d)) AS INT) AS dims, CAST(sum(n) - max(n) AS BIGINT) AS n_other FROM (SELECT 'c' || label % 2 AS collection, CASE WHEN label = 2 THEN 8 ELSE len(embedding) END AS d, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY 1"


def claim_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of orders as a graph: edges with their status, and the number of claims at both ends."""
    status = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "weak").otherwise("draft")
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("asset:"), "o_custkey").alias("subject"), F.lit("is_like").alias("predicate"), F.concat(F.lit("domain:"), "o_orderpriority").alias("object"), (F.col("o_totalprice") / 500000).alias("confidence"), status.alias("status"))
    nodes, edges = records.claim_graph(claims, {"asset": "Asset"})
    n = nodes.select("node", "kind", "label", "n_claims")
    return edges.join(n.select(F.col("node").alias("src"), F.col("label").alias("asset"), F.col("kind").alias("src_kind"), F.col("n_claims").alias("src_claims")), "src").join(n.select(F.col("node").alias("dst"), F.col("kind").alias("dst_kind"), F.col("n_claims").alias("dst_claims")), "dst").select("claim_id", "asset", "dst", "status", "src_kind", "dst_kind", "src_claims", "dst_claims")


CLAIM_GRAPH = "SELECT o_orderkey AS claim_id, CAST(o_custkey AS VARCHAR) AS asset, 'domain:' || o_orderpriority AS dst, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'weak' ELSE 'proposed' END AS status, 'Asset' AS src_kind, 'unknown' AS dst_kind, count(*) OVER (PARTITION BY o_custkey) AS src_claims, count(*) OVER (PARTITION BY o_orderpriority) AS dst_claims FROM orders"


def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the graph of claims the edges of a status, relation and kind of end, and of least confidence, by what they point to."""
    status = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "weak").otherwise("draft")
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.concat(F.when(F.col("o_custkey") % 2 == 0, "asset:").otherwise("model:"), "o_custkey").alias("subject"), F.lit("is_like").alias("predicate"), F.concat(F.lit("domain:"), "o_orderpriority").alias("object"), (F.col("o_totalprice") / 500000).alias("confidence"), status.alias("status"))
    nodes, found = records.claim_graph(claims, {"asset": "Asset", "domain": "Domain"})
    kept = filters.matching(found, {"status": "active", "rel": "is_like"}, least={"confidence": 0.5})
    assets = filters.matching(nodes, {"kind": "Asset"}).select(F.col("node").alias("src"))
    return kept.join(assets, "src", "left_semi").groupBy("dst", "rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"), F.round(F.min("confidence"), 6).alias("least"))


PROVENANCE_EDGES = "SELECT 'domain:' || o_orderpriority AS dst, 'is_like' AS rel, count(*) AS n, count(DISTINCT o_custkey) AS n_src, round(min(o_totalprice / 500000), 6) AS least FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 AND o_totalprice / 500000 >= 0.5 GROUP BY 1"


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's closes on every day that any asset was traded."""
    made = bars(spark, sf_dir)
    return rounded(records.reindexed(made.where(F.col("asset") == BENCHMARK).select("ts", F.col("close").alias("value")), made.select("ts")), ["ts", "since"], ["value"])


REINDEXED = f"SELECT ts, b.ts AS since, b.close AS value FROM (SELECT DISTINCT ts FROM ({BARS})) d ASOF LEFT JOIN (SELECT ts, close FROM ({BARS}) WHERE asset = '{BENCHMARK}') b USING (ts)"


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a scaling over the first years of lines."""
    lines = table(spark, sf_dir, "lineitem").withColumn("none", F.lit(3.0))
    _, found = records.normalised_with(lines, ["l_quantity", "l_extendedprice", "l_discount", "none"])
    _, ranged = records.normalised_with(lines, ["l_quantity", "l_tax", "none"], "minmax")
    return rounded(found.withColumn("method", F.lit("zscore")).unionAll(ranged.withColumn("method", F.lit("minmax"))), ["method", "name"], ["low", "width"])


def _normalised_sql() -> str:
    z = " UNION ALL ".join(f"SELECT 'zscore' AS method, '{c}' AS name, avg({c}) AS low, stddev_samp({c}) AS width FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    m = " UNION ALL ".join(f"SELECT 'minmax', '{c}', min({c}), max({c}) - min({c}) FROM lineitem" for c in ("l_quantity", "l_tax"))
    return picked(f"{z} UNION ALL {m} UNION ALL SELECT 'zscore', 'none', 0.0, 1.0 UNION ALL SELECT 'minmax', 'none', 0.0, 1.0", ["method", "name"], ["low", "width"])


def quality_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(records.spread_of(docs, ["lang"], ["n_chars", "quality", "toxic"]), ["lang", "metric", "n", "low", "high", "total", "n_null"], ["mean"])


QUALITY_SPREAD = " UNION ALL ".join(f"SELECT lang, '{c}' AS metric, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, CAST(sum({c}) AS DOUBLE) AS total, count(*) - count({c}) AS n_null, round(avg({c}), 6) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1" for c in ("n_chars", "quality", "toxic"))


def sequence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = expanded.sequences(bars(spark, sf_dir), ["close", "volume"], 10)
    return rounded(records.sequences_split(made).groupBy("asset", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.avg("target").alias("mean")), ["asset", "part", "n", "first", "last"], ["mean"])


def _sequence_sql() -> str:
    rows = f"SELECT asset, ts, close AS target, lead(close) OVER ({S}) AS more, row_number() OVER ({S}) AS i FROM ({BARS})"
    kept = f"SELECT asset, ts, target, row_number() OVER ({S}) AS k, count(*) OVER (PARTITION BY asset) AS n FROM ({rows}) WHERE i > 10 AND more IS NOT NULL"
    return f"SELECT asset, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last, round(avg(target), 6) AS mean FROM ({kept}) GROUP BY 1, 2"


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of brands that a run with a budget of a hundred tests, and their correlation."""
    closes = brand_closes(spark, sf_dir)
    pairs = records.capped_pairs(closes.select(F.col("asset").alias("name")), 100)
    rets = features.returns(closes, (1,)).select("asset", "ts", F.col("ret_1d").alias("ret")).dropna()
    return rounded(pairs.join(pairwise.correlations(rets), ["a", "b"], "left"), ["a", "b", "k", "n"], ["r"])


def _budget_sql() -> str:
    names = f"SELECT DISTINCT asset AS name FROM ({BRAND_CLOSES})"
    pairs = f"SELECT a.name AS a, b.name AS b, row_number() OVER (ORDER BY a.name, b.name) AS k FROM ({names}) a JOIN ({names}) b ON a.name < b.name"
    rets = f"SELECT * FROM (SELECT asset, ts, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM ({BRAND_CLOSES})) WHERE ret IS NOT NULL"
    r = f"SELECT x.asset AS a, y.asset AS b, count(*) AS n, corr(x.ret, y.ret) AS r FROM ({rets}) x JOIN ({rets}) y ON x.ts = y.ts AND x.asset < y.asset GROUP BY 1, 2"
    return f"SELECT a, b, k, n, round(r, 6) + 0.0 AS r FROM ({pairs}) LEFT JOIN ({r}) USING (a, b) WHERE k <= 100"


def moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines made of orders: words of both moods by status and priority."""
    said = F.when(F.col("o_orderstatus") == "F", "Shares rally: record profit, raised guidance!").when(F.col("o_orderstatus") == "O", "Weak quarter; loss and lawsuit. Missed guidance, lower.").otherwise("No news of the recorded beats")
    text = F.concat(said, F.when(F.col("o_orderpriority") == "1-URGENT", " Risk of fraud").when(F.col("o_orderpriority") == "2-HIGH", " GROWTH, growth").otherwise(""))
    made = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return made.withColumn("m", records.mood("text")).select("o_orderkey", "m.*")


MOODS = """SELECT o_orderkey, CASE WHEN u + d = 0 THEN 0.0 ELSE round((u - d) / (u + d), 3) END AS score, CASE WHEN u + d > 0 AND (u - d) / (u + d) > 0.1 THEN 'bullish' WHEN u + d > 0 AND (u - d) / (u + d) < -0.1 THEN 'bearish' ELSE 'neutral' END AS label, CAST(u AS INT) AS rising, CAST(d AS INT) AS falling
 FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 0 ELSE 1 END + CAST(o_orderpriority = '2-HIGH' AS INT) AS u, CASE o_orderstatus WHEN 'O' THEN 5 ELSE 0 END + 2 * CAST(o_orderpriority = '1-URGENT' AS INT) AS d FROM orders)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names each supplier reaches directly, read from filings; and how many of each relation are the most named. The relations are read once, and written for what asks them."""
    path = new_folder(spark, "relations")
    filing_relations(spark, sf_dir).write.parquet(path)
    found = spark.read.parquet(path)
    return mentions.chain(found).unionAll(mentions.ranked(found, 5).groupBy("rel").agg(F.sum("n").alias("n_names")).select(F.concat(F.lit("top "), "rel").alias("src"), F.lit(0).alias("tier"), "n_names"))


CHAIN = f"WITH f AS ({FILING_RELATIONS}) SELECT src, 1 AS tier, count(*) AS n_names FROM f WHERE rel = 'supplier_of' GROUP BY 1 UNION ALL SELECT 'top ' || rel, 0, CAST(sum(n) AS BIGINT) FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rel ORDER BY n DESC, src, dst) <= 5) GROUP BY rel"


def known_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that are read from filings beside those that are known beforehand, by kind and whether they are known and read."""
    known = spark.createDataFrame([(a, b, "supplier_of") for a, b, _, _ in mentions.SUPPLIERS], "src string, dst string, rel string")
    both = mentions.with_known(filing_relations(spark, sf_dir), known)
    return both.groupBy("rel", "known", "read").agg(F.count("*").alias("n_relations"), F.sum("n").alias("n"), F.count_distinct("src").alias("n_src"))


KNOWN_RELATIONS = f"SELECT rel, false AS known, true AS read, count(*) AS n_relations, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT src) AS n_src FROM ({FILING_RELATIONS}) GROUP BY rel UNION ALL SELECT 'supplier_of', true, false, {len(mentions.SUPPLIERS)}, 0, {len({a for a, *_ in mentions.SUPPLIERS})}"


def full_hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's best lag; of pairs that are strong enough also Granger's p and the information, in the same pass."""

    def measure(x, y) -> list[tuple]:
        found = pairwise.best_lag(x, y, 5, 60)
        if not found:
            return []
        lag, r, n = found[0]
        strong = r is not None and abs(r) >= 0.04
        return [(lag, r, n, discovery.granger_p(x, y, 5) if strong else None, pairwise.neighbour_information(x, y) if strong else None)]

    found = pairwise.pairwise(returns(spark, sf_dir), measure, "lag int, r double, n long, granger_p double, nats double")
    return rounded(found.withColumn("strength", relations.strength()), ["a", "b", "lag", "n", "strength"], ["r", "granger_p", "nats"])


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by the mean composite score of their folds, and the winner of each asset."""
    scored = walkforward.fold_metrics(fitted_folds(spark, sf_dir)).where("status = 'ok'").withColumn("composite", validation.composite("accuracy", "auc", "hit_rate", "sharpe"))
    means = scored.groupBy("asset", "model").agg(F.avg("composite").alias("composite"))
    return rounded(baseline.winner(means, ["asset"], "composite"), ["asset", "winner", "confidence"], ["composite", "lead"])


def last_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))
    return rounded(bars(spark, sf_dir).withColumn("k", k).where("k <= 365"), ["asset", "ts", "k"], ["open", "high", "low", "close", "volume"])


def wide_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the brands and parts that they link, the widest first, with their rank."""
    from pyspark.sql import Window

    links = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    found = links.groupBy(F.col("l_suppkey").alias("factor")).agg(F.count_distinct("p_brand").alias("n_classes"), F.count_distinct("l_partkey").alias("n_edges"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_classes"), F.desc("n_edges"), "factor"))).where("rank <= 20")


def feature_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the base set is expected to have against those that it has, by asset the number of values of each."""
    made = bars(spark, sf_dir).transform(features.returns).transform(features.bands)
    names = records.feature_names(made.columns)
    due = records.names_due(names, [*names[:-1], "no_such_feature"])
    long = made.select("asset", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).isNotNull().cast("int").alias("there")) for c in names))).alias("f")).select("asset", "f.*")
    state = F.when(F.col("name").isin(*due["unexpected"]), "unexpected").otherwise("expected")
    return long.groupBy("asset", "name", state.alias("state")).agg(F.sum("there").alias("n"))


def _contract_sql() -> str:
    names = [*(f"ret_{n}d" for n in (1, 5, 10, 21, 63)), "log_ret_1d", "log_ret_5d", "cum_ret_21d", "cum_ret_63d", "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct"]
    least = {"ret_1d": 1, "ret_5d": 5, "ret_10d": 10, "ret_21d": 21, "ret_63d": 63, "log_ret_1d": 1, "log_ret_5d": 5, "cum_ret_21d": 21, "cum_ret_63d": 63} | dict.fromkeys(names[9:], 19)
    return " UNION ALL ".join(f"SELECT asset, '{c}' AS name, '{'unexpected' if c == names[-1] else 'expected'}' AS state, greatest(count(*) - {least[c]}, 0) AS n FROM ({BARS}) GROUP BY 1" for c in names)


def near_duplicates_of_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors within a cosine of those whose id is divisible by 20, counted."""
    found = table(spark, sf_dir, "embeddings")
    asked = found.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.exact_top_k(found, asked, 50, 0.25).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"))


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    cosine = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
    return {
        "sources_matched": (matched, MATCHED),
        "dataset_groups": (versions, VERSIONS),
        "kept_reports": (reports, "SELECT event_id AS entry_id, ts AS created, value FROM events WHERE user_id % 3 = 1 AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 25"),
        "vector_collections": (collections, COLLECTIONS),
        "claim_graph": (claim_graph, CLAIM_GRAPH),
        "provenance_edges": (provenance_edges, PROVENANCE_EDGES),
        "benchmark_reindexed": (reindexed, picked(REINDEXED, ["ts", "since"], ["value"])),
        "scaling_parameters": (normalised, _normalised_sql()),
        "quality_spread": (quality_spread, QUALITY_SPREAD),
        "sequence_parts": (sequence_parts, _sequence_sql()),
        "pairs_in_budget": (budget, _budget_sql()),
        "headline_moods": (moods, MOODS),
        "supply_chain": (chain, CHAIN),
        "known_relations": (known_relations, KNOWN_RELATIONS),
        "full_hunt": (full_hunt, None),
        "model_comparison": (model_comparison, None),
        "last_candles": (last_candles, picked(f"SELECT *, CAST(row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS INT) AS k FROM ({BARS}) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC) <= 365", ["asset", "ts", "k"], ["open", "high", "low", "close", "volume"])),
        "widest_bridges": (wide_bridges, "SELECT factor, n_classes, n_edges, CAST(rank AS INT) AS rank FROM (SELECT l_suppkey AS factor, count(DISTINCT p_brand) AS n_classes, count(DISTINCT l_partkey) AS n_edges, row_number() OVER (ORDER BY count(DISTINCT p_brand) DESC, count(DISTINCT l_partkey) DESC, l_suppkey) AS rank FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) WHERE rank <= 20"),
        "feature_contract": (feature_contract, _contract_sql()),
        "vector_neighbourhoods": (near_duplicates_of_queries, f"SELECT query_id, count(*) AS n, round(min(s), 6) AS least FROM (SELECT q.vec_id AS query_id, v.vec_id, {cosine} AS s FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine}, 9) DESC, v.vec_id) <= 50) WHERE round(s, 9) >= 0.25 GROUP BY 1"),
    }

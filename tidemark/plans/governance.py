"""Queries of registries, claims, experiments, sinks and discovery; orders and customers stand for the registered things."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import discovery, lifecycle, relations
from tidemark.plans.market import rounded
from tidemark.plans.operations import POINTS, query, series
from tidemark.plans.sql import BARS, picked
from tidemark.sources import sinks
from tidemark.sources.tables import table

STATUS = {"AUTOMOBILE": "discovered", "BUILDING": "sampled", "FURNITURE": "validated", "MACHINERY": "approved", "HOUSEHOLD": "rejected"}
CODES = [200, 204, 301, 401, 404, 405, 429, 500, 503]
AS_OF = "1999-01-01"


def _case(column, table_: dict, other: str):
    found = F.lit(other)
    for k, v in table_.items():
        found = F.when(F.col(column) == k, v).otherwise(found)
    return found


def _sql_case(column: str, table_: dict, other: str) -> str:
    return f"CASE {column} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in table_.items())} ELSE '{other}' END"


NEXT = {"1-URGENT": "sampled", "2-HIGH": "validated", "3-MEDIUM": "approved", "4-NOT SPECIFIED": "quarantined"}
CLAIM = {"1-URGENT": "supported", "2-HIGH": "proposed", "3-MEDIUM": "weak", "4-NOT SPECIFIED": "rejected"}
ACTIONS = {"click": "finish", "view": "backtest", "purchase": "promote", "signup": "fail"}


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", _case("c_mktsegment", STATUS, "quarantined").alias("status"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("p"))
    return lifecycle.transitioned(_registry(spark, sf_dir), asked.select("c_custkey", _case("p", NEXT, "rejected").alias("new_status")), "c_custkey")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, CODES)), (F.col("c_custkey") % len(CODES) + 1).cast("int")).alias("code"), F.when(F.col("c_custkey") % 11 == 0, "sdk").otherwise("api").alias("method"))
    return lifecycle.probed(_registry(spark, sf_dir), answers.select("c_custkey", lifecycle.reachable("code", "method").alias("ok")), "c_custkey")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    old = customers.where("c_custkey % 3 <> 0").select("c_custkey", _case("c_mktsegment", STATUS, "quarantined").alias("status"), F.lit(0.25).alias("score"), F.array(F.lower("c_mktsegment")).alias("tags"), F.lit("old").alias("notes"))
    new = customers.where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).alias("score"), F.array(F.lit("daily"), F.lower("c_mktsegment")).alias("tags"), F.lit("new").alias("notes"))
    return lifecycle.registered(old, new, "c_custkey").withColumn("tags", F.concat_ws(",", "tags"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("counterpoints"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.concat("l_returnflag", "l_linestatus").alias("source_type"), (F.col("l_tax") > 0.06).alias("conflicts"))
    return lifecycle.evaluated(found, evidence).withColumn("notes", F.size("notes").cast("long"))


def sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    found = orders.select(F.col("o_orderkey").alias("claim_id"), _case("o_orderpriority", CLAIM, "archived").alias("status"), F.when(F.col("o_orderstatus") == "P", "hypothesis").otherwise("relationship").alias("claim_type"))
    edges = orders.join(table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("l_returnflag") == "R", "rejected").otherwise("supported").alias("edge_status"))
    return lifecycle.synced(found, edges, create_missing=True)


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("experiment_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), _case("event_type", ACTIONS, "archive").alias("action"))
    return lifecycle.experiments(log)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    old = suppliers.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("node"), F.create_map(F.lit("name"), F.lit("old"), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("properties"))
    new = suppliers.where("s_suppkey % 2 = 0 or s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("node"), F.create_map(F.lit("name"), F.col("s_name")).alias("properties"))
    found = lifecycle.upserted_nodes(old, new)
    return found.select("node", F.col("properties")["name"].alias("name"), F.col("properties")["nation"].alias("nation"))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09 or l_tax >= 0.08")
    entries = rows.select(F.concat(F.lit("e"), (F.col("l_orderkey") % 50).cast("string")).alias("entry_id"), F.col("l_returnflag").alias("source"), F.when(F.col("l_discount") >= 0.09, "discount").otherwise("tax").alias("reason"))
    resolved = table(spark, sf_dir, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("entry_id"))
    return sinks.quarantine_summary(entries, resolved)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("event_type") == "purchase", 100.0).when(F.col("event_type") == "view", 50.0)
    return sinks.health(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("metric"), "value", limit.alias("threshold")))


def regimes(prices: DataFrame) -> DataFrame:
    rows = series(prices).withColumn("size", F.abs("ret"))
    return discovery.clustered(rows, ["ret", "size"], 3).select("asset", "ts", "cluster")


def soft_regimes(prices: DataFrame) -> DataFrame:
    rows = series(prices).withColumn("size", F.abs("ret"))
    return discovery.clustered(rows, ["ret", "size"], 2, soft=True).select("asset", "ts", F.round(F.array_max("probabilities"), 4).alias("probability"))


def latent_factors(prices: DataFrame) -> DataFrame:
    return rounded(discovery.components(prices, ["open", "high", "low", "close", "volume"], 2), ["component", "column"], ["explained", "loading"])


CUSTOMERS = f"SELECT *, {_sql_case('c_mktsegment', STATUS, 'quarantined')} AS status FROM customer"
ALLOWED = " OR ".join(f"(status = '{k}' AND s IN ({', '.join(repr(x) for x in v)}))" for k, v in lifecycle.TRANSITIONS.items())
EVIDENCE = "SELECT o_orderkey AS claim_id, any_value(o_orderstatus) AS os, count(l_orderkey) AS n, count(DISTINCT l_returnflag || l_linestatus) AS types, count(*) FILTER (WHERE l_tax > 0.06) AS against FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"
LEVELS = f"SELECT *, (n > 0 AND 2 * against >= n) AS rej, CASE WHEN n = 0 OR 2 * against >= n THEN 'none' WHEN n >= 4 AND types >= 3 AND against = 0 THEN 'strong' WHEN n >= 2 AND types >= 2 THEN 'moderate' ELSE 'weak' END AS support FROM ({EVIDENCE})"
LOG = f"SELECT user_id, ts, event_id, {_sql_case('event_type', ACTIONS, 'archive')} AS action FROM events"
SO_FAR = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
CELLS = f"SELECT a, b, u, v, count(*) AS c FROM (SELECT a, b, ntile(8) OVER (PARTITION BY a, b ORDER BY x, i) AS u, ntile(8) OVER (PARTITION BY a, b ORDER BY y, i) AS v FROM ({POINTS})) GROUP BY ALL"


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    return {
        "source_transitions": (transitions, f"SELECT c_custkey, CASE WHEN accepted THEN s ELSE status END AS status, accepted FROM (SELECT *, CASE WHEN s IS NOT NULL THEN ({ALLOWED}) END AS accepted FROM ({CUSTOMERS}) LEFT JOIN (SELECT o_custkey AS c_custkey, {_sql_case('p', NEXT, 'rejected')} AS s FROM (SELECT o_custkey, arg_max(o_orderpriority, row(o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1)) USING (c_custkey))"),
        "source_probes": (probes, f"SELECT c_custkey, CASE WHEN adv THEN 'sampled' ELSE status END AS status, CASE WHEN adv THEN 'sampled' ELSE 'updated' END AS action FROM (SELECT *, status = 'discovered' AND (c_custkey % 11 = 0 OR {CODES}[c_custkey % {len(CODES)} + 1] NOT IN (405, 500, 503)) AS adv FROM ({CUSTOMERS}))"),
        "source_candidates": (candidates, f"SELECT c_custkey, CASE WHEN o THEN status ELSE 'discovered' END AS status, CASE WHEN n THEN round(CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 ELSE 0.5 END, 4) ELSE 0.25 END AS score, CASE WHEN n AND (NOT o OR status = 'discovered') THEN array_to_string(list_sort(['daily', lower(c_mktsegment)]), ',') ELSE lower(c_mktsegment) END AS tags, concat_ws(chr(10), CASE WHEN o THEN 'old' END, CASE WHEN n THEN 'new' END) AS notes, CASE WHEN NOT o THEN 'created' WHEN n THEN 'updated' ELSE 'kept' END AS action FROM (SELECT *, c_custkey % 3 <> 0 AS o, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS n FROM ({CUSTOMERS}))"),
        "claim_evaluation": (claims, f"SELECT claim_id, n, types, against, support, round(greatest(0, least(0.95, CASE support WHEN 'weak' THEN 0.3 WHEN 'moderate' THEN 0.6 WHEN 'strong' THEN 0.9 ELSE 0 END + least(0.05, greatest(types - 1, 0) * 0.01) - least(0.2, against * 0.05)))::DOUBLE, 4) AS score, CASE WHEN n = 0 THEN 'propose' WHEN rej THEN 'reject' WHEN support IN ('moderate', 'strong') THEN 'support' ELSE 'flag_weak' END AS advice, (n = 0)::BIGINT + rej::BIGINT + (NOT rej AND against > 0)::BIGINT + (types = 1 AND n >= 2)::BIGINT + (os = 'P')::BIGINT AS notes FROM ({LEVELS})"),
        "claim_sync": (sync, f"WITH c AS (SELECT o_orderkey AS claim_id, {_sql_case('o_orderpriority', CLAIM, 'archived')} AS status, o_orderstatus AS os FROM orders), e AS (SELECT claim_id, count(*) FILTER (WHERE CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'supported' END <> status) AS k FROM c JOIN lineitem ON claim_id = l_orderkey WHERE l_returnflag <> 'N' GROUP BY 1) SELECT claim_id, status, CASE WHEN k > 0 THEN 'updated' WHEN k = 0 THEN 'unchanged' WHEN status <> 'supported' OR os = 'P' THEN 'skipped' ELSE 'created' END AS action, coalesce(k, 0) AS n_edges FROM c LEFT JOIN e USING (claim_id)"),
        "node_upsert": (nodes, "SELECT s_suppkey AS node, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN s_name ELSE 'old' END AS name, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier"),
        "experiment_states": (experiments, f"WITH r AS (SELECT *, count(*) FILTER (WHERE action IN ('finish', 'fail', 'archive')) {SO_FAR} AS part, bool_or(action = 'backtest') {SO_FAR} AS bt FROM ({LOG})), p AS (SELECT user_id, part, max(action) FILTER (WHERE action IN ('finish', 'fail', 'archive')) AS st, count(*) FILTER (WHERE action = 'promote') AS asked, bool_or(action = 'promote' AND bt) AS pr, bool_or(bt) AS bt FROM r GROUP BY 1, 2), q AS (SELECT *, coalesce(pr AND st = 'finish', false) AS ok FROM p) SELECT user_id AS experiment_id, arg_max(CASE WHEN ok THEN 'promoted' WHEN st = 'finish' THEN 'completed' WHEN st = 'fail' THEN 'failed' WHEN st = 'archive' THEN 'archived' ELSE 'running' END, part) AS status, bool_or(bt) AS backtest, CAST(sum(ok::BIGINT) AS BIGINT) AS promotions, CAST(sum(asked) - sum(ok::BIGINT) AS BIGINT) AS refused FROM q GROUP BY 1"),
        "quarantine_summary": (quarantined, "SELECT source, reason, count(*) AS n_rows, count(DISTINCT e) AS n_entries, count(DISTINCT e) FILTER (WHERE e >= 25) AS n_open FROM (SELECT l_orderkey % 50 AS e, l_returnflag AS source, CASE WHEN l_discount >= 0.09 THEN 'discount' ELSE 'tax' END AS reason FROM lineitem WHERE l_discount >= 0.09 OR l_tax >= 0.08) GROUP BY 1, 2"),
        "health_readings": (health, "SELECT event_id, event_type AS metric, value, CASE event_type WHEN 'purchase' THEN 100.0::DOUBLE WHEN 'view' THEN 50.0::DOUBLE END AS threshold, coalesce(value > CASE event_type WHEN 'purchase' THEN 100.0::DOUBLE WHEN 'view' THEN 50.0::DOUBLE END, false) AS flagged FROM events"),
        "retained_bars": (query(lambda b: sinks.retained(b, "ts", AS_OF, 2).groupBy("asset").agg(F.count("*").alias("n"))), f"SELECT asset, count(*) AS n FROM ({BARS}) WHERE ts >= DATE '1997-01-01' GROUP BY 1"),
        "mutual_information": (query(lambda b: rounded(discovery.mutual_information(series(b)), ["a", "b", "n"], ["nats"])), picked(f"SELECT a, b, any_value(n) AS n, sum(c / n * ln(c * n / (nu * nv))) AS nats FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY a, b) AS BIGINT) AS n, sum(c) OVER (PARTITION BY a, b, u) AS nu, sum(c) OVER (PARTITION BY a, b, v) AS nv FROM ({CELLS})) WHERE n >= 60 GROUP BY 1, 2", ["a", "b", "n"], ["nats"])),
        "granger": (query(lambda b: rounded(discovery.granger(series(b)), ["a", "b", "n"], ["p_a_causes_b", "p_b_causes_a"])), None),
        "regime_clusters": (query(regimes), None),
        "regime_mixture": (query(soft_regimes), None),
        "latent_factors": (query(latent_factors), None),
    }

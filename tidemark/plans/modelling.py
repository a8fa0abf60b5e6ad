"""Queries of models over folds, online regimes, pairs of series, vector cells, samples, relations in text, ticks and discovery runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical, dataset_digest, digest
from tidemark.operators import features, mentions, pairwise, runs, sampling, vector_index, walkforward
from tidemark.operators.walkforward import Model
from tidemark.plans.discovery import PAIRS, returns
from tidemark.plans.governance import STATUS, _case, _sql_case
from tidemark.plans.market import bars, rounded
from tidemark.plans.sql import BARS, picked
from tidemark.sources.sinks import new_folder
from tidemark.sources.tables import table
from tidemark.streaming import regimes, sinks

SCALED = ("ret_1d", "ret_5d", "ret_21d", "realized_vol_21d", "atr_ratio", "stoch_k", "roc_21")
MODELS = [Model("baseline", SCALED), Model("momentum", ("ret_5d", "ret_21d", "roc_21")), Model("strict", SCALED, c=0.01), Model("unweighted", SCALED, balanced=False)]


def fitted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From bars to fits: features, a label of the next five bars, and each model on five folds of each asset."""
    made = bars(spark, sf_dir).transform(features.returns).transform(features.volatility).transform(features.oscillators)
    return walkforward.fits(features.forward_label(made, strict_parity=False), MODELS, gap=5)


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = walkforward.fold_metrics(fitted_folds(spark, sf_dir))
    return rounded(done, ["asset", "model", "fold", "status", "n_train", "n_val", "n_test", "beat"], ["accuracy", "precision", "recall", "f1", "auc", "hit_rate", "total_return", "benchmark_return", "sharpe", "max_drawdown"])


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.verdicts(walkforward.fold_metrics(fitted_folds(spark, sf_dir)), ["asset", "model"])


def online_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the stream ``regimes.regimes``."""
    return rounded(regimes.replayed(regimes.market_vectors(bars(spark, sf_dir))), ["key", "ts", "regime", "n_seen"], ["probability"])


def brand_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, ts, close): the mean unit price of each brand's sales a day."""
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return sold.groupBy(F.col("p_brand").alias("asset"), F.to_date("l_shipdate").alias("ts")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def brand_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.returns(brand_closes(spark, sf_dir), (1,)).select("asset", "ts", F.col("ret_1d").alias("ret")).dropna()


BRAND_CLOSES = "SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"
BRAND_RETURNS = f"SELECT * FROM (SELECT asset, ts, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM ({BRAND_CLOSES})) WHERE ret IS NOT NULL"
BRAND_PAIRS = f"SELECT a.asset AS a, b.asset AS b, a.ret AS x, b.ret AS y, row_number() OVER (PARTITION BY a.asset, b.asset ORDER BY a.ts) AS i FROM ({BRAND_RETURNS}) a JOIN ({BRAND_RETURNS}) b ON a.ts = b.ts AND a.asset < b.asset"


def rank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairwise.rank_matrix(brand_returns(spark, sf_dir), least_rows=30), ["a", "b", "n"], ["pearson", "spearman", "kendall"])


def _rank_matrix_sql() -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY a, b ORDER BY {c}) + (count(*) OVER (PARTITION BY a, b, {c}) - 1) / 2"
    tau = "SELECT p.a, p.b, sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))) AS kendall FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.i < q.i GROUP BY 1, 2"
    rho = f"SELECT a, b, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry FROM p) GROUP BY 1, 2"
    return f"WITH p AS MATERIALIZED ({BRAND_PAIRS}), t AS ({tau}), r AS ({rho}) {picked('SELECT * FROM r JOIN t USING (a, b) WHERE n >= 30', ['a', 'b', 'n'], ['pearson', 'spearman', 'kendall'])}"


def information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairwise.information(returns(spark, sf_dir)), ["a", "b", "n"], ["nats"])


def _information_sql() -> str:
    unit = lambda c: f"({c} - avg({c}) OVER (PARTITION BY a, b)) / stddev_pop({c}) OVER (PARTITION BY a, b)"
    near = "SELECT z.a, z.b, z.i, min(greatest(abs(z.u - o.u), abs(z.v - o.v)), 3)[3] * (1 - 1e-9) AS r FROM z JOIN z o ON z.a = o.a AND z.b = o.b AND z.i <> o.i GROUP BY 1, 2, 3"
    strips = "SELECT z.a, z.b, z.i, count(*) FILTER (WHERE abs(z.u - o.u) <= r) AS nx, count(*) FILTER (WHERE abs(z.v - o.v) <= r) AS ny FROM z JOIN near USING (a, b, i) JOIN z o ON z.a = o.a AND z.b = o.b GROUP BY 1, 2, 3"
    psi = "SELECT k, sum(CASE WHEN k > 1 THEN 1.0 / (k - 1) ELSE 0 END) OVER (ORDER BY k) - 0.5772156649015329 AS psi FROM (SELECT CAST(unnest(range(1, 100001)) AS DOUBLE) AS k)"
    nats = "SELECT s.a, s.b, count(*) AS n, greatest(0, any_value(pn.psi) + any_value(p3.psi) - avg(px.psi) - avg(py.psi)) AS nats FROM strips s JOIN psi px ON px.k = nx JOIN psi py ON py.k = ny JOIN (SELECT a, b, count(*) AS n FROM z GROUP BY 1, 2) c ON c.a = s.a AND c.b = s.b JOIN psi pn ON pn.k = c.n JOIN psi p3 ON p3.k = 3 GROUP BY 1, 2"
    return f"WITH z AS MATERIALIZED (SELECT a, b, i, {unit('x')} AS u, {unit('y')} AS v FROM ({PAIRS})), near AS ({near}), strips AS ({strips}), psi AS MATERIALIZED ({psi}), nats AS ({nats}) {picked('SELECT * FROM nats WHERE n >= 60', ['a', 'b', 'n'], ['nats'])}"


#: Cells of the index and how many of them a query is compared with.
CELLS, PROBES = 32, 20


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = table(spark, sf_dir, "embeddings")
    return found, found.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, asked = _asked(spark, sf_dir)
    return rounded(vector_index.probed_top_k(vector_index.cells(found, CELLS), asked, 10, PROBES, payload={"label": 1}), ["query_id", "vec_id", "rank", "n_read"], ["score"])


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact search's ten best the index finds, and the share of all rows that it reads."""
    found, asked = _asked(spark, sf_dir)
    probed = vector_index.probed_top_k(vector_index.cells(found, CELLS), asked, 10, PROBES)
    told = vector_index.recall(probed, vector_index.exact_top_k(found, asked, 10)).join(probed.select("query_id", "n_read").distinct(), "query_id", "left")
    all_rows = found.agg(F.count("*").alias("n_rows"))
    done = told.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"), F.avg("n_read").alias("rows_read")).crossJoin(all_rows)  # one row each
    return rounded(done.withColumn("share_read", F.col("rows_read") / F.col("n_rows")), ["n_queries", "n_rows"], ["recall", "rows_read", "share_read"])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.ticks_of(table(spark, sf_dir, "events")).withColumn("change_pct", sinks.change("value", "before"))


TICKS = "SELECT *, coalesce(round((value - before) / nullif(before, 0) * 100, 4), 0) AS change_pct FROM (SELECT event_type, event_id, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events WHERE value IS NOT NULL)"


def tick_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks kept by day in a table: written once with errors in some, then these again as they should be."""
    path = new_folder(spark, "ticks")
    found = ticks(spark, sf_dir).withColumns({"day": F.to_date("ts"), "version": F.lit(1)})
    wrong = F.pmod(F.crc32(F.col("event_id").cast("string").cast("binary")), F.lit(3)) == 0
    keys = ["event_type", "event_id", "day"]
    sinks.upsert_partitions(found.withColumn("value", F.when(wrong, F.col("value") + 1).otherwise(F.col("value"))), path, keys, ["version"], "day")
    sinks.upsert_partitions(found.where(wrong).withColumn("version", F.lit(2)), path, keys, ["version"], "day")
    return spark.read.parquet(path).groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def latest_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tick of each type with the one before it."""
    return sinks.latest(ticks(spark, sf_dir), ["event_type"], ["ts", "event_id"])


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body): each customer's orders as a JSON array, an object with a list, one object a line, or CSV; nothing without orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("note"))
    line = F.to_json(F.struct("date", "value", "note"), {"ignoreNullFields": "false"})
    cells = F.concat_ws(",", "date", F.coalesce(F.col("value").cast("string"), F.lit("")), "note")
    lists = orders.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("json"), cells.alias("csv")))).alias("rows"))
    text = lambda c, sep: F.array_join(F.transform("rows", lambda r: r[c]), sep)
    kind = F.col("id") % 4
    body = F.when(kind == 0, F.concat(F.lit("["), text("json", ", "), F.lit("]"))).when(kind == 1, F.concat(F.lit('{"meta": {"unit": "usd"}, "data": ['), text("json", ", "), F.lit("]}"))).when(kind == 2, text("json", "\n")).otherwise(F.concat(F.lit("date,value,note\n"), text("csv", "\n")))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return customers.join(lists, "id", "left").select("id", F.coalesce(body, F.lit("")).alias("body"))


def sampled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _case("c_mktsegment", STATUS, "quarantined").alias("status"))
    done = sampling.sampled(registry, _bodies(spark, sf_dir))
    return done.select("id", "status", "action", "note")


def sample_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.quality(sampling.rows_of(_bodies(spark, sf_dir))), ["id", "format", "n_rows", "n_columns", "time_column", "has_times", "has_numbers", "passed", "issues", "columns"], ["null_rate", "score"])


SAMPLE = """SELECT c_custkey AS id, CASE WHEN n = 0 OR (c_custkey % 4 = 2 AND n = 1) THEN 0 ELSE n END AS n_rows, CASE WHEN n = 0 OR (c_custkey % 4 = 2 AND n = 1) THEN 'unknown' ELSE (['json', 'json_object', 'ndjson', 'csv'])[c_custkey % 4 + 1] END AS format, v AS filled, w AS noted
 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS w FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 50) GROUP BY 1
 UNION ALL SELECT c_custkey, 0, 0, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) ON o_custkey = c_custkey"""
SAMPLE_QUALITY = f"""SELECT *, CASE WHEN n_rows = 0 THEN 'No parseable rows (format=unknown).' ELSE concat_ws('; ', CASE WHEN n_rows < 2 THEN 'Only ' || n_rows || ' row(s); need at least 2.' END, CASE WHEN null_rate > 0.5 THEN 'Null rate ' || CAST(round(null_rate * 100) AS INT) || '% exceeds 50% threshold.' END) END AS issues,
 CASE WHEN n_rows > 0 THEN 'date' END AS time_column, n_rows > 0 AS has_times, n_rows > 0 AS has_numbers, CASE WHEN n_rows > 0 THEN (least(n_rows / 50, 1) + 1 - null_rate + 2) / 4 ELSE 0.0 END AS score,
 CASE WHEN n_rows > 0 THEN 'date date, note ' || CASE WHEN noted > 0 THEN 'string' ELSE 'null' END || ', value ' || CASE WHEN filled > 0 THEN 'double' ELSE 'null' END ELSE '' END AS columns
 FROM (SELECT *, CASE WHEN n_rows > 0 THEN 3 ELSE 0 END AS n_columns, CASE WHEN n_rows > 0 THEN 1 - (n_rows + filled + noted) / (3 * n_rows) ELSE 0.0 END AS null_rate FROM ({SAMPLE}))"""
SAMPLED = f"""SELECT id, CASE WHEN status = 'sampled' AND issues = '' THEN 'validated' ELSE status END AS status, CASE WHEN status = 'sampled' THEN CASE WHEN issues = '' THEN 'validated' ELSE 'failed' END END AS action,
 CASE WHEN status = 'sampled' THEN concat_ws(' | ', 'rows=' || n_rows, 'cols=' || n_columns, printf('null_rate=%.1f%%', null_rate * 100), 'format=' || format, CASE WHEN issues <> '' THEN 'issues=' || issues END) END AS note
 FROM ({SAMPLE_QUALITY}) JOIN (SELECT c_custkey AS id, {_sql_case('c_mktsegment', STATUS, 'quarantined')} AS status FROM customer) USING (id)"""

SAID = {"A": "is a supplier to", "N": "has partnered with", "R": "competes with"}
RELS = {"A": "supplier_of", "N": "partner_of", "R": "competes_with"}


def filing_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales told as filings, one of each supplier and month, and the relations that are read from their text."""
    names = lambda t, key, name: table(spark, sf_dir, t).select(key, name)
    bought = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(names("customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    sold = table(spark, sf_dir, "lineitem").join(bought.select(F.col("o_orderkey").alias("l_orderkey"), "c_name"), "l_orderkey")
    said = F.when(F.col("l_returnflag") == "A", SAID["A"]).when(F.col("l_returnflag") == "N", SAID["N"]).otherwise(SAID["R"])
    sales = sold.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.collect_list(F.concat_ws(" ", said, F.concat("c_name", F.lit(".")))).alias("told"))
    sales = sales.join(names("supplier", "s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))  # the supplier's name is that of the whole filing
    text = F.array_join(F.array_sort(F.transform("told", lambda t: F.concat_ws(" ", "s_name", t))), " ")
    filings = sales.select((F.col("l_suppkey") * 1000 + F.months_between("month", F.lit("1990-01-01")).cast("long")).alias("doc_id"), text.alias("text"))
    aliases = names("supplier", "s_suppkey", F.col("s_name").alias("alias")).select("alias", F.concat(F.lit("S"), "s_suppkey").alias("entity"))
    aliases = aliases.unionByName(names("customer", "c_custkey", F.col("c_name").alias("alias")).select("alias", F.concat(F.lit("C"), "c_custkey").alias("entity")))
    places = mentions.mentioned(filings).select("doc_id", "rel", "start", "before", "after")
    said_once = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"))  # a sale is one sentence with one phrase
    return mentions.relations(mentions.resolved(places, aliases, said_once))


FILING_RELATIONS = f"SELECT 'S' || l_suppkey AS src, 'C' || o_custkey AS dst, CASE l_returnflag WHEN 'A' THEN '{RELS['A']}' WHEN 'N' THEN '{RELS['N']}' ELSE '{RELS['R']}' END AS rel, count(*) AS n, min(l_suppkey * 1000 + date_diff('month', DATE '1990-01-01', date_trunc('month', l_shipdate))) AS first_doc FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"
#: Phrases that the corpus has, beside those of relations.
CORPUS = (*mentions.PHRASES, (r"licen[cs]ed?", "license"), (r"under the", "under"), (r"th\w+ of", "of"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.mentioned(table(spark, sf_dir, "documents"), CORPUS)
    return found.groupBy("doc_id", "rel").agg(F.count("*").alias("n"))


def _phrases_sql() -> str:
    counts = (f"SELECT doc_id, '{rel}' AS rel, CAST(len(regexp_extract_all(text, '(?i){p}')) AS BIGINT) AS n FROM documents" for p, rel in CORPUS)
    return f"SELECT * FROM ({' UNION ALL '.join(counts)}) WHERE n > 0"


def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the brands, the second over the days after the first alone, and what changed."""
    closes, folder = brand_closes(spark, sf_dir), new_folder(spark, "discovery")
    runs.discovered(closes, folder, "1997-06-30", 30, 0.03)
    version = runs.discovered(closes, folder, None, 30, 0.03)
    return rounded(runs.report(spark, folder, version), ["section", "subject", "change"], ["before", "now"])


def _report_sql() -> str:
    edges = lambda until: f"SELECT a, b, corr(x, y) AS r FROM (SELECT p.a, p.b, p.x, p.y FROM p WHERE ts <= DATE '{until}') GROUP BY 1, 2 HAVING count(*) >= 30 AND abs(corr(x, y)) >= 0.03"
    rank = lambda e: f"SELECT node, degree, CAST(row_number() OVER (ORDER BY round(strength, 9) DESC, node) AS INT) AS rank FROM (SELECT node, count(*) AS degree, sum(abs(r)) AS strength FROM (SELECT a AS node, r FROM {e} UNION ALL SELECT b, r FROM {e}) GROUP BY 1)"
    one = lambda e, n: f"SELECT unnest([{{'subject': 'n_edges', 'v': (SELECT count(*)::DOUBLE FROM {e})}}, {{'subject': 'n_nodes', 'v': (SELECT count(*)::DOUBLE FROM {n})}}, {{'subject': 'mean_degree', 'v': (SELECT avg(degree) FROM {n})}}, {{'subject': 'mean_r', 'v': (SELECT avg(abs(r)) FROM {e})}}, {{'subject': 'positive_share', 'v': (SELECT avg(CAST(r > 0 AS INT)) FROM {e})}}], recursive := true)"
    edge = "SELECT 'edge' AS section, coalesce(o.a, e.a) || '/' || coalesce(o.b, e.b) AS subject, CASE WHEN o.r IS NULL THEN 'gained' WHEN e.r IS NULL THEN 'lost' WHEN abs(e.r) - abs(o.r) >= 0.01 THEN 'strengthened' WHEN abs(e.r) - abs(o.r) <= -0.01 THEN 'weakened' END AS change, o.r AS before, e.r AS now FROM e1 o FULL JOIN e2 e ON o.a = e.a AND o.b = e.b"
    node = "SELECT 'rank', e.node, CASE WHEN o.rank IS NULL THEN 'entered' WHEN e.rank < o.rank THEN 'up' WHEN e.rank > o.rank THEN 'down' END, o.rank, e.rank FROM n2 e LEFT JOIN n1 o USING (node)"
    metric = "SELECT 'metric', e.subject, CASE WHEN e.v > o.v THEN 'up' WHEN e.v < o.v THEN 'down' ELSE 'same' END, o.v, e.v FROM m2 e JOIN m1 o USING (subject)"
    pairs = BRAND_PAIRS.replace("a.ret AS x", "a.ts AS ts, a.ret AS x")
    parts = f"p AS MATERIALIZED ({pairs}), e1 AS ({edges('1997-06-30')}), e2 AS ({edges('9999-01-01')}), n1 AS ({rank('e1')}), n2 AS ({rank('e2')}), m1 AS ({one('e1', 'n1')}), m2 AS ({one('e2', 'n2')})"
    return f"WITH {parts} {picked(f'SELECT * FROM ({edge} UNION ALL {node} UNION ALL {metric}) WHERE change IS NOT NULL', ['section', 'subject', 'change'], ['before', 'now'])}"


def customer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested bodies with keys in another order, as one text for equal values."""
    balance = F.struct(F.col("c_acctbal").alias("value"), F.lit("usd").alias("currency"), F.array(F.struct(F.col("c_nationkey").alias("z"), F.lit("é\n").alias("a"))).alias("at"))
    body = F.to_json(F.struct(F.col("c_name").alias("name"), balance.alias("balance"), F.array("c_mktsegment", F.lit('say "x"')).alias("tags"), (F.col("c_acctbal") > 0).alias("active"), F.lit(None).cast("string").alias("note")), {"ignoreNullFields": "false"})
    found = table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))
    return found.select("c_custkey", canonical("body").alias("canonical"), digest("body").alias("digest"))


CUSTOMER_JSON = r"""SELECT c_custkey, canonical, sha256(canonical)[:12] AS digest FROM (SELECT c_custkey, '{"active": ' || (c_acctbal > 0) || ', "balance": {"at": [{"a": "\u00e9\n", "z": ' || c_nationkey || '}], "currency": "usd", "value": ' || c_acctbal || '}, "name": "' || c_name || '", "note": null, "tags": ["' || c_mktsegment || '", "say \"x\""]}' AS canonical FROM customer)"""


def dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bars(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n_rows"), F.min("ts").cast("timestamp").cast("string").alias("first"), F.max("ts").cast("timestamp").cast("string").alias("last"))
    return sizes.select("asset", "n_rows", dataset_digest(F.lower("asset"), ["ret_1d", "atr_ratio"], 5, F.col("n_rows"), F.col("first"), F.col("last"), 0.7, 0.15).alias("version"))


DATASET_VERSIONS = f"""SELECT asset, n_rows, sha256('{{"feature_cols": ["ret_1d", "atr_ratio"], "n_rows": ' || n_rows || ', "seq_len": null, "symbol": "' || upper(asset) || '", "target_horizon": 5, "time_range_end": "' || b || ' 00:00:00", "time_range_start": "' || a || ' 00:00:00", "train_frac": 0.7, "val_frac": 0.15}}')[:12] AS version FROM (SELECT asset, count(*) AS n_rows, min(ts) AS a, max(ts) AS b FROM ({BARS}) GROUP BY 1)"""


def catalog() -> dict:
    """name -> (query, SQL or None)."""
    return {
        "walk_forward_models": (fold_metrics, None),
        "walk_forward_verdicts": (verdicts, None),
        "online_regimes": (online_regimes, None),
        "kendall_matrix": (rank_matrix, _rank_matrix_sql()),
        "neighbour_information": (information, _information_sql()),
        "vector_index_search": (index_search, None),
        "vector_index_recall": (index_recall, None),
        "ticks": (ticks, TICKS),
        "latest_ticks": (latest_ticks, f"SELECT * FROM ({TICKS}) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"),
        "tick_table": (tick_table, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
        "sampled_sources": (sampled_sources, SAMPLED),
        "sample_quality": (sample_quality, picked(SAMPLE_QUALITY.replace("SELECT *,", "SELECT *, issues = '' AS passed FROM (SELECT *,", 1) + ")", ["id", "format", "n_rows", "n_columns", "time_column", "has_times", "has_numbers", "passed", "issues", "columns"], ["null_rate", "score"])),
        "filing_relations": (filing_relations, FILING_RELATIONS),
        "corpus_phrases": (phrases, _phrases_sql()),
        "discovery_report": (discovery_report, _report_sql()),
        "customer_json": (customer_json, CUSTOMER_JSON),
        "dataset_versions": (dataset_versions, DATASET_VERSIONS),
    }

"""Edges made of tables: sectors and industries, events, reports, and a graph of all that is known; and what is read from a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import decayed

EDGE = ["src", "dst", "rel", "weight"]


def classified(assets: DataFrame) -> DataFrame:
    """Edges of assets (asset, sector, industry): to the industry and the sector (BELONGS_TO), and of the industry to its sector (PART_OF). A null end has none."""
    one = lambda src, dst, rel: assets.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))
    sector, industry = F.concat(F.lit("sector:"), "sector"), F.concat(F.lit("industry:"), "industry")
    made = one(F.col("asset"), industry, "BELONGS_TO").unionAll(one(F.col("asset"), sector, "BELONGS_TO")).unionAll(one(industry, sector, "PART_OF"))
    return made.where("src is not null and dst is not null").distinct()


def correlated(pairs: DataFrame) -> DataFrame:
    """Undirected edges of (a, b, r): the ends in order, one edge a pair, that of the largest |r| (ties: the positive one)."""
    ends = pairs.where("a <> b and r is not null").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "r")
    return ends.groupBy("src", "dst").agg(F.max_by("r", F.struct(F.abs("r"), "r")).alias("r")).withColumn("rel", F.lit("CORRELATED_WITH"))


def triggered(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Edges of events (event_id, indicator) to indicators that there are."""
    return events.join(indicators.select("indicator").distinct(), "indicator", "left_semi").select(F.col("event_id").alias("src"), F.col("indicator").alias("dst"), F.lit("TRIGGERED_BY").alias("rel")).distinct()


def reported(reports: DataFrame, universe: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of reports (symbol, date, eps, eps_estimate, quarter): event nodes, one a symbol and day (the greatest row), and the edges of assets to them; only symbols of the universe (symbol), if given."""
    kept = reports.join(universe.select("symbol").distinct(), "symbol", "left_semi") if universe is not None else reports
    kept = kept.withColumn("event_id", F.concat_ws("_", F.lit("earnings"), "symbol", F.col("date").cast("string")))
    rest = [c for c in kept.columns if c != "event_id"]
    nodes = kept.groupBy("event_id").agg(F.max(F.struct(*rest)).alias("r")).select("event_id", "r.*")
    return nodes, nodes.select(F.col("symbol").alias("src"), F.col("event_id").alias("dst"), F.lit("REPORTS").alias("rel"))


def knowledge(supplies: DataFrame, impacts: DataFrame, sectors: DataFrame, found: DataFrame) -> DataFrame:
    """All edges (src, dst, rel, weight) of a graph for message passing, as often as they are made.

    Supplies (src, dst, share): by their share (0.1 without), half of it the other way. Impacts (src, dst): 1. Sectors (asset, sector): 1 both ways.
    Found pairs (a, b, relationship_type, r): leads one way, all others both ways, by |r|.
    """
    both = lambda rows, back=1.0: rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", (F.col("weight") * back).alias("weight")))
    share = F.when(F.coalesce("share", F.lit(0.0)) != 0, F.col("share")).otherwise(0.1)
    made = [
        both(supplies.select("src", "dst", F.lit("supplies_to").alias("rel"), share.alias("weight")), 0.5), impacts.select("src", "dst", F.lit("impacts").alias("rel"), F.lit(1.0).alias("weight")),
        both(sectors.select(F.col("asset").alias("src"), F.concat(F.lit("SECTOR:"), "sector").alias("dst"), F.lit("belongs_to").alias("rel"), F.lit(1.0).alias("weight"))),
    ]
    pair = found.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("relationship_type").alias("rel"), F.abs("r").alias("weight"))
    made += [pair.where("rel = 'leads'"), both(pair.where("rel <> 'leads'"))]
    return reduce(DataFrame.unionByName, made)


def weighed(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges (src, dst, rel_type, confidence, pearson_r, age_days, evidence) with the weight that a model sees: the confidence after decay, without one |r|, else a half; those of ``least`` or more."""
    weight = F.when(F.col("confidence").isNotNull(), decayed("confidence", "age_days", "evidence", "rel_type")).otherwise(F.coalesce(F.abs("pearson_r"), F.lit(0.5)))
    return edges.withColumn("weight", weight).where(F.col("weight") >= least)


def counted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes (kind) by kind and edges (rel) by relation."""
    each = nodes.groupBy(F.lit("node").alias("what"), "kind").agg(F.count("*").alias("n"))
    return each.unionAll(edges.groupBy(F.lit("edge").alias("what"), F.col("rel").alias("kind")).agg(F.count("*").alias("n")))


def partners(edges: DataFrame, least: float = 0.4, top: int = 20) -> DataFrame:
    """(node, other, r, rank): the strongest correlations (src, dst, r) of each node at either end, at least ``least``; ``top`` of each."""
    ends = edges.where(F.abs("r") >= least)
    each = ends.select(F.col("src").alias("node"), F.col("dst").alias("other"), "r").unionAll(ends.select(F.col("dst").alias("node"), F.col("src").alias("other"), "r"))
    order = Window.partitionBy("node").orderBy(F.desc(F.round(F.abs("r"), 9)), "other")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: The features that are shown, in order, with their name and kind.
SHOWN = (
    ("rsi_14", "RSI 14", "momentum"), ("rsi_28", "RSI 28", "momentum"), ("macd", "MACD", "trend"), ("macd_signal", "MACD Signal", "trend"), ("adx_14", "ADX 14", "trend"), ("bb_pct", "BB Position", "volatility"),
    ("realized_vol_21d", "Realized Vol 21D", "volatility"), ("rolling_sharpe_21", "Sharpe 21D", "risk"), ("max_drawdown_63", "Max DD 63D", "risk"), ("obv", "OBV", "volume"), ("cmf_20", "CMF 20", "volume"),
    ("williams_r_14", "Williams %R", "momentum"), ("stoch_k_14", "Stoch %K", "momentum"), ("ema_9_21_cross", "EMA Cross 9/21", "trend"), ("ema_50_200_cross", "EMA Cross 50/200", "trend"),
)


def shown(featured: DataFrame, by: list[str], n: int = 8) -> DataFrame:
    """(by, place, name, kind, value): the first ``n`` shown features that are there and not null, in their order."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.round(F.col(c).cast("double"), 4).alias("value")) for i, (c, name, kind) in enumerate(SHOWN) if c in featured.columns]
    found = F.slice(F.filter(F.array(*cells), lambda x: x["value"].isNotNull()), 1, n)
    return featured.select(*by, F.posexplode(found).alias("place", "f")).select(*by, (F.col("place") + 1).alias("place"), "f.name", "f.kind", "f.value")


def mood(articles: DataFrame) -> DataFrame:
    """(symbol, n_articles, score, label): the mean score of all feeds' articles (symbol, score) and its label, bullish or bearish beyond 0.05."""
    done = articles.groupBy("symbol").agg(F.count("*").alias("n_articles"), F.avg("score").alias("_s"))
    return done.select("symbol", "n_articles", F.round("_s", 3).alias("score"), F.when(F.col("_s") > 0.05, "bullish").when(F.col("_s") < -0.05, "bearish").otherwise("neutral").alias("label"))

"""Registries and their life cycles: sources, claims with evidence, experiments. A registry is a table, a change is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What status of a source may follow another.
TRANSITIONS = {
    "discovered": ["sampled", "rejected"],
    "sampled": ["validated", "rejected", "quarantined"],
    "validated": ["approved", "rejected"],
    "approved": ["quarantined", "rejected"],
    "quarantined": ["validated", "rejected"],
    "rejected": ["discovered"],
}
#: Besides 200 to 399, answers of a server that is there.
REACHABLE = [401, 403, 404, 429]
#: Claims of these types and statuses become edges; proposed ones where asked for.
EDGE_TYPES = ["relationship", "source_usefulness", "feature_usefulness", "performance"]
NO_EDGE = ["weak", "rejected", "archived"]
#: The score of each level of support.
SUPPORT = {"none": 0.0, "weak": 0.3, "moderate": 0.6, "strong": 0.9}


def _lookup(table: dict, key: str) -> Column:
    pairs = (x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)))
    return F.try_element_at(F.create_map(*pairs), F.col(key))


def transitioned(registry: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The registry (key, status, ...) after at most one change (key, new_status) of each key; ``accepted`` is null without
    one and false where the status may not follow, which then stays."""
    allowed = F.coalesce(F.array_contains(_lookup(TRANSITIONS, "status"), F.col("new_status")), F.lit(False))
    found = registry.join(changes.select(key, "new_status"), key, "left").withColumn("accepted", F.when(F.col("new_status").isNotNull(), allowed))
    return found.withColumn("status", F.when(F.col("accepted"), F.col("new_status")).otherwise(F.col("status"))).drop("new_status")


def reachable(code: str, method: str) -> Column:
    """Whether a probe's answer says that the source is there; packages are not probed and count as there."""
    there = F.col(code).between(200, 399) | F.col(code).isin(REACHABLE)
    return (F.col(method) == "sdk") | F.coalesce(there, F.lit(False))


def probed(registry: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Probes (key, ok) applied: a discovered source that is there becomes sampled, all others get a note only."""
    action = F.when((F.col("status") == "discovered") & F.col("ok"), "sampled").otherwise("updated")
    found = registry.join(probes.select(key, "ok"), key).withColumn("action", action)
    return found.withColumn("status", F.when(F.col("action") == "sampled", "sampled").otherwise(F.col("status"))).drop("ok")


def registered(registry: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Candidates (key, score, tags, notes; one each) merged into the registry (same columns and status).

    New ones become discovered. A known one keeps its status and gets the score and the note, appended; its tags grow only
    while it is discovered. A missing score is 0.5.
    """
    new = candidates.select(key, F.round(F.coalesce("score", F.lit(0.5)), 4).alias("_score"), F.col("tags").alias("_tags"), F.col("notes").alias("_notes"), F.lit(True).alias("_new"))
    both = registry.withColumn("_old", F.lit(True)).join(new, key, "full")
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new"), "updated").otherwise("kept")
    union = F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("_tags", F.array().cast("array<string>"))))
    grows = F.col("_new").isNotNull() & (F.coalesce("status", F.lit("discovered")) == "discovered")
    return both.select(
        key,
        F.coalesce("status", F.lit("discovered")).alias("status"),
        F.coalesce("_score", "score").alias("score"),
        F.when(grows, union).otherwise(F.col("tags")).alias("tags"),
        F.concat_ws("\n", "notes", "_notes").alias("notes"),
        action.alias("action"),
    )


def evaluated(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Support of each claim (claim_id, counterpoints) by its evidence (claim_id, source_type, conflicts).

    Strong: four items or more of three types or more, none in conflict. Moderate: two and two. If half or more conflict,
    none, and the claim is to be rejected.
    """
    found = evidence.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_distinct("source_type").alias("types"), F.count_if("conflicts").alias("against"))
    n, types, against = (F.coalesce(c, F.lit(0)) for c in ("n", "types", "against"))
    all_claims = claims.join(found, "claim_id", "left").select("claim_id", "counterpoints", n.alias("n"), types.alias("types"), against.alias("against"))
    rejected = (F.col("n") > 0) & (2 * F.col("against") >= F.col("n"))
    level = F.when((F.col("n") == 0) | rejected, "none").when((F.col("n") >= 4) & (F.col("types") >= 3) & (F.col("against") == 0), "strong")
    level = level.when((F.col("n") >= 2) & (F.col("types") >= 2), "moderate").otherwise("weak")
    all_claims = all_claims.withColumn("support", level)
    bonus = F.least(F.lit(0.05), F.greatest(F.col("types") - 1, F.lit(0)) * 0.01)
    score = F.greatest(F.lit(0.0), F.least(F.lit(0.95), _lookup(SUPPORT, "support") + bonus - F.least(F.lit(0.2), F.col("against") * 0.05)))
    advice = F.when(F.col("n") == 0, "propose").when(rejected, "reject").when(F.col("support").isin("moderate", "strong"), "support").otherwise("flag_weak")
    notes = F.array_compact(F.array(
        F.when(F.col("n") == 0, "no evidence yet"),
        F.when(rejected, "half or more of the evidence conflicts"),
        F.when(~rejected & (F.col("against") > 0), F.format_string("%d items conflict", "against")),
        F.when((F.col("types") == 1) & (F.col("n") >= 2), "all evidence is of one source type"),
        F.when(F.col("counterpoints") > 0, F.format_string("%d counterpoints", "counterpoints")),
    ))
    return all_claims.select("claim_id", "n", "types", "against", "support", F.round(score, 4).alias("score"), advice.alias("advice"), notes.alias("notes"))


def skip_reason(include_proposed: bool = False) -> Column:
    """Why a claim (status, claim_type) becomes no edge; null where it does."""
    proposed = (F.col("status") == "proposed") & F.lit(not include_proposed)
    return F.when(F.col("status").isin(NO_EDGE), "status").when(proposed, "proposed").when(~F.col("claim_type").isin(EDGE_TYPES), "claim_type")


def synced(claims: DataFrame, edges: DataFrame, create_missing: bool = False, include_proposed: bool = False) -> DataFrame:
    """What a sync does with each claim (claim_id, status, claim_type): updated, unchanged, created, skipped or missing.

    Edges (claim_id, edge_status) take the claim's status; ``n_edges`` counts those that change.
    """
    held = edges.join(claims.select("claim_id", "status"), "claim_id").groupBy("claim_id").agg(F.count_if(F.col("edge_status") != F.col("status")).alias("n_edges"))
    missing = F.when(skip_reason(include_proposed).isNotNull(), "skipped").otherwise("created") if create_missing else F.lit("missing")
    action = F.when(F.col("n_edges") > 0, "updated").when(F.col("n_edges") == 0, "unchanged").otherwise(missing)
    return claims.join(held, "claim_id", "left").select("claim_id", "status", action.alias("action"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def upserted_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (node, properties map<string,string>; one each): of a node in both, the new values of a key win."""
    empty = F.create_map().cast("map<string,string>")
    both = old.join(new.withColumnRenamed("properties", "_new"), "node", "full")
    kept = F.map_filter(F.coalesce("properties", empty), lambda k, _: ~F.map_contains_key(F.coalesce("_new", empty), k))
    return both.select("node", F.map_concat(kept, F.coalesce("_new", empty)).alias("properties"))


def experiments(log: DataFrame) -> DataFrame:
    """The state of each experiment from its log (experiment_id, at, seq, action).

    Actions: finish, fail, archive set the status; backtest attaches a result; promote counts only after a finish, with a
    result, once until the next status. Other actions change nothing. An experiment starts as running.
    """
    order = Window.partitionBy("experiment_id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("action").isin("finish", "fail", "archive")
    rows = log.withColumn("_part", F.count_if(sets).over(order)).withColumn("_backtest", F.max(F.col("action") == "backtest").over(order))
    rows = rows.withColumn("_set", F.last(F.when(sets, F.col("action")), True).over(order))
    asks = F.when((F.col("action") == "promote") & F.col("_backtest") & (F.col("_set") == "finish"), True)
    state = rows.groupBy("experiment_id", "_part").agg(
        F.max("_set").alias("set"), F.max(F.coalesce(asks, F.lit(False))).alias("promoted"), F.count_if(F.col("action") == "promote").alias("asked"), F.max("_backtest").alias("backtest")
    )
    last = state.groupBy("experiment_id").agg(F.max_by(F.struct("set", "promoted"), "_part").alias("s"), F.max("backtest").alias("backtest"), F.sum(F.col("promoted").cast("long")).alias("promotions"), F.sum("asked").alias("asked"))
    status = F.when(F.col("s.promoted"), "promoted").when(F.col("s.set") == "finish", "completed").when(F.col("s.set") == "fail", "failed").when(F.col("s.set") == "archive", "archived").otherwise("running")
    return last.select("experiment_id", status.alias("status"), "backtest", "promotions", (F.col("asked") - F.col("promotions")).alias("refused"))

"""Degrees, PageRank and personalised PageRank as joins and sums; each few rounds are a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.walk import between, both_ways
from graphloom.tables import dealt, discard, materialize, parts_of

#: Rounds between two written tables.
EVERY = 4
MAX_ROUNDS = 100


def degrees(symbols: DataFrame, edges: DataFrame, relationships: tuple[str, ...] | None = None) -> DataFrame:
    """A2, A3: symbols with ``inbound`` and ``outbound``; one sum over the edges before any join."""
    own = edges if relationships is None else edges.where(F.col("relationship").isin(list(relationships)))
    ends = own.where("target_type = 'symbol'").select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(own.where("source_type = 'symbol'").select(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counted = ends.groupBy("id").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    zero = F.lit(0).cast("bigint")
    return symbols.join(counted, "id", "left").withColumns({n: F.coalesce(n, zero) for n in ("inbound", "outbound")})


def pagerank(spark: SparkSession, symbols: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = 0.85, epsilon: float = 1e-6, relationships: tuple[str, ...] = ("CALLS", "IMPORTS_SYMBOL", "EXTENDS", "IMPLEMENTS")) -> DataFrame:
    """(id, score). Mass of nodes without targets goes to all; parallel edges count apart.

    ``rounds`` fixes their number; otherwise it stops once the scores move by at most ``epsilon`` in sum.
    """
    nodes = materialize(spark, symbols.select("id").distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    own = edges.where(F.col("relationship").isin(list(relationships)) & (F.col("source_type") == "symbol") & (F.col("target_type") == "symbol"))
    own, parts = own.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")), parts_of(own)
    # dealt out by target and then by source, which the sums of both kinds below keep
    own = dealt(own, parts, "to").join(dealt(nodes.withColumnRenamed("id", "to"), parts, "to"), "to", "left_semi")
    own = dealt(own, parts, "id").join(dealt(nodes, parts, "id"), "id", "left_semi")
    weighted = own.groupBy("id", "to").agg(F.count("*").alias("w"))
    links = materialize(spark, weighted.withColumn("out", F.sum("w").over(W.partitionBy("id"))), "links")
    parts = parts_of(links)
    spread = dealt(links, parts, "id")
    tail = materialize(spark, nodes.join(links.select("id").distinct(), "id", "left_anti"), "dangling")
    scores = nodes.withColumn("score", F.lit(1.0 / n))
    for k in range(1, (MAX_ROUNDS if rounds is None else rounds) + 1):
        lost = scores.join(tail, "id", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        lost_mass = lost.first()["lost"]
        given = dealt(scores, parts, "id").join(spread, "id").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("score") * F.col("w") / F.col("out")).alias("got"))
        fresh = nodes.join(given, "id", "left").select("id", (F.lit((1 - damping) / n + damping * lost_mass / n) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        fresh = materialize(spark, fresh, "scores")
        old = scores
        moved = fresh.join(scores.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] if rounds is None else None
        scores = fresh
        if k > 1:
            discard(spark, old)
        if moved is not None and moved <= epsilon:
            break
    return scores


def personalized_pagerank(spark: SparkSession, edges: DataFrame, reached: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(seed_id, id, score) on the undirected multigraph of ``reached`` (seed_id, id), restarting at ``seeds``.

    Nodes without neighbours keep only their restart; their mass isn't passed on.
    """
    inside = reached.select("seed_id", "id").distinct()
    steps = both_ways(between(edges, inside)).groupBy("at", "next").agg(F.count("*").alias("w"))
    links = inside.withColumnRenamed("id", "at").join(steps, "at").join(inside.withColumnRenamed("id", "next"), ["seed_id", "next"], "left_semi")
    links = materialize(spark, links.select("seed_id", "at", "next", "w", F.sum("w").over(W.partitionBy("seed_id", "at")).alias("out")), "links")
    seeds = seeds.select("seed_id", "id").distinct()
    share = seeds.withColumn("restart", 1.0 / F.count("*").over(W.partitionBy("seed_id")))
    base = materialize(spark, inside.join(share, ["seed_id", "id"], "left").withColumn("restart", F.coalesce("restart", F.lit(0.0))), "restart")
    scores = base.select("seed_id", "id", F.col("restart").alias("score"))
    for k in range(1, rounds + 1):
        given = scores.withColumnRenamed("id", "at").join(links, ["seed_id", "at"]).groupBy("seed_id", F.col("next").alias("id")).agg(F.sum(F.col("score") * F.col("w") / F.col("out")).alias("got"))
        scores = base.join(given, ["seed_id", "id"], "left").select("seed_id", "id", ((1 - damping) * F.col("restart") + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if k % EVERY == 0 or k == rounds:
            scores = materialize(spark, scores, "scores")
    return scores


def rank_position(symbols: DataFrame, score: str = "pagerank_score") -> DataFrame:
    """One plus the number of symbols with a higher score.

    Equal scores are counted first, so the running sum goes over distinct scores only.
    """
    by_score = symbols.groupBy(score).agg(F.count("*").alias("_n"))
    # a range-partitioned running sum: sums of each partition are few, so their offsets are a small join
    parts = by_score.repartitionByRange(F.desc(score)).withColumn("_p", F.spark_partition_id())
    parts = parts.withColumn("_run", F.sum("_n").over(W.partitionBy("_p").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)))
    parts = materialize(symbols.sparkSession, parts, "ranks")
    totals = parts.groupBy("_p").agg(F.sum("_n").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    ranks = parts.join(before, "_p").select(F.col(score).alias("_s"), (F.coalesce("_run", F.lit(0)) + F.col("_before") + 1).alias("rank_position"))
    return symbols.join(ranks, symbols[score].eqNullSafe(ranks["_s"]), "left").drop("_s")

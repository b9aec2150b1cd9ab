"""Diagnostics, latency, gates and other roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.tables import dealt, parts_of, running_sum


def diagnostics_summary(rows: DataFrame) -> DataFrame:
    """A4: (dimension, value, n) for all rows and by stage, category and severity, in one pass."""
    grouped = rows.groupingSets([[], ["stage"], ["category"], ["severity"]], "stage", "category", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # a grouping bit is set where the column was summed away
    dimension = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "stage").when(F.col("g") == 5, "category").otherwise("severity")
    value = F.when(F.col("g") == 3, F.col("stage")).when(F.col("g") == 5, F.col("category")).when(F.col("g") == 6, F.col("severity"))
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n")


def latest_run(rows: DataFrame) -> DataFrame:
    """A4: the run of the newest row."""
    return rows.agg(F.max_by("run_id", "id").alias("run_id"))


def recent(rows: DataFrame, limit: int, offset: int = 0, **equal: str | None) -> DataFrame:
    """Newest first, with optional filters."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("id")).offset(max(0, offset)).limit(max(1, limit))


def index_percentiles(rows: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """The value at place round_half_even((n - 1) * p) of each group's sorted values.

    Equal values are counted first; running counts over ranges of values then find the place, so no group is one task's.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running_sum(counted, keys, [F.col(value)], "_n", "_to")
    at = lambda p: F.bround((F.col("_to_all") - 1) * p).cast("bigint")
    picks = [F.max(F.when((F.col("_to") > at(p)) & (F.col("_to") - F.col("_n") <= at(p)), F.col(value))).alias(name) for name, p in percents.items()]
    return placed.groupBy(*keys).agg(*picks)


def tool_summary(rows: DataFrame, keys: list[str], newest: int | None = None) -> DataFrame:
    """Calls, successes, their rate and latencies, over the newest rows if asked."""
    if newest is not None:
        rows = rows.orderBy(F.desc("id")).limit(newest)
    base = rows.groupBy(*keys).agg(F.count("*").alias("total_calls"), F.count_if("success").alias("success_calls"))
    latency = index_percentiles(rows, keys, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    out = base.join(latency, keys, "left") if keys else base.crossJoin(latency)  # one row each
    rate = F.bround(F.col("success_calls") / F.greatest(F.col("total_calls"), F.lit(1)), 4)
    return out.withColumn("failure_calls", F.col("total_calls") - F.col("success_calls")).withColumn("success_rate", rate)


def latest_by(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each key's last row."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("_r")).select(key, "_r.*")


def violations(values: DataFrame, gates: DataFrame) -> DataFrame:
    """(suite, metric, value) against gates (suite, metric, lowest, highest); a missing value is a violation."""
    joined = gates.join(values, ["suite", "metric"], "left")
    return joined.where(F.col("value").isNull() | (F.col("value") < F.col("lowest")) | (F.col("value") > F.col("highest")))


def ambiguity_rate(edges: DataFrame) -> DataFrame:
    """The share of edges with a confidence under one; 0 without edges."""
    return edges.agg(F.coalesce(F.avg(F.when(F.col("confidence") < 1, 1.0).otherwise(0.0)), F.lit(0.0)).alias("ambiguity_rate"))


def counts_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A1, A7, A20."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def totals(rows: DataFrame, root: str, sums: list[str]) -> DataFrame:
    """Sums by root, and over all (root is null)."""
    return rows.rollup(root).agg(*[F.sum(c).alias(c) for c in sums])


def first_names(symbols: DataFrame, most: int = 8) -> DataFrame:
    """Each file's first names in line order, with their place."""
    place = F.row_number().over(W.partitionBy("file_path").orderBy("start_line", "id"))
    return symbols.select("file_path", "name", place.alias("place")).where(F.col("place") <= most)


def explain_symbol(symbols: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """Each symbol's strongest neighbours by rank: (id, way, other, place). Only edges between symbols count."""
    own = edges.where("source_type = 'symbol' AND target_type = 'symbol'")
    ways = own.select(F.col("target_id").alias("id"), F.lit("inbound").alias("way"), F.col("source_id").alias("other")).unionByName(own.select(F.col("source_id").alias("id"), F.lit("outbound").alias("way"), F.col("target_id").alias("other")))
    parts = parts_of(own)
    ways = dealt(ways, parts, "other").distinct()  # one dealing for this and the join
    rows = dealt(ways.join(dealt(symbols.select(F.col("id").alias("other"), "name", "pagerank_score"), parts, "other"), "other"), parts, "id")
    place = F.row_number().over(W.partitionBy("id", "way").orderBy(F.desc("pagerank_score"), "other"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def inspector(symbols: DataFrame, edges: DataFrame, nodes: int = 300, links: int = 500) -> tuple[DataFrame, DataFrame]:
    """The best nodes and the edges among them."""
    own = symbols.orderBy(F.desc("pagerank_score"), "id").limit(nodes)
    between = induced(edges.where("source_type = 'symbol' AND target_type = 'symbol'"), own)
    return own, between.orderBy("source_id", "target_id", "relationship").limit(links)


def inspector_bundle(nodes: DataFrame, links: DataFrame) -> dict:
    """The inspector's nodes and edges as one JSON-ready object; both are bounded."""
    shown = nodes.select("id", "name", "qualified_name", "kind", "file_path", "pagerank_score").orderBy(F.desc("pagerank_score"), "id")
    return {"nodes": [r.asDict() for r in shown.collect()], "edges": [r.asDict() for r in links.select("source_id", "target_id", "relationship").collect()]}


def append_metrics(rows: DataFrame, path: str) -> None:
    """Performance rows are appended as JSON lines."""
    rows.write.mode("append").json(path)

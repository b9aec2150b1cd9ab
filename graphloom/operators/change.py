"""Change sets, deltas between snapshots, promotion and reconciliation of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.metrics import ambiguity_rate
from graphloom.tables import EDGE_KEY, dealt, first_by, parts_of


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) A, D or M between two tables of path and hash."""
    joined = previous.select("path", F.col("hash").alias("_old"), F.lit(True).alias("_was")).join(current.select("path", F.col("hash").alias("_new"), F.lit(True).alias("_is")), "path", "full_outer")
    status = F.when(F.col("_was").isNull(), "A").when(F.col("_is").isNull(), "D").when(~F.col("_old").eqNullSafe(F.col("_new")), "M")
    return joined.select("path", status.alias("status")).where("status IS NOT NULL")


def touched_paths(changes: DataFrame) -> DataFrame:
    """The paths that changes touch, old names of renames included."""
    return changes.select(F.explode(F.array("path", "old_path")).alias("path")).where("path IS NOT NULL").distinct()


def build_delta(changes: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What changed paths hold: files with hash and size, symbols, edges with both ends named, quality."""
    paths = touched_paths(changes)
    own = symbols.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    end = lambda rows, n: rows.select(F.col("id").alias(f"{n}_id"), F.struct("qualified_name", "file_path").alias(n))
    between = edges.where("source_type = 'symbol' AND target_type = 'symbol'").drop("file_path")
    parts = parts_of(between)
    # touched sources first: only their edges look for a target
    near = dealt(between, parts, "source_id").join(end(own, "source"), "source_id").join(end(symbols, "target"), "target_id")
    return {
        "files": changes.join(files.select("path", "content_hash", "size_bytes"), "path", "left"),
        "symbols": own,
        "edges": near.select("source", "target", "relationship", "line_number", "confidence"),
        "quality": ambiguity_rate(near),
    }


def promote(delta: dict[str, DataFrame], parse_failures: int = 0, min_confidence: float = 0.75, max_ambiguity: float = 0.25, max_failures: int = 0) -> tuple[dict[str, DataFrame] | None, str]:
    """The delta's distinct symbols and confident edges, or None and why not."""
    if parse_failures > max_failures:
        return None, "parse_failures"
    if delta["quality"].first()["ambiguity_rate"] > max_ambiguity:
        return None, "ambiguity"
    edges = delta["edges"].where(F.col("confidence") >= min_confidence).dropDuplicates(["source", "target", "relationship"])
    return {"symbols": delta["symbols"].dropDuplicates(["qualified_name", "file_path"]), "edges": edges}, "promoted"


def reconcile(artifact: dict[str, DataFrame], local: dict[str, DataFrame], touched: DataFrame) -> dict[str, DataFrame]:
    """The artifact outside touched paths, and what is local; of equal keys local wins."""
    paths = touched.select("path").distinct()
    kept = artifact["symbols"].join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
    symbols = local["symbols"].withColumn("_from", F.lit(0)).unionByName(kept.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    away = artifact["edges"]
    for side in ("source", "target"):
        away = away.join(paths, F.col(f"{side}.file_path") == F.col("path"), "left_anti")
    edges = local["edges"].withColumn("_from", F.lit(0)).unionByName(away.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return {"symbols": first_by(symbols, ["qualified_name", "file_path"], [F.col("_from")]).drop("_from"), "edges": first_by(edges, ["source", "target", "relationship"], [F.col("_from")]).drop("_from")}


def same_edges(a: DataFrame, b: DataFrame) -> bool:
    return a.select(EDGE_KEY).exceptAll(b.select(EDGE_KEY)).isEmpty() and b.select(EDGE_KEY).exceptAll(a.select(EDGE_KEY)).isEmpty()


def pending(queue: DataFrame, repo: str, limit: int) -> DataFrame:
    """A repository's waiting entries, oldest first."""
    return queue.where((F.col("repo_id") == repo) & F.col("status").isin("queued", "retry")).orderBy("created_at", "id").limit(max(1, limit))


def marked(queue: DataFrame, marks: DataFrame) -> DataFrame:
    """K9: entries with new states (id, status, last_error); unknown states become retry, attempts count up."""
    status = F.when(F.col("_s").isin("queued", "retry", "pushed", "failed"), F.col("_s")).otherwise("retry")
    joined = queue.join(marks.select("id", F.col("status").alias("_s"), F.col("last_error").alias("_e"), F.lit(1).alias("_m")), "id", "left")
    hit = F.col("_m").isNotNull()
    return joined.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("last_error", F.when(hit, F.col("_e")).otherwise(F.col("last_error"))).withColumn("attempt_count", F.col("attempt_count") + F.coalesce("_m", F.lit(0))).select(queue.columns)

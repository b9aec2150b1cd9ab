"""The indexing job: scan, extract, resolve, rank. Incremental runs read only the files that changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import rank, resolve
from graphloom.sources import extract, files
from graphloom.tables import delete_files, ignore_duplicate_edges, materialize, replace_files


@dataclass(frozen=True)
class Index:
    """The tables of one snapshot. ``facts`` are the extractors' rows, kept so that unchanged files aren't read again."""

    files: DataFrame
    facts: DataFrame
    symbols: DataFrame
    edges: DataFrame
    external: DataFrame
    diagnostics: DataFrame


def build(spark: SparkSession, listing: DataFrame, facts: DataFrame, go_module: str | None = None, ranked: bool = True, hints: DataFrame | None = None) -> Index:
    """E12, E13, E16 over extracted ``facts``. ``hints`` (file_path, line, receiver, owner_type) come from sidecars."""
    symbols = materialize(spark, extract.symbols(facts), "symbols")
    calls = materialize(spark, resolve.enclosing(extract.calls(facts), symbols, ["call_id", "callee", "receiver"]), "calls")
    near = resolve.look_back(calls.where("receiver IS NOT NULL"), extract.assignments(facts))
    blocks = extract.receiver_types(facts)
    within = (F.col("line") >= F.col("b.start_line")) & (F.col("line") <= F.col("b.end_line"))
    typed = calls.alias("c").join(blocks.alias("b"), (F.col("c.file_path") == F.col("b.file_path")) & (F.col("c.receiver") == F.col("b.receiver")) & within).select("c.call_id", F.col("b.type_name").alias("hint"))
    types = near.unionByName(typed)
    if hints is not None:
        types = types.unionByName(calls.join(hints, ["file_path", "line", "receiver"]).select("call_id", F.col("owner_type").alias("hint")))
    resolved = resolve.resolve_calls(calls, symbols, extract.aliases(facts), types, extract.import_hints(facts))
    found, external = resolve.resolve_imports(extract.imports(facts), listing, go_module)
    number = listing.select("path", F.xxhash64("path").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF).cast("bigint")).alias("id"))
    imports = (
        found.join(number.select(F.col("path").alias("file_path"), F.col("id").alias("source_id")), "file_path")
        .join(number.select(F.col("path").alias("target_path"), F.col("id").alias("target_id")), "target_path")
        .select("source_id", "target_id", F.lit("file").alias("source_type"), F.lit("file").alias("target_type"), F.lit("IMPORTS").alias("relationship"), "file_path", "line_number", F.lit(1.0).alias("confidence"))
    )
    edges = materialize(spark, ignore_duplicate_edges(resolve.call_edges(calls, resolved).unionByName(imports)), "edges")
    if ranked:
        scores = rank.pagerank(spark, symbols, edges)
        symbols = symbols.drop("pagerank_score").join(scores.withColumnRenamed("score", "pagerank_score"), "id")
    external = external.select("file_path", "import_statement", "module_name", "line_number")
    return Index(listing, facts, symbols, edges, external, extract.errors(facts))


def full_index(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, go_module: str | None = None) -> Index:
    """Everything below ``root``."""
    listing = materialize(spark, files.scan(spark, root, include, exclude), "files")
    facts = materialize(spark, extract.extract(listing), "facts")
    return build(spark, listing.drop("text"), facts, go_module)


def incremental_index(spark: SparkSession, old: Index, root: str, changes: DataFrame, go_module: str | None = None) -> Index:
    """``changes`` (status, path, old_path) applied to ``old``: only added, modified and renamed files are read."""
    gone = changes.where("status IN ('D', 'R')").select(F.when(F.col("status") == "R", F.col("old_path")).otherwise(F.col("path")).alias("path"))
    fresh = changes.where("status IN ('A', 'M', 'R')").select("path").distinct()
    listing, _, _ = delete_files(old.files, old.symbols, old.edges.where("file_path IS NOT NULL"), gone.unionByName(fresh))
    paths = [r["path"] for r in fresh.toLocalIterator()]  # the driver lists what it opens: one path for each changed file
    read = materialize(spark, files.scan_paths(spark, root, paths), "files")
    facts = materialize(spark, replace_files(old.facts, extract.extract(read), gone.unionByName(fresh)), "facts")
    return build(spark, materialize(spark, listing.unionByName(read.drop("text")), "files"), facts, go_module)


def stats(index: Index) -> dict:
    """Counts of a snapshot's tables."""
    return {
        "files": index.files.count(),
        "files_indexed": index.files.where("language IS NOT NULL").count(),
        "symbols": index.symbols.count(),
        "edges": index.edges.count(),
        "external_deps": index.external.count(),
        "diagnostics": index.diagnostics.count(),
    }

"""Many repositories as one table with a repository column: catalog, routing, search and cross-repository edges."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import scalar
from graphloom.operators import search
from graphloom.tables import first_by, upsert

EXPORTED = 50_000
CROSS_KEY = ["source_repo_id", "source_qualified_name", "source_file_path", "target_repo_id", "target_qualified_name", "target_file_path", "relationship"]


def exported_symbols(symbols: DataFrame, most: int = EXPORTED) -> DataFrame:
    """Each repository's best symbols by rank (``symbols`` has repo_id)."""
    place = F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc_nulls_last("pagerank_score"), "qualified_name", "file_path"))
    return symbols.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def _contains(name: str) -> Column:
    """a name holds the text, whatever its case, or the qualified name is the text."""
    escaped = name.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col("name").ilike(f"%{escaped}%") | (F.col("qualified_name") == name)


def exported_search(exported: DataFrame, name: str, kind: str = "any", limit: int = 20) -> DataFrame:
    """F18."""
    found = exported.where(_contains(name))
    found = found if kind == "any" else found.where(F.col("kind") == kind)
    return found.orderBy(F.desc_nulls_last("pagerank_score"), "qualified_name", "repo_id", "file_path").limit(schema.clamp(limit, schema.MAX_SEARCH_LIMIT))


def enabled(shards: DataFrame) -> DataFrame:
    """Enabled shards in order, at most the cap."""
    return shards.where("enabled").orderBy("repo_id").limit(schema.MAX_SHARDS)


def route_symbol(exported: DataFrame, shards: DataFrame, name: str) -> DataFrame:
    """(repo_id, place) of the repositories that export the name, best hit first; all enabled ones if none does."""
    hits = exported_search(exported, name, limit=schema.MAX_SEARCH_LIMIT)  # so windows and sums have at most as many rows
    best = F.struct(-F.coalesce("pagerank_score", F.lit(0.0)), "qualified_name")
    found = hits.groupBy("repo_id").agg(F.min(best).alias("b"))
    if found.isEmpty():
        found = enabled(shards).select("repo_id", F.struct(F.lit(0.0), F.lit("")).alias("b"))
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("b", "repo_id"))
    return found.select("repo_id", place.alias("place")).where(F.col("place") <= schema.MAX_SHARDS)


def neighbours(cross: DataFrame, repos: DataFrame, name: str) -> DataFrame:
    """The repositories at the other end of a name's edges that leave or enter one of ``repos``."""
    out = cross.where(F.col("source_qualified_name") == name).join(repos.select(F.col("repo_id").alias("source_repo_id")), "source_repo_id", "left_semi").select(F.col("target_repo_id").alias("repo_id"))
    into = cross.where(F.col("target_qualified_name") == name).join(repos.select(F.col("repo_id").alias("target_repo_id")), "target_repo_id", "left_semi").select(F.col("source_repo_id").alias("repo_id"))
    return out.unionByName(into).distinct()


def route(exported: DataFrame, cross: DataFrame, shards: DataFrame, name: str, source: str | None = None) -> DataFrame:
    """(repo_id, way, place) to ask for a name: the source, those that export it (or all), then their neighbours."""
    spark = exported.sparkSession
    first = spark.createDataFrame([(source, 0, 0)] if source else [], "repo_id string, way int, place int")
    owns = route_symbol(exported, shards, name).select("repo_id", F.lit(1).alias("way"), "place")
    known = first.unionByName(owns)
    near = neighbours(cross, known, name).select("repo_id", F.lit(2).alias("way"), F.lit(0).alias("place"))
    best = known.unionByName(near).groupBy("repo_id").agg(F.min(F.struct("way", "place")).alias("b"))
    return best.select("repo_id", "b.way", "b.place").orderBy("way", "place", "repo_id").limit(schema.MAX_SHARDS)


def federated_search(symbols: DataFrame, edges: DataFrame, query: str, kind: str = "any", limit: int = 20, shards: DataFrame | None = None) -> DataFrame:
    """The best symbols over all asked repositories in one job, in global order.

    Identifiers are (repo_id, id); edges carry repo_id, too.
    """
    own = symbols if shards is None else symbols.join(shards.select("repo_id"), "repo_id", "left_semi")
    found = search.like_candidates(own, schema.truncate_query(query), kind)
    calls = edges.where("relationship = 'CALLS'")
    ends = calls.select("repo_id", F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(calls.select("repo_id", F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counted = ends.groupBy("repo_id", "id").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    zero = F.lit(0).cast("bigint")
    rows = found.join(counted, ["repo_id", "id"], "left").withColumns({n: F.coalesce(n, zero) for n in ("inbound", "outbound")})
    score = scalar.hybrid_score(scalar.lexical_score(F.lit(query), F.col("name"), F.col("qualified_name")), scalar.structural_score(F.col("pagerank_score"), F.col("inbound"), F.col("outbound")), F.lit(0.0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "qualified_name", "repo_id").limit(schema.clamp(limit, schema.MAX_FEDERATED))


def shard_report(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols and edges of each repository."""
    counts = symbols.groupBy("repo_id").agg(F.count("*").alias("symbols"))
    links = edges.groupBy("repo_id").agg(F.count("*").alias("edges"))
    return counts.join(links, "repo_id", "full").fillna(0)


def resolve_external(deps: DataFrame, exported: DataFrame, most: int = 20) -> DataFrame:
    """External dependencies meet exported symbols of other repositories.

    TypeScript modules match by their last segment as name, others by module prefix. A prefix join is an equi join on
    every dotted prefix of the qualified name. The best ``most`` are taken before a repository's own are dropped.
    """
    last = F.element_at(F.split("module_name", "/"), -1)
    by_name = deps.where("language = 'typescript'").select("repo_id", "file_path", "module_name", last.alias("key"), F.lit("name").alias("way"))
    by_module = deps.where("language <> 'typescript'").select("repo_id", "file_path", "module_name", F.col("module_name").alias("key"), F.lit("module").alias("way"))
    names = exported.select(F.col("repo_id").alias("target_repo_id"), F.col("qualified_name").alias("target_qualified_name"), F.col("file_path").alias("target_file_path"), "pagerank_score", F.col("name").alias("key"), F.lit("name").alias("way"))
    cuts = F.transform(F.sequence(F.lit(1), F.size(F.split("qualified_name", "\\."))), lambda i: F.array_join(F.slice(F.split("qualified_name", "\\."), F.lit(1), i), "."))
    modules = exported.select(F.col("repo_id").alias("target_repo_id"), F.col("qualified_name").alias("target_qualified_name"), F.col("file_path").alias("target_file_path"), "pagerank_score", F.explode(cuts).alias("key"), F.lit("module").alias("way"))
    # what a key finds does not depend on who asks, so each key's best are chosen before the join
    place = F.row_number().over(W.partitionBy("key", "way").orderBy(F.desc_nulls_last("pagerank_score"), "target_qualified_name", "target_repo_id", "target_file_path"))
    best = names.unionByName(modules).withColumn("_n", place).where(F.col("_n") <= most)
    kept = by_name.unionByName(by_module).join(best, ["key", "way"]).where(F.col("repo_id") != F.col("target_repo_id"))
    rows = kept.select(F.col("repo_id").alias("source_repo_id"), F.col("module_name").alias("source_qualified_name"), F.col("file_path").alias("source_file_path"), "target_repo_id", "target_qualified_name", "target_file_path", F.lit("IMPORTS").alias("relationship"), F.when(F.col("way") == "name", 0.8).otherwise(1.0).alias("confidence"))
    return first_by(rows, CROSS_KEY, [F.desc("confidence")])


def cross_edges(cross: DataFrame, repo: str, direction: str = "both", limit: int = schema.MAX_CROSS_EDGES) -> DataFrame:
    """Edges into or out of a repository."""
    condition = {"in": F.col("target_repo_id") == repo, "out": F.col("source_repo_id") == repo}
    both = condition["in"] | condition["out"] if direction == "both" else condition[direction]
    return cross.where(both).orderBy(*CROSS_KEY).limit(schema.clamp(limit, schema.MAX_CROSS_EDGES))


def workspace_search(symbols: DataFrame, roots: DataFrame, query: str, kind: str = "any", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the matches in all enabled roots (``symbols`` has root), by importance, name and root."""
    own = symbols.join(roots.where("enabled").select("root"), "root", "left_semi")
    found = search.like_candidates(own, schema.truncate_query(query), kind).withColumnRenamed("pagerank_score", "importance_score")
    order = [F.desc_nulls_last("importance_score"), F.asc("qualified_name"), F.asc("root"), F.asc("file_path")]
    return found.orderBy(*order).offset(max(0, offset)).limit(schema.clamp(limit, schema.MAX_SEARCH_LIMIT))


@dataclass(frozen=True)
class Catalog:
    """The registry of shards with what they export and the edges between them; each change is a new catalog."""

    shards: DataFrame
    exported: DataFrame
    cross: DataFrame

    def register(self, rows: DataFrame) -> Catalog:
        """Shards (repo_id, repo_path) become enabled, in place of those of their name."""
        fresh = rows.select("repo_id", "repo_path", F.lit(True).alias("enabled"), F.lit(0).cast("bigint").alias("symbol_count"), F.lit(0).cast("bigint").alias("edge_count"))
        return replace(self, shards=upsert(self.shards, fresh, ["repo_id"]))

    def unregister(self, repo: str) -> Catalog:
        """A shard goes with its exports and with the edges at either end."""
        rest = self.exported.where(F.col("repo_id") != repo)
        return Catalog(self.shards.where(F.col("repo_id") != repo), rest, self.without_edges(repo).cross)

    def listed(self, only_enabled: bool = True) -> DataFrame:
        return (self.shards.where("enabled") if only_enabled else self.shards).orderBy("repo_id")

    def shard(self, repo: str) -> DataFrame:
        return self.shards.where(F.col("repo_id") == repo)

    def counted(self, report: DataFrame) -> Catalog:
        """Counts (repo_id, symbols, edges) take their places."""
        found = report.select("repo_id", F.col("symbols").alias("_s"), F.col("edges").alias("_e"))
        joined = self.shards.join(found, "repo_id", "left")
        shown = {"symbol_count": F.coalesce("_s", "symbol_count"), "edge_count": F.coalesce("_e", "edge_count")}
        return replace(self, shards=joined.withColumns(shown).select(self.shards.columns))

    def with_edges(self, rows: DataFrame) -> Catalog:
        """Edges take the place of those of their seven keys."""
        return replace(self, cross=upsert(self.cross, first_by(rows, CROSS_KEY, [F.desc("confidence")]), CROSS_KEY))

    def without_edges(self, repo: str) -> Catalog:
        return replace(self, cross=self.cross.where((F.col("source_repo_id") != repo) & (F.col("target_repo_id") != repo)))

    def edges_of(self, repo: str, name: str | None = None, direction: str = "both") -> DataFrame:
        """Edges from a repository (out), to it (in) or both; with a name only that symbol's."""
        ends = {"out": "source", "in": "target"}
        found = [(F.col(f"{e}_repo_id") == repo) & (F.lit(True) if name is None else F.col(f"{e}_qualified_name") == name) for d, e in ends.items() if direction in (d, "both")]
        return self.cross.where(reduce(lambda a, b: a | b, found)).orderBy(*CROSS_KEY)

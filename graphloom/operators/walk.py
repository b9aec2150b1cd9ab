"""Bounded traversals of the edge table, for any number of seeds in one job.

A frontier is joined with the edges once a level; what was reached before is left out by an anti join. Each level is a
written table, so lineage stays short and a lost executor costs one level. Seeds are a grouping column: a
single-symbol call is a table of one row. Where a level meets a node more than once, the smallest line is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import scalar
from graphloom.tables import first_by, materialize


def resolve(symbols: DataFrame, names: DataFrame, exact_first: bool = True) -> DataFrame:
    """(query, id): for each ``query`` the best symbol of that qualified name or name, by rank, then id.

    With ``exact_first`` qualified names win over names.
    """
    q = names.select("query").distinct()
    found = symbols.select(F.col("qualified_name").alias("query"), "id", "pagerank_score", F.lit(0).alias("way")).unionByName(symbols.select(F.col("name").alias("query"), "id", "pagerank_score", F.lit(1).alias("way")))
    order = ([F.col("way")] if exact_first else []) + [F.desc_nulls_last("pagerank_score"), F.col("id")]
    return first_by(found.join(q, "query"), ["query"], order).select("query", "id")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(at, next, line) of one step in a direction."""
    backward, relationships = {
        "callers": (True, ["CALLS"]),
        "callees": (False, ["CALLS"]),
        "implementors": (True, ["IMPLEMENTS"]),
        "supers": (False, ["EXTENDS", "IMPLEMENTS"]),
    }[direction]
    near, far = ("target", "source") if backward else ("source", "target")
    return edges.where(F.col("relationship").isin(relationships) & (F.col(f"{near}_type") == "symbol")).select(F.col(f"{near}_id").alias("at"), F.col(f"{far}_id").alias("next"), F.col("line_number").alias("line"))


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among ``nodes`` (id), so that what follows works on those alone."""
    ids = nodes.select("id").distinct()
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


def both_ways(edges: DataFrame, relationships: tuple[str, ...] = schema.RELATIONSHIPS) -> DataFrame:
    """(at, next) of undirected steps between symbols; parallel edges stay."""
    own = edges.where(F.col("relationship").isin(list(relationships)) & (F.col("source_type") == "symbol") & (F.col("target_type") == "symbol"))
    return own.select(F.col("source_id").alias("at"), F.col("target_id").alias("next")).unionByName(own.select(F.col("target_id").alias("at"), F.col("source_id").alias("next")))


def levels(spark: SparkSession, steps: DataFrame, seeds: DataFrame, depth: int, nodes: DataFrame | None = None, cap: int | None = None, with_seeds: bool = False) -> DataFrame:
    """(seed_id, id, depth, line) of all that is reached from ``seeds`` (seed_id, id) over ``steps`` (at, next[, line]).

    With ``nodes`` (id) only those are reached and walked on. ``cap`` bounds what a seed reaches, by depth, line and id.
    """
    line = F.col("line").cast("int") if "line" in steps.columns else F.lit(None).cast("int")
    steps = steps.select("at", "next", line.alias("line"))
    if nodes is not None:
        steps = steps.join(nodes.select(F.col("id").alias("next")), "next", "left_semi")
    start = seeds.select("seed_id", "id", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("line")).distinct()
    done = [materialize(spark, start, "level")]
    for level in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, done).select("seed_id", "id")
        met = done[-1].select("seed_id", F.col("id").alias("at")).join(steps, "at").groupBy("seed_id", F.col("next").alias("id")).agg(F.min("line").alias("line"))
        fresh = met.join(seen, ["seed_id", "id"], "left_anti").select("seed_id", "id", F.lit(level).alias("depth"), "line")
        if cap is not None:
            order = W.partitionBy("seed_id").orderBy(F.col("line").asc_nulls_first(), "id")
            before = seen.groupBy("seed_id").agg(F.count("*").alias("_before"))
            fresh = fresh.withColumn("_n", F.row_number().over(order)).join(before, "seed_id").where(F.col("_n") + F.col("_before") <= cap).drop("_n", "_before")
        fresh = materialize(spark, fresh, "level")
        if fresh.isEmpty():
            break
        done.append(fresh)
    out = reduce(DataFrame.unionByName, done)
    return out if with_seeds else out.where("depth > 0")


def references(spark: SparkSession, edges: DataFrame, symbols: DataFrame, seeds: DataFrame, direction: str = "both", depth: int = 1, cap: int | None = None) -> DataFrame:
    """G1: reached symbols with direction, line and depth. Unknown identifiers are walked through and then left out."""
    schema.one_of(direction, schema.DIRECTIONS, "direction")
    depth = schema.clamp(depth, schema.MAX_DEPTH)
    names = ("callers", "callees") if direction == "both" else (direction,)
    found = [levels(spark, directed(edges, d), seeds, depth, cap=cap).withColumn("direction", F.lit(d)) for d in names]
    return reduce(DataFrame.unionByName, found).join(symbols.select("id", "name", "qualified_name", "file_path", "start_line", "end_line", "signature"), "id").withColumn("line", F.coalesce("line", F.lit(0)))


def blast_radius(spark: SparkSession, edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Callers of callers; unknown identifiers end the walk. ``scope`` is direct or transitive."""
    found = levels(spark, directed(edges, "callers"), seeds, depth, nodes=symbols)
    return found.join(symbols.select("id", "name", "file_path"), "id").select("seed_id", "id", "name", "file_path", F.coalesce("line", F.lit(0)).alias("line"), "depth", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("scope"))


def blast_summary(symbols: DataFrame, seeds: DataFrame, reached: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Counts, distinct files and risk for each seed; the seed's own file counts."""
    counts = reached.groupBy("seed_id").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    own = seeds.join(symbols.select("id", "file_path"), "id").select("seed_id", "file_path")
    files = own.unionByName(reached.select("seed_id", "file_path"))
    if types is not None:
        files = files.unionByName(types.select("seed_id", "file_path"))
        counts = counts.join(types.groupBy("seed_id").agg(F.count("*").alias("types")), "seed_id", "full")
    counted = files.groupBy("seed_id").agg(F.count_distinct("file_path").alias("files"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    out = counted.join(counts, "seed_id", "left").select("seed_id", zero("direct").alias("direct"), zero("transitive").alias("transitive"), "files", *([zero("types").alias("types")] if types is not None else []))
    return out.withColumn("risk", scalar.risk(F.col("direct"), F.col("transitive"), F.col("types") if types is not None else None))


def type_dependents(edges: DataFrame, symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """What extends or implements a seed, with the relationship."""
    own = edges.where(F.col("relationship").isin("EXTENDS", "IMPLEMENTS") & (F.col("target_type") == "symbol")).select(F.col("target_id").alias("at"), F.col("source_id").alias("id"), "relationship")
    return seeds.select("seed_id", F.col("id").alias("at")).join(own, "at").join(symbols.select("id", "name", "qualified_name", "file_path"), "id").drop("at")


def change_impact(spark: SparkSession, edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 3, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(dependents by call or type with an impact reason, summary for each seed)."""
    calls = levels(spark, directed(edges, "callers"), seeds, schema.clamp(depth, schema.MAX_DEPTH), nodes=symbols, cap=cap).join(symbols.select("id", "name", "qualified_name", "file_path"), "id")
    types = type_dependents(edges, symbols, seeds)
    reason = F.concat(F.lit("call_dependency:depth="), F.col("depth").cast("string"))
    rows = calls.select("seed_id", "id", "name", "file_path", reason.alias("impact_reason")).unionByName(types.select("seed_id", "id", "name", "file_path", F.concat(F.lit("type_dependency:"), F.col("relationship")).alias("impact_reason")))
    return rows, blast_summary(symbols, seeds, calls, types)


def data_flow(spark: SparkSession, edges: DataFrame, symbols: DataFrame, seeds: DataFrame, direction: str = "both", depth: int = 3) -> DataFrame:
    """(seed_id, from_id, to_id, line, depth): every call edge at every state of the walk, a state being a node and its role.

    A state is walked on from once; its edges are reported each time another state shares the node.
    """
    schema.one_of(direction, schema.FLOWS, "direction")
    depth = schema.clamp(depth, schema.MAX_DEPTH)
    known = symbols.select("id")
    calls = edges.where((F.col("relationship") == "CALLS") & (F.col("source_type") == "symbol") & (F.col("target_type") == "symbol")).select("source_id", "target_id", F.coalesce("line_number", F.lit(0)).alias("line"))
    ways = []
    if direction in ("upstream", "both"):
        ways.append(calls.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("at"), F.col("source_id").alias("next"), F.lit("upstream").alias("way"), "source_id", "target_id", "line"))
    if direction in ("downstream", "both"):
        ways.append(calls.join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("at"), F.col("target_id").alias("next"), F.lit("downstream").alias("way"), "source_id", "target_id", "line"))
    steps = reduce(DataFrame.unionByName, ways)
    states = [materialize(spark, seeds.select("seed_id", "id", F.lit("target").alias("role")).distinct(), "flow")]
    paths = []
    for level in range(1, depth + 1):
        taken = materialize(spark, states[-1].select("seed_id", F.col("id").alias("at")).join(steps, "at").withColumn("depth", F.lit(level)), "paths")
        paths.append(taken.select("seed_id", F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "line", "depth"))
        fresh = taken.select("seed_id", F.col("next").alias("id"), F.col("way").alias("role")).distinct()
        fresh = materialize(spark, fresh.join(reduce(DataFrame.unionByName, states), ["seed_id", "id", "role"], "left_anti"), "flow")
        if fresh.isEmpty():
            break
        states.append(fresh)
    return reduce(DataFrame.unionByName, paths)


def flow_nodes(paths: DataFrame, seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each node of the paths with its first role: by depth, upstream before downstream."""
    ends = paths.select("seed_id", F.col("from_id").alias("id"), "depth", F.lit("upstream").alias("role"), F.col("to_id").alias("other")).unionByName(paths.select("seed_id", F.col("to_id").alias("id"), "depth", F.lit("downstream").alias("role"), F.col("from_id").alias("other")))
    start = seeds.select("seed_id", "id", F.lit(0).alias("depth"), F.lit("target").alias("role"), F.lit(None).cast("bigint").alias("other"))
    return first_by(start.unionByName(ends), ["seed_id", "id"], [F.col("depth"), F.desc("role"), F.col("other")]).join(symbols.select("id", "name", "file_path"), "id").select("seed_id", "id", "name", "file_path", "role")


def expand(spark: SparkSession, edges: DataFrame, seeds: DataFrame, depth: int = 2, cap: int | None = None) -> DataFrame:
    """Undirected; seeds of one ``seed_id`` start together at depth 0."""
    return levels(spark, both_ways(edges), seeds, schema.clamp(depth, schema.MAX_CONTEXT_DEPTH), cap=cap, with_seeds=True).select("seed_id", "id", "depth")


def hydrate_source(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``source`` is lines start_line to end_line of the file's ``text``, empty where there is none."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    n = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    source = F.array_join(F.slice(lines, F.greatest(F.col("start_line"), F.lit(1)), n), "\n")
    return rows.join(files.select(F.col("path").alias("file_path"), "text"), "file_path", "left").withColumn("source", F.coalesce(source, F.lit(""))).drop("text")

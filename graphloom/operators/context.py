"""Context bundles and structure maps within a token budget.

The folds that decide what fits are sequential by definition. A structure map stops at the first line that doesn't
fit, which a running sum says; a context bundle skips what doesn't fit and goes on, one grouped fold over a bounded
number of symbols (the node cap) for each request.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import scalar
from graphloom.operators.rank import personalized_pagerank
from graphloom.operators.walk import both_ways, between, expand, hydrate_source
from graphloom.tables import materialize, running_sum


BY_FILE = ["file_path", "-pagerank_score", "start_line", "id"]


def _by_file() -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in BY_FILE]


def _below(symbols: DataFrame, path: str) -> DataFrame:
    if path in ("", "."):
        return symbols
    pattern = path if path.endswith("%") else path.rstrip("/") + "/%"
    return symbols.where(F.col("file_path").ilike(pattern.replace("\\", "\\\\")))


def _lines(own: DataFrame, best: DataFrame | None, signatures: bool) -> DataFrame:
    """Lines of ``own`` in order; TOP marks those in ``best`` (id), or the first ten."""
    rows = running_sum(own.withColumn("_one", F.lit(1)), [], _by_file(), "_one", "rank").drop("_one", "rank_all")
    if best is None:
        rows = rows.withColumn("top", F.col("rank") <= 10)
    else:
        rows = rows.join(best.select("id", F.lit(True).alias("top")), "id", "left").withColumn("top", F.coalesce("top", F.lit(False)))
    named = F.concat_ws(" ", "kind", "name")
    detail = F.coalesce(F.nullif(F.col("signature"), F.lit("")), named) if signatures else named
    line = F.concat(F.lit("  "), F.when(F.col("top"), "[TOP] ").otherwise(""), detail, F.lit("  [rank:"), F.col("rank").cast("string"), F.lit("]"))
    heads = rows.groupBy("file_path").agg(F.min("rank").alias("rank")).select((2 * F.col("rank") - 1).alias("position"), F.col("file_path").alias("line"))
    lines = heads.unionByName(rows.select((2 * F.col("rank")).alias("position"), line.alias("line")))
    return lines.withColumn("tokens", scalar.estimate_tokens(F.col("line")))


def _best(own: DataFrame) -> DataFrame:
    return own.orderBy(F.desc("pagerank_score"), *_by_file()).limit(10).select("id")


def structure_lines(symbols: DataFrame, path: str = ".", signatures: bool = True, ranked: bool = False) -> DataFrame:
    """The map's lines in order: (position, line, tokens). With ``ranked``, TOP marks the best ten symbols."""
    own = _below(symbols, path)
    return _lines(own, _best(own) if ranked else None, signatures)


def structure(symbols: DataFrame, path: str = ".", budget: int = 4_000, signatures: bool = True, ranked: bool = False) -> DataFrame:
    """The longest prefix of lines within the budget.

    A line costs a token at least, so the first ``budget`` symbols have all lines that can fit, and the rest is not read on.
    """
    budget = schema.clamp(budget, schema.MAX_BUDGET)
    own = _below(symbols, path)
    lines = _lines(own.orderBy(*_by_file()).limit(budget), _best(own) if ranked else None, signatures)
    return running_sum(lines, [], [F.col("position")], "tokens", "used").drop("used_all").where(F.col("used") <= budget)


def structure_text(lines: DataFrame) -> str:
    """The map as text; the budget bounds its lines."""
    return "\n".join(r["line"] for r in lines.orderBy("position").collect())


def ranked_context(spark: SparkSession, symbols: DataFrame, edges: DataFrame, seeds: DataFrame, query: str, depth: int = 2, cap: int | None = None) -> DataFrame:
    """(seed_id, id, depth, ppr, score, is_seed and the symbol's columns)."""
    reached = materialize(spark, expand(spark, edges, seeds, depth, cap), "reached")
    ppr = personalized_pagerank(spark, edges, reached, seeds)
    terms = F.lit(query)
    found = scalar.relevance(scalar.tokens(terms), F.col("name"), F.col("qualified_name"), F.col("signature"))
    rows = reached.join(ppr.withColumnRenamed("score", "ppr"), ["seed_id", "id"]).join(symbols, "id")
    rows = rows.join(seeds.select("seed_id", "id", F.lit(True).alias("is_seed")).distinct(), ["seed_id", "id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    return rows.withColumn("score", scalar.context_score(F.col("ppr"), F.col("pagerank_score"), F.col("depth"), found))


def topology_order(scores: dict[int, float], seeds: set[int], neighbours: dict[int, set[int]]) -> list[tuple[int, str]]:
    """Breadth first from the seeds, better scores first at every step, then the rest by score; ids break ties."""
    best = lambda ids: sorted(ids, key=lambda i: (-scores.get(i, 0.0), i))
    waiting: list[tuple[int, int, str]] = [(n, i, "seed") for n, i in enumerate(best(seeds))]
    turn, out, seen = len(waiting), [], set()
    while waiting:
        _, at, reason = heapq.heappop(waiting)
        if at in seen:
            continue
        seen.add(at)
        out.append((at, reason))
        for near in best(neighbours.get(at, set()) - seen):
            heapq.heappush(waiting, (turn, near, "graph_neighbor"))
            turn += 1
    return out + [(i, "rank_fallback") for i in best(set(scores) - seen)]


def reachable(included: set[int], seeds: set[int], neighbours: dict[int, set[int]]) -> int:
    """How many of the included are reached from included seeds over included ones."""
    waiting = list(included & seeds)
    seen = set(waiting)
    while waiting:
        fresh = neighbours.get(waiting.pop(), set()) & included - seen
        seen |= fresh
        waiting += fresh
    return len(seen)


BUNDLE = "seed_id bigint, position int, id bigint, name string, file_path string, qualified_name string, start_line int, end_line int, kind string, depth int, included_as string, source string, tokens bigint, selection_reason string, duplicate_skips int, redaction_hits bigint, connected int"


def bundle(ranked: DataFrame, edges: DataFrame, budget: int = 8_000, signatures_only: bool = False, cap: int = schema.MAX_VISITED) -> DataFrame:
    """What of ``ranked`` (with ``source``) fits, in topological order. Sources and signatures are both redacted."""
    budget = schema.clamp(budget, schema.MAX_BUDGET)
    inside = ranked.select("seed_id", "id")
    steps = both_ways(between(edges, inside)).distinct()
    near = inside.withColumnRenamed("id", "at").join(steps, "at").join(inside.withColumnRenamed("id", "next"), ["seed_id", "next"], "left_semi").groupBy("seed_id", F.col("at").alias("id")).agg(F.collect_set("next").alias("near"))
    full, full_hits = scalar.redact(F.col("source"))
    short, short_hits = scalar.redact(F.coalesce("signature", F.lit("")))
    columns = ["seed_id", "id", "name", "kind", "qualified_name", "file_path", "start_line", "end_line", "depth", "score", "is_seed"]
    rows = ranked.select(*columns, full.alias("full"), full_hits.alias("full_hits"), short.alias("short"), short_hits.alias("short_hits"), scalar.estimate_tokens(full).alias("full_tokens"), scalar.estimate_tokens(short).alias("short_tokens")).join(near, ["seed_id", "id"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {int(r.id): r for r in pdf.itertuples()}
        seeds = {i for i, r in at.items() if r.is_seed}
        neighbours = {i: set() if r.near is None else {int(x) for x in r.near} for i, r in at.items()}
        order = topology_order({i: float(r.score) for i, r in at.items()}, seeds, neighbours)
        out, seen, used, skipped, hits = [], set(), 0, 0, 0
        for i, reason in order:
            if len(out) >= cap:
                break
            r = at[i]
            ways = [("full_source", r.full, r.full_tokens, r.full_hits)] if r.is_seed and not signatures_only else []
            ways.append(("signature_only", r.short, r.short_tokens, r.short_hits))
            hits += ways[0][3]
            for mode, text, cost, _ in ways:
                key = (r.qualified_name, r.file_path, text)
                if key in seen:
                    skipped += 1
                    break
                if used + cost <= budget:
                    seen.add(key)
                    used += cost
                    why = f"{reason},depth={r.depth},mode={mode}" + ",seed_match" * bool(r.is_seed)
                    out.append((r.seed_id, len(out), i, r.name, r.file_path, r.qualified_name, r.start_line, r.end_line, r.kind, r.depth, mode, text, cost, why))
                    break
        names = [c.split()[0] for c in BUNDLE.split(", ")]
        connected = reachable({o[2] for o in out}, seeds, neighbours)
        return pd.DataFrame([(*o, skipped, hits, connected) for o in out], columns=names)

    return rows.groupBy("seed_id").applyInPandas(fold, BUNDLE)


def quality(included: DataFrame, seeds: DataFrame, budget: int) -> DataFrame:
    """Seed hits, connectedness within the bundle, depth, use of the budget and duplicates, for each seed_id."""
    start = seeds.join(included.select("seed_id", "id"), ["seed_id", "id"], "left_semi")
    hit = start.distinct().groupBy("seed_id").agg(F.count("*").alias("hit"))
    total = seeds.distinct().groupBy("seed_id").agg(F.count("*").alias("total"))
    base = included.groupBy("seed_id").agg(F.count("*").alias("n"), F.avg("depth").alias("avg_depth"), F.sum("tokens").alias("tokens"), F.max("duplicate_skips").alias("skips"), F.max("redaction_hits").alias("redaction_hits"), F.max("connected").alias("connected"))
    joined = total.join(base, "seed_id", "left").join(hit, "seed_id", "left").fillna(0)
    some = F.col("n") > 0
    part = lambda c: F.round(F.when(some, c).otherwise(F.lit(0.0)), 4)
    return joined.select(
        "seed_id",
        part(F.col("hit") / F.greatest(F.col("total"), F.lit(1))).alias("seed_hit_rate"),
        part(F.col("connected") / F.greatest(F.col("n"), F.lit(1))).alias("connectedness"),
        part(F.col("tokens") / F.lit(max(budget, 1))).alias("token_efficiency"),
        part(F.col("avg_depth")).alias("avg_depth"),
        F.col("n").alias("included_count"),
        F.round(F.when(some, F.col("n") / (F.col("n") + F.col("skips"))).otherwise(F.lit(1.0)), 4).alias("dedupe_ratio"),
        "redaction_hits",
    )


def get_context(spark: SparkSession, symbols: DataFrame, edges: DataFrame, seeds: DataFrame, query: str, files: DataFrame | None = None, budget: int = 8_000, signatures_only: bool = False, depth: int = 2) -> DataFrame:
    """The bundle's symbols. ``files`` (path, text) gives sources; without it they are empty."""
    cap = schema.node_cap(symbols.count())
    rows = ranked_context(spark, symbols, edges, seeds, query, depth, cap)
    rows = hydrate_source(rows, files) if files is not None else rows.withColumn("source", F.lit(""))
    return materialize(spark, bundle(rows, edges, budget, signatures_only, cap), "bundle")


def by_file(included: DataFrame) -> DataFrame:
    """Entries of each file, by line."""
    entry = F.struct("start_line", "id", "name", "kind", "included_as", "source")
    return included.groupBy("seed_id", "file_path").agg(F.sort_array(F.collect_list(entry)).alias("symbols"))

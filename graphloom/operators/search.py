"""Symbol search: full-text and pattern candidates, lexical, structural and semantic scores, top-k and paging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import scalar
from graphloom.operators.rank import degrees
from graphloom.operators.walk import resolve

FIELDS = ("name", "qualified_name", "docstring", "signature")
#: A query that a full-text index reads as plain words; anything else finds nothing there.
_BAREWORDS = re.compile(r"[\w\s]+")
_OPERATORS = {"AND", "OR", "NOT", "NEAR"}


def _like(pattern: str) -> str:
    """A LIKE pattern without escape character."""
    return pattern.replace("\\", "\\\\")


def kind_and_file(kind: str = "any", file_pattern: str | None = None) -> Column:
    """F2, F3."""
    condition = F.lit(True) if kind == "any" else F.col("kind") == kind
    return condition & F.col("file_path").ilike(_like(file_pattern.replace("*", "%"))) if file_pattern is not None else condition


def like_candidates(symbols: DataFrame, query: str, kind: str = "any", file_pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """F1, O2: name or qualified name contains the query; its ``%`` and ``_`` stay wildcards."""
    pattern = _like(f"%{query.lower()}%")
    found = symbols.where((F.lower("name").like(pattern) | F.lower("qualified_name").like(pattern)) & kind_and_file(kind, file_pattern))
    return found if limit is None else found.orderBy(F.desc("pagerank_score"), "name", "id").limit(limit)


def token_index(symbols: DataFrame) -> DataFrame:
    """The inverted index (token, id, tf) over name, qualified name, docstring and signature."""
    text = F.concat_ws(" ", *FIELDS)
    return symbols.select("id", F.explode(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def fts_candidates(symbols: DataFrame, query: str, kind: str = "any", file_pattern: str | None = None, limit: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Symbols that hold every token of the query in any field, by term frequency, then rank.

    A query with anything but plain words finds nothing, as an index would reject it.
    """
    words = query.split()
    if not words or not _BAREWORDS.fullmatch(query) or _OPERATORS & set(words):
        return symbols.limit(0).withColumn("tf", F.lit(0).cast("bigint"))
    asked = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    if not asked:
        return symbols.limit(0).withColumn("tf", F.lit(0).cast("bigint"))
    hits = (token_index(symbols) if index is None else index).where(F.col("token").isin(asked)).groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).where(F.col("n") == len(asked)).select("id", "tf")
    found = symbols.where(kind_and_file(kind, file_pattern)).join(hits, "id")
    return found if limit is None else found.orderBy(F.desc("tf"), F.desc("pagerank_score"), "id").limit(limit)


def candidates(symbols: DataFrame, query: str, kind: str = "any", file_pattern: str | None = None, limit: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Both kinds of candidates once each; a full-text hit keeps its label."""
    fts = fts_candidates(symbols, query, kind, file_pattern, limit, index).drop("tf").withColumn("match_strategy", F.lit("fts"))
    like = like_candidates(symbols, query, kind, file_pattern, limit).withColumn("match_strategy", F.lit("like"))
    return fts.unionByName(like.join(fts.select("id"), "id", "left_anti"))


def scored(found: DataFrame, edges: DataFrame, query: str, hybrid: bool = True, semantic: bool = False) -> DataFrame:
    """N5 over call degrees."""
    q = F.lit(query)
    with_degrees = degrees(found, edges, ("CALLS",))
    score = scalar.hybrid_score(
        scalar.lexical_score(q, F.col("name"), F.col("qualified_name")),
        scalar.structural_score(F.col("pagerank_score"), F.col("inbound"), F.col("outbound")),
        scalar.semantic_score(q, F.col("signature"), F.col("docstring")) if semantic else F.lit(0.0),
        hybrid,
    )
    return with_degrees.withColumn("score", score).withColumnsRenamed({"inbound": "callers_count", "outbound": "callees_count"})


def search_order() -> list[Column]:
    """O1, with the identifier last."""
    return [F.desc("score"), F.col("qualified_name"), F.col("file_path"), F.col("id")]


def search_symbols(symbols: DataFrame, edges: DataFrame, query: str, kind: str = "any", file_pattern: str | None = None, limit: int = 20, offset: int = 0, index: DataFrame | None = None, hybrid: bool = True, semantic: bool = False) -> DataFrame:
    """The best symbols for a query."""
    schema.one_of(kind, schema.KINDS, "kind")
    query = schema.truncate_query(query)
    limit = schema.clamp(limit, schema.MAX_SEARCH_LIMIT)
    asked = schema.clamp(limit + max(0, offset), schema.MAX_SEARCH_LIMIT)
    found = candidates(symbols, query, kind, file_pattern, schema.clamp(3 * asked, schema.MAX_SEARCH_LIMIT), index)
    page = scored(found, edges, query, hybrid, semantic).orderBy(*search_order()).limit(asked)
    return page.orderBy(*search_order()).offset(offset) if offset else page


def pick_seeds(symbols: DataFrame, query: str, entry_points: list[str] | None = None, limit: int = 8) -> DataFrame:
    """(id) of entry points, else full-text hits, else symbols with any word of the query."""
    spark = symbols.sparkSession
    names = list(dict.fromkeys(entry_points or []))[: schema.MAX_SEEDS]
    if names:
        found = resolve(symbols, spark.createDataFrame([(n,) for n in names], "query string"), exact_first=False).select("id").distinct()
        if not found.isEmpty():
            return found
    hits = fts_candidates(symbols, query.strip(), limit=limit).select("id")
    if not hits.isEmpty():
        return hits
    words = [w for w in query.lower().split() if w]
    if not words:
        return symbols.select("id").limit(0)
    patterns = [_like(f"%{w}%") for w in words]
    any_word = F.lit(False)
    for p in patterns:
        any_word = any_word | F.lower("name").like(p) | F.lower("qualified_name").like(p)
    return symbols.where(any_word).orderBy(F.desc("pagerank_score"), "id").limit(limit).select("id")


def symbol_scores(symbols: DataFrame, edges: DataFrame, include_tests: bool = False) -> DataFrame:
    """A3 with N11 and N12, the base of entry points, hot paths and orphans."""
    own = symbols if include_tests else symbols.where(~scalar.is_test_path(F.col("file_path")))
    rank = F.coalesce("pagerank_score", F.lit(0.0))
    return degrees(own, edges).withColumn("entry_score", scalar.entry_score(rank, F.col("inbound"), F.col("outbound"), F.col("file_path"))).withColumn("hot_score", scalar.hot_score(rank, F.col("inbound"), F.col("outbound")))


def entry_points(symbols: DataFrame, edges: DataFrame, limit: int = 20, include_tests: bool = False) -> DataFrame:
    """G14."""
    return symbol_scores(symbols, edges, include_tests).orderBy(F.desc("entry_score"), "qualified_name", "file_path").limit(schema.clamp(limit, schema.MAX_SEARCH_LIMIT))


def hot_paths(symbols: DataFrame, edges: DataFrame, limit: int = 20, include_tests: bool = False) -> DataFrame:
    """G14."""
    return symbol_scores(symbols, edges, include_tests).orderBy(F.desc("hot_score"), "qualified_name", "id").limit(schema.clamp(limit, schema.MAX_SEARCH_LIMIT))


def orphans(symbols: DataFrame, edges: DataFrame, include_tests: bool = False) -> DataFrame:
    """symbols that no edge leads to."""
    own = symbols if include_tests else symbols.where(~scalar.is_test_path(F.col("file_path")))
    return own.join(edges.where("target_type = 'symbol'").select(F.col("target_id").alias("id")), "id", "left_anti")

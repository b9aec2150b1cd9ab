"""Registered queries over the star schema's graph view, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import change, context, federated, metrics, rank, resolve, search, walk
from graphloom.plans import graph_view as g
from graphloom.tables import dealt, ignore_duplicate_edges, materialize, parts_of, upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Columns that hold sums of doubles are rounded on both sides.
DIGITS = 6


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def graph_sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {g.SQL.strip()}{', ' + more if more else ''}\n{body}"


def stored(spark: SparkSession, sf_dir: str, relationships: tuple[str, ...] | None = None) -> g.Graph:
    """The graph with its edges as a written table, for walks that read them once a level."""
    return g.Graph(g.symbols(spark, sf_dir), materialize(spark, g.edges(spark, sf_dir, relationships), "edges"))


def seeds_of(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "seed_id long, id long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), DIGITS) for n in names})


# -- traversal ---------------------------------------------------------------------------------------------------


def walk_sql(near: str, far: str, relationships: str, seeds: str, depth: int, known: bool = False) -> str:
    join = f"JOIN g_symbols k ON k.id = e.{far}_id" if known else ""
    return f"""w(seed_id, id, depth) AS (
  SELECT id, id, 0 FROM g_symbols WHERE {seeds}
  UNION SELECT w.seed_id, e.{far}_id, w.depth + 1 FROM w JOIN g_edges e ON e.{near}_id = w.id {join} WHERE e.relationship IN ({relationships}) AND w.depth < {depth}
), reached AS (SELECT seed_id, id, min(depth) AS depth FROM w GROUP BY seed_id, id)
, lined AS (
  SELECT r.seed_id, r.id, r.depth, coalesce(min(e.line_number), 0) AS line FROM reached r
  JOIN reached p ON p.seed_id = r.seed_id AND p.depth = r.depth - 1 JOIN g_edges e ON e.{near}_id = p.id AND e.{far}_id = r.id
  WHERE r.depth > 0 AND e.relationship IN ({relationships}) GROUP BY r.seed_id, r.id, r.depth)"""


REFERENCES = ["seed_id", "id", "name", "file_path", "line", "depth"]
REFERENCES_SQL = "SELECT l.seed_id, l.id, s.name, s.file_path, l.line, l.depth FROM lined l JOIN g_symbols s ON s.id = l.id"
PARTS = "id IN (1000000001, 1000000002, 1000000003)"


@query(graph_sql(REFERENCES_SQL, walk_sql("target", "source", "'CALLS'", "id = 1000000001", 2)))
def walk_callers_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 of one seed."""
    gr = stored(spark, sf_dir, ("CALLS",))
    return walk.references(spark, gr.edges, gr.symbols, seeds_of(spark, g.PART + 1), "callers", 2).select(REFERENCES)


@query(graph_sql(REFERENCES_SQL, walk_sql("source", "target", "'CALLS'", PARTS, 2)))
def walk_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 of three seeds in one job."""
    gr = stored(spark, sf_dir, ("CALLS",))
    return walk.references(spark, gr.edges, gr.symbols, seeds_of(spark, *(g.PART + i for i in (1, 2, 3))), "callees", 2).select(REFERENCES)


@query(graph_sql(REFERENCES_SQL, walk_sql("source", "target", "'EXTENDS', 'IMPLEMENTS'", "kind = 'method'", 2)))
def walk_supers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gr = stored(spark, sf_dir, ("EXTENDS", "IMPLEMENTS"))
    seeds = gr.symbols.where("kind = 'method'").select(F.col("id").alias("seed_id"), "id")
    return walk.references(spark, gr.edges, gr.symbols, seeds, "supers", 2).select(REFERENCES)


@query(graph_sql(REFERENCES_SQL, walk_sql("target", "source", "'IMPLEMENTS'", "kind = 'constant'", 2)))
def walk_implementors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gr = stored(spark, sf_dir, ("IMPLEMENTS",))
    seeds = gr.symbols.where("kind = 'constant'").select(F.col("id").alias("seed_id"), "id")
    return walk.references(spark, gr.edges, gr.symbols, seeds, "implementors", 3).select(REFERENCES)


BLAST = walk_sql("target", "source", "'CALLS'", "id IN (1000000001, 1000000002)", 2, known=True)


@query(graph_sql("SELECT l.seed_id, l.id, s.name, s.file_path, l.line, l.depth, CASE WHEN l.depth = 1 THEN 'direct' ELSE 'transitive' END AS scope FROM lined l JOIN g_symbols s ON s.id = l.id", BLAST))
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    gr = stored(spark, sf_dir, ("CALLS",))
    return walk.blast_radius(spark, gr.edges, gr.symbols, seeds_of(spark, g.PART + 1, g.PART + 2), 2)


@query(graph_sql("""SELECT seed_id, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive,
  count(DISTINCT file_path) AS files, CASE WHEN count(*) FILTER (depth > 0) >= 10 THEN 'high' WHEN count(*) FILTER (depth > 0) >= 3 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT r.seed_id, r.depth, s.file_path FROM reached r JOIN g_symbols s ON s.id = r.id) t GROUP BY seed_id""", BLAST))
def blast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, A10."""
    gr = stored(spark, sf_dir, ("CALLS",))
    seeds = seeds_of(spark, g.PART + 1, g.PART + 2)
    return walk.blast_summary(gr.symbols, seeds, walk.blast_radius(spark, gr.edges, gr.symbols, seeds, 2))


IMPACT = walk_sql("target", "source", "'CALLS'", "id IN (1000000001, 4000000003)", 1, known=True)


@query(graph_sql("""SELECT l.seed_id, l.id, s.name, s.file_path, 'call_dependency:depth=' || l.depth AS impact_reason FROM lined l JOIN g_symbols s ON s.id = l.id
UNION ALL SELECT e.target_id, s.id, s.name, s.file_path, 'type_dependency:' || e.relationship FROM g_edges e JOIN g_symbols s ON s.id = e.source_id
WHERE e.relationship IN ('EXTENDS', 'IMPLEMENTS') AND e.target_id IN (1000000001, 4000000003)""", IMPACT))
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    gr = stored(spark, sf_dir, ("CALLS", "EXTENDS", "IMPLEMENTS"))
    return walk.change_impact(spark, gr.edges, gr.symbols, seeds_of(spark, g.PART + 1, g.NATION + 3), 1)[0]


@query(graph_sql("""SELECT x.seed_id, coalesce(c.direct, 0) AS direct, coalesce(c.transitive, 0) AS transitive, coalesce(t.types, 0) AS types, x.files,
  CASE WHEN coalesce(c.n, 0) + coalesce(t.types, 0) >= 12 THEN 'high' WHEN coalesce(c.n, 0) + coalesce(t.types, 0) >= 4 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT seed_id, count(DISTINCT file_path) AS files FROM (
    SELECT r.seed_id, s.file_path FROM reached r JOIN g_symbols s ON s.id = r.id UNION ALL
    SELECT e.target_id, s.file_path FROM g_edges e JOIN g_symbols s ON s.id = e.source_id WHERE e.relationship IN ('EXTENDS', 'IMPLEMENTS') AND e.target_id IN (1000000001, 4000000003)) u GROUP BY seed_id) x
LEFT JOIN (SELECT seed_id, count(*) AS n, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive FROM reached WHERE depth > 0 GROUP BY seed_id) c ON c.seed_id = x.seed_id
LEFT JOIN (SELECT target_id, count(*) AS types FROM g_edges WHERE relationship IN ('EXTENDS', 'IMPLEMENTS') GROUP BY target_id) t ON t.target_id = x.seed_id""", IMPACT))
def change_impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gr = stored(spark, sf_dir, ("CALLS", "EXTENDS", "IMPLEMENTS"))
    return walk.change_impact(spark, gr.edges, gr.symbols, seeds_of(spark, g.PART + 1, g.NATION + 3), 1)[1]


FLOW = """f(id, role, depth) AS (
  SELECT CAST(1000000001 AS BIGINT), 'target', 0
  UNION SELECT CASE WHEN d.way = 'upstream' THEN e.source_id ELSE e.target_id END, d.way, f.depth + 1
  FROM f CROSS JOIN (VALUES ('upstream'), ('downstream')) d(way) JOIN g_calls e ON (d.way = 'upstream' AND e.target_id = f.id) OR (d.way = 'downstream' AND e.source_id = f.id) WHERE f.depth < 2
), states AS (SELECT id, role, min(depth) AS depth FROM f GROUP BY id, role)
, paths AS (
  SELECT e.source_id AS from_id, e.target_id AS to_id, e.line_number AS line, s.depth + 1 AS depth FROM states s JOIN g_calls e ON e.target_id = s.id WHERE s.depth < 2
  UNION ALL SELECT e.source_id, e.target_id, e.line_number, s.depth + 1 FROM states s JOIN g_calls e ON e.source_id = s.id WHERE s.depth < 2)"""


@query(graph_sql("SELECT CAST(1000000001 AS BIGINT) AS seed_id, from_id, to_id, line, depth FROM paths", FLOW))
def data_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    gr = stored(spark, sf_dir, ("CALLS",))
    return walk.data_flow(spark, gr.edges, gr.symbols, seeds_of(spark, g.PART + 1), "both", 2)


@query(graph_sql("""SELECT CAST(1000000001 AS BIGINT) AS seed_id, t.id, s.name, s.file_path, t.role FROM (
  SELECT id, role, row_number() OVER (PARTITION BY id ORDER BY depth, role DESC) AS n FROM (
    SELECT 1000000001 AS id, 'target' AS role, 0 AS depth UNION ALL SELECT from_id, 'upstream', depth FROM paths UNION ALL SELECT to_id, 'downstream', depth FROM paths) u) t
JOIN g_symbols s ON s.id = t.id WHERE t.n = 1""", FLOW))
def data_flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, O6."""
    gr = stored(spark, sf_dir, ("CALLS",))
    seeds = seeds_of(spark, g.PART + 1)
    return walk.flow_nodes(walk.data_flow(spark, gr.edges, gr.symbols, seeds, "both", 2), seeds, gr.symbols)


UNDIRECTED = "u AS (SELECT source_id AS a, target_id AS b FROM g_edges UNION ALL SELECT target_id, source_id FROM g_edges)"
EXPAND = f"""{UNDIRECTED}, x(id, depth) AS (
  SELECT CAST(4000000003 AS BIGINT), 0 UNION SELECT u.b, x.depth + 1 FROM x JOIN u ON u.a = x.id WHERE x.depth < 2
), e2 AS (SELECT id, min(depth) AS depth FROM x GROUP BY id)"""


@query(graph_sql("SELECT CAST(4000000003 AS BIGINT) AS seed_id, id, depth FROM e2", EXPAND))
def expand_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return walk.expand(spark, stored(spark, sf_dir).edges, seeds_of(spark, g.NATION + 3), 2)


@query(graph_sql("SELECT e.source_id, e.target_id, e.relationship FROM g_edges e JOIN g_symbols a ON a.id = e.source_id JOIN g_symbols b ON b.id = e.target_id WHERE a.pagerank_score > 0.095 AND b.pagerank_score > 0.095"))
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    gr = g.graph(spark, sf_dir)
    return metrics.induced(gr.edges, gr.symbols.where("pagerank_score > 0.095")).select("source_id", "target_id", "relationship")


# -- ranking -----------------------------------------------------------------------------------------------------


@query(graph_sql("""SELECT s.id, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM g_symbols s
LEFT JOIN (SELECT target_id, count(*) AS n FROM g_calls GROUP BY 1) i ON i.target_id = s.id LEFT JOIN (SELECT source_id, count(*) AS n FROM g_calls GROUP BY 1) o ON o.source_id = s.id"""))
def degree_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    gr = g.graph(spark, sf_dir, ("CALLS",))
    return rank.degrees(gr.symbols, gr.edges, ("CALLS",)).select("id", "inbound", "outbound")


@query(graph_sql("""SELECT s.id, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM g_symbols s
LEFT JOIN (SELECT target_id, count(*) AS n FROM g_edges GROUP BY 1) i ON i.target_id = s.id LEFT JOIN (SELECT source_id, count(*) AS n FROM g_edges GROUP BY 1) o ON o.source_id = s.id"""))
def degree_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    gr = g.graph(spark, sf_dir)
    return rank.degrees(gr.symbols, gr.edges).select("id", "inbound", "outbound")


def _pagerank_sql(rounds: int) -> str:
    steps = ["pn AS (SELECT count(*) AS n FROM g_symbols)", "pe AS (SELECT source_id, target_id, count(*) OVER (PARTITION BY source_id) AS o FROM g_edges WHERE relationship IN ('CALLS', 'EXTENDS', 'IMPLEMENTS'))", "p0 AS (SELECT id, 1.0 / n AS s FROM g_symbols, pn)"]
    for k in range(1, rounds + 1):
        p = f"p{k - 1}"
        steps.append(f"""p{k} AS (SELECT s.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(s), 0) FROM {p} WHERE id NOT IN (SELECT source_id FROM pe)) / n + 0.85 * coalesce(t.s, 0) AS s
  FROM g_symbols s CROSS JOIN pn LEFT JOIN (SELECT pe.target_id, sum({p}.s / pe.o) AS s FROM pe JOIN {p} ON {p}.id = pe.source_id GROUP BY 1) t ON t.target_id = s.id)""")
    return graph_sql(f"SELECT id, round(s, 9) AS score FROM p{rounds}", ", ".join(steps))


@query(_pagerank_sql(5))
def pagerank_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 with five rounds."""
    gr = g.graph(spark, sf_dir, ("CALLS", "EXTENDS", "IMPLEMENTS"))
    return rank.pagerank(spark, gr.symbols, gr.edges, rounds=5).select("id", F.round("score", 9).alias("score"))


def _ppr_sql(rounds: int) -> str:
    steps = [EXPAND, "pe AS (SELECT u.a, u.b, count(*) OVER (PARTITION BY u.a) AS o FROM u JOIN e2 x ON x.id = u.a JOIN e2 y ON y.id = u.b)", "p0 AS (SELECT id, CASE WHEN id = 4000000003 THEN 1.0 ELSE 0.0 END AS s FROM e2)"]
    for k in range(1, rounds + 1):
        steps.append(f"p{k} AS (SELECT x.id, CASE WHEN x.id = 4000000003 THEN 0.15 ELSE 0.0 END + 0.85 * coalesce(t.s, 0) AS s FROM e2 x LEFT JOIN (SELECT pe.b, sum(p{k - 1}.s / pe.o) AS s FROM pe JOIN p{k - 1} ON p{k - 1}.id = pe.a GROUP BY 1) t ON t.b = x.id)")
    return graph_sql(f"SELECT CAST(4000000003 AS BIGINT) AS seed_id, id, round(s, 9) AS score FROM p{rounds}", ", ".join(steps))


@query(_ppr_sql(20))
def ppr_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 on what one seed reaches."""
    edges, seeds = stored(spark, sf_dir).edges, seeds_of(spark, g.NATION + 3)
    return rank.personalized_pagerank(spark, edges, walk.expand(spark, edges, seeds, 2), seeds).select("seed_id", "id", F.round("score", 9).alias("score"))


@query(graph_sql("SELECT id, rank() OVER (ORDER BY pagerank_score DESC) AS rank_position FROM g_symbols"))
def rank_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return rank.rank_position(g.symbols(spark, sf_dir)).select("id", "rank_position")


# -- search ------------------------------------------------------------------------------------------------------


@query(graph_sql("SELECT id, name, qualified_name FROM g_symbols WHERE (lower(name) LIKE '%widget%' OR lower(qualified_name) LIKE '%widget%') AND kind = 'function' AND file_path ILIKE 'SRC/brand1%' ORDER BY pagerank_score DESC, name, id LIMIT 60"))
def search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F3, O2."""
    return search.like_candidates(g.symbols(spark, sf_dir), "Widget", "function", "SRC/brand1*", 60).select("id", "name", "qualified_name")


FTS = """toks AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', name, qualified_name, docstring, signature)), '[\\p{L}\\p{N}]+')) AS token FROM g_symbols)
, hits AS (SELECT id, count(DISTINCT token) AS n, count(*) AS tf FROM toks WHERE token IN ('red', 'economy') GROUP BY id HAVING count(DISTINCT token) = 2)"""


@query(graph_sql("SELECT id, tf FROM hits", FTS))
def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    return search.fts_candidates(g.symbols(spark, sf_dir), "red economy").select("id", "tf")


SCORED = """cand AS (SELECT s.*, 'fts' AS match_strategy FROM g_symbols s JOIN hits h ON h.id = s.id UNION ALL
  SELECT s.*, 'like' FROM g_symbols s WHERE (lower(name) LIKE '%red economy%' OR lower(qualified_name) LIKE '%red economy%') AND id NOT IN (SELECT id FROM hits))
, deg AS (SELECT c.id, (SELECT count(*) FROM g_calls e WHERE e.target_id = c.id) AS i, (SELECT count(*) FROM g_calls e WHERE e.source_id = c.id) AS o FROM cand c)
, lexed AS (SELECT c.*, i AS callers_count, o AS callees_count,
   len(list_intersect(['red', 'economy'], list_distinct(regexp_extract_all(lower(name || ' ' || qualified_name), '[a-z_][a-z0-9_]+')))) / 2.0 AS lex FROM cand c JOIN deg ON deg.id = c.id)
, scored AS (SELECT *, round(0.55 * lex + 0.35 * (pagerank_score + 0.1 * ln(1 + callers_count + callees_count)), 6) AS score FROM lexed)"""


@query(graph_sql("SELECT id, match_strategy, callers_count, callees_count, score FROM scored", FTS + ", " + SCORED))
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, A2, N1, N3, N5 over all candidates."""
    gr = g.graph(spark, sf_dir, ("CALLS",))
    found = search.scored(search.candidates(gr.symbols, "red economy"), gr.edges, "red economy")
    return rounded(found, "score").select("id", "match_strategy", "callers_count", "callees_count", "score")


@query(graph_sql("SELECT id, score FROM (SELECT * FROM scored ORDER BY score DESC, qualified_name, file_path, id LIMIT 15) t ORDER BY score DESC, qualified_name, file_path, id LIMIT 5 OFFSET 10",
    FTS + ", " + SCORED.replace("FROM g_symbols s JOIN hits h ON h.id = s.id UNION ALL", "FROM g_symbols s JOIN (SELECT h.id FROM hits h JOIN g_symbols s2 ON s2.id = h.id ORDER BY tf DESC, pagerank_score DESC, h.id LIMIT 45) h ON h.id = s.id UNION ALL")))
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13, O3, O4."""
    gr = g.graph(spark, sf_dir, ("CALLS",))
    return rounded(search.search_symbols(gr.symbols, gr.edges, "red economy", limit=5, offset=10), "score").select("id", "score")


BASE = """b AS (SELECT s.*, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM g_symbols s
  LEFT JOIN (SELECT target_id, count(*) AS n FROM g_edges GROUP BY 1) i ON i.target_id = s.id LEFT JOIN (SELECT source_id, count(*) AS n FROM g_edges GROUP BY 1) o ON o.source_id = s.id
  WHERE NOT (lower(file_path) LIKE '%/test%' OR lower(file_path) LIKE '%_test.py'))"""


@query(graph_sql("""SELECT id, inbound, outbound, round(CAST(0.6 AS DOUBLE) * pagerank_score + CAST(0.25 AS DOUBLE) * inbound + CAST(0.1 AS DOUBLE) * outbound + CASE WHEN regexp_matches(regexp_extract(lower(file_path), '[^/]*$'), '^(main|app|server|cli|index)') THEN 0.35 ELSE 0 END, 6) AS entry_score
FROM b ORDER BY 4 DESC, qualified_name, file_path LIMIT 50""", BASE))
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14, N11, F12."""
    gr = g.graph(spark, sf_dir)
    return search.entry_points(gr.symbols, gr.edges, 50).select("id", "inbound", "outbound", "entry_score")


@query(graph_sql("SELECT id, round(2.0 * inbound + outbound + 10.0 * pagerank_score, 6) AS hot_score FROM b ORDER BY 2 DESC, qualified_name, id LIMIT 50", BASE))
def hot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14, N12."""
    gr = g.graph(spark, sf_dir)
    return search.hot_paths(gr.symbols, gr.edges, 50).select("id", "hot_score")


@query(graph_sql("SELECT id, name FROM g_symbols s WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.target_id = s.id)"))
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    gr = g.graph(spark, sf_dir)
    return search.orphans(gr.symbols, gr.edges, include_tests=True).select("id", "name")


@query(graph_sql("""SELECT q.query, (SELECT id FROM g_symbols s WHERE s.qualified_name = q.query OR s.name = q.query ORDER BY (s.qualified_name = q.query) DESC, pagerank_score DESC, id LIMIT 1) AS id
FROM (VALUES ('red widget'), ('NATION_3'), ('part.blue bolt.2'), ('NATION_4')) q(query) WHERE EXISTS (SELECT 1 FROM g_symbols s WHERE s.qualified_name = q.query OR s.name = q.query)"""))
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, W1."""
    names = spark.createDataFrame([("red widget",), ("NATION_3",), ("part.blue bolt.2",), ("NATION_4",)], "query string")
    return walk.resolve(g.symbols(spark, sf_dir), names)


# -- context -----------------------------------------------------------------------------------------------------

LINES = """r AS (SELECT *, row_number() OVER (ORDER BY file_path, pagerank_score DESC, start_line, id) AS rk FROM g_symbols WHERE file_path ILIKE 'src/%')
, ln AS (SELECT 2 * min(rk) - 1 AS position, file_path AS line FROM r GROUP BY file_path
  UNION ALL SELECT 2 * rk, '  ' || CASE WHEN rk <= 10 THEN '[TOP] ' ELSE '' END || coalesce(nullif(signature, ''), kind || ' ' || name) || '  [rank:' || rk || ']' FROM r)
, tk AS (SELECT *, CASE WHEN strlen(line) = 0 THEN 0 ELSE greatest(1, CAST(floor(strlen(line) / 3.5) AS BIGINT)) END AS tokens FROM ln)"""


@query(graph_sql("SELECT position, line, tokens FROM tk", LINES))
def structure_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines."""
    return context.structure_lines(g.symbols(spark, sf_dir), "src").select("position", "line", "tokens")


@query(graph_sql("SELECT position, line, used FROM (SELECT *, sum(tokens) OVER (ORDER BY position) AS used FROM tk) t WHERE used <= 4000", LINES))
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix within the budget."""
    return context.structure(g.symbols(spark, sf_dir), "src").select("position", "line", "used")


@query("""WITH a AS (SELECT doc_id, text AS t0, len(regexp_extract_all(text, 'sk-[A-Za-z0-9]{20,}')) AS h0, regexp_replace(text, 'sk-[A-Za-z0-9]{20,}', '[REDACTED_OPENAI_KEY]', 'g') AS t1 FROM documents),
b AS (SELECT *, len(regexp_extract_all(t1, 'AKIA[0-9A-Z]{16}')) AS h1, regexp_replace(t1, 'AKIA[0-9A-Z]{16}', '[REDACTED_AWS_ACCESS_KEY]', 'g') AS t2 FROM a),
c AS (SELECT *, len(regexp_extract_all(t2, '(?i)(api[_-]?key|token|secret)\\s*[:=]\\s*[''"][^''"]+[''"]')) AS h2, regexp_replace(t2, '(?i)(api[_-]?key|token|secret)\\s*[:=]\\s*[''"][^''"]+[''"]', '\\1="[REDACTED]"', 'g') AS t3 FROM b),
d AS (SELECT *, len(regexp_extract_all(t3, '(?s)-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA )?PRIVATE KEY-----')) AS h3, regexp_replace(t3, '(?s)-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA )?PRIVATE KEY-----', '[REDACTED_PRIVATE_KEY]', 'g') AS t4 FROM c)
SELECT doc_id, CAST(h0 + h1 + h2 + h3 AS BIGINT) AS hits, sha256(t4) AS redacted FROM d""")
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N10 over whole documents."""
    text, hits = scalar.redact(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", hits.alias("hits"), F.sha2(text.cast("binary"), 256).alias("redacted"))


@query()
def context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential by definition, so tests hold it against a plain fold."""
    gr = stored(spark, sf_dir)
    return context.get_context(spark, gr.symbols, gr.edges, seeds_of(spark, g.NATION + 3), "nation customer", budget=600, depth=1).select("seed_id", "position", "id", "included_as", "tokens", "selection_reason")


@query("""SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(strlen(text) / 3.5) AS BIGINT)) END AS tokens,
  CAST(len(list_distinct([lower(x) for x in regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+')])) AS BIGINT) AS identifiers FROM documents""")
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2, N7."""
    return read(spark, sf_dir, "documents").select("doc_id", scalar.estimate_tokens(F.col("text")).alias("tokens"), F.size(scalar.tokens(F.col("text"))).cast("bigint").alias("identifiers"))


# -- metrics, change sets ----------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT event_type AS stage, CASE WHEN value > 50 THEN 'slow' ELSE 'fast' END AS category, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity FROM events)
SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM d UNION ALL SELECT 'stage', stage, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM d GROUP BY 2""")
def diag_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") > 50, "slow").otherwise("fast").alias("category"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"))
    return metrics.diagnostics_summary(rows)


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type AS tool, max(CASE WHEN i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) THEN value END) AS p50, max(CASE WHEN i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) THEN value END) AS p95 FROM s GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return metrics.index_percentiles(read(spark, sf_dir, "events").withColumnRenamed("event_type", "tool"), ["tool"], "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH t AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 200), s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM t)
SELECT count(*) AS total_calls, count(*) FILTER (event_type <> 'error') AS success_calls, count(*) FILTER (event_type = 'error') AS failure_calls, round_even(count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate,
 (SELECT value FROM s WHERE i = round_even((n - 1) * 0.5, 0)) AS p50_latency_ms, (SELECT value FROM s WHERE i = round_even((n - 1) * 0.95, 0)) AS p95_latency_ms FROM t""")
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"))
    return metrics.tool_summary(rows, [], 200).select("total_calls", "success_calls", "failure_calls", "success_rate", "p50_latency_ms", "p95_latency_ms")


@query("SELECT event_type AS tool, max(event_id) AS id, arg_max(user_id, event_id) AS user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("event_id").alias("id"), "user_id", "value")
    return metrics.latest_by(rows, "tool", "id")


@query("SELECT event_id AS id, event_type, value FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20 OFFSET 40")
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, O5."""
    return metrics.recent(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "value"), 20, 40, event_type="error")


GATES = [("click", 0.0, 30.0), ("error", 40.0, 1000.0), ("missing", 0.0, 1.0)]


@query("""WITH v AS (SELECT event_type AS suite, 'mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1), gt(suite, lowest, highest) AS (VALUES ('click', 0.0, 30.0), ('error', 40.0, 1000.0), ('missing', 0.0, 1.0))
SELECT gt.suite, 'mean' AS metric, CAST(lowest AS DOUBLE) AS lowest, CAST(highest AS DOUBLE) AS highest, v.value FROM gt LEFT JOIN v ON v.suite = gt.suite WHERE v.value IS NULL OR v.value < lowest OR v.value > highest""")
def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    values = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("suite")).agg(F.round(F.avg("value"), DIGITS).alias("value")).withColumn("metric", F.lit("mean"))
    gates = spark.createDataFrame([(s, "mean", a, b) for s, a, b in GATES], "suite string, metric string, lowest double, highest double")
    return metrics.violations(values, gates).select("suite", "metric", "lowest", "highest", "value")


@query("SELECT o_orderpriority AS root, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open, count(*) AS files FROM orders GROUP BY ROLLUP(o_orderpriority)")
def workspace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("root"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("open"), F.lit(1).alias("files"))
    return metrics.totals(rows, "root", ["open", "files"])


@query(graph_sql("SELECT file_path, kind, count(*) AS n FROM g_symbols GROUP BY 1, 2"))
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return metrics.counts_by(g.symbols(spark, sf_dir), ["file_path", "kind"])


@query(graph_sql("SELECT file_path, name, place FROM (SELECT file_path, name, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS place FROM g_symbols) t WHERE place <= 8"))
def first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return metrics.first_names(g.symbols(spark, sf_dir))


@query(graph_sql("SELECT round(avg(CASE WHEN confidence < 1 THEN 1.0 ELSE 0.0 END), 6) AS ambiguity_rate FROM g_edges"))
def ambiguity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return rounded(metrics.ambiguity_rate(g.edges(spark, sf_dir)), "ambiguity_rate")


@query(graph_sql("""SELECT id, way, other, name, place FROM (SELECT w.id, w.way, w.other, s.name, row_number() OVER (PARTITION BY w.id, w.way ORDER BY s.pagerank_score DESC, w.other) AS place
FROM (SELECT DISTINCT target_id AS id, 'inbound' AS way, source_id AS other FROM g_edges UNION SELECT DISTINCT source_id, 'outbound', target_id FROM g_edges) w JOIN g_symbols s ON s.id = w.other) t WHERE place <= 3"""))
def explain_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15, J6."""
    gr = g.graph(spark, sf_dir)
    return metrics.explain_symbol(gr.symbols, gr.edges, 3).select("id", "way", "other", "name", "place")


@query(graph_sql("""SELECT e.source_id, e.target_id, e.relationship FROM g_edges e WHERE e.source_id IN (SELECT id FROM n) AND e.target_id IN (SELECT id FROM n)
ORDER BY 1, 2, 3 LIMIT 500""", "n AS (SELECT id FROM g_symbols WHERE kind IN ('class', 'interface', 'constant') ORDER BY pagerank_score DESC, id LIMIT 300)"))
def inspector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the types' part of the graph, whose best nodes have edges among them."""
    gr = g.graph(spark, sf_dir)
    types = gr.symbols.where("kind IN ('class', 'interface', 'constant')")
    return metrics.inspector(types, gr.edges)[1].select("source_id", "target_id", "relationship")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("hash"))
    changed = F.when(F.col("o_orderkey") % 11 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash"))
    return orders.where("o_orderkey % 10 <> 0").select("path", "hash"), orders.where("o_orderkey % 7 <> 0").select("path", changed.alias("hash"))


@query("""WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderstatus AS h FROM orders WHERE o_orderkey % 10 <> 0), c AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderstatus || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END AS h FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'A' WHEN c.path IS NULL THEN 'D' ELSE 'M' END AS status FROM p FULL JOIN c ON p.path = c.path WHERE p.path IS NULL OR c.path IS NULL OR p.h <> c.h""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20, U6."""
    return change.snapshot_diff(*_snapshots(spark, sf_dir))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 7 <> 0")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1."""
    return upsert(*_snapshots(spark, sf_dir), ["path"])


@query("""SELECT source_id, target_id, file_path, line_number FROM (SELECT l_partkey AS source_id, l_suppkey AS target_id, 'o' || l_orderkey AS file_path, l_linenumber AS line_number,
 row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY 'o' || l_orderkey, l_linenumber) AS n FROM lineitem) t WHERE n = 1""")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, U3."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.lit("symbol").alias("source_type"), F.lit("symbol").alias("target_type"), F.lit("CALLS").alias("relationship"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file_path"), F.col("l_linenumber").alias("line_number"), F.lit(1.0).alias("confidence"))
    return ignore_duplicate_edges(rows).select("source_id", "target_id", "file_path", "line_number")


def _artifacts(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("qualified_name"), F.col("p_brand").alias("file_path"), "p_partkey", "p_size")
    none = spark.createDataFrame([], "source struct<qualified_name:string,file_path:string>, target struct<qualified_name:string,file_path:string>, relationship string")
    artifact = parts.where("p_partkey % 3 <> 0").select("qualified_name", "file_path", F.lit("artifact").alias("origin"))
    local = parts.where("p_partkey % 5 = 0").select("qualified_name", "file_path", F.lit("local").alias("origin"))
    touched = spark.createDataFrame([("Brand#1",), ("Brand#2",)], "path string")
    return {"symbols": artifact, "edges": none}, {"symbols": local, "edges": none}, touched


@query("""SELECT 'p' || p_partkey AS qualified_name, p_brand AS file_path, CASE WHEN p_partkey % 5 = 0 THEN 'local' ELSE 'artifact' END AS origin FROM part
WHERE p_partkey % 5 = 0 OR (p_partkey % 3 <> 0 AND p_brand NOT IN ('Brand#1', 'Brand#2'))""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y3, U9, J21."""
    return change.reconcile(*_artifacts(spark, sf_dir))["symbols"].select("qualified_name", "file_path", "origin")


# -- resolution --------------------------------------------------------------------------------------------------


def _call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lit(".py")).alias("file_path"))
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("line"))
    n = parts_of(lines)
    return dealt(lines, n, "l_partkey").join(dealt(part, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("call_id"), "file_path", "line")


@query(graph_sql("""SELECT call_id, file_path, line, caller_id FROM (SELECT c.call_id, c.file_path, c.line, s.id AS caller_id, row_number() OVER (PARTITION BY c.call_id, c.file_path, c.line ORDER BY s.end_line - s.start_line, s.start_line, s.id) AS n
FROM (SELECT DISTINCT l_partkey AS call_id, 'src/' || lower(replace(p_brand, '#', '')) || '.py' AS file_path, CAST(trunc(l_quantity) AS INT) AS line FROM lineitem JOIN part ON p_partkey = l_partkey) c
JOIN g_symbols s ON s.file_path = c.file_path AND c.line BETWEEN s.start_line AND s.end_line) t WHERE n = 1"""))
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join within a file."""
    return resolve.enclosing(_call_sites(spark, sf_dir), g.symbols(spark, sf_dir), ["call_id"])


@query("""SELECT DISTINCT a.l_partkey * 100 + a.l_linenumber AS call_id, CAST(b.l_suppkey AS VARCHAR) AS hint FROM lineitem a JOIN lineitem b ON a.l_returnflag = b.l_returnflag AND a.l_partkey = b.l_partkey
WHERE CAST(trunc(b.l_quantity) AS INT) < CAST(trunc(a.l_quantity) AS INT) AND CAST(trunc(b.l_quantity) AS INT) >= CAST(trunc(a.l_quantity) AS INT) - 10""")
def look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band join."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("call_id"), F.col("l_returnflag").alias("file_path"), F.col("l_partkey").cast("string").alias("receiver"), F.col("l_quantity").cast("int").alias("line"), F.col("l_suppkey").cast("string").alias("type_name"))
    return resolve.look_back(rows, rows, 10)


#: Methods and functions of customers, and a call for each order, so that all eight strategies occur.
CALLS = """s AS (SELECT c_custkey AS id, 'm' || (c_custkey % 500) AS name, 'pkg.n' || c_nationkey || '.c' || (c_custkey % 7) || '.m' || (c_custkey % 500) AS qname, 'c' || (c_custkey % 7) AS owner,
  CASE WHEN c_custkey % 5 = 0 THEN 'function' ELSE 'method' END AS kind, 'src/n' || c_nationkey || '.py' AS file_path FROM customer)
, c AS (SELECT o_orderkey AS call_id, o_custkey AS caller_id, 'm' || (o_orderkey % 500) AS callee, 'src/n' || (o_orderkey % 25) || '.py' AS file_path, o_orderkey % 11 = 0 AS typed,
  CASE o_orderkey % 8 WHEN 1 THEN 'self' WHEN 2 THEN 'c' || (o_orderkey % 7) WHEN 3 THEN 'n' || (o_orderkey % 25) WHEN 4 THEN 'al' WHEN 5 THEN 'zz' WHEN 6 THEN 'this' ELSE '' END AS receiver FROM orders)
, u AS (SELECT c.call_id, t.id AS target_id, CASE
    WHEN k.kind = 'method' AND t.kind = 'method' AND starts_with(t.qname, regexp_replace(k.qname, '\\.[^.]*$', '') || '.') AND c.receiver IN ('', 'self', 'this') THEN 0
    WHEN t.kind = 'method' AND c.typed AND t.owner = 'c2' THEN 1
    WHEN t.kind = 'method' AND c.receiver = 'al' AND t.owner = 'c5' THEN 2
    WHEN t.kind = 'method' AND c.receiver NOT IN ('', 'self', 'this') AND t.owner = c.receiver THEN 3
    WHEN t.kind = 'method' AND c.receiver NOT IN ('', 'self', 'this') AND contains(t.qname, '.' || c.receiver || '.') THEN 4
    WHEN t.file_path = c.file_path THEN 5
    WHEN contains(t.qname, 'n7') OR t.file_path LIKE '%/n7.py' THEN 6 ELSE 7 END AS rnk
  FROM c JOIN s k ON k.id = c.caller_id JOIN s t ON t.name = c.callee)"""
WAYS = {"class_scoped": 0.78, "typed": 0.84, "alias_typed": 0.83, "owner": 0.79, "receiver_scoped": 0.75, "same_file": 0.80, "import_scoped": 0.70, "any": 0.50}


@query(f"""WITH {CALLS} SELECT call_id, target_id, [{', '.join(f"'{w}'" for w in WAYS)}][rnk + 1] AS strategy, CASE WHEN n = 1 THEN 1.0 ELSE [{', '.join(map(str, WAYS.values()))}][rnk + 1] END AS confidence
FROM (SELECT *, min(rnk) OVER (PARTITION BY call_id) AS m, count(*) OVER (PARTITION BY call_id, rnk) AS n FROM u) v WHERE rnk = m""")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies, over all calls."""
    c = F.col
    text = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    customers = read(spark, sf_dir, "customer")
    name, owner = text("m", c("c_custkey") % 500), text("c", c("c_custkey") % 7)
    symbols = customers.select(c("c_custkey").alias("id"), name.alias("name"), F.concat_ws(".", F.lit("pkg"), text("n", c("c_nationkey")), owner, name).alias("qualified_name"), F.when(c("c_custkey") % 5 == 0, "function").otherwise("method").alias("kind"), F.concat(text("src/n", c("c_nationkey")), F.lit(".py")).alias("file_path"))
    key = c("o_orderkey")
    receiver = F.when(key % 8 == 0, F.lit(None).cast("string"))
    for i, value in enumerate((F.lit("self"), text("c", key % 7), text("n", key % 25), F.lit("al"), F.lit("zz"), F.lit("This"), F.lit("")), 1):
        receiver = receiver.when(key % 8 == i, value)
    calls = read(spark, sf_dir, "orders").select(key.alias("call_id"), c("o_custkey").alias("caller_id"), text("m", key % 500).alias("callee"), receiver.alias("receiver"), F.concat(text("src/n", key % 25), F.lit(".py")).alias("file_path"))
    places = calls.select("file_path").distinct()
    aliases = places.select("file_path", F.lit("al").alias("alias"), F.lit("c5").alias("original"))
    hints = places.select("file_path", F.lit("n7").alias("hint"))
    return resolve.resolve_calls(calls, symbols, aliases, calls.where("call_id % 11 = 0").select("call_id", F.lit("c2").alias("hint")), hints)


@query("""WITH i AS (SELECT p_partkey AS k, p_partkey % 5 AS way, p_partkey % 40 AS m FROM part)
SELECT k AS import_id, CASE way WHEN 0 THEN 'pkg/m' || m || CASE WHEN m % 2 = 0 THEN '.py' ELSE '/__init__.py' END WHEN 1 THEN 'com/p' || m || '.java' WHEN 2 THEN 'com/p' || m || '/A.java'
  WHEN 3 THEN 'web/t' || m || CASE WHEN m % 2 = 0 THEN '.ts' ELSE '/index.js' END ELSE 'g' || m || '/a.go' END AS target_path FROM i WHERE m < 20""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and prefix candidates of four languages; of forty modules twenty are there."""
    way, m = F.col("p_partkey") % 5, (F.col("p_partkey") % 40).cast("string")
    pick = lambda *items: F.element_at(F.array(*items), (way + 1).cast("int"))
    language = pick(*[F.lit(x) for x in ("python", "java", "java", "typescript", "go")])
    path = pick(*[F.lit(x) for x in ("src/a.py", "X.java", "X.java", "web/sub/x.ts", "main.go")])
    module = pick(F.concat(F.lit("pkg.m"), m), F.concat(F.lit("com.p"), m), F.concat(F.lit("com.p"), m, F.lit(".*")), F.concat(F.lit("../t"), m), F.concat(F.lit("example.com/mod/g"), m))
    imports = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("import_id"), path.alias("file_path"), language.alias("language"), module.alias("module_name"))
    n, even = F.col("id").cast("string"), F.col("id") % 2 == 0
    paths = [F.concat(F.lit("pkg/m"), n, F.when(even, ".py").otherwise("/__init__.py")), F.concat(F.lit("com/p"), n, F.lit(".java")), F.concat(F.lit("com/p"), n, F.lit("/B.java")), F.concat(F.lit("com/p"), n, F.lit("/A.java")), F.concat(F.lit("web/t"), n, F.when(even, ".ts").otherwise("/index.js")), F.concat(F.lit("g"), n, F.lit("/z.go")), F.concat(F.lit("g"), n, F.lit("/a.go"))]
    files = spark.range(20).select(F.explode(F.array(*paths)).alias("path"))
    return resolve.resolve_imports(imports, files, "example.com/mod")[0].select("import_id", "target_path")


# -- federation --------------------------------------------------------------------------------------------------


def _shards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations are repositories: a part belongs to the one of its key."""
    repo = lambda c: F.concat(F.lit("repo"), (c % 25).cast("string"))
    symbols = g.symbols(spark, sf_dir).where("kind = 'function'").withColumn("repo_id", repo(F.col("id")))
    edges = g.edges(spark, sf_dir, ("CALLS",)).withColumn("repo_id", repo(F.col("target_id")))
    return symbols, edges.where(repo(F.col("source_id")) == F.col("repo_id"))


SHARDS = """fs AS (SELECT *, 'repo' || (id % 25) AS repo_id FROM g_symbols WHERE kind = 'function')
, fe AS (SELECT source_id, target_id, 'repo' || (target_id % 25) AS repo_id FROM g_calls WHERE source_id % 25 = target_id % 25)"""


@query(graph_sql("SELECT repo_id, id FROM (SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY pagerank_score DESC, qualified_name, file_path) AS n FROM fs) t WHERE n <= 50000", SHARDS))
def exported_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K18."""
    return federated.exported_symbols(_shards(spark, sf_dir)[0]).select("repo_id", "id")


@query(graph_sql("""SELECT repo_id, id, round(0.55 * lex + 0.35 * (pagerank_score + 0.1 * ln(1 + i + o)), 6) AS score FROM (
  SELECT fs.*, CASE WHEN lower(name) = 'red widget' THEN 1.0 WHEN contains(lower(name), 'red widget') THEN 0.9 ELSE 0.8 END AS lex,
    (SELECT count(*) FROM fe WHERE fe.target_id = fs.id) AS i, (SELECT count(*) FROM fe WHERE fe.source_id = fs.id) AS o
  FROM fs WHERE lower(name) LIKE '%red widget%' OR lower(qualified_name) LIKE '%red widget%') t ORDER BY 0.55 * lex + 0.35 * (pagerank_score + 0.1 * ln(1 + i + o)) DESC, qualified_name, repo_id LIMIT 30""", SHARDS))
def federated_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4, U2."""
    symbols, edges = _shards(spark, sf_dir)
    return rounded(federated.federated_search(symbols, edges, "red widget", limit=30), "score").select("repo_id", "id", "score")


@query(graph_sql("SELECT coalesce(s.repo_id, e.repo_id) AS repo_id, coalesce(s.n, 0) AS symbols, coalesce(e.n, 0) AS edges FROM (SELECT repo_id, count(*) AS n FROM fs GROUP BY 1) s FULL JOIN (SELECT repo_id, count(*) AS n FROM fe GROUP BY 1) e ON e.repo_id = s.repo_id", SHARDS))
def shard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6, A20."""
    return federated.shard_report(*_shards(spark, sf_dir))


CROSS = SHARDS + """, ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY pagerank_score DESC, qualified_name, file_path) AS en FROM fs) t WHERE en <= 50000)
, dp AS (SELECT DISTINCT 'repo' || (s_suppkey % 25) AS repo_id, 'f' || s_suppkey AS file_path, 'part.' || p_name AS module_name FROM supplier JOIN part ON p_partkey = s_suppkey)
, cr AS (SELECT d.repo_id AS source_repo_id, d.module_name AS source_qualified_name, d.file_path AS source_file_path, ex.repo_id AS target_repo_id, ex.qualified_name AS target_qualified_name, ex.file_path AS target_file_path,
    row_number() OVER (PARTITION BY d.repo_id, d.file_path, d.module_name ORDER BY ex.pagerank_score DESC, ex.qualified_name, ex.repo_id, ex.file_path) AS n
  FROM dp d JOIN ex ON ex.qualified_name LIKE d.module_name || '.%')"""


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = federated.exported_symbols(_shards(spark, sf_dir)[0])
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    deps = read(spark, sf_dir, "supplier").select("s_suppkey").join(part, "s_suppkey").select(F.concat(F.lit("repo"), (F.col("s_suppkey") % 25).cast("string")).alias("repo_id"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file_path"), F.concat(F.lit("part."), F.col("p_name")).alias("module_name"), F.lit("python").alias("language")).distinct()
    return federated.resolve_external(deps, exported)


@query(graph_sql("SELECT DISTINCT source_repo_id, source_qualified_name, source_file_path, target_repo_id, target_qualified_name, target_file_path, 'IMPORTS' AS relationship, 1.0 AS confidence FROM cr WHERE n <= 20 AND source_repo_id <> target_repo_id", CROSS))
def cross_repo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, R7."""
    return _cross(spark, sf_dir)


@query(graph_sql("""SELECT repo_id, min(way) AS way FROM (SELECT 'repo3' AS repo_id, 0 AS way UNION ALL SELECT * FROM al
  UNION ALL SELECT target_repo_id, 2 FROM ce WHERE source_qualified_name = 'part.red widget' AND source_repo_id IN (SELECT repo_id FROM kn)
  UNION ALL SELECT source_repo_id, 2 FROM ce WHERE target_qualified_name = 'part.red widget' AND target_repo_id IN (SELECT repo_id FROM kn)) t GROUP BY 1 ORDER BY 2, 1 LIMIT 16""",
    CROSS + ", ce AS (SELECT * FROM cr WHERE n <= 20 AND source_repo_id <> target_repo_id), al AS (SELECT 'repo' || k AS repo_id, 1 AS way FROM range(5) r(k)), kn AS (SELECT 'repo3' AS repo_id UNION SELECT repo_id FROM al)"))
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No repository exports the module's name, so all five that are enabled are asked, and those that import it."""
    exported = federated.exported_symbols(_shards(spark, sf_dir)[0])
    shards = spark.range(25).select(F.concat(F.lit("repo"), F.col("id").cast("string")).alias("repo_id"), (F.col("id") < 5).alias("enabled"))
    return federated.route(exported, _cross(spark, sf_dir), shards, "part.red widget", "repo3").select("repo_id", "way")


# -- scalar functions --------------------------------------------------------------------------------------------


@query(graph_sql("""SELECT id, sha256(coalesce(signature, '')) AS signature_hash, regexp_replace(replace(file_path, '/', '.'), '\\.py$', '') AS module, substr(sha256(file_path), 1, 16) AS repo,
 'graph://r/' || qualified_name || '#' || file_path AS uri, CASE WHEN len(string_split(qualified_name, '.')) >= 2 THEN string_split(qualified_name, '.')[-2] ELSE '' END AS owner, 'python' AS language FROM g_symbols"""))
def scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N13, N18, N21, N23, S3."""
    c = F.col
    return g.symbols(spark, sf_dir).select("id", scalar.signature_hash(c("signature")).alias("signature_hash"), scalar.module_name(c("file_path")).alias("module"), scalar.repo_id(c("file_path")).alias("repo"), scalar.symbol_uri(F.lit("r"), c("qualified_name"), c("file_path")).alias("uri"), scalar.method_owner(c("qualified_name")).alias("owner"), scalar.language_of(c("file_path")).alias("language"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts by a stream that runs until its input is used up."""
    from graphloom.streaming.watch import windowed_counts

    return rounded(windowed_counts(spark, f"{sf_dir}/events.parquet"), "total")

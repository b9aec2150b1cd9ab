import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import context, metrics, rank, search, walk
from graphloom.tables import Snapshots, delete_files, ignore_duplicate_edges, migrate, rename_files, replace_files, upsert

SYMBOLS = "id long, name string, qualified_name string, kind string, file_path string, start_line int, end_line int, signature string, docstring string, pagerank_score double"


def symbols(spark, *rows):
    """(id, name[, score[, path[, kind[, signature[, docstring]]]]])"""
    full = []
    for r in rows:
        i, name, score, path, kind, signature, doc = (*r, *(None, 0.1, "src/a.py", "function", None, None)[len(r) - 1 :])
        full.append((i, name, f"m.{name}", kind, path, 10 * i, 10 * i + 5, signature or f"def {name}()", doc, score))
    return spark.createDataFrame(full, SYMBOLS)


def edges(spark, *rows):
    """(source, target[, relationship[, line]])"""
    full = [(a, b, "symbol", "symbol", (r or ["CALLS"])[0], "src/a.py", (r[1] if len(r) > 1 else 1), 1.0) for a, b, *r in rows]
    return spark.createDataFrame(full, schema.EDGES)


def seeds(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "seed_id long, id long")


def found(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_references(spark):
    s, e = symbols(spark, (1, "a"), (2, "b"), (3, "c")), edges(spark, (1, 2, "CALLS", 10), (2, 3, "CALLS", 20))
    assert found(walk.references(spark, e, s, seeds(spark, 2)), "direction", "name", "line", "depth") == [("callees", "c", 20, 1), ("callers", "a", 10, 1)]
    assert found(walk.references(spark, e, s, seeds(spark, 3), "callers", 99), "name", "depth") == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        walk.references(spark, e, s, seeds(spark, 2), "sideways")


def test_types(spark):
    s, e = symbols(spark, (1, "Impl"), (2, "Base"), (3, "Top")), edges(spark, (1, 2, "IMPLEMENTS"), (2, 3, "EXTENDS"))
    assert found(walk.references(spark, e, s, seeds(spark, 2), "implementors"), "name") == [("Impl",)]
    assert found(walk.references(spark, e, s, seeds(spark, 1), "supers", 2), "name", "depth") == [("Base", 1), ("Top", 2)]
    assert found(walk.references(spark, e, s, seeds(spark, 3), "implementors"), "name") == []


def test_dangling_edges(spark):
    s, e = symbols(spark, (1, "a"), (3, "c")), edges(spark, (1, 9), (9, 3))
    assert found(walk.references(spark, e, s, seeds(spark, 3), "callers", 2), "name", "depth") == [("a", 2)]
    assert found(walk.blast_radius(spark, e, s, seeds(spark, 3)), "name") == []


def test_blast_and_impact(spark):
    s = symbols(spark, (1, "target"), (2, "direct"), (3, "transitive", 0.1, "src/b.py"), (4, "Impl", 0.1, "src/c.py"))
    e = edges(spark, (2, 1, "CALLS", 10), (3, 2, "CALLS", 20), (4, 1, "IMPLEMENTS", 1))
    reached = walk.blast_radius(spark, e, s, seeds(spark, 1))
    assert found(reached, "name", "scope", "line") == [("direct", "direct", 10), ("transitive", "transitive", 20)]
    assert walk.blast_summary(s, seeds(spark, 1), reached).first().asDict() == {"seed_id": 1, "direct": 1, "transitive": 1, "files": 2, "risk": "low"}
    rows, summary = walk.change_impact(spark, e, s, seeds(spark, 1))
    assert found(rows, "name", "impact_reason") == [("Impl", "type_dependency:IMPLEMENTS"), ("direct", "call_dependency:depth=1"), ("transitive", "call_dependency:depth=2")]
    assert summary.first()["types"] == 1 and summary.first()["files"] == 3


def test_data_flow(spark):
    s, e = symbols(spark, (1, "a"), (2, "b"), (3, "c")), edges(spark, (1, 2, "CALLS", 10), (2, 3, "CALLS", 20))
    paths = walk.data_flow(spark, e, s, seeds(spark, 2), "both", 2)
    # each neighbour's state reports its own edges again
    assert found(paths, "from_id", "to_id", "depth") == [(1, 2, 1), (1, 2, 2), (2, 3, 1), (2, 3, 2)]
    assert found(walk.flow_nodes(paths, seeds(spark, 2), s), "name", "role") == [("a", "upstream"), ("b", "target"), ("c", "downstream")]


def test_levels_are_shortest_paths(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(150)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    want = set()
    for seed in (0, 1, 2):
        depth, queue = {seed: 0}, deque([seed])
        while queue:
            at = queue.popleft()
            for b in near.get(at, ()):
                if b not in depth:
                    depth[b] = depth[at] + 1
                    queue.append(b)
        want |= {(seed, i, d) for i, d in depth.items() if 0 < d <= 6}
    steps = spark.createDataFrame(sorted(pairs), "at long, next long")
    assert set(found(walk.levels(spark, steps, seeds(spark, 0, 1, 2), 6), "seed_id", "id", "depth")) == want
    capped = walk.levels(spark, steps, seeds(spark, 0), 6, cap=10, with_seeds=True)
    assert capped.count() == 10


def test_pagerank_keeps_its_mass(spark):
    s, e = symbols(spark, (1, "a"), (2, "b"), (3, "c"), (4, "d")), edges(spark, (1, 2), (3, 2), (2, 9), (1, 2, "EXTENDS"))
    scores = dict(found(rank.pagerank(spark, s, e), "id", "score"))
    assert max(scores, key=scores.get) == 2 and abs(sum(scores.values()) - 1) < 1e-9
    assert rank.pagerank(spark, s.limit(0), e).count() == 0
    ppr = rank.personalized_pagerank(spark, e, seeds(spark, 1, 2, 3).select(F.lit(0).alias("seed_id"), "id"), seeds(spark, 1).select(F.lit(0).alias("seed_id"), "id"))
    assert 0.9 < sum(r["score"] for r in ppr.collect()) <= 1.0 + 1e-9


def test_rank_position(spark):
    s = symbols(spark, (1, "a", 0.9), (2, "b", 0.5), (3, "c", 0.5), (4, "d", 0.1))
    assert found(rank.rank_position(s), "id", "rank_position") == [(1, 1), (2, 2), (3, 2), (4, 4)]


def test_search(spark):
    s = symbols(spark, (1, "authenticate", 0.9), (2, "AuthService", 0.5, "src/a.py", "class"), (3, "login", 0.1), (4, "verify_password", 0.2, "src/a.py", "function", None, "Validate bcrypt hash"))
    e = edges(spark, (3, 1))
    rows = search.search_symbols(s, e, "auth", "function", "src/*").collect()
    assert [(r["name"], r["callers_count"], r["match_strategy"]) for r in rows] == [("authenticate", 1, "like")]
    rows = search.search_symbols(s, e, "bcrypt").collect()
    assert [(r["name"], r["match_strategy"]) for r in rows] == [("verify_password", "fts")]
    assert found(search.fts_candidates(s, "password verify"), "name") == [("verify_password",)]
    assert search.fts_candidates(s, "a.b").count() == search.fts_candidates(s, "verify AND hash").count() == 0
    assert found(search.like_candidates(s, "a_th"), "name") == [("AuthService",), ("authenticate",)]
    assert found(search.pick_seeds(s, "nothing", ["login", "AuthService"]), "id") == [(2,), (3,)]
    assert found(search.pick_seeds(s, "log.in auth"), "id") == [(1,), (2,)]
    assert found(search.orphans(s, e), "name") == [("AuthService",), ("login",), ("verify_password",)]
    page = search.search_symbols(s, e, "s", limit=1, offset=1)
    assert page.count() == 1


def fold(s, near, start, budget):
    """A plain context bundle of signatures."""
    out, used = [], 0
    for i, _ in context.topology_order(s, start, near):
        if used + 4 <= budget:
            out.append(i)
            used += 4
    return out


def test_context(spark):
    s = symbols(spark, (1, "alpha", 0.4), (2, "beta", 0.1), (3, "gamma", 9.9))
    e = edges(spark, (1, 2), (2, 3))
    rows = context.get_context(spark, s, e, spark.createDataFrame([(0, 1)], "seed_id long, id long"), "alpha", budget=7, signatures_only=True)
    assert found(rows, "name", "position") == [("alpha", 0), ("beta", 1)]
    quality = context.quality(rows, spark.createDataFrame([(0, 1)], "seed_id long, id long"), 7).first()
    assert quality["connectedness"] == 1.0 and quality["seed_hit_rate"] == 1.0 and quality["included_count"] == 2
    assert context.topology_order({1: 0.1, 2: 0.5, 3: 0.5, 4: 0.9}, {1}, {1: {2, 3}, 2: {1}, 3: {1}}) == [(1, "seed"), (2, "graph_neighbor"), (3, "graph_neighbor"), (4, "rank_fallback")]


def test_context_redacts_sources_and_falls_back(spark):
    s = symbols(spark, (1, "leak", 0.4, "src/a.py", "function", "def leak(token='abc')"))
    files = spark.createDataFrame([("src/a.py", "\n" * 9 + "token = 'sk-" + "a" * 24 + "'\n" + "x = 1\n" * 30)], "path string, text string")
    seed = spark.createDataFrame([(0, 1)], "seed_id long, id long")
    whole = context.get_context(spark, s, edges(spark), seed, "leak", files, 8_000).first()
    assert "sk-" not in whole["source"] and "REDACTED" in whole["source"] and whole["redaction_hits"] >= 1 and whole["included_as"] == "full_source"
    short = context.get_context(spark, s, edges(spark), seed, "leak", files, 9).first()
    assert short["included_as"] == "signature_only" and "abc" not in short["source"]


def test_structure(spark):
    s = symbols(spark, (1, "authenticate", 0.9, "src/auth.py"), (2, "authorize", 0.5, "src/auth.py"), (3, "other", 0.5, "lib/x.py"))
    text = context.structure_text(context.structure(s, "src"))
    assert text.split("\n") == ["src/auth.py", "  [TOP] def authenticate()  [rank:1]", "  [TOP] def authorize()  [rank:2]"]
    assert context.structure_text(context.structure(s, "src", 4)) == "src/auth.py"


def test_guards():
    assert schema.clamp(999, schema.MAX_DEPTH) == 6 and schema.clamp(-3, 5) == 1
    assert schema.node_cap(10) == 128 and schema.node_cap(50_000) == 2_000 and schema.edge_cap(10) == 256
    assert len(schema.truncate_query("é" * 400).encode()) == 512 and schema.truncate_query("a" + "é" * 400)[-1] == "é"


def test_inspector_counts_only_symbol_edges(spark):
    s = symbols(spark, (1, "a", 0.9), (2, "b", 0.5), (3, "c", 0.1))
    e = edges(spark, (1, 2), (2, 3)).unionByName(edges(spark, (1, 3)).withColumn("target_type", F.lit("file")))
    assert found(metrics.inspector(s, e, 2)[1], "source_id", "target_id") == [(1, 2)]
    assert found(metrics.explain_symbol(s, e), "id", "way", "other") == [(1, "outbound", 2), (2, "inbound", 1), (2, "outbound", 3), (3, "inbound", 2)]


def test_tables(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "path string, v int"), spark.createDataFrame([("b", 20), (None, 30)], "path string, v int")
    assert sorted(upsert(old, new, ["path"]).collect(), key=str) == sorted([("a", 1), ("b", 20), (None, 30)], key=str)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "file_path string, v int")
    assert found(replace_files(rows, rows.where("v = 2"), spark.createDataFrame([("a",), ("b",)], "path string")), "v") == [(2,)]
    e = edges(spark, (1, 2, "CALLS", 9), (1, 2, "CALLS", 3), (1, 2, "EXTENDS", 5))
    assert found(ignore_duplicate_edges(e), "relationship", "line_number") == [("CALLS", 3), ("EXTENDS", 5)]
    s = symbols(spark, (1, "a", 0.1, "x.py"), (2, "b", 0.1, "y.py"))
    f, s2, e2 = delete_files(spark.createDataFrame([("x.py",), ("y.py",)], "path string"), s, e, spark.createDataFrame([("x.py",)], "path string"))
    assert f.count() == 1 and found(s2, "name") == [("b",)] and e2.count() == 3
    assert found(rename_files(s, spark.createDataFrame([("x.py", "z.py")], "old_path string, path string")), "file_path", "qualified_name") == [("y.py", "m.b"), ("z.py", "m.a")]
    snap = Snapshots(spark, str(tmp_path / "t"))
    assert snap.version() == 0 and snap.write(old) == 1 and snap.write(new) == 2 and snap.read().count() == 2 and snap.restore(1) == 3 and snap.read().count() == 3
    ok, history = migrate({"t": old}, 0, {1: lambda t: {"t": t["t"].withColumn("w", F.lit(1))}, 2: lambda t: 1 / 0, 3: lambda t: {}})
    assert ok["t"].columns == ["path", "v", "w"] and [h["status"] for h in history] == ["success", "failed"]

"""Work that grows with the input and the results, not with pairs of rows or opened ranges."""

import pytest

from graphloom import queries_code, tables  # noqa: F401
from graphloom.operators import resolve
from graphloom.queries import ORACLE_SQL, QUERIES
from graphloom.sources import files

from .measured import measured
from .oracle import compare

SF = "/root/testdata/sf0.001"


def test_calls_of_a_hot_name_make_no_pairs(spark):
    n = 400
    symbols = spark.range(n).selectExpr("id", "'run' AS name", "concat('m.C', id, '.run') AS qualified_name", "'method' AS kind", "concat('src/f', id, '.py') AS file_path")
    calls = spark.range(n).selectExpr("id AS call_id", "id AS caller_id", "'run' AS callee", "CASE id % 3 WHEN 0 THEN 'self' WHEN 1 THEN concat('c', id) ELSE 'zz' END AS receiver", "concat('src/f', (id + 1) % 400, '.py') AS file_path")
    with measured(spark) as figures:
        got = {tuple(r) for r in resolve.resolve_calls(calls, symbols).collect()}
    assert got == {(i, i if i % 3 == 0 else (i + 1) % n, "class_scoped" if i % 3 == 0 else "same_file", 1.0) for i in range(n)}
    assert 0 < max(figures("number of output rows")) < 20 * n


def test_parts_and_hints_of_names_are_found_by_text(spark):
    symbols = spark.createDataFrame([(1, "go", "a.b.c.go", "method", "x/one.py"), (2, "go", "a.bb.c.go", "method", "x/two.py"), (3, "go", "b.c.go", "method", "x/three.go"), (4, "me", "main", "method", "x/me.py")], "id long, name string, qualified_name string, kind string, file_path string")
    calls = spark.createDataFrame([("part", 4, "go", "b.c", "q.py"), ("first", 4, "go", "B", "q.py"), ("text", 4, "go", None, "q.py"), ("ends", 4, "go", None, "r.py"), ("alias", 4, "al", "", "r.py"), ("self", 4, "me", "cls", "q.py"), ("lost", 9, "go", None, "q.py")], "call_id string, caller_id long, callee string, receiver string, file_path string")
    aliases = spark.createDataFrame([("r.py", "al", "go"), ("r.py", "al", "me")], "file_path string, alias string, original string")
    hints = spark.createDataFrame([("q.py", "bb."), ("q.py", ""), ("r.py", "three")], "file_path string, hint string")
    got = {}
    for r in resolve.resolve_calls(calls, symbols, aliases, None, hints).collect():
        got.setdefault(r["call_id"], []).append((r["target_id"], r["strategy"], r["confidence"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        "part": [(1, "receiver_scoped", 1.0)], "first": [(1, "receiver_scoped", 1.0)], "text": [(2, "import_scoped", 1.0)], "ends": [(3, "import_scoped", 1.0)],
        "alias": [(3, "import_scoped", 1.0)], "self": [(4, "any", 1.0)],
    }


def test_hints_deal_out_ranges_not_lines(spark):
    rows = [("a", s, e, "r", t) for t in ("T", None) for s, e in ((1, 400), (1, 400), (50, 60), (300, 700), (1000, 1100), (1020, 1030), (-5, 3), (9, None), (None, 7), (2000, 1), (5000, 9000))]
    raw = spark.createDataFrame(rows, "file_path string, line_start int, line_end int, receiver string, owner_type string")
    with measured(spark) as figures:
        got = [tuple(r) for r in files.semantic_hints(raw).collect()]
    want = {("a", line, "r", t) for _, s, e, _, t in rows if s is not None for line in range(s, min(max(e or s, s), s + 512) + 1)}
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < sum(figures("shuffle records written")) <= 2 * len(rows)


@pytest.mark.parametrize("name", ["pagerank_5", "enclosing_symbol", "explain_neighbours", "deleted_files", "promoted_edges"])
def test_parts_grow_with_the_tables(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "PART_BYTES", 5_000, raising=False)  # 22 parts of lineitem, where the session has 4
    with measured(spark) as figures:
        assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) == ""
    assert max(figures("number of partitions")) > 12


def test_unknown_sizes_ask_for_no_parts(spark):
    assert tables.parts_of(spark.createDataFrame([(1,)], "a long")) == 0
    assert tables.parts_of(spark.createDataFrame([(1,)], "a long").repartition(3).mapInArrow(lambda it: it, "a long")) == 0

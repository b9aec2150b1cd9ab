import random
import time

import numpy as np

from graphloom.llm import near_copies, simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = plain(a), plain(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(rng, text, n):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def dealt_out(spark):
    """Bytes of all shuffles until now."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.3)  # figures of executors are told again after some time
    spark.range(1).repartition(2).count()
    context.listenerBus().waitUntilEmpty(30_000)
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.length()))


def test_shingles_and_similarity():
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "A", "a b c d", "a b c d e", "a B c d e f", "x " * 40, " ".join(rng.choices("abcd", k=300))]
    for a in texts:
        assert len(near_copies.shingles(a)) == len(plain(a))
        for b in texts:
            if plain(a) or plain(b):
                assert near_copies.near(near_copies.shingles(a), near_copies.shingles(b)) == (similarity(a, b) >= 0.8)


def test_bands_find_what_is_similar():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(500):  # 160 in common, 20 on either side: 0.8
        own = rng.integers(0, 2**64, 200, dtype=np.uint64)
        met += bool(set(near_copies.bands_of(own[:180])) & set(near_copies.bands_of(own[20:])))
    assert met >= 497


def test_stage_drops_near_copies(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(f"w{rng.randrange(3_000)}" for _ in range(300))
    first = [prose() for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(first)]
    rows += [(100 + i, changed(rng, t, 4)) for i, t in enumerate(first)]  # about 0.87
    rows += [(200 + i, changed(rng, t, 20)) for i, t in enumerate(first)]  # about 0.55
    rows += [(300 + i, changed(rng, first[0], 2)) for i in range(60)]  # a large group
    base = changed(rng, first[1], 150)
    rows += [(400 + i, changed(rng, base, 12)) for i in range(60)]  # similar, but no near copies: many leaders in a band
    far = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2
    assert sum(far(rows[i][1], rows[40 + i][1]) for i in range(40)) > 30
    rng.shuffle(rows)
    texts = dict(rows)
    stay = {r["doc_id"] for r in near_copies.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    assert not any(similarity(texts[a], texts[b]) >= 0.8 for a in stay for b in stay if a < b)
    assert all(any(similarity(texts[k], texts[j]) >= 0.8 for j in texts if j != k) for k in texts if k not in stay)
    assert all(len(stay & {i, 100 + i}) == 1 for i in range(1, 40))  # of two copies one stays
    assert len(stay & {0, 100, *range(300, 360)}) == 1  # of a cluster its middle


def test_unlike_texts_under_one_identifier_stay(spark):
    one, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(3, one, "x"), (5, one, "x"), (5, other, "y"), (6, third, "z"), (6, third, "y"), (6, third, "y"), (None, one, "x"), (None, third + " d", "x"), (None, other + " d e", "q")]
    docs = spark.createDataFrame([*rows, (None, "one of its own without identifier", "n"), (6, other + " e", "y")], "doc_id long, text string, source string")
    runs = [sorted(map(tuple, near_copies.dedup_stage(spark, docs.repartition(n), "").collect()), key=str) for n in (1, 4)]
    assert runs[0] == runs[1]
    kept = [(k, t[0]) for k, t, _ in runs[0]]
    assert sorted(kept, key=str) == sorted([(3, "a"), (5, "b"), (6, "c"), (None, "o")], key=str)


def test_rows_that_differ_beside_identifier_and_text(spark):
    docs = spark.createDataFrame([(1, "same text", f"s{i}", i) for i in range(9)], "doc_id long, text string, `a.b` string, row int")
    got = [near_copies.dedup_stage(spark, docs.repartition(n), "") for n in (1, 3)]
    assert got[0].columns == docs.columns and got[0].collect() == got[1].collect() and got[0].count() == 1


def test_simhash_groups_are_candidates(spark):
    contents = near_copies.sketches(spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f g " * 30, "a b c d e f g " * 31, "z"])], "doc_id long, text string"))
    contents = contents.selectExpr("struct(nameless, doc_id, h) AS me", "size", "fp", "array(doc_id) AS bands")  # no band is shared
    assert {r["me"]["doc_id"] for r in near_copies.candidates(spark, contents).collect()} == {0, 1}


def test_stage_deals_out_only_texts_that_matter(spark, tmp_path):
    rng = random.Random(5)
    first = [rng.randbytes(8_000).hex(" ", 4) for _ in range(300)]  # 2,000 words that don't compress to less than half
    rows = [(i, t) for i, t in enumerate([*first, *first[:10], *[changed(rng, t, 20) for t in first[10:20]]])]
    spark.createDataFrame([*rows, rows[30]], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    before = dealt_out(spark)
    near_copies.dedup_stage(spark, spark.read.parquet(f"{tmp_path}/docs"), "").write.parquet(f"{tmp_path}/kept")
    assert dealt_out(spark) - before < sum(len(t) for t in first) / 4  # all texts dealt out once are half of that sum
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect() if not 10 <= r["doc_id"] < 20 and r["doc_id"] < 310) == [*range(10), *range(20, 300)]
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 300


def test_filters_lose_nothing(spark, monkeypatch):
    keys = spark.range(3_000).selectExpr("struct(0 AS nameless, id AS doc_id, xxhash64(id) AS h) AS me")
    rows = spark.range(9_000).selectExpr("struct(0 AS nameless, id AS doc_id, xxhash64(id) AS h) AS me")
    for most in (2**20, 1):
        monkeypatch.setattr(near_copies, "FILTER_WORDS", most)
        passing = near_copies.filter_of(spark, keys)
        through, rest = ({r["me"]["doc_id"] for r in passing(rows, how).collect()} for how in ("left_semi", "left_anti"))
        assert through | rest == set(range(9_000)) and not through & rest and set(range(3_000)) <= through
        assert len(through) < 3_200 if most > 1 else len(through) == 9_000  # a full filter lets all through
    assert {r["me"]["doc_id"] for r in near_copies.filter_of(spark, keys.limit(0))(keys, "left_anti").collect()} == set(range(3_000))


def test_a_full_filter_changes_no_result(spark, edge, monkeypatch):
    runs = []
    for most in (2**20, 1):
        monkeypatch.setattr(near_copies, "FILTER_WORDS", most)
        runs.append(sorted(map(str, near_copies.dedup_stage(spark, edge, "").collect())))
    assert runs[0] == runs[1] and runs[0]

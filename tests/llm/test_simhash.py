import random
from collections import Counter

import numpy as np
import xxhash

from graphloom.llm import near_copies, simhash

from .conftest import SF, edge_rows


def similar(a, b):
    return near_copies.near(near_copies.shingles(a), near_copies.shingles(b))


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    least = {}
    for (k, _), p in zip(rows, prints, strict=True):
        if k is not None:
            least[roots[p]] = min(least.get(roots[p], k), k)
    return Counter((k, f"{p:016x}", least.get(roots[p])) for (k, _), p in zip(rows, prints, strict=True))


def test_query_against_brute_force(spark, small):
    assert Counter(tuple(r) for r in simhash.op6_simhash(spark, SF).collect()) == brute([(r["doc_id"], r["text"]) for r in small.collect()])


def test_edges(spark, edge, empty):
    rows = [r[:2] for r in edge_rows()]
    got = Counter((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in simhash.near_duplicates(spark, edge).collect())
    assert got == brute(rows)
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_dedup_stage(spark, edge, empty):
    stay = near_copies.dedup_stage(spark, edge, "")
    assert stay.columns == edge.columns
    got = Counter((r["doc_id"], r["text"]) for r in stay.collect())
    assert max(got.values()) == 1
    texts = {(t or "") for _, t, *_ in edge_rows()}
    kept = {t or "" for _, t in got}
    assert kept <= texts and all(t in kept or any(similar(t, x) for x in kept) for t in texts)
    assert not any(similar(a, b) for a in kept for b in kept if a < b)
    assert near_copies.dedup_stage(spark, empty, "").count() == 0


def _clusters(rng, n=300, each=12):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    one = lambda: np.uint64(1) << rng.integers(0, 64, n * each, dtype=np.uint64)
    return np.unique(np.concatenate([base, np.repeat(base, each) ^ one() ^ one() ^ one()]))


def test_bit_slices():
    rng = np.random.default_rng(1)
    values = _clusters(rng)[:1_500]
    for radius in (0, 1, 2):
        near = np.zeros((len(values),) * 2, bool)
        near[simhash.within(simhash.planes_of(values), len(values), values, radius)] = True
        assert (near == (np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)).all()


def test_links_lose_nothing_where_groups_are_hot(spark):
    rng = np.random.default_rng(2)
    hot = np.unique(rng.integers(0, 4_000, 900, dtype=np.uint64) | np.uint64(0xABCD << 48))
    values = np.unique(np.concatenate([_clusters(rng, 60), hot]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    want = brute_components([int(v) for v in values])
    for limit in (simhash.GROUP_LIMIT, 50):
        roots = {r["node"]: r["root"] for r in simhash.components(spark, simhash.links(spark, df, limit)).collect()}
        got = {int(v): roots.get(int(v.view(np.int64)), int(v.view(np.int64))) for v in values}
        assert len(set(zip(map(want.get, got), got.values(), strict=True))) == len(set(want.values())) == len(set(got.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 600), (600, 700), (700, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(spark, edges).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and got[600] == got[700] == 500


def test_long_texts_are_hashed_in_slices(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bc", "déf", "g\u00a0h"]) for _ in range(n)) + rng.choice(["", " \n"]) for n in (0, 1, 2, 3, 4, 50, 700)]
    whole = [(simhash.fingerprint(t), simhash.fingerprint(t, 5), near_copies.shingles(t).tolist()) for t in texts]
    for size in (1, 3, 40):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert [(simhash.fingerprint(t), simhash.fingerprint(t, 5), near_copies.shingles(t).tolist()) for t in texts] == whole

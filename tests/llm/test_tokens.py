import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import AddedToken, Tokenizer

from graphloom.llm import chunk_bpe, packing, sst, tokens

from .conftest import SF, edge_rows

LETTERS = [*"aAbé ÉŒœſßıİΣσ'sdt.,!?<|>\n\t\x0b\x1c\x85  ́̊Anň12٣_-*%$&#|;:", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", "ŉ", "中文", " word ", " the "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer())


def test_ids_of_fields(library):
    own, rng = tokens.FieldEncoder(tokens.default_tokenizer()), random.Random(1)
    assert own.plain
    for _ in range(5_000):
        s = "".join(rng.choices(LETTERS, k=rng.randint(0, 16)))
        assert own.ids(s).tolist() == library.encode(s, add_special_tokens=False).ids, s
    assert own.ids(None).tolist() == []


@pytest.fixture(scope="module")
def spanning(tmp_path_factory):
    """The vocabulary with added tokens that span white space or strip it."""
    full = Tokenizer.from_file(tokens.default_tokenizer())
    full.add_tokens([AddedToken("b the a", normalized=False), AddedToken("<x>", lstrip=True, rstrip=True, normalized=False)])
    path = str(tmp_path_factory.mktemp("vocabulary") / "spanning.json")
    full.save(path)
    return path


@pytest.fixture(params=["own", "spanning", "bytes"])
def vocabulary(request, spanning):
    import public_tokenizers

    return {"own": tokens.default_tokenizer(), "spanning": spanning, "bytes": public_tokenizers.path("byte_bpe_50k.json")}[request.param]


def test_rules_of_vocabularies(spanning):
    import public_tokenizers

    assert tokens.FieldEncoder(tokens.default_tokenizer()).spaced
    for path in (spanning, public_tokenizers.path("byte_bpe_50k.json")):
        own, full = tokens.FieldEncoder(path), Tokenizer.from_file(path)
        assert not own.spaced
        for text in ("b the a", " x <x>  y", "a\n\n b ", None):
            assert own.ids(text).tolist() == full.encode(text or "", add_special_tokens=False).ids


def test_chunks_agree_with_whole_texts(vocabulary, monkeypatch):
    rng = random.Random(2)
    library = Tokenizer.from_file(vocabulary)
    coder = chunk_bpe.ChunkCoder(vocabulary)
    monkeypatch.setattr(chunk_bpe, "MASK", 7)  # a cut every eight bytes
    letters = [*LETTERS, "b the a", " <x> ", " b the", " the a ", "b", " a ", "  "]
    passage = "".join(rng.choices(letters, k=800))
    for _ in range(120):
        s = "".join(rng.choices(letters, k=rng.randint(0, 200))) + passage + "".join(rng.choices(letters, k=rng.randint(0, 50)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert coder.ids(s) == ids
        assert coder.decoded(s) == library.decode(ids, skip_special_tokens=False)
    assert coder.reused > coder.made and coder.asked > 120


def test_a_token_over_white_space_at_a_join(spanning):
    """A cut at white space alone would be wrong here, and so would ids of chunks put side by side."""
    coder, library = chunk_bpe.ChunkCoder(spanning), Tokenizer.from_file(spanning)
    left, right = b"one two three b the", b" a four five six"
    a, b = coder.chunk(left), coder.chunk(right)
    whole = library.encode((left + right).decode(), add_special_tokens=False).ids
    side = [i for part in (left, right) for i in library.encode(part.decode(), add_special_tokens=False).ids]
    assert side != whole
    assert coder.join(a, b) is None  # the unit before the last is inside the token: no agreement yet
    assert coder.wider([left, right]) == whole and coder.grown == 1
    pieces = chunk_bpe.chunks(b"no space" * 200)
    assert b"".join(pieces) == b"no space" * 200
    for text in ("x" * 5_000, "\u4e2d" * 4_000, "\u00e9 " * 3_000):
        assert b"".join(chunk_bpe.chunks(text.encode())).decode() == text and coder.ids(text) == library.encode(text, add_special_tokens=False).ids
        assert all(p.decode() for p in chunk_bpe.chunks(text.encode()))


def test_cuts_follow_content():
    rng = random.Random(4)
    passage = bytes(rng.choices(range(32, 127), k=60_000))
    first, second = chunk_bpe.cuts(b"x" * 100 + passage), chunk_bpe.cuts(b"y" * 777 + passage)
    shared = {c - 100 for c in first if c > 200} & {c - 777 for c in second if c > 877}
    assert len(shared) >= len(first) - 2 > 3
    assert chunk_bpe.cuts(b"") == [] and chunk_bpe.cuts(b"ab") == [2]


def _brute(library, rows):
    return Counter((k, len(ids := library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for k, t in rows)


def test_op10(spark, library, edge, empty, small):
    assert Counter(tuple(r) for r in chunk_bpe.encode_documents(edge).collect()) == _brute(library, [r[:2] for r in edge_rows()])
    assert Counter(tuple(r) for r in chunk_bpe.op10_chunk_bpe(spark, SF).collect()) == _brute(library, [(r["doc_id"], r["text"]) for r in small.collect()])
    assert chunk_bpe.encode_documents(empty).count() == 0


def _all_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, library, edge, empty, small):
    want, start = [], 0
    for r in sorted(small.collect(), key=lambda r: r["doc_id"]):
        ids = _all_ids(library, r["text"])
        want.append((r["doc_id"], start, len(ids), _crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in sst.op2_sst_shards(spark, SF).collect()) == want
    got = sorted((tuple(r) for r in sst.read_shards(spark, sst.write_shards(spark, edge)).collect()), key=lambda r: r[1])
    assert Counter((r[0], r[3]) for r in got) == Counter((k, _crc(_all_ids(library, t))) for k, t, *_ in edge_rows())
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0
    known = [r[0] for r in got if r[0] is not None]
    assert known == sorted(known) and [r[0] for r in got[:2]] == [None, None]
    assert sst.read_shards(spark, sst.write_shards(spark, empty)).count() == 0


def test_lookup_in_a_shard(spark, small, library):
    manifest = sst.write_shards(spark, small).orderBy("rank").collect()
    shards = [sst.Shard(r["path"]) for r in manifest]
    want = {r["doc_id"]: _all_ids(library, r["text"]) for r in small.collect()}
    for k, ids in want.items():
        found = [v for s in shards for v in s.get(k)]
        assert [np.frombuffer(v, "<u2").tolist() for v in found] == [ids]
    missing = [k for k in range(10**6, 10**6 + 2_000)]
    assert not any(s.get(k) for s in shards for k in missing)
    assert sum(s.may_have(sst.key_of(k)) for s in shards for k in missing) < 0.05 * len(missing) * len(shards)
    assert [sst.identifier_of(sst.key_of(k)) for k in (None, -5, 0, 2**62)] == [None, -5, 0, 2**62]


def test_damaged_shard(spark, small):
    path = sst.write_shards(spark, small).first()["path"].removeprefix("file://").removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[50] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(sst.Shard(path).entries())


def _check_packing(rows, docs, library, longest=4096):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(
        (k, i, s, len(ids[s : s + longest]), _crc(ids[s : s + longest])) for k, t in docs for ids in [_all_ids(library, t)] for i, s in enumerate(range(0, len(ids), longest))
    )
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= longest
    return len(bins)


def test_op3(spark, library, edge, empty, small):
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    rows = packing.op3_best_fit(spark, SF).collect()
    used = _check_packing(rows, docs, library)
    assert used <= sum(r["length"] for r in rows) / 4096 * 1.02 + 1
    _check_packing(packing.pack(spark, edge, group_pieces=5).collect(), [r[:2] for r in edge_rows()], library)
    assert packing.pack(spark, empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 60, 500)
    capacity = packing.Capacity(tokens=100, documents=4, attention=3_000 + 59 * 59, rule=rule)
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= capacity.attention
        assert sorted(offsets[bins == b]) == [0, *np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), capacity)


def test_ranges_keep_the_order_and_split_hot_identifiers():
    ranges = sst.Ranges(3, [5, 7, 7, 7, 7, 9])
    rng = random.Random(1)
    rows = sorted((k is not None, k or 0, rng.getrandbits(32)) for k in [None] * 50 + [7] * 200 + list(range(-3, 14)) * 3)
    parts = [ranges.of(k if known else None, crc) for known, k, crc in rows]
    assert parts == sorted(parts) and max(parts) < ranges.count == 10
    assert len({p for (known, k, _), p in zip(rows, parts, strict=True) if known and k == 7}) >= 4
    assert len({p for (known, *_), p in zip(rows, parts, strict=True) if not known}) == 4


def test_op2_with_a_hot_identifier(spark, library):
    rng = random.Random(3)
    docs = [(7 if i % 3 else None if i % 2 else i, " ".join(rng.choices(["a", "the", "of", "dog"], k=i % 50))) for i in range(600)]
    rows = sst.read_shards(spark, sst.write_shards(spark, spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((k, len(ids := _all_ids(library, t)), _crc(ids)) for k, t in docs)
    rows.sort(key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert keys == sorted(keys)

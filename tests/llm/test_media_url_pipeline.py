import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import common, flac, url_filter

from .conftest import SF, edge_rows


def payloads():
    rng = np.random.default_rng(0)
    wave = (128 + 100 * np.sin(np.arange(576 * 6) / 40)).astype(np.uint8)
    return [bytes(576), b"\xff" * 1152, bytes(range(256)) * 9, rng.integers(0, 256, 1728, dtype=np.uint8).tobytes(), wave.tobytes(), (b"\x00\xff" * 288), np.cumsum(np.full(576, 3)).astype(np.uint8).tobytes(), flac.payload_of("the thing " * 4_000)[1], b"a" * 570 + b"\x00\xff\x00\xff\x00\xff"]


def test_streams_are_lossless():
    own = payloads()
    streams = flac.encode_many(own)
    assert flac.decode_many(streams) == own and [flac.encode(p) for p in own] == streams
    kinds = {s[flac._layout(s)[0] + 6] >> 1 for s in streams}
    assert {0, 1} < kinds and any(k >= 8 for k in kinds)
    with pytest.raises(ValueError):
        flac.encode(b"abc")


def test_a_frame_that_holds_the_next_header_by_chance():
    rng = np.random.default_rng(7)
    noise = bytearray(rng.integers(0, 256, 576 * 4, dtype=np.uint8).tobytes())
    for frame, inside in ((0, 1), (0, 1), (1, 2), (2, 3)):
        at = 576 * frame + 100 + 60 * (noise[576 * frame + 100] ^ 0x80 == 0xFF)
        header = flac._header(inside)
        noise[at : at + len(header)] = bytes(b ^ 0x80 for b in header)  # such frames are stored as they are
    own = bytes(noise)
    stream = flac.encode(own)
    assert all(stream.count(flac._header(n)) >= 2 for n in (1, 2, 3))
    assert flac.decode_many([stream, flac.encode(b"z" * 576)]) == [own, b"z" * 576]
    assert [flac.read_from(stream, 576 * i) for i in range(4)] == [[(576 * i, own[576 * i : 576 * i + 576])] for i in range(4)]
    damaged = bytearray(stream)
    damaged[-40] ^= 1
    with pytest.raises(ValueError):
        flac.decode_many([bytes(damaged)])


def test_seek():
    p = flac.payload_of("some words to seek in " * 9_000)[1]
    s = flac.encode(p)
    for sample in (0, 575, 576, 64 * 576 + 3, len(p) - 1):
        at = sample // 576 * 576
        assert flac.read_from(s, sample, 2) == [(i, p[i : i + 576]) for i in (at, at + 576) if i < len(p)]


def test_damage_is_found():
    s = flac.encode(flac.payload_of("some words " * 3_000)[1])
    first = flac._layout(s)[0]
    for i in (0, 30, first, first + 5, first + 100, len(s) - 1):
        broken = bytearray(s)
        broken[i] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode_many([bytes(broken)])
    with pytest.raises(ValueError):
        flac.decode_many([s[:-40]])


class _Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def rice(self, value, k):
        u = value << 1 if value >= 0 else (-value << 1) - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)

    def frame(self):
        self.bits += [0] * (-len(self.bits) % 8)
        data = np.packbits(np.array(self.bits, np.uint8))
        crc = int(flac.crc16_rows(data, np.array([0]), np.array([len(data)]))[0])
        return data.tobytes() + crc.to_bytes(2, "big")


@pytest.mark.parametrize("order,weights,shift", [(2, [7, -3], 2), (3, [5, -2, 1], 2)])
def test_linear_predictor_partitions_and_escape(order, weights, shift):
    rng = np.random.default_rng(order)
    x = np.clip(np.cumsum(rng.integers(-3, 4, 576)), -128, 127).tolist()
    w = _Writer()
    for b in flac._header(0):
        w.put(b, 8)
    w.put((31 + order) << 1, 8)
    for v in x[:order]:
        w.put(v & 255, 8)
    w.put(5 - 1, 4)
    w.put(shift, 5)
    for c in weights:
        w.put(c & 31, 5)
    w.put(0, 2)
    w.put(2, 4)  # four partitions
    for part in range(4):
        lo, hi = max(order, part * 144), (part + 1) * 144
        rest = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(weights)) >> shift) for i in range(lo, hi)]
        if part == 2:
            w.put(15, 4)
            w.put(12, 5)
            for r in rest:
                w.put(r & 4095, 12)
        else:
            w.put(part, 4)
            for r in rest:
                w.rice(r, part)
    data = w.frame()
    assert flac.decode_frames(data, np.array([0]), np.array([len(data)]))[0].tolist() == x


def test_checksums_against_bits():
    def slow(data, poly, width):
        c = 0
        for b in data:
            c ^= b << (width - 8)
            for _ in range(8):
                c = (c << 1 ^ poly if c >> (width - 1) & 1 else c << 1) & ((1 << width) - 1)
        return c

    data = bytes(range(200))
    rows = flac.crc16_rows(np.frombuffer(data, np.uint8), np.array([0, 10, 50]), np.array([200, 3, 0]))
    assert rows.tolist() == [slow(data, 0x8005, 16), slow(data[10:13], 0x8005, 16), 0] and flac.crc8(data) == slow(data, 7, 8)


def test_op7(spark, edge, empty, small):
    for df, rows in ((edge, [r[:2] for r in edge_rows()]), (small, [(r["doc_id"], r["text"]) for r in small.collect()])):
        got = flac.read_media(flac.with_media(df)).collect()
        want = Counter()
        for k, t in rows:
            n, p = flac.payload_of(t)
            want[k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
        assert Counter(tuple(r)[:5] for r in got) == want
        by_text = {}
        for r in got:
            assert by_text.setdefault(r["payload_sha256"], (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
    blocks = flac.pcm_blocks(flac.with_media(small)).groupBy("doc_id").agg({"sample_offset": "max"}).count()
    assert blocks == small.count()
    assert flac.read_media(flac.with_media(empty)).count() == 0


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


URLS = [None, "", "nourl", "http://", "http://com/en/", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/", "http://notexample.com/en/71", "x://net/de/8", "x://example.net/de/81#a", "x://q.example.net/de/7", "a://org#/es/", "a://org/es/", "a://b://org/es/x", "http://h?://x/y", "http://é.org/es/é?", "http://.org/es/", "http://a..com/en/"]


def test_op9(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(4, URLS[4], "h", "r"), (None, URLS[4], None, None)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*url_filter.RULES, url_filter.RULES[0]], "verdict string, host string, path string")
    want = Counter([(i, *brute_url(u, url_filter.RULES)) for i, u in [*enumerate(URLS), (4, URLS[4]), (None, URLS[4])]])
    assert Counter(tuple(r) for r in url_filter.judge(spark, pages, rules).collect()) == want
    assert url_filter.judge(spark, pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(spark, pages, rules.limit(0)).collect()} == {"allow"}
    table = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert Counter(tuple(r) for r in url_filter.op9_url_filter(spark, SF).collect()) == Counter((r["page_id"], *brute_url(r["url"], url_filter.RULES)) for r in table)


def test_bloom_filter(spark):
    """Every listed key passes, few others do, and the bits are those of a plain count."""
    keys = spark.range(5_000).selectExpr("xxhash64(id) AS h")
    rows, blocks = url_filter.build_filter(keys)
    ask = lambda df: url_filter.passing(df, rows, blocks).count()
    assert ask(keys) == 5_000 and ask(spark.range(10_000, 30_000).selectExpr("xxhash64(id) AS h")) < 600
    want = {}
    for (h,) in keys.collect():
        h %= 2**64
        own = want.setdefault((h >> 32) % blocks, set())
        own |= {((h & 0xFFFF) + i * (h >> 16 & 0xFFFF | 1) + i * i) % 512 for i in range(url_filter.PROBES)}
    got = {r["block"]: {64 * w + b for w in range(8) for b in range(64) if r[f"word{w}"] >> b & 1} for r in rows.collect()}
    assert got == want


def test_long_urls_and_many_labels(spark):
    long = [f"http://{'a.' * 300}example.com/en/{'x' * 50_000}", f"https://example.com/en/7{'/' * 9_000}?q", "http://" + "b" * 70_000]
    pages = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    rules = [*url_filter.RULES, ("block", "b" * 70_000, ""), ("allow", "com", "/en/" + "x" * 40_000)]
    got = url_filter.judge(spark, pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *brute_url(u, rules)) for i, u in enumerate(long))


def test_plan_of_the_filter(spark):
    plan = url_filter.op9_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert "word7" in plan and "MapInArrow" not in plan and "Cartesian" not in plan


def test_pipeline_stages(spark):
    docs = common.documents(spark, SF)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(spark, stage(spark, docs, SF), name)
        assert after.columns == names and 0 < after.count() <= docs.count() and after.exceptAll(docs).count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()) == Counter(tuple(r) for r in packed.select("doc_id", "piece", "ids_crc32").collect())


def test_pipeline_on_edges(spark, edge, empty):
    for docs in (edge, empty):
        names = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == names
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()

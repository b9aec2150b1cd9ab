"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over each text's bytes cuts it where the content says so, so texts that share a passage share its
chunks wherever it stands. A distinct chunk is encoded once for each Python worker and reused; the memo has a
bounded number of bytes. Then each join of two chunks is repaired: a window over the last units of one and the first
of the other is encoded again by the library, and the ids are joined only if the window's ids and token borders agree
with those of both chunks on a unit at either side (a unit is what stands between white space, or more of it where a
token spans white space). Where they don't, the window grows to twice its units, and at last to the whole text. So ids
and decoded texts are those of whole texts, added tokens included; a token that spans a join shows up in the window.

Chunks are encoded through the memo of fields where ``tokens.FieldEncoder`` has found the vocabulary to split at white
space, else by the library. A decoder other than the plain one decodes a text's ids as a whole.

Defined results: a null text is empty; an empty text has no ids and decodes to the empty text; a text of any length is
one row, with some bytes of output for each token in memory; one without white space is one chunk; repeated rows and
null identifiers are kept; extra columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import documents, per_step

#: Bytes that the rolling hash sees, a mask that gives chunks of about 2,048 bytes, and the bytes the memos may hold.
WINDOW = 16
MASK = (1 << 11) - 1
MEMO_BYTES = 64_000_000
#: Fields in each memo of texts.
MAX_FIELDS = 400_000
#: Units that a chunk has at least, but for the only one of a text.
LEAST_UNITS = 4
_MIX = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where a text is cut: behind windows whose rolling (cyclic polynomial) hash has its low bits unset."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    rolled = _MIX[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # the hash of twice the width is the rotated hash of one half and that of the other
        left = rolled[:-width]
        rolled = (left << np.uint32(width) | left >> np.uint32(32 - width)) ^ rolled[width:]
        width *= 2
    found = np.flatnonzero((rolled & np.uint32(MASK)) == 0) + WINDOW
    out = found.tolist()
    return out if out and out[-1] == n else [*out, n]


def chunks(data: bytes) -> list[bytes]:
    """A text's chunks: cut between characters, and each with ``LEAST_UNITS`` fields, so that its two ends are apart."""
    out, start = [], 0
    for end in cuts(data):
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end > start and (end == len(data) or len(data[start:end].split(None, LEAST_UNITS - 1)) == LEAST_UNITS):
            out.append(data[start:end])
            start = end
    if len(out) > 1 and len(out[-1].split(None, LEAST_UNITS - 1)) < LEAST_UNITS:
        out[-2:] = [out[-2] + out[-1]]
    return out


class Unit(NamedTuple):
    """A unit's bytes, with the white space before it, and its ids."""

    data: bytes
    ids: list[int]


class Chunk(NamedTuple):
    """The output of a chunk's first unit, of its last, and of all between; and two units at either end."""

    first: tuple[bytes, bytes]
    inner: tuple[bytes, bytes]
    last: tuple[bytes, bytes]
    head: tuple[Unit, Unit]
    tail: tuple[Unit, Unit]


class _Fields(dict):
    """A field's ids as decimal text, or as tokens, each with a space behind; bounded like the memo of ids.

    Both forms of a new field are made at once: ``other`` is the memo of the other form.
    """

    def __init__(self, encoder: tokens.FieldEncoder, names: list[bytes], other_names: list[bytes]) -> None:
        self.encoder, self.names, self.other_names, self.other = encoder, names, other_names, {}

    def __missing__(self, field: bytes) -> bytes:
        if len(self) >= MAX_FIELDS:
            self.clear()
        if len(self.other) >= MAX_FIELDS:
            self.other.clear()
        ids = memoryview(self.encoder.field(field)).cast(self.encoder.code)
        out = self[field] = b"".join([self.names[i] for i in ids])
        self.other[field] = b"".join([self.other_names[i] for i in ids])
        return out


class ChunkCoder:
    """A text's ids as decimal text and its decoded text, each joined from chunks."""

    def __init__(self, path: str) -> None:
        self.encoder = tokens.FieldEncoder(path)
        self.full = self.encoder.full
        size = self.encoder.size
        self.numbers = [b"%d " % i for i in range(size)]
        self.names = [f"{self.full.id_to_token(i) or ''} ".encode() for i in range(size)]
        self.decimal = _Fields(self.encoder, self.numbers, self.names)
        self.token = _Fields(self.encoder, self.names, self.numbers)
        self.decimal.other, self.token.other = self.token, self.decimal
        self.plain_decoder = self.full.decoder is None
        self.memo: dict[bytes, Chunk] = {}
        self.joins: dict[tuple, tuple[bytes, bytes] | None] = {}
        self.held = 0
        #: Bytes of chunks that were met before and of those that were encoded; joins that were asked, and that grew.
        self.reused = self.made = self.asked = self.grown = 0

    def shown(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join([self.numbers[i] for i in ids]), b"".join([self.names[i] for i in ids])

    def units(self, data: bytes) -> list[Unit]:
        """By the library: a unit ends where a field ends and no token goes on; what follows belongs to the last."""
        text = data.decode()
        window = _Window(self.full, text)
        out, at, done = [], 0, 0
        for m in tokens.FIELD.finditer(text):
            i = window.border(m.end())
            if i is not None:
                out.append(Unit(text[at : m.end()].encode(), window.ids[done:i]))
                at, done = m.end(), i
        if at < len(text) or done < len(window.ids):
            last = out.pop() if out else Unit(b"", [])
            out.append(Unit(last.data + text[at:].encode(), last.ids + window.ids[done:]))
        return out

    def _encoded(self, data: bytes) -> Chunk:
        fields = data.split()
        if not self.encoder.spaced or len(fields) < 3:
            units = self.units(data)
            if len(units) < 3:
                none = Unit(b"", [])
                return Chunk(self.shown([i for u in units for i in u.ids]), (b"", b""), (b"", b""), (none, none), (none, none))
            return Chunk(self.shown(units[0].ids), self.shown([i for u in units[1:-1] for i in u.ids]), self.shown(units[-1].ids), (units[0], units[1]), (units[-2], units[-1]))
        show = lambda own: (b"".join(map(self.decimal.__getitem__, own)), b"".join(map(self.token.__getitem__, own)))
        ids = lambda field: memoryview(self.encoder.field(field)).cast(self.encoder.code).tolist()
        one = len(data) - len(data.lstrip()) + len(fields[0])
        two = len(data) - len(data[one:].lstrip()) + len(fields[1])
        end = len(data.rstrip())
        last = len(data[: end - len(fields[-1])].rstrip())
        other = len(data[: last - len(fields[-2])].rstrip())
        head = Unit(data[:one], ids(fields[0])), Unit(data[one:two], ids(fields[1]))
        tail = Unit(data[other:last], ids(fields[-2])), Unit(data[last:], ids(fields[-1]))
        return Chunk(show(fields[:1]), show(fields[1:-1]), show(fields[-1:]), head, tail)

    def chunk(self, data: bytes) -> Chunk:
        found = self.memo.get(data)
        if found is None:
            if self.held >= MEMO_BYTES:
                self.memo.clear()
                self.joins.clear()
                self.held = 0
            found = self.memo[data] = self._encoded(data)
            self.held += len(data) + sum(map(len, found.inner)) + 2_000
            self.made += len(data)
        else:
            self.reused += len(data)
        return found

    def agreed(self, left: list[Unit], right: list[Unit], drop: int) -> list[int] | None:
        """The library's ids for the last ``drop`` units of ``left`` and the first of ``right``, read in a window of all.

        None if the window's ids or borders of the units next to them are not those that the chunks have.
        """
        lengths = [len(u.data.decode()) for u in left + right]
        ends = np.cumsum([0, *lengths]).tolist()
        window = _Window(self.full, b"".join([u.data for u in left + right]).decode())
        mine, other = len(left) - drop - 1, len(left) + drop
        a, b, c, d = (window.border(ends[i]) for i in (mine, mine + 1, other, other + 1))
        if None in (a, b, c, d) or window.ids[a:b] != left[mine].ids or window.ids[c:d] != right[drop].ids:
            return None
        return window.ids[b:c]

    def join(self, a: Chunk, b: Chunk) -> tuple[bytes, bytes] | None:
        """The output in place of the last unit of ``a`` and the first of ``b``, if two units on either side settle it."""
        key = (*[u.data for u in a.tail + b.head], *a.tail[0].ids, -1, *b.head[1].ids)
        if key not in self.joins:
            ids = self.agreed(list(a.tail), list(b.head), 1) if a.tail[0].data and b.head[1].data else None
            self.joins[key] = None if ids is None else self.shown(ids)
            self.held += 700
        self.asked += 1
        return self.joins[key]

    def wider(self, pieces: list[bytes]) -> list[int]:
        """Ids of a text where two units did not settle every join: windows grow to twice the units, then to the whole."""
        self.grown += 1
        units = [self.units(p) for p in pieces]
        drops, between = [0], []
        for left, right in zip(units[:-1], units[1:], strict=True):
            k, found = 2, None
            while found is None and k // 2 < min(len(left), len(right)):
                found = self.agreed(left[-k:], right[:k], k // 2)
                k *= 2
            if found is None:
                return self.full.encode(b"".join(pieces).decode(), add_special_tokens=False).ids
            drops.append(k // 4)
            between.append(found)
        drops.append(0)
        out: list[int] = []
        for i, own in enumerate(units):
            if len(own) < drops[i] + drops[i + 1] + 1:  # the windows of both joins meet: their agreement is not on one unit
                return self.full.encode(b"".join(pieces).decode(), add_special_tokens=False).ids
            out += [x for u in own[drops[i] : len(own) - drops[i + 1]] for x in u.ids]
            out += between[i] if i < len(between) else []
        return out

    def parts(self, text: str | None) -> list[tuple[bytes, bytes]]:
        """Pieces of output: decimal ids and tokens, each with a space behind."""
        pieces = chunks((text or "").encode())
        found = list(map(self.chunk, pieces))
        if not found:
            return []
        out = [found[0].first, found[0].inner]
        for a, b in zip(found[:-1], found[1:], strict=True):
            between = self.join(a, b)
            if between is None:
                return [self.shown(self.wider(pieces))]
            out += [between, b.inner]
        return [*out, found[-1].last]

    def ids(self, text: str | None) -> list[int]:
        return [int(x) for x in b"".join([x[0] for x in self.parts(text)]).split()]

    def _decoded(self, parts: list[tuple[bytes, bytes]]) -> bytes:
        if self.plain_decoder:
            return b"".join([x[1] for x in parts])[:-1]
        return self.full.decode([int(x) for p in parts for x in p[0].split()], skip_special_tokens=False).encode()

    def decoded(self, text: str | None) -> str:
        return self._decoded(self.parts(text)).decode()

    def digests(self, text: str | None) -> tuple[int, str, str]:
        parts = self.parts(text)
        ids = b"".join([x[0] for x in parts])
        return ids.count(b" "), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(self._decoded(parts)).hexdigest()


class _Window:
    """The library's ids of a text and where they may be parted."""

    def __init__(self, full: tokens.Tokenizer, text: str) -> None:
        found = full.encode(text, add_special_tokens=False)
        self.ids, self.offsets = found.ids, found.offsets
        self.ends = [o[1] for o in self.offsets]

    def border(self, place: int) -> int | None:
        """How many tokens end up to ``place``, if none goes over it."""
        i = bisect_right(self.ends, place)
        return i if i == len(self.ends) or self.offsets[i][0] >= place else None


@lru_cache(maxsize=1)
def coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path = path or tokens.default_tokenizer()

    def make():
        own = coder(path)

        def work(keys: list, texts: list) -> dict:
            n, ids, decoded = zip(*map(own.digests, texts), strict=True)
            return {"doc_id": keys, "n_tokens": list(n), "ids_sha256": list(ids), "decoded_sha256": list(decoded)}

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(per_step(make, schema), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))

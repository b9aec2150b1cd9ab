"""FLAC media columns: lossless 8-bit mono streams in frames of 576 samples, written and read with numpy.

The writer picks for each frame the fixed linear predictor (order 0 to 4) with the least residual and codes it with one
Rice parameter; frames of one value and frames that coding would enlarge are stored as constant or verbatim. The
reader also restores general linear predictors (LPC), verifies the CRC-8 of every frame header, the CRC-16 of every
frame and the MD5 of the samples, and gives blocks of PCM with the offset of their first sample. Both work on many
frames at a time: one numpy step takes one sample, or one byte, of every frame.

A payload byte is an unsigned sample; FLAC's samples are signed, so 128 is taken off and put back.

Defined results: a null text is empty, and an empty text is one frame of bytes 255; equal texts have equal streams;
a text of any length is one stream, with some ten times its bytes in memory; repeated rows and null identifiers are kept;
extra columns are ignored, whatever their names; no rows give no rows. A stream that is cut or changed raises
``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BLOCK = 576
RATE = 8_000
#: Frames coded in one numpy step.
STEP_FRAMES = 4_096
#: Frames between two seek points.
SEEK_FRAMES = 64
MAX_ORDER = 4


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = []
    for n in range(256):
        c = n << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        table.append(c)
    return np.array(table, np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16_rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges at once, longest first while any is left."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.zeros(len(at), np.uint32)
    live = len(at)
    padded = data
    for i in range(int(left[0]) if len(left) else 0):
        while live and left[live - 1] <= i:
            live -= 1
        c = crc[:live]
        crc[:live] = (c << np.uint32(8) & np.uint32(0xFFFF)) ^ _CRC16[c >> np.uint32(8) ^ padded[at[:live] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in FLAC's extension of UTF-8."""
    if n < 128:
        return bytes([n])
    tail = []
    first = 0x3F
    while n > first:
        tail.append(128 | n & 63)
        n >>= 6
        first >>= 1
    return bytes([(0xFF ^ (first << 1 | 1)) & 0xFF | n, *reversed(tail)])


def _headers(first: int, count: int) -> list[bytes]:
    out = []
    for n in range(first, first + count):
        # sync and fixed blocks; 576 samples, 8 kHz; mono, 8 bits
        own = b"\xff\xf8\x24\x02" + _number(n)
        out.append(own + bytes([crc8(own)]))
    return out


_HEADERS: list[bytes] = []


def _header(n: int) -> bytes:
    if n < 100_000:
        if n >= len(_HEADERS):
            _HEADERS.extend(_headers(len(_HEADERS), n + 1 - len(_HEADERS)))
        return _HEADERS[n]
    return _headers(n, 1)[0]


def _code_frames(samples: np.ndarray, numbers: list[int]) -> tuple[bytes, np.ndarray]:
    """Frames of ``samples`` (int16, frames x 576) one after the other, and the length of each."""
    count = len(samples)
    residuals = [samples.astype(np.int16)]
    for _ in range(MAX_ORDER):
        residuals.append(np.diff(residuals[-1], axis=1))
    cost = np.stack([np.abs(r[:, MAX_ORDER - o :]).sum(axis=1, dtype=np.int32) for o, r in enumerate(residuals)], axis=1)
    order = cost.argmin(axis=1)
    u = np.zeros((count, BLOCK), np.int32)
    for o in range(MAX_ORDER + 1):
        rows = np.flatnonzero(order == o)
        if len(rows):
            r = residuals[o] if len(rows) == count else residuals[o][rows]
            u[rows, o:] = r << 1 ^ r >> 15
    n = (BLOCK - order).astype(np.int64)
    # the best parameter is near the logarithm of the mean; it and its neighbours are tried
    near = np.log2(np.maximum(u.sum(axis=1, dtype=np.int64) / n * 0.7, 1)).astype(np.int32)
    best_bits, k = None, None
    for d in (0, 1):
        p = np.clip(near + d, 0, 8)
        bits = (u >> p[:, None]).sum(axis=1, dtype=np.int64) + n * (p + 1)
        if best_bits is None:
            best_bits, k = bits, p
        else:
            k = np.where(bits < best_bits, p, k)
            best_bits = np.minimum(bits, best_bits)
    coded_bits = 8 + 8 * order + 10 + best_bits
    constant = (samples == samples[:, :1]).all(axis=1)
    verbatim = ~constant & (coded_bits >= 8 + 8 * BLOCK)
    coded = ~constant & ~verbatim
    heads = [_header(i) for i in numbers]
    head_n = np.array([len(h) for h in heads], np.int64)
    body_bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, coded_bits))
    lengths = head_n + (body_bits + 7) // 8 + 2
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    out = np.zeros(total + 8, np.uint8)
    blob = np.frombuffer(b"".join(heads), np.uint8)
    at = np.repeat(starts - (np.cumsum(head_n) - head_n), head_n) + np.arange(len(blob))
    out[at] = blob
    body = starts + head_n
    raw = (samples & 0xFF).astype(np.uint8)
    out[body[verbatim]] = 0x02
    if verbatim.any():
        out[(body[verbatim] + 1)[:, None] + np.arange(BLOCK)] = raw[verbatim]
    out[body[constant] + 1] = raw[constant, 0]
    if coded.any():
        rows = np.flatnonzero(coded)
        out[body[rows]] = (8 + order[rows]) << 1
        for o in range(1, MAX_ORDER + 1):
            own = rows[order[rows] >= o]
            out[body[own] + o] = raw[own, o - 1]
        # method 0, partition order 0: six zero bits, then four of the parameter
        at = body[rows] + 1 + order[rows]
        out[at] = k[rows] >> 2
        out[at + 1] |= ((k[rows] & 3) << 6).astype(np.uint8)
        own_u, own_k = u[rows], k[rows][:, None]
        quotient = own_u >> own_k
        size = quotient + (own_k + 1)
        value = own_u & (1 << own_k) - 1 | 1 << own_k
        for o in range(1, MAX_ORDER + 1):  # warm-up samples take no bits
            size[order[rows] >= o, o - 1] = 0
            value[order[rows] >= o, o - 1] = 0
        ends_at = np.cumsum(size, axis=1, dtype=np.int32)
        # a code's last k + 1 bits, at most nine, lie in two bytes
        place = ends_at + (8 * (at - at[0]) + 10)[:, None] - (own_k + 1)
        value <<= 15 - own_k - (place & 7)
        byte = (place >> 3).ravel()
        low, span = int(at[0]), int(byte[-1]) + 2
        value = value.ravel()
        for shift, d in ((8, 0), (0, 1)):
            out[low : low + span] += np.bincount(byte + d, value >> shift & 255, span).astype(np.uint8)
    crc = crc16_rows(out, starts, lengths - 2)
    end = starts + lengths
    out[end - 2], out[end - 1] = crc >> 8, crc & 255
    return out[:total].tobytes(), lengths


def encode(payload: bytes) -> bytes:
    """A FLAC stream of a payload whose length is a positive multiple of 576."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload's length is a positive multiple of 576")
    return encode_many([payload])[0]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    counts = [len(p) // BLOCK for p in payloads]
    numbers = [i for n in counts for i in range(n)]
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    data, lengths = [], []
    for at in range(0, len(samples), STEP_FRAMES):
        own, n = _code_frames(samples[at : at + STEP_FRAMES], numbers[at : at + STEP_FRAMES])
        data.append(own)
        lengths.append(n)
    frames, sizes = b"".join(data), np.concatenate(lengths)
    ends = np.cumsum(sizes)
    out, done = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        own = sizes[done : done + n]
        start = int(ends[done - 1]) if done else 0
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        at = np.cumsum(own) - own
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(at[i]), BLOCK) for i in range(0, n, SEEK_FRAMES))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames[start : start + int(own.sum())])
        done += n
    return out


class _Bits:
    """Reads at one bit place for each of many frames."""

    def __init__(self, data: bytes) -> None:
        self.data = np.frombuffer(data + bytes(16), np.uint8)
        # eight bytes from any byte on, as one big-endian word
        self.words = np.ndarray(len(self.data) - 8, ">u8", self.data, strides=(1,))

    def word(self, place: np.ndarray) -> np.ndarray:
        """64 bits from ``place``, of which at least 57 are right."""
        return self.words[np.minimum(place >> 3, len(self.words) - 1)].astype(np.uint64) << (place & 7).astype(np.uint64)

    def take(self, place: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        n = np.asarray(n, np.uint64)
        return np.where(n == 0, np.uint64(0), self.word(place) >> np.minimum(np.uint64(64) - n, np.uint64(63))).astype(np.int64)


#: Leading zeros of 16 bits.
_LEAD = np.array([16 - n.bit_length() for n in range(1 << 16)], np.int64)


def _signed(value: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = np.int64(1) << (np.asarray(bits, np.int64) - 1)
    return (value ^ half) - half


def _rice(bits: _Bits, place: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Rice code from each place: the residuals and the places behind them."""
    word = bits.word(place)
    lead = _LEAD.take((word >> np.uint64(48)).view(np.int64))
    if lead.max(initial=0) < 16:
        rest = (word << (lead + 1).view(np.uint64)) >> np.uint64(1)  # a parameter is less than 31
        u = lead << k | (rest >> (63 - k).view(np.uint64)).view(np.int64)
        return u >> 1 ^ -(u & 1), place + (lead + 1 + k)
    zeros = lead
    open_ = lead == 16
    while open_.any():
        place = np.where(open_, place + 16, place)
        if (place >> 3 >= len(bits.words)).any():
            raise ValueError("a frame ends within a Rice code")
        more = _LEAD.take((bits.word(place) >> np.uint64(48)).view(np.int64))
        zeros = np.where(open_, zeros + more, zeros)
        lead = np.where(open_, more, lead)
        open_ = open_ & (more == 16)
    place = place + lead + 1
    u = zeros << k | bits.take(place, k)
    return u >> 1 ^ -(u & 1), place + k


def decode_frames(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Samples (frames x 576) of mono 8-bit frames; their checksums are verified first."""
    bits = _Bits(data)
    raw = bits.data
    if (crc16_rows(raw, starts, lengths - 2) != raw[starts + lengths - 2].astype(np.uint32) << 8 | raw[starts + lengths - 1]).any():
        raise ValueError("a frame's CRC-16 is wrong")
    if ((raw[starts] != 0xFF) | (raw[starts + 1] != 0xF8) | (raw[starts + 2] >> 4 != 2) | (raw[starts + 3] != 2)).any():
        raise ValueError("not a frame of 576 8-bit mono samples")
    number = raw[starts + 4]
    extra = np.select([number < 0x80, number < 0xE0, number < 0xF0, number < 0xF8, number < 0xFC, number < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    head = np.zeros(len(starts), np.uint32)
    for i in range(int(extra.max()) + 5 if len(extra) else 0):
        head = np.where(i < extra + 5, _CRC8[head ^ raw[starts + i]], head)
    if (head != raw[starts + 5 + extra]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    place = 8 * (starts + 6 + extra)
    kind = (bits.take(place, 8) >> 1) & 63
    if (bits.take(place, 8) & 0x81).any():
        raise ValueError("wasted bits or padding in a subframe")
    place = place + 8
    out = np.zeros((len(starts), BLOCK), np.int16)
    flat = kind == 0
    out[flat] = _signed(bits.take(place[flat], 8), 8)[:, None]
    plain = np.flatnonzero(kind == 1)
    if len(plain):
        at = place[plain] >> 3
        out[plain] = raw[at[:, None] + np.arange(BLOCK)].astype(np.int8)
    for o in sorted(set(kind[(kind >= 8) & (kind <= 12)].tolist())):
        rows = np.flatnonzero(kind == o)
        _predicted(bits, out, rows, place[rows], o - 8, None)
    for o in sorted(set(kind[kind >= 32].tolist())):
        rows = np.flatnonzero(kind == o)
        _predicted(bits, out, rows, place[rows], o - 31, "lpc")
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("a subframe of a reserved kind")
    return out


def _predicted(bits: _Bits, out: np.ndarray, rows: np.ndarray, place: np.ndarray, order: int, kind: str | None) -> None:
    own = np.zeros((BLOCK, len(rows)), np.int64)
    for i in range(order):
        own[i] = _signed(bits.take(place, 8), 8)
        place = place + 8
    if kind == "lpc":
        precision = bits.take(place, 4) + 1
        shift = _signed(bits.take(place + 4, 5), 5)
        place = place + 9
        weights = np.zeros((order, len(rows)), np.int64)
        for i in range(order):
            weights[i] = _signed(bits.take(place, precision), precision)
            place = place + precision
    head = bits.take(place, 6)
    if (head >> 4 > 1).any():
        raise ValueError("a residual of a reserved method")
    place = _residuals(bits, own, place + 6, order, head >> 4 == 1, BLOCK >> (head & 15))
    if kind == "lpc":
        for i in range(order, BLOCK):
            own[i] += (weights * own[i - order : i][::-1]).sum(axis=0) >> shift
    else:
        # the residual is the order-th difference, so summing up as often restores the samples
        firsts = [own[:order]]
        for _ in range(order):
            firsts.append(np.diff(firsts[-1], axis=0))
        for o in range(order - 1, -1, -1):
            own[o] = firsts[o][0]
            np.cumsum(own[o:], axis=0, out=own[o:])
    out[rows] = own.T


def _residuals(bits: _Bits, own: np.ndarray, place: np.ndarray, order: int, wide: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rice partitions of ``size`` samples into the rows of ``own`` from ``order`` on."""
    width = np.where(wide, 5, 4)
    k = np.zeros(len(place), np.int64)
    escaped = np.zeros(len(place), np.int64)
    whole = bool((size == BLOCK).all())
    flat_any = False
    for i in range(order, BLOCK):
        if i == order or not whole:
            fresh = (i % size == 0) | (i == order)
            value = bits.take(place, width)
            escape = fresh & (value == (np.int64(1) << width) - 1)
            place = np.where(fresh, place + width, place)
            k = np.where(fresh, value, k)
            escaped = np.where(escape, bits.take(place, 5), np.where(fresh, 0, escaped))
            place = np.where(escape, place + 5, place)
            k = np.where(escape, -1, k)
            flat_any = bool((k < 0).any())
        if flat_any:
            flat, coded = k < 0, k >= 0
            n = escaped[flat]
            own[i, flat] = np.where(n > 0, _signed(bits.take(place[flat], n), np.maximum(n, 1)), 0)
            place = place.copy()
            place[flat] += n
            own[i, coded], place[coded] = _rice(bits, place[coded], k[coded])
        else:
            own[i], place = _rice(bits, place, k)
    return place


def _layout(stream: bytes) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """Place of the first frame, samples, MD5 and seek points of a stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info, seek = 4, False, b"", []
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the stream ends within its metadata")
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        own = stream[at + 4 : at + 4 + n]
        if kind == 0:
            info = own
        elif kind == 3:
            seek = [struct.unpack(">QQ", own[i : i + 16]) for i in range(0, n, 18)]
        at += 4 + n
    return at, int.from_bytes(info[10:18], "big") & (1 << 36) - 1, info[18:34], seek


def _frame_starts(stream: bytes, at: int, count: int) -> np.ndarray:
    """Where frames begin, taking each header at its first place: right unless a frame holds the next one's header by chance."""
    starts, i = [], at
    while len(starts) < count:
        want = _header(len(starts))
        if not stream.startswith(want, i):
            i = stream.find(want, i)
            if i < 0:
                raise ValueError("a frame is missing, or its header is wrong")
        starts.append(i)
        i += len(want) + 4
    return np.array(starts, np.int64)


def _checked_starts(stream: bytes, at: int, first: int, count: int, last: bool = True) -> list[int]:
    """Where frames ``first`` and up begin, and where the last of them ends.

    A frame goes on to the next header before which its CRC-16 is right, so chance matches are passed over. The end
    of the stream is the end of the ``last`` frame.
    """
    starts = [at]
    if not stream.startswith(_header(first), at):
        raise ValueError("a frame is missing, or its header is wrong")
    for n in range(first + 1, first + count + 1):
        begin = end = starts[-1]
        crc, done = 0, begin
        while True:
            end = len(stream) if last and n == first + count else stream.find(_header(n), max(end + 1, begin + 8))
            if end < 0:
                raise ValueError("a frame is missing, or its header or checksum is wrong")
            for byte in stream[done : end - 2]:
                crc = (crc << 8 & 0xFFFF) ^ int(_CRC16[crc >> 8 ^ byte])
            done = max(done, end - 2)
            if crc == int.from_bytes(stream[end - 2 : end], "big"):
                break
            if end == len(stream):
                raise ValueError("the checksum of a frame is wrong")
        starts.append(end)
    return starts


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams; checksums of headers, frames and samples are verified.

    Where they fail, frames are looked for once more with their checksums, so that a frame that holds the header of the
    next by chance is read, and only a damaged stream raises.
    """
    layouts = [_layout(s) for s in streams]
    try:
        return _decoded(streams, [_frame_starts(s, at, samples // BLOCK) for s, (at, samples, _, _) in zip(streams, layouts, strict=True)], layouts)
    except ValueError:
        starts = [np.array(_checked_starts(s, at, 0, samples // BLOCK)[:-1], np.int64) for s, (at, samples, _, _) in zip(streams, layouts, strict=True)]
        return _decoded(streams, starts, layouts)


def _decoded(streams: list[bytes], own_starts: list[np.ndarray], layouts: list[tuple]) -> list[bytes]:
    starts, counts, sums, base = [], [], [], 0
    for s, own, (_, _, md5, _) in zip(streams, own_starts, layouts, strict=True):
        starts.append(np.append(own, len(s)) + base)
        counts.append(len(own))
        sums.append(md5)
        base += len(s)
    data = b"".join(streams)
    first = np.concatenate([s[:-1] for s in starts]) if starts else np.zeros(0, np.int64)
    sizes = np.concatenate([np.diff(s) for s in starts]) if starts else np.zeros(0, np.int64)
    out = []
    for at in range(0, len(first), STEP_FRAMES):
        a, n = first[at : at + STEP_FRAMES], sizes[at : at + STEP_FRAMES]
        low, high = int(a[0]), int(a[-1] + n[-1])
        out.append((decode_frames(data[low:high], a - low, n) + 128).astype(np.uint8).tobytes())
    pcm, found, done = b"".join(out), [], 0
    for n, md5 in zip(counts, sums, strict=True):
        own = pcm[done * BLOCK : (done + n) * BLOCK]
        if hashlib.md5((np.frombuffer(own, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the MD5 of the samples is wrong")
        found.append(own)
        done += n
    return found


def read_from(stream: bytes, sample: int, blocks: int = 1) -> list[tuple[int, bytes]]:
    """Up to ``blocks`` PCM blocks from the one that holds ``sample``: (offset of the first sample, bytes).

    Decoding starts at the nearest seek point, not at the start of the stream.
    """
    at, samples, _, seek = _layout(stream)
    frame = sample // BLOCK
    known, offset = max(((s, o) for s, o in seek if s <= sample), default=(0, 0))
    total, first = samples // BLOCK, known // BLOCK
    last = min(frame + blocks, total)
    if frame >= last:
        return []
    places = _checked_starts(stream, at + offset, first, last - first, last == total)
    starts, ends = list(enumerate(places[:-1], first)), places[1:]
    own = [(k, s, e) for (k, s), e in zip(starts, ends, strict=False) if frame <= k < last]
    if not own:
        return []
    a, b = np.array([s for _, s, _ in own]), np.array([e for _, _, e in own])
    pcm = (decode_frames(stream, a, b - a) + 128).astype(np.uint8)
    return [(k * BLOCK, pcm[j].tobytes()) for j, (k, _, _) in enumerate(own)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and those padded with 255 to a positive multiple of 576."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def features(pcm: bytes) -> str:
    """Mean, root mean square and zero crossings of the samples, as text."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return f"mean={x.mean():.6f};rms={np.sqrt(np.square(x, dtype=np.int64).mean()):.6f};crossings={crossings}"


def _steps(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        first, held, rows = 0, 0, []
        values = batch.column(column)
        for i in range(len(values)):
            rows.append(values[i].as_py())
            held += len(rows[-1] or b"")
            if held >= most:
                yield batch.slice(first, len(rows)), rows
                first, held, rows = i + 1, 0, []
        if rows:
            yield batch.slice(first, len(rows)), rows


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _steps(batches, 1, 2_000_000):
            sizes, payloads = zip(*map(payload_of, texts), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(encode_many(list(payloads)), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of each stream, from its decoded samples."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, streams in _steps(batches, 2, 1_500_000):
            pcm = decode_many(streams)
            columns = [
                pa.array([len(p) for p in pcm], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in pcm]),
                pa.array([zlib.crc32(p[-32:]) for p in pcm], pa.int64()),
                pa.array([len(s) for s in streams], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                pa.array([features(p) for p in pcm]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return media.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def pcm_blocks(media: DataFrame, frames: int = SEEK_FRAMES) -> DataFrame:
    """(doc_id, sample_offset, pcm): the decoded samples in blocks that start at their sample offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, streams in _steps(batches, 2, 1_500_000):
            rows = [(k, i, p[i : i + frames * BLOCK]) for k, p in zip(batch.column(0).to_pylist(), decode_many(streams), strict=True) for i in range(0, len(p), frames * BLOCK)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int64()), pa.array(list(columns[2]), pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    return media.mapInArrow(run, "doc_id bigint, sample_offset bigint, pcm binary")


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(with_media(documents(spark, sf_dir)))

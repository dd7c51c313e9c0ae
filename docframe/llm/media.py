"""Media columns: FLAC with Rice residuals and linear predictors, encoded and decoded in batches.

``encode`` stores a text's bytes, padded, as 8-bit mono samples in FLAC frames of
192 samples.  Each frame is a constant, or the residual of a fixed predictor of
order 0 to 2 or of a quantised linear predictor of order 4, whichever is least,
as Rice codes.  A stream holds STREAMINFO with the MD5 of its samples and a seek
table with a point for every ``SEEK_FRAMES`` frames.

``decode`` finds the frames by sync code, header checksum and frame number,
verifies the CRC-16 of each, and decodes all frames of a batch in step: one
sample of every frame at a time.  It reads constant, verbatim, fixed and linear
subframes, both Rice methods, partitions and escapes, of mono 8-bit streams of
fixed block size.  The MD5 of the samples must agree.  ``pcm_blocks`` gives the
samples in blocks with their sample offsets and the bytes to seek to.

Samples are the payload's bytes in offset binary (as 8-bit PCM commonly is), so
that the PCM read back is the payload.  Null and empty texts are one frame of
blanks.  Equal texts give equal streams.  Everything happens within a row, a bounded
number of frames at a time, so that a very long text needs a few times its own
bytes.  ``encode`` reads doc_id and text only; ``decode`` carries other columns
along and replaces those named as its own.  A stream that is null or can't be
decoded gives null samples and says why in ``error``; the others of its batch are
decoded.  Repeated rows are stored one by one; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import by_slices, list_column

BLOCK = 192
SEEK_FRAMES = 64
RATE = 8000
ORDER, PRECISION, SHIFT = 4, 8, 6
SLICE = 1 << 20
#: Frames that are coded at a time.
CHUNK = 4096
#: Coefficients of the fixed predictors, as the format defines them.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ polynomial, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-16 of each byte range, all ranges in step."""
    order = np.argsort(-sizes, kind="stable")
    at, crc = starts[order], np.zeros(len(starts), np.int64)
    remaining = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
    for step, live in enumerate(remaining):
        part = crc[:live]
        crc[:live] = CRC16[(part >> 8) ^ data[at[:live] + step]] ^ (part << 8 & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def payloads(data: np.ndarray, off: np.ndarray, unit: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with blanks to a positive multiple of ``unit`` bytes: bytes and offsets."""
    sizes = np.diff(off)
    padded = np.maximum(-(-sizes // unit), 1) * unit
    at = np.concatenate([[0], np.cumsum(padded)])
    out = np.full(at[-1], 0x20, np.uint8)
    out[K.ranges_of(at[:-1], sizes)] = data
    return out, at


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantised linear predictors of order ``ORDER`` of each row, by Levinson's recursion."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : BLOCK - k]).sum(axis=1) for k in range(ORDER + 1)], axis=1)
    a = np.zeros((len(x), ORDER))
    error = r[:, 0] * 1.000001 + 1e-3
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = error * (1 - k * k)
    return np.clip(np.round(a * (1 << SHIFT)), -128, 127).astype(np.int32)


def _residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, predictors, residual) of each frame; kinds 0..2 fixed orders, 3 linear, 4 constant."""
    q = _predictors(x)
    tries = [x.copy() for _ in range(4)]
    tries[1][:, 1:] = x[:, 1:] - x[:, :-1]
    tries[2][:, 2:] = x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]
    guess = sum(q[:, i : i + 1] * x[:, ORDER - 1 - i : BLOCK - 1 - i] for i in range(ORDER))
    tries[3][:, ORDER:] = x[:, ORDER:] - (guess >> SHIFT)
    cost = np.stack([np.abs(t[:, ORDER:]).sum(axis=1) for t in tries], axis=1)
    cost[:, 3] += 40
    kind = np.argmin(cost, axis=1)
    residual = np.choose(kind[:, None], tries)
    kind[(x == x[:, :1]).all(axis=1)] = 4
    return kind, q, residual


def encode_frames(payload: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of a payload, their bytes and offsets; ``number`` is each frame's number in its stream."""
    x = (payload ^ 0x80).view(np.int8).reshape(-1, BLOCK).astype(np.int32)
    n = len(x)
    kind, q, residual = _residuals(x)
    order = np.array([0, 1, 2, ORDER, 0])[kind]
    code = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    open_ = np.arange(BLOCK) >= order[:, None]
    code[~open_] = 0
    bits = np.stack([(code >> k).sum(axis=1) + (k + 1) * (BLOCK - order) for k in range(10)], axis=1)
    k = np.argmin(bits, axis=1)
    constant = kind == 4
    value = np.zeros((n, 11 + BLOCK), np.int64)
    size = np.zeros((n, 11 + BLOCK), np.int64)
    value[:, 0], size[:, 0] = np.where(constant, 0, np.where(kind == 3, 0b100000 | (ORDER - 1), 0b001000 | order)) << 1, 8
    for i in range(ORDER):
        value[:, 1 + i], size[:, 1 + i] = x[:, i] & 0xFF, np.where(order > i, 8, 0)
        value[:, 6 + i], size[:, 6 + i] = q[:, i] & 0xFF, np.where(kind == 3, PRECISION, 0)
    size[constant, 1] = 8
    value[:, 5], size[:, 5] = (PRECISION - 1) << 5 | SHIFT, np.where(kind == 3, 9, 0)
    value[:, 10], size[:, 10] = k, np.where(constant, 0, 10)
    value[:, 11:] = (1 << k[:, None]) | (code & ((1 << k[:, None]) - 1))
    size[:, 11:] = np.where(open_ & ~constant[:, None], (code >> k[:, None]) + k[:, None] + 1, 0)
    value[size == 0] = 0

    head = np.zeros((n, 11), np.int64)
    head[:, 0], head[:, 1], head[:, 2], head[:, 3] = 0xFF, 0xF8, 0x14, 0x02  # 192 samples, 8 kHz, mono, 8 bits
    extra = (number >= 0x80).astype(int) + (number >= 0x800) + (number >= 0x10000) + (number >= 0x200000) + (number >= 0x4000000)
    for i in range(6):
        left = extra - i
        first = np.where(extra == 0, number, ((0xFF00 >> (extra + 1)) & 0xFF) | (number >> (6 * extra)))
        head[:, 4 + i] = first if i == 0 else np.where(left >= 0, 0x80 | (number >> (6 * np.maximum(left, 0)) & 0x3F), 0)
    crc = np.zeros(n, np.int64)
    for i in range(10):
        crc = np.where(i < 5 + extra, CRC8[crc ^ head[:, i]], crc)
    head_size = 6 + extra
    head[np.arange(n), head_size - 1] = crc

    body = -(-size.sum(axis=1) // 8)
    at = np.concatenate([[0], np.cumsum(head_size + body + 2)])
    out = np.zeros(at[-1] + 3, np.uint8)
    for i in range(11):
        has = i < head_size
        out[at[:-1][has] + i] = head[has, i]
    ends = (at[:-1] + head_size)[:, None] * 8 + np.cumsum(size, axis=1)
    live = size > 0
    ends, value = ends[live], value[live] << (-ends[live] & 7)
    last = (ends - 1) >> 3
    for back in range(3):
        piece = (value >> (8 * back)) & 0xFF
        some = piece > 0
        np.add.at(out, last[some] - back, piece[some].astype(np.uint8))
    total = crc16(out, at[:-1], np.diff(at) - 2)
    out[at[1:] - 2], out[at[1:] - 1] = total >> 8, total & 0xFF
    return out[: at[-1]], at


def streams(payload: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A FLAC stream for each payload."""
    counts = np.diff(off) // BLOCK
    number = K.ranges_of(np.zeros(len(counts), np.int64), counts)
    parts = [encode_frames(payload[a * BLOCK : (a + CHUNK) * BLOCK], number[a : a + CHUNK]) for a in range(0, len(number), CHUNK)]
    data = np.concatenate([np.zeros(0, np.uint8), *(p for p, _ in parts)])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(a) for _, a in parts)]))])
    first = np.concatenate([[0], np.cumsum(counts)])
    signed = payload ^ 0x80
    out = []
    for i, n in enumerate(counts.tolist()):
        a, b = int(first[i]), int(first[i + 1])
        sizes = np.diff(at[a : b + 1])
        points = range(0, n, SEEK_FRAMES)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(signed[off[i] : off[i + 1]].tobytes()).digest()
        seek = b"".join(struct.pack(">QQH", p * BLOCK, int(at[a + p] - at[a]), BLOCK) for p in points)
        out.append(b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + data[at[a] : at[b]].tobytes())
    return out


class Bits:
    """Bit fields of many positions at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(data) + 8
        self.window = np.zeros(n, np.uint64)
        for i in range(8):
            self.window |= padded[i : i + n] << np.uint64(56 - 8 * i)

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.window[np.minimum(place >> 3, len(self.window) - 1)] << (place & 7).astype(np.uint64)

    def read(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        size = np.asarray(size)
        wide = np.clip(64 - size, 0, 63).astype(np.uint64)
        return np.where(size > 0, self.at(place) >> wide, 0).astype(np.int64)

    def zeros(self, place: np.ndarray) -> np.ndarray:
        """How many zero bits come before the next one bit."""
        out = np.zeros(len(place), np.int64)
        live, at = np.arange(len(place)), place
        while len(live):
            top = (self.at(at) >> np.uint64(32)).astype(np.int64)
            lead = 32 - np.frexp(top.astype(np.float64))[1]
            out[live] += lead
            more = (top == 0) & (at >> 3 < len(self.window) - 1)
            live, at = live[more], at[more] + 32
        return out


def _signed(v: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = 1 << (np.maximum(bits, 1) - 1)
    return (v ^ half) - half


def decode_frames(bits: Bits, place: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Samples of the subframes that start at each bit; blocks are of ``block`` samples at most 65535."""
    n, width = len(place), int(block.max(initial=0))
    head = bits.read(place, 8)
    kind = head >> 1 & 0x3F
    if (head & 0x81).any():
        raise ValueError("subframes with wasted or reserved bits are not supported")
    place = place + 8
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    verbatim, constant = kind == 1, kind == 0
    if not (linear | fixed | verbatim | constant).all():
        raise ValueError("reserved subframe type")
    order = np.where(linear, (kind & 31) + 1, np.where(fixed, kind - 8, 0))
    most = max(1, int(order.max(initial=0)))
    x = np.zeros((n, width), np.int64)
    warm = np.where(constant, 1, order)
    for i in range(int(warm.max(initial=0))):
        has = warm > i
        x[has, i] = _signed(bits.read(place[has], 8), 8)
        place = place + 8 * has
    x[constant] = x[constant, :1]
    coefficient, shift = np.zeros((n, most), np.int64), np.zeros(n, np.int64)
    for o, c in enumerate(FIXED):
        if c and (rows := fixed & (order == o)).any():
            coefficient[rows, :o] = c
    precision = np.where(linear, bits.read(place, 4) + 1, 0)
    place = place + 4 * linear
    shift[linear] = _signed(bits.read(place[linear], 5), 5)
    place = place + 5 * linear
    for i in range(most):
        has = linear & (order > i)
        coefficient[has, i] = _signed(bits.read(place[has], precision[has]), precision[has])
        place = place + precision * has
    coded = linear | fixed
    method, partitions = bits.read(place, 2), bits.read(place + 2, 4)
    if (method[coded] > 1).any():
        raise ValueError("reserved residual coding")
    place = place + 6 * coded
    part = np.where(coded, block >> partitions, 1)
    wide = np.where(method == 0, 4, 5)
    parameter, raw = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(width):
        inside = i < block
        spelled = np.flatnonzero(verbatim & inside)
        if len(spelled):
            x[spelled, i] = _signed(bits.read(place[spelled], 8), 8)
            place[spelled] += 8
        rows = np.flatnonzero(coded & inside & (i >= order))
        if not len(rows):
            continue
        fresh = rows[(i == order[rows]) | (i % part[rows] == 0)]
        if len(fresh):
            parameter[fresh] = bits.read(place[fresh], wide[fresh])
            place[fresh] += wide[fresh]
            escaped = fresh[parameter[fresh] == (1 << wide[fresh]) - 1]
            raw[fresh] = 0
            if len(escaped):
                raw[escaped] = bits.read(place[escaped], 5)
                place[escaped] += 5
                parameter[escaped] = -1
        p, at = parameter[rows], place[rows]
        if (p < 0).any():
            plain = p < 0
            zeros = np.where(plain, 0, bits.zeros(at))
            low = np.where(plain, raw[rows], p)
            skip = np.where(plain, 0, zeros + 1)
            v = bits.read(at + skip, low)
            code = (zeros << np.maximum(p, 0)) | v
            r = np.where(plain, np.where(low > 0, _signed(v, low), 0), (code >> 1) ^ -(code & 1))
        else:
            zeros = bits.zeros(at)
            skip, low = zeros + 1, p
            code = (zeros << p) | bits.read(at + skip, p)
            r = (code >> 1) ^ -(code & 1)
        place[rows] = at + skip + low
        depth = min(most, i)
        if depth:
            guess = (coefficient[rows, :depth] * x[rows, i - depth : i][:, ::-1]).sum(axis=1) >> shift[rows]
            r = r + guess
        x[rows, i] = r
    return x


def decode_streams(media: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """(PCM in offset binary, seek points (sample, byte)) of each stream."""
    data = np.frombuffer(b"".join(media), np.uint8)
    ends = np.cumsum([len(m) for m in media])
    starts = ends - [len(m) for m in media]
    infos, frames_at, seeks = [], [], []
    for m, base in zip(media, starts.tolist(), strict=True):
        if m[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, info, seek = 4, False, None, []
        while not last:
            last, kind, size = bool(m[at] & 0x80), m[at] & 0x7F, int.from_bytes(m[at + 1 : at + 4], "big")
            body = m[at + 4 : at + 4 + size]
            if kind == 0:
                fields = int.from_bytes(body[10:18], "big")
                info = (int.from_bytes(body[:2], "big"), fields & ((1 << 36) - 1), body[18:34])
                if fields >> 41 & 7 or (fields >> 36 & 31) != 7:
                    raise ValueError("only mono 8-bit streams are supported")
            elif kind == 3:
                seek = [struct.unpack(">QQ", body[i : i + 16]) for i in range(0, size, 18)]
            at += 4 + size
        infos.append(info)
        frames_at.append(base + at)
        seeks.append([(s, o + at) for s, o in seek])
    frames_at = np.array(frames_at)
    sync = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))
    stream = np.searchsorted(ends, sync, "right")
    sync, stream = sync[sync >= frames_at[stream]], stream[sync >= frames_at[stream]]
    padded = np.concatenate([data, np.zeros(32, np.uint8)]).astype(np.int64)
    first = padded[sync + 4]
    extra = np.where(first < 0x80, 0, np.where(first < 0xE0, 1, np.where(first < 0xF0, 2, np.where(first < 0xF8, 3, np.where(first < 0xFC, 4, 5)))))
    number = np.where(extra == 0, first, first & (0x3F >> extra))
    for i in range(1, 6):
        number = np.where(i <= extra, number << 6 | padded[sync + 4 + i] & 0x3F, number)
    code = padded[sync + 2] >> 4
    tail = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    rate = padded[sync + 2] & 15
    size = 5 + extra + tail + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    crc = np.zeros(len(sync), np.int64)
    for i in range(int(size.max(initial=0))):
        crc = np.where(i < size, CRC8[crc ^ padded[sync + i]], crc)
    after = 5 + extra
    block = np.choose(np.clip(code, 0, 8), [0, 192, 576, 1152, 2304, 4608, padded[sync + after] + 1, (padded[sync + after] << 8 | padded[sync + after + 1]) + 1, 256])
    block = np.where(code > 8, 256 << np.maximum(code - 8, 0), block)
    good = crc == padded[sync + size]
    sync, stream, number, block, size = (v[good] for v in (sync, stream, number, block, size))
    need = np.array([-(-i[1] // i[0]) for i in infos])
    base = np.concatenate([[0], np.cumsum(need)])

    def follow(only: np.ndarray) -> np.ndarray:
        """Frames in order: each runs to the next header with the number due, and its CRC-16 agrees."""
        chosen = []
        for s in only.tolist():
            mine = np.flatnonzero(stream == s).tolist()
            due, open_ = 0, None
            for c in [*mine, None]:
                end = int(ends[s]) if c is None else int(sync[c])
                if c is not None and number[c] != due:
                    continue
                if open_ is not None:
                    a = int(sync[open_])
                    if end - a < 3 or int(crc16(data, np.array([a]), np.array([end - a - 2]))[0]) != int(data[end - 2]) << 8 | int(data[end - 1]):
                        if c is None:
                            raise ValueError("frame checksum mismatch")
                        continue
                    chosen.append(open_)
                open_, due = c, due + 1
        return np.array(chosen, np.int64)

    exact = (np.bincount(stream, minlength=len(media)) == need) & (np.bincount(stream, weights=number == np.arange(len(number)) - base[stream] if len(number) == base[-1] else number * 0, minlength=len(media)) == need)
    if not exact.all():
        keep = follow(np.arange(len(media)))
        sync, stream, number, block, size = (v[keep] for v in (sync, stream, number, block, size))
        if len(sync) != base[-1]:
            raise ValueError("frames are missing")
    stop = np.concatenate([sync[1:], [len(data)]])
    stop = np.where(np.concatenate([stream[1:] != stream[:-1], [True]]), ends[stream], stop) if len(sync) else stop
    if (crc16(data, sync, stop - sync - 2) != (padded[stop - 2] << 8 | padded[stop - 1])).any():
        keep = follow(np.arange(len(media)))  # a header within a frame's data took a frame's place
        sync, stream, block, size = (v[keep] for v in (sync, stream, block, size))
    stop = np.concatenate([sync[1:], [len(data)]])
    pieces = [np.zeros(0, np.uint8)]
    for a in range(0, len(sync), CHUNK):
        mine, begin = slice(a, a + CHUNK), sync[a]
        x = decode_frames(Bits(data[begin : stop[mine][-1]]), (sync[mine] + size[mine] + 1 - begin) * 8, block[mine])
        pieces.append((x.astype(np.int8).view(np.uint8) ^ 0x80)[np.arange(x.shape[1]) < block[mine][:, None]])
    flat = np.concatenate(pieces)
    at = np.concatenate([[0], np.cumsum(np.bincount(stream, weights=block, minlength=len(media)))]).astype(np.int64)
    pcm = []
    for i, info in enumerate(infos):
        got = flat[at[i] : at[i + 1]][: info[1]]
        if hashlib.md5((got ^ 0x80).tobytes()).digest() != info[2]:
            raise ValueError("samples don't match the stream's MD5")
        pcm.append(got.tobytes())
    return pcm, seeks


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row: its text as a FLAC stream."""

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off)), pa.array(streams(*payloads(data, off)), pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", work, f"doc_id {kind}, n_bytes bigint, media binary", SLICE)


def _each(media: list[bytes | None]) -> tuple[list[bytes | None], list[list[tuple[int, int]]], list[str | None]]:
    """Samples, seek points and errors of streams of which some may be null or broken."""
    try:
        if all(m is not None for m in media):
            pcm, seeks = decode_streams(media)
            return pcm, seeks, [None] * len(media)
    except _BROKEN:
        pass
    out: tuple[list, list, list] = ([], [], [])
    for m in media:
        try:
            if m is None:
                raise ValueError("no stream")
            (pcm,), (seek,) = decode_streams([m])
            one = (pcm, seek, None)
        except _BROKEN as e:
            one = (None, [], f"{type(e).__name__}: {e}")
        for values, value in zip(out, one, strict=True):
            values.append(value)
    return out


#: What a stream that isn't one, or is cut short, makes the decoder raise.
_BROKEN = (ValueError, IndexError, TypeError, OverflowError, ZeroDivisionError, struct.error)


def decode(media: DataFrame) -> DataFrame:
    """The rows with ``pcm``, the seek points, a feature string of the samples, and ``error`` where there are none."""

    def work(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        pcm, seeks, errors = _each(rows.column("media").to_pylist())
        points = [p for s in seeks for p in s]
        seek = pa.StructArray.from_arrays([pa.array([p[i] for p in points], pa.int64()) for i in (0, 1)], ["sample", "offset"])
        lists = list_column(seek, np.concatenate([[0], np.cumsum([len(s) for s in seeks])]).astype(np.int64))
        features: list[str | None] = []
        for p in pcm:
            if not p:
                features.append(None if p is None else "samples=0")
                continue
            s = np.frombuffer(p, np.uint8).astype(np.int16) - 128
            turns = int(((s[1:] > s.mean()) != (s[:-1] > s.mean())).sum())
            features.append(f"samples={len(s)};min={s.min()};max={s.max()};power={int((s.astype(np.int64) ** 2).sum()) // len(s)};turns={turns}")
        new = [pa.array(pcm, pa.binary()), lists, pa.array(features, pa.string()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*rows.schema.names, "pcm", "seek", "feature", "error"])

    media = media.drop("pcm", "seek", "feature", "error")
    schema = T.StructType([*media.schema.fields, *T._parse_datatype_string("pcm binary, seek array<struct<sample:bigint,offset:bigint>>, feature string, error string").fields])
    return by_slices(media, "media", work, schema, SLICE)


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, byte_offset, pcm): the samples between seek points."""
    rows = decoded.select("doc_id", "pcm", F.posexplode("seek").alias("block", "point"))
    return rows.select("doc_id", "block", F.col("point.sample").alias("sample_offset"), F.col("point.offset").alias("byte_offset"), F.expr(f"substring(pcm, int(point.sample + 1), {BLOCK * SEEK_FRAMES})").alias("pcm"))


def digest(docs: DataFrame) -> DataFrame:
    """Per row the sizes and digests of the payload read back and of the stored form."""
    got = decode(encode(docs))
    size = F.length("pcm")
    return got.select(
        "doc_id",
        "n_bytes",
        size.cast("bigint").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, length(pcm) - 15, 16)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

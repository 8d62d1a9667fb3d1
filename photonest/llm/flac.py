"""FLAC as a media column: encode samples to streams, decode and verify them, seek in them, write PCM blocks.

``Reader`` reads any stream of fixed or adaptive blocks with constant, verbatim, fixed-predictor or
LPC subframes, Rice or Rice2 residuals, wasted bits and all stereo modes; it checks the CRC-8 of frame
headers, the CRC-16 of frames and the MD5 of the samples. ``decode_many`` does the same for many mono
streams at once, frames side by side: a step of numpy takes the next Rice code, or the next sample behind
its linear predictor, of every frame. What it is not made for (several channels, partitions, no seek table)
goes to ``Reader``.

``encode_many`` writes mono blocks of ``BLOCK`` samples, each with the fixed predictor or the LPC one that
leaves the least residual, and a seek table with every frame, so that a reader finds any sample without
decoding what stands before it.

For texts: the UTF-8 bytes, filled with zero bytes to a positive multiple of 64, are unsigned 8-bit
samples (stored minus 128, as FLAC's are signed). Streams are decoded and verified into blocks of PCM,
written with the offset of each block's first sample; what is told of a text is read from those blocks.

A null text is empty. Memory is bounded by one document; repeated rows give equal streams. A damaged stream
raises an error. An empty table gives an empty one; other columns never take part.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from photonest.llm.common import map_texts, table, utf8
from photonest.session import materialize

BLOCK = 4096
RATE = 8000
UNIT = 64
LPC_ORDER = 4
#: Samples, or bytes of a stream, that are worked on side by side.
GROUP = 1 << 20


def _crc_table(poly: int, width: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        crc = (crc << 1) ^ np.where(crc >> (width - 1) & 1, poly, 0)
    return (crc & ((1 << width) - 1)).astype(np.uint16)


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)
_REACH = 4096


@lru_cache(maxsize=1)
def _crc16_by_place() -> np.ndarray:
    """CRC-16 of each byte value with so many zero bytes behind it; the checksum is linear."""
    out = np.empty((_REACH, 256), dtype=np.uint16)
    out[0] = _CRC16
    for i in range(1, _REACH):
        out[i] = (out[i - 1] << 8) ^ _CRC16[out[i - 1] >> 8]
    return out


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: bytes | np.ndarray) -> int:
    places, crc = _crc16_by_place(), 0
    data = np.frombuffer(data, dtype=np.uint8) if not isinstance(data, np.ndarray) else data
    for at in range(0, len(data), _REACH):
        part = data[at : at + _REACH]
        if crc:  # what came before enters with the first two bytes
            part = part.copy()
            part[0] ^= crc >> 8
            if len(part) > 1:
                part[1] ^= crc & 0xFF
        back = np.arange(len(part) - 1, -1, -1)
        carried = (crc << 8) & 0xFFFF if crc and len(part) == 1 else 0
        crc = int(np.bitwise_xor.reduce(places[back, part])) ^ carried
    return crc


def _frame_number(n: int) -> bytes:
    """A number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while n >= limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit = limit >> 1 if len(tail) > 1 else 0x20
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


@lru_cache(maxsize=1)
def _crc16_pairs() -> np.ndarray:
    """CRC-16 of every two bytes."""
    first = _CRC16[np.arange(1 << 16) >> 8]
    return ((first << 8) ^ _CRC16[(first >> 8) ^ (np.arange(1 << 16) & 0xFF).astype(np.uint16)]).astype(np.uint16)


def crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each run of bytes, two bytes of all runs at a time; zeros in front change nothing."""
    pairs = _crc16_pairs()
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    wide = -(-int(size.max(initial=0)) // 2)
    rows = np.zeros((len(size), 2 * wide), dtype=np.uint8)
    for i, f in enumerate(order.tolist()):
        rows[i, 2 * wide - size[f] :] = data[starts[f] : ends[f]]
    crc = np.zeros(len(size), dtype=np.uint16)
    active = np.searchsorted(-size[order], -2 * (wide - np.arange(wide)) + 1, side="right")  # runs that have begun
    for n, pair in zip(active.tolist(), np.ascontiguousarray(rows.view(">u2").T).astype(np.uint16), strict=True):
        crc[:n] = pairs[crc[:n] ^ pair[:n]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


#: What the linear predictor of each fixed order multiplies the samples before by, latest first.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
PRECISION = 12


def _back(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.zeros(n, dtype=x.dtype), x[: len(x) - n]])


def _predictors(x: np.ndarray, pos: np.ndarray, begin: np.ndarray, size: np.ndarray, lpc_order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each frame: fixed order or 8 for LPC, order, coefficients [frame, lag], shift."""
    frames, most = len(begin), max(4, lpc_order)
    lags = [_back(x, j + 1) for j in range(most)]

    def bits(residual: np.ndarray, order: int, head: int) -> np.ndarray:
        left = np.maximum(size - order, 1)
        mean = np.add.reduceat(np.where(pos >= order, np.abs(residual), 0), begin) / left
        return np.where(size > order, left * (np.log2(mean + 0.5) + 2) + head, np.inf)

    cost, diff = [], x
    for order in range(5):
        cost.append(bits(diff, order, 8 * order))
        diff = diff - _back(diff, 1)
    kind = np.argmin(cost, axis=0)
    least = np.min(cost, axis=0)
    order, shift = kind.copy(), np.zeros(frames, dtype=np.int64)
    coefficients = np.zeros((frames, most), dtype=np.int64)
    coefficients[:, :4] = np.array([[*f, *[0] * (4 - len(f))] for f in _FIXED])[kind]
    if lpc_order:
        real = x.astype(np.float64)
        auto = [np.add.reduceat(np.where(pos >= j, real * (lags[j - 1] if j else real), 0.0), begin) for j in range(lpc_order + 1)]
        a, error = np.zeros((lpc_order, frames)), np.maximum(auto[0], 1.0)
        for i in range(lpc_order):  # Levinson-Durbin for all frames
            k = (auto[i + 1] - sum(a[j] * auto[i - j] for j in range(i))) / error
            a[:i], a[i] = a[:i] - k * a[:i][::-1], k
            error = np.maximum(error * (1 - k * k), 1e-9)
        top = np.maximum(np.abs(a).max(axis=0), 1e-9)
        lpc_shift = np.clip(PRECISION - 2 - np.ceil(np.log2(top)), 0, 15).astype(np.int64)
        limit = 1 << (PRECISION - 1)
        rounded = np.clip(np.rint(a * (1 << lpc_shift)), -limit, limit - 1).astype(np.int64).T
        guess = sum(np.repeat(rounded[:, j], size) * lags[j] for j in range(lpc_order)) >> np.repeat(lpc_shift, size)
        better = bits(x - guess, lpc_order, (8 + PRECISION) * lpc_order + 9) < least
        kind[better], order[better], shift[better] = 8, lpc_order, lpc_shift[better]
        coefficients[better] = 0
        coefficients[better, :lpc_order] = rounded[better]
    return kind, order, coefficients, shift


def _frames(x: np.ndarray, begin: np.ndarray, size: np.ndarray, number: list[int], depth: int, lpc_order: int) -> list[bytes]:
    """The frames of samples ``x``, cut at ``begin`` into runs of ``size``."""
    pos = np.arange(len(x)) - np.repeat(begin, size)
    kind, order, coefficients, shift = _predictors(x, pos, begin, size, lpc_order)
    guess = sum(np.repeat(coefficients[:, j], size) * _back(x, j + 1) for j in range(coefficients.shape[1])) >> np.repeat(shift, size)
    residual = x - guess
    coded = pos >= np.repeat(order, size)
    folded = np.where(coded, (residual << 1) ^ (residual >> 63), 0)
    left = size - order
    mean = np.add.reduceat(folded, begin) / np.maximum(left, 1)
    low = np.maximum(0, np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64) - 1)
    tried = [np.minimum(14, low + i) for i in range(3)]
    sizes = [np.add.reduceat(folded >> np.repeat(k, size), begin) + left * (k + 1) for k in tried]
    pick = np.argmin(sizes, axis=0)
    rice, length = np.choose(pick, tried), np.choose(pick, sizes)
    same = np.minimum.reduceat(x, begin) == np.maximum.reduceat(x, begin)
    raw = ~same & (length + depth * order + 10 > depth * size)
    mask = (1 << depth) - 1
    heads, tails, spots, at = [], [], [], 0
    for f in range(len(begin)):
        first, n, o = int(begin[f]), int(size[f]), int(order[f])
        head = bytes([0xFF, 0xF8, 0x70, {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[depth] << 1]) + _frame_number(number[f]) + (n - 1).to_bytes(2, "big")
        head += bytes([crc8(head)])
        if same[f] or raw[f]:
            value, width = (2, 8) if raw[f] else (int(x[first]) & mask, 8 + depth)
        else:
            value, width = ((32 + o - 1) << 1, 8) if kind[f] == 8 else ((8 + o) << 1, 8)
            for v in x[first : first + o].tolist():
                value, width = value << depth | v & mask, width + depth
            if kind[f] == 8:
                value, width = value << 9 | (PRECISION - 1) << 5 | int(shift[f]), width + 9
                for c in coefficients[f, :o].tolist():
                    value, width = value << PRECISION | c & ((1 << PRECISION) - 1), width + PRECISION
            value, width = value << 10 | int(rice[f]), width + 10  # Rice with 4-bit parameters, one partition
        heads.append((at, head, value, width))
        spots.append(at + 8 * len(head) + width)
        end = spots[-1] + (0 if same[f] else depth * n if raw[f] else int(length[f]))
        tails.append((at >> 3, -(-end // 8)))
        at = tails[-1][1] * 8
    bits = np.zeros(at, dtype=np.uint8)
    for start, head, value, width in heads:
        more = -width % 8
        bits[start : start + 8 * len(head) + width] = np.unpackbits(np.frombuffer(head + (value << more).to_bytes((width + more) // 8, "big"), dtype=np.uint8))[: 8 * len(head) + width]
    for f in np.flatnonzero(raw).tolist():
        samples = x[begin[f] : begin[f] + size[f]]
        bits[spots[f] : spots[f] + depth * len(samples)] = (samples[:, None] >> np.arange(depth - 1, -1, -1) & 1).astype(np.uint8).ravel()
    use = coded & np.repeat(~same & ~raw, size)
    k = np.repeat(rice, size)
    width = np.where(use, (folded >> k) + 1 + k, 0)
    ends = np.cumsum(width)
    before = (ends - width)[begin]
    stop = (ends - 1 - k + np.repeat(np.array(spots, dtype=np.int64) - before, size))[use]
    folded, k = folded[use], k[use]
    bits[stop] = 1
    for b in range(int(k.max(initial=0))):
        if (k > b).all():
            bits[stop + 1 + b] = folded >> (k - 1 - b) & 1
        else:
            some = k > b
            bits[stop[some] + 1 + b] = folded[some] >> (k[some] - 1 - b) & 1
    packed = np.packbits(bits)
    starts, ends = np.array(tails, dtype=np.int64).reshape(-1, 2).T
    return [packed[a:b].tobytes() + int(c).to_bytes(2, "big") for a, b, c in zip(starts.tolist(), ends.tolist(), crc16_many(packed, starts, ends), strict=True)]


def encode_many(signals: list[np.ndarray], depth: int = 8, block: int = BLOCK, rate: int = RATE, lpc_order: int = LPC_ORDER) -> list[bytes]:
    """FLAC streams of signed mono signals of 8, 12, 16, 20 or 24 bits; ``lpc_order`` 0 leaves the fixed predictors."""
    cuts = [range(0, len(x), block) for x in signals]
    size = np.array([min(block, len(x) - at) for x, c in zip(signals, cuts, strict=True) for at in c], dtype=np.int64)
    frames: list[bytes] = []
    if len(size):
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in signals])
        number = [i for c in cuts for i in range(len(c))]
        ends = np.cumsum(size)
        parts = np.flatnonzero(np.diff(ends // GROUP, append=-1)) + 1  # groups of frames, for memory
        for lo, hi in zip([0, *parts[:-1].tolist()], parts.tolist(), strict=True):
            base = int(ends[lo] - size[lo])
            frames += _frames(flat[base : ends[hi - 1]], ends[lo:hi] - size[lo:hi] - base, size[lo:hi], number[lo:hi], depth, lpc_order)
    width, out, i = {8: 1, 12: 2, 16: 2, 20: 3, 24: 3}[depth], [], 0
    for x, c in zip(signals, cuts, strict=True):
        own, i = frames[i : i + len(c)], i + len(c)
        seek, offset = [], 0
        for at, frame in zip(c, own, strict=True):
            seek.append(at.to_bytes(8, "big") + offset.to_bytes(8, "big") + min(block, len(x) - at).to_bytes(2, "big"))
            offset += len(frame)
        raw = np.asarray(x).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        sizes = [len(f) for f in own] or [0]
        info = max(16, block).to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | (depth - 1) << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(raw).digest()
        table_bytes = b"".join(seek)
        blocks = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table_bytes).to_bytes(3, "big") + table_bytes
        out.append(b"fLaC" + blocks + b"".join(own))
    return out


def encode(samples: np.ndarray, depth: int = 8, block: int = BLOCK, rate: int = RATE, lpc_order: int = 0) -> bytes:
    """A FLAC stream of one signal."""
    return encode_many([samples], depth, block, rate, lpc_order)[0]


class Reader:
    """A FLAC stream in memory."""

    _BLOCKS = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
    _DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        self.data, at, last = data, 4, False
        self.seek_points: list[tuple[int, int, int]] = []
        while not last:
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.depth = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
                self.total, self.md5 = packed & (1 << 36) - 1, body[18:34]
                self.block = int.from_bytes(body[:2], "big")
            elif kind == 3:
                self.seek_points = [
                    (int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big"))
                    for i in range(0, size - 17, 18)
                ]
            at += 4 + size
        self.first = at
        self.latest: tuple[int, tuple[np.ndarray, int, int]] | None = None

    def frame(self, at: int) -> tuple[np.ndarray, int, int]:
        """The frame at byte ``at``; the latest one is kept."""
        if self.latest is None or self.latest[0] != at:
            self.latest = at, self._frame(at)
        return self.latest[1]

    def _head(self, at: int) -> tuple[int, int, int, int, int]:
        """Of the frame at byte ``at``: where its subframes begin, block size, channel mode, bits a sample, first sample number; verified."""
        data = self.data
        if data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
            raise ValueError("no frame here")
        adaptive = data[at + 1] & 1
        size_code, rate_code, mode, depth_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
        p = at + 4
        lead = data[p]
        extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
        number = lead if not extra else lead & (1 << (6 - extra)) - 1
        for b in data[p + 1 : p + 1 + extra]:
            number = number << 6 | b & 0x3F
        p += 1 + extra
        if size_code in (6, 7):
            n = int.from_bytes(data[p : p + size_code - 5], "big") + 1
            p += size_code - 5
        else:
            n = self._BLOCKS[size_code]
        p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
        if crc8(data[at:p]) != data[p]:
            raise ValueError("frame header does not match its checksum")
        return p + 1, n, mode, self._DEPTHS.get(depth_code, self.depth), number if adaptive else number * self.block

    def _frame(self, at: int) -> tuple[np.ndarray, int, int]:
        """Samples [channel, sample], first sample number and end of the frame at byte ``at``; verified."""
        data = self.data
        p, n, mode, depth, number = self._head(at)
        channels = mode + 1 if mode < 8 else 2
        points = [x for x in self._ends if x > p]
        # Without a seek table the bits of all that follows may have to be unpacked.
        limit = points[0] if points else len(data)
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=limit - p, offset=p))
        ones = np.flatnonzero(bits)
        below = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        out, b = [], 0
        for c in range(channels):
            wide = depth + (1 if mode == 8 and c == 1 or mode == 9 and c == 0 or mode == 10 and c == 1 else 0)
            x, b = self._subframe(bits, ones, below, b, n, wide)
            out.append(x)
        end = p + -(-b // 8)
        if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
            raise ValueError("frame does not match its checksum")
        if mode == 8:
            out[1] = out[0] - out[1]
        elif mode == 9:
            out[0] = out[0] + out[1]
        elif mode == 10:
            middle = (out[0] << 1) | (out[1] & 1)
            out = [(middle + out[1]) >> 1, (middle - out[1]) >> 1]
        return np.array(out), number, end + 2

    @property
    def _ends(self) -> list[int]:
        return [self.first + o for _, o, _ in self.seek_points] + [len(self.data)]

    @staticmethod
    def _number(bits: np.ndarray, at: int, width: int, signed: bool = True) -> int:
        value = int.from_bytes(np.packbits(np.concatenate([np.zeros(-width % 8, np.uint8), bits[at : at + width]])).tobytes(), "big") if width else 0
        return value - (1 << width) if signed and width and value >> (width - 1) else value

    @staticmethod
    def _numbers(bits: np.ndarray, at: int, count: int, width: int) -> np.ndarray:
        weight = 1 << np.arange(width - 1, -1, -1, dtype=np.int64)
        weight[0] = -weight[0]
        return bits[at : at + count * width].reshape(count, width).astype(np.int64) @ weight

    def _subframe(self, bits: np.ndarray, ones: np.ndarray, below: np.ndarray, b: int, n: int, depth: int) -> tuple[np.ndarray, int]:
        kind = self._number(bits, b + 1, 6, signed=False)
        wasted = 0
        b += 8
        if bits[b - 1]:
            wasted = int(ones[below[b]]) - b + 1
            b += wasted
            depth -= wasted
        if kind == 0:
            x, b = np.full(n, self._number(bits, b, depth), dtype=np.int64), b + depth
        elif kind == 1:
            x, b = self._numbers(bits, b, n, depth), b + n * depth
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm = self._numbers(bits, b, order, depth) if order else np.empty(0, np.int64)
            b += order * depth
            coefficients, shift = [], 0
            if kind >= 32:
                precision = self._number(bits, b, 4, signed=False) + 1
                shift = self._number(bits, b + 4, 5)
                b += 9
                coefficients = self._numbers(bits, b, order, precision).tolist()
                b += order * precision
            residual, b = self._residual(bits, ones, below, b, n, order)
            if coefficients:
                x = warm.tolist()
                for r in residual.tolist():
                    guess = sum(c * x[-1 - j] for j, c in enumerate(coefficients))
                    x.append((guess >> shift) + r)
                x = np.array(x, dtype=np.int64)
            else:
                x = residual
                for i in range(order, 0, -1):  # undo one difference after another
                    x = np.cumsum(np.concatenate([np.diff(warm, i - 1)[:1], x]))
        else:
            raise ValueError(f"subframe type {kind} is reserved")
        return x << wasted, b

    def _residual(self, bits: np.ndarray, ones: np.ndarray, below: np.ndarray, b: int, n: int, order: int) -> tuple[np.ndarray, int]:
        wide = 4 + self._number(bits, b, 2, signed=False)
        parts = 1 << self._number(bits, b + 2, 4, signed=False)
        b += 6
        out = []
        for i in range(parts):
            count = n // parts - (order if i == 0 else 0)
            k = self._number(bits, b, wide, signed=False)
            b += wide
            if k == (1 << wide) - 1:
                raw = self._number(bits, b, 5, signed=False)
                b += 5
                out.append(self._numbers(bits, b, count, raw) if raw else np.zeros(count, np.int64))
                b += raw * count
                continue
            if not count:
                continue
            base = int(below[b])
            room = ones[base : base + (count * 64 if parts > 1 else len(ones))]
            after = below[np.minimum(room + 1 + k, len(bits))] - base  # which one-bit ends the next code
            follow = after.tolist()
            walk, j = [0] * count, 0
            for t in range(count):
                walk[t] = j
                if j >= len(follow):
                    raise ValueError("residual runs past the frame")
                j = follow[j]
            stop = room[walk]
            begin = np.concatenate([[b], stop[:-1] + 1 + k])
            folded = (stop - begin) << k
            for t in range(k):
                folded |= bits[stop + 1 + t].astype(np.int64) << (k - 1 - t)
            out.append((folded >> 1) ^ -(folded & 1))
            b = int(stop[-1]) + 1 + k
        return np.concatenate(out) if out else np.empty(0, np.int64), b

    def blocks(self):
        """``(first sample, samples [channel, sample])`` of every frame in order."""
        at = self.first
        while at < len(self.data):
            x, start, at = self.frame(at)
            yield start, x

    def samples(self) -> np.ndarray:
        """All samples [channel, sample], held against the stream's MD5."""
        found = [x for _, x in self.blocks()]
        x = np.concatenate(found, axis=1) if found else np.empty((self.channels, 0), np.int64)
        width = -(-self.depth // 8)
        raw = np.ascontiguousarray(x.T).astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        if any(self.md5) and hashlib.md5(raw).digest() != self.md5:
            raise ValueError("samples do not match the stream's MD5")
        return x

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` samples from ``start`` on, decoding only the frames that hold them."""
        before = [(s, o) for s, o, _ in self.seek_points if s <= start]
        at = self.first + (before[-1][1] if before else 0)
        out: list[np.ndarray] = []
        while at < len(self.data) and sum(x.shape[1] for x in out) < count:
            x, first, at = self.frame(at)
            out.append(x[:, max(0, start - first) :])
        return np.concatenate(out, axis=1)[:, :count] if out else np.empty((self.channels, 0), np.int64)


class _Lane:
    """A mono subframe as ``decode_many`` takes it: where its codes begin, how many there are, and its predictor."""

    def __init__(self, reader: Reader, at: int, end: int, base: int) -> None:
        p, self.n, mode, depth, self.number = reader._head(at)
        head = int.from_bytes(reader.data[p : p + 128].ljust(128, b"\0"), "big")
        spot = 1024

        def take(width: int, signed: bool = False) -> int:
            nonlocal spot
            spot -= width
            value = head >> spot & (1 << width) - 1
            return value - (1 << width) if signed and value >> (width - 1) else value

        kind = take(7)
        self.plain = mode == 0 and not take(1)  # one channel, no wasted bits
        self.warm: list[int] = []
        self.coefficients: tuple[int, ...] = ()
        self.shift = self.rice = self.left = 0
        if kind == 0:
            self.warm = [take(depth, True)] * self.n
        elif kind == 1:
            self.plain = self.plain and depth == 8
            self.warm = np.frombuffer(reader.data, dtype=np.int8, count=self.n, offset=p + 1).tolist() if self.plain else []
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            if order * (depth + 16) + 40 > 1024:
                self.plain = False
                return
            self.warm = [take(depth, True) for _ in range(order)]
            self.coefficients = _FIXED[order] if kind < 32 else ()
            if kind >= 32:
                precision, self.shift = take(4) + 1, take(5, True)
                self.coefficients = tuple(take(precision, True) for _ in range(order))
            wide = 5 if take(2) else 4
            self.plain = self.plain and take(4) == 0 and self.shift >= 0
            self.rice = take(wide)
            self.plain = self.plain and self.rice <= 14
            self.left = self.n - order
        else:
            raise ValueError(f"subframe type {kind} is reserved")
        self.bit = 8 * (base + p - at) + 1024 - spot
        self.end = 8 * (base + end - at - 2)


def _rice_codes(data: np.ndarray, bit: np.ndarray, end: np.ndarray, left: np.ndarray, rice: np.ndarray) -> np.ndarray:
    """The residuals of all lanes, lane after lane; lanes stand in falling order of ``left``."""
    bits = np.unpackbits(data)
    ones = np.flatnonzero(bits)
    below = np.zeros(len(bits) + 1, dtype=np.int64)
    np.cumsum(bits, out=below[1:])
    steps = int(left.max(initial=0))
    active = np.searchsorted(-left, -np.arange(steps), side="left")
    stops = np.zeros((steps, len(left)), dtype=np.int64)
    skip, j = rice + 1, below[bit]
    try:
        for t, n in enumerate(active.tolist()):
            stops[t, :n] = ones[j[:n]]
            j = below[stops[t, :n] + skip[:n]]
    except IndexError:
        raise ValueError("residual runs past the frame") from None
    live = np.arange(steps)[:, None] < left
    begin = np.concatenate([bit[None, :], stops[:-1] + skip])[: max(steps, 1)] if steps else stops
    stop, begin, k = stops.T[live.T], begin.T[live.T], np.repeat(rice, left)
    if (stop + 1 + k > np.repeat(end, left)).any():
        raise ValueError("residual runs past the frame")
    at = stop + 1
    byte = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    window = byte[at >> 3] << 16 | byte[(at >> 3) + 1] << 8 | byte[(at >> 3) + 2]
    folded = (stop - begin) << k | window >> (24 - (at & 7) - k) & (1 << k) - 1
    return (folded >> 1) ^ -(folded & 1)


def _lanes(data: np.ndarray, lanes: list[_Lane]) -> list[np.ndarray]:
    """Samples of each lane."""
    order = sorted(range(len(lanes)), key=lambda i: -lanes[i].left)
    mine = [lanes[i] for i in order]
    left = np.array([x.left for x in mine], dtype=np.int64)
    residual = _rice_codes(data, *(np.array([getattr(x, c) for x in mine], dtype=np.int64) for c in ("bit", "end")), left, np.array([x.rice for x in mine], dtype=np.int64))
    # Behind a predictor, the samples of all lanes follow one another side by side.
    most = max((len(x.coefficients) for x in mine), default=0)
    steps = int(left.max(initial=0))
    x = np.zeros((most + steps, len(mine)), dtype=np.int64)
    x[most:].T[(np.arange(steps)[:, None] < left).T] = residual
    if most:
        weight = np.zeros((most, len(mine)), dtype=np.int64)
        for f, lane in enumerate(mine):
            n = len(lane.coefficients)
            if n:
                weight[most - n :, f] = lane.coefficients[::-1]
                x[most - n : most, f] = lane.warm
        shift = np.array([lane.shift for lane in mine], dtype=np.int64)
        active = np.searchsorted(-left, -np.arange(steps), side="left")
        for t, n in enumerate(active.tolist()):
            x[most + t, :n] += np.einsum("pf,pf->f", weight[:, :n], x[t : t + most, :n]) >> shift[:n]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(lanes)
    for f, (i, lane) in enumerate(zip(order, mine, strict=True)):
        out[i] = np.concatenate([np.array(lane.warm, dtype=np.int64), x[most : most + lane.left, f]])
    return out


def decode_many(streams: list[bytes]) -> list[tuple[Reader, list[tuple[int, np.ndarray]]]]:
    """Of each mono stream, verified: its reader, and ``(first sample, samples)`` of each frame."""
    readers = [Reader(x) for x in streams]
    out: list = [(r, []) for r in readers]
    todo: list[tuple[int, int, int]] = []

    def work() -> None:
        sizes = np.array([b - a for _, a, b in todo], dtype=np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(streams[i][a:b] for i, a, b in todo), dtype=np.uint8)
        told = data[ends - 2].astype(np.int64) << 8 | data[ends - 1]
        if (crc16_many(data, ends - sizes, ends - 2) != told).any():
            raise ValueError("frame does not match its checksum")
        lanes = [_Lane(readers[i], a, b, base) for (i, a, b), base in zip(todo, (ends - sizes).tolist(), strict=True)]
        good = [f for f, lane in enumerate(lanes) if lane.plain]
        found = dict(zip(good, _lanes(data, [lanes[f] for f in good]), strict=True))
        for f, (i, a, _) in enumerate(todo):
            out[i][1].append((lanes[f].number, found[f] if f in found else readers[i].frame(a)[0][0]))
        todo.clear()

    held = 0
    for i, r in enumerate(readers):
        ends = r._ends
        if r.channels != 1 or not r.seek_points and r.first < len(r.data):
            out[i] = (r, [(start, x[0]) for start, x in r.blocks()])
            continue
        for a, b in zip(ends, ends[1:]):  # noqa: B905
            if held + b - a > GROUP and todo:
                work()
                held = 0
            todo.append((i, a, b))
            held += b - a
    if todo:
        work()
    for r, blocks in out:
        width = -(-r.depth // 8)
        sums = hashlib.md5()
        for _, x in blocks:
            sums.update(x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
        if any(r.md5) and r.channels == 1 and sums.digest() != r.md5:
            raise ValueError("samples do not match the stream's MD5")
    return out


def payload(text: bytes) -> bytes:
    """The text's bytes, filled with zeros to a positive multiple of 64."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(df: DataFrame, lpc_order: int = LPC_ORDER) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's payload as a FLAC stream."""
    schema = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("media", BinaryType())])

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column("text"))
        media = encode_many([(np.frombuffer(payload(t), dtype=np.uint8) ^ 0x80).view(np.int8) for t in texts], lpc_order=lpc_order)
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t) for t in texts], "media": media}

    return map_texts(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema, limit=GROUP)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media_bytes, media_sha256, offsets, blocks)``: the decoded and verified streams.

    ``blocks`` are 8-bit unsigned PCM, ``offsets`` the places of their first samples, ascending, so that a sample is
    found without the blocks before it.
    """
    schema = StructType(
        [StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType())]
        + [StructField("offsets", ArrayType(LongType())), StructField("blocks", ArrayType(BinaryType()))]
    )

    def kernel(batch: pa.RecordBatch) -> dict:
        media = batch.column("media").to_pylist()
        found = [blocks for _, blocks in decode_many(media)]
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "media_bytes": list(map(len, media)),
            "media_sha256": [hashlib.sha256(x).hexdigest() for x in media],
            "offsets": [[start for start, _ in blocks] for blocks in found],
            "blocks": [[(x + 128).astype(np.uint8).tobytes() for _, x in blocks] for blocks in found],
        }

    return map_texts(media, kernel, schema, text="media", limit=GROUP)


def read_pcm(offsets: list[int], blocks: list[bytes], start: int, count: int) -> bytes:
    """``count`` samples from ``start`` on, from the blocks that hold them alone."""
    first = max(0, bisect_right(offsets, start) - 1)
    last = bisect_left(offsets, start + count)
    held = b"".join(blocks[first:last])
    return held[start - offsets[first] :][:count] if held else b""


def features(x: np.ndarray) -> str:
    """Of unsigned 8-bit samples: how many, mean, deviation, share of rises, greatest step."""
    step = np.diff(x.astype(np.int16))
    n = len(x)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.uint16) ** 2).sum(dtype=np.int64))
    sd = max(0.0, square / n - (total / n) ** 2) ** 0.5
    return f"n={n};mean={total / n:.4f};sd={sd:.4f};rises={int((step > 0).sum()) / (n - 1):.4f};step={int(np.abs(step).max())}"


def describe(pcm: DataFrame) -> DataFrame:
    """What the PCM blocks hold: the payload's digest, its last 64 bytes by seeking, and features."""
    schema = StructType(
        [StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType())]
        + [StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType())]
    )

    def kernel(batch: pa.RecordBatch) -> dict:
        out: dict = {f.name: [] for f in schema} | {c: batch.column(c) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")}
        for offsets, blocks in zip(batch.column("offsets").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            whole = b"".join(blocks)
            out["payload_bytes"].append(len(whole))
            out["payload_sha256"].append(hashlib.sha256(whole).hexdigest())
            out["tail_crc32"].append(zlib.crc32(read_pcm(offsets, blocks, len(whole) - UNIT, UNIT)))
            out["feature"].append(features(np.frombuffer(whole, dtype=np.uint8)))
        return out

    return map_texts(pcm, kernel, schema, text="media_sha256")


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(materialize(pcm_blocks(store(table(spark, sf_dir, "documents"))), "pcm-blocks"))

"""FLAC streams in a binary column: encode and decode PCM, with frame checksums and seekable sample offsets.

All frames of a batch advance together: a step decodes or packs one symbol of every frame by array operations.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, utf8

BLOCK = 512
RATE = 8000
#: Prediction from a sample's predecessors, nearest first, and the shift of the sum: the fixed predictors of order 0 to 2, and linear predictors.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
LPC = [([1, 1, 1, 1, 1, 1, 1, 1], 3), ([4, 3, 3, 2, 2, 1, 1], 4)]
_PRECISION = 5


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out[i] = c & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of many byte ranges, all ranges a byte further at each step."""
    table, out = (CRC8, np.zeros(len(begin), np.uint32)) if bits == 8 else (CRC16, np.zeros(len(begin), np.uint32))
    order = np.argsort(-(end - begin), kind="stable")
    size, at, value = (end - begin)[order], begin[order].copy(), out[order]
    live = len(size)
    for i in range(int(size[0]) if live else 0):
        while live and size[live - 1] <= i:
            live -= 1
        v, x = value[:live], raw[at[:live] + i]
        value[:live] = table[v ^ x] if bits == 8 else ((v << np.uint32(8)) & np.uint32(0xFFFF)) ^ table[(v >> np.uint32(8)) ^ x]
    out[order] = value
    return out


def _utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    more: list[int] = []
    width = next(w for w in range(2, 8) if n < 1 << (5 * w + 1))
    for _ in range(width - 1):
        more.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - width)) & 0xFF | n, *reversed(more)])


def _residual(x: np.ndarray, coef: list[int], shift: int) -> np.ndarray:
    """Samples less their predictions; x is frames x samples."""
    p, n = len(coef), x.shape[1]
    if not p:
        return x
    sum_ = x[:, p - 1 : n - 1] * np.int32(coef[0])
    for i, c in enumerate(coef[1:], 1):
        sum_ += x[:, p - 1 - i : n - 1 - i] * np.int32(c) if c != 1 else x[:, p - 1 - i : n - 1 - i]
    return x[:, p:] - (sum_ >> np.int32(shift))


def _zigzag(res: np.ndarray) -> np.ndarray:
    return (res << 1) ^ (res >> 31)


def encode_frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of 8-bit mono samples (frames x block, int32, -128..127): each a constant, verbatim, fixed or linear-prediction subframe.

    Of each predictor the size is estimated from the sum of its residuals; the best is packed where that beats plain samples. number: of each frame in its stream.
    """
    frames, block = x.shape
    best = np.full(frames, 8.0 * block)  # verbatim
    kind, rice, kept = np.ones(frames, np.int64), np.zeros(frames, np.int64), {}
    choices = {8 + order: (FIXED[order], 0) for order in (0, 1, 2)} | {32 + len(c) - 1: (c, shift) for c, shift in LPC}
    for type_, (coef, shift) in choices.items() if block > 16 else ():
        z = _zigzag(_residual(x, coef, shift))
        total, n = z.sum(1, dtype=np.int64), block - len(coef)
        k = np.clip(np.log2(np.maximum(total / n * 0.72, 1)).astype(np.int64), 0, 14)
        cost = 18 + 8 * len(coef) + (9 + _PRECISION * len(coef) if type_ >= 32 else 0)
        size = cost + n * (1.0 + k) + np.maximum((total - n * ((1 << k) - 1) / 2) / (1 << k), 0)
        better = size < best - 1
        best[better], kind[better], rice[better] = size[better], type_, k[better]
        kept[type_] = z
    kind[(x == x[:, :1]).all(1)] = 0
    out: list[bytes] = [b""] * frames
    numbers = number.tolist()
    for type_ in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == type_)
        if type_ == 0:
            body = [bytes([0, v & 0xFF]) for v in x[rows, 0].tolist()]
        elif type_ == 1:
            body = [b"\x02" + r.tobytes() for r in x[rows].astype(np.int8).view(np.uint8)]
        else:
            body = _pack(x[rows], rice[rows], type_, *choices[type_], kept[type_][rows])
        for r, b in zip(rows.tolist(), body):
            out[r] = _header(block, numbers[r]) + b
    joined = np.frombuffer(b"".join(out), np.uint8)
    end = np.cumsum([len(o) for o in out])
    sums = crc(joined, end - [len(o) for o in out], end, 16).tolist() if frames else []
    return [o + s.to_bytes(2, "big") for o, s in zip(out, sums)]


@functools.lru_cache(100_000)
def _header(block: int, number: int) -> bytes:
    head = b"\xff\xf8\x74\x02" + _utf8_number(number) + (block - 1).to_bytes(2, "big")
    c = 0
    for b in head:
        c = int(CRC8[c ^ b])
    return head + bytes([c])


def _pack(x: np.ndarray, rice: np.ndarray, type_: int, coef: list[int], shift: int, z: np.ndarray) -> list[bytes]:
    """Subframes of one predictor. Code lengths give each code its place; codes are disjoint bits, so bytes are sums of the codes that reach into them."""
    order, lpc = len(coef), type_ >= 32
    k = rice.astype(np.int32)[:, None]
    width = np.int32(1) + (z >> k) + k
    fixed: list[tuple[np.ndarray | int, int]] = [(type_ << 1, 8), *[(x[:, i] & 0xFF, 8) for i in range(order)]]
    if lpc:
        fixed += [(_PRECISION - 1, 4), (shift, 5), *[(c & ((1 << _PRECISION) - 1), _PRECISION) for c in coef]]
    fixed += [(0, 2), (0, 4), (rice, 4)]
    head = sum(w for _, w in fixed)
    end = head + np.cumsum(width, 1, dtype=np.int64)
    size = -(-end[:, -1] // 8)
    base = np.concatenate([[0], np.cumsum(size)])
    # the stop bit and the rest, k + 1 bits
    code = (np.int32(1) << k) | (z & ((np.int32(1) << k) - 1))
    start = end - 1 - k + base[:-1, None] * 8
    spots, values = [(start >> 3).ravel()], [(code.astype(np.int64) << (23 - k - (start & 7))).ravel()]
    at = base[:-1] * 8
    for v, w in fixed:
        spots.append(at >> 3)
        values.append(np.broadcast_to(np.asarray(v, np.int64), at.shape) << (24 - w - (at & 7)))
        at = at + w
    n = int(base[-1])
    acc = np.bincount(np.concatenate(spots), weights=np.concatenate(values), minlength=n + 2).astype(np.int64)
    data = acc[:n] >> 16
    data[1:] += (acc[: n - 1] >> 8) & 0xFF
    data[2:] += acc[: n - 2] & 0xFF
    packed, edges = data.astype(np.uint8).tobytes(), base.tolist()
    return [packed[i:j] for i, j in zip(edges[:-1], edges[1:])]


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream of each payload, its bytes less 128 as 8-bit mono samples; with STREAMINFO and a SEEKTABLE of every eighth frame."""
    todo: dict[int, list[tuple[int, int, int]]] = {}
    for d, p in enumerate(payloads):
        for n, s in enumerate(range(0, len(p), block)):
            todo.setdefault(min(block, len(p) - s), []).append((d, n, s))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    for size, places in todo.items():
        for i in range(0, len(places), 4096):
            some = places[i : i + 4096]
            x = np.frombuffer(b"".join(payloads[d][s : s + size] for d, _, s in some), np.uint8).reshape(-1, size).astype(np.int32) - 128
            number = np.array([n for _, n, _ in some])
            for (d, n, _), f in zip(some, encode_frames(x, number)):
                frames[d][n] = f
    out = []
    for p, fs in zip(payloads, frames):
        samples = len(p)
        pcm = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        sizes = [len(f) for f in fs] or [0]
        info = (
            max(16, min(block, samples) if len(fs) < 2 else block).to_bytes(2, "big") * 2
            + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
            + ((RATE << 44) | (0 << 41) | (7 << 36) | samples).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        )
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        points = b"".join((n * block).to_bytes(8, "big") + int(offsets[n]).to_bytes(8, "big") + min(block, samples - n * block).to_bytes(2, "big") for n in range(0, len(fs), 8))
        table = bytes([0x83]) + len(points).to_bytes(3, "big") + points
        out.append(b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + table + b"".join(fs))
    return out


class Corrupt(ValueError):
    pass


def metadata(stream: bytes) -> dict:
    """STREAMINFO, the seek points (sample, offset from the first frame, samples) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise Corrupt("no FLAC stream")
    at, out, last = 4, {"seek": []}, False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            out |= {"min_block": int.from_bytes(body[:2], "big"), "max_block": int.from_bytes(body[2:4], "big"), "rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size - 17, 18) if body[i : i + 8] != b"\xff" * 8]
        at += 4 + size
    return out | {"frames_at": at}


_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


class Frames:
    """Mono frames of many streams, decoded in step. raw: the streams joined; begin: first byte of each frame."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray, bits: np.ndarray):
        self.raw = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.wide = np.zeros(len(raw) + 8, np.uint64)
        for j in range(8):
            self.wide |= self.raw[j : j + len(self.wide)].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.begin, self.pos, self.depth = begin, begin * 8, bits
        self.begin_bits = self.pos

    def read(self, rows: np.ndarray | slice, width: np.ndarray | int) -> np.ndarray:
        """`width` (1 to 32) bits of each row, unsigned."""
        p = self.pos[rows]
        w = np.asarray(width, np.uint64)
        v = (self.wide[p >> 3] << (p & 7).astype(np.uint64)) >> (np.uint64(64) - w)
        self.pos[rows] = p + np.asarray(width, np.int64)
        return v.astype(np.int64)

    def signed(self, rows: np.ndarray | slice, width: np.ndarray | int) -> np.ndarray:
        v, w = self.read(rows, width), np.asarray(width, np.int64)
        return v - ((v >> (w - 1)) << w)

    def unary(self, rows: np.ndarray | slice) -> np.ndarray:
        """Zeros before the next one bit, which is read too."""
        p = self.pos[rows].copy()
        total = np.zeros(len(p), np.int64)
        todo = np.arange(len(p))
        while len(todo):
            q = p[todo]
            v = (self.wide[q >> 3] << (q & 7).astype(np.uint64)) >> np.uint64(8)  # 56 bits that are surely there
            have = v != 0
            _, e = np.frexp((v >> np.uint64(4)).astype(np.float64))  # 52 bits, exact
            small = (v >> np.uint64(4)) == 0
            zeros = np.where(small, 52, 52 - e)
            have &= ~small
            total[todo] += zeros
            p[todo] = q + zeros + have
            if (p[todo] > len(self.raw) * 8 - 64).any():
                raise Corrupt("a code runs past the stream")
            todo = todo[~have]
        self.pos[rows] = p
        return total

    def headers(self) -> None:
        rows = slice(None)
        if (self.read(rows, 15) != 0x7FFC).any():
            raise Corrupt("no frame where one is due")
        self.read(rows, 1)
        block, rate, channels, depth, _ = self.read(rows, 4), self.read(rows, 4), self.read(rows, 4), self.read(rows, 3), self.read(rows, 1)
        if channels.any():
            raise Corrupt("more than one channel")
        lead = self.read(rows, 8)
        more = np.zeros(len(lead), np.int64)
        for n in range(2, 8):
            more[lead >= ((0xFF << (8 - n)) & 0xFF)] = n - 1
        number = np.where(more == 0, lead, lead & ((1 << np.maximum(6 - more, 0)) - 1))
        for i in range(int(more.max()) if len(more) else 0):
            r = np.flatnonzero(more > i)
            number[r] = number[r] << 6 | self.read(r, 8) & 0x3F
        size = np.zeros(len(lead), np.int64)
        for code, n in _SIZES.items():
            size[block == code] = n
        for code, width in ((6, 8), (7, 16)):
            r = np.flatnonzero(block == code)
            size[r] = self.read(r, width) + 1
        for code, width in ((12, 8), (13, 16), (14, 16)):
            self.read(np.flatnonzero(rate == code), width)
        for code, n in _DEPTHS.items():
            self.depth = np.where(depth == code, n, self.depth)
        end = self.pos >> 3
        told = self.read(rows, 8)
        if (crc(self.raw, self.begin, end, 8) != told).any():
            raise Corrupt("a frame header's checksum differs")
        self.size, self.number = size, number

    def decode(self) -> np.ndarray:
        """Samples, frames x longest block; afterwards pos is behind each frame's checksum."""
        self.headers()
        every = np.arange(len(self.size))
        longest = int(self.size.max()) if len(every) else 0
        out = np.zeros((longest, len(every)), np.int64)  # a row per step
        if (self.read(slice(None), 1) != 0).any():
            raise Corrupt("a reserved bit is set")
        type_ = self.read(slice(None), 6)
        waste = np.zeros(len(every), np.int64)
        r = np.flatnonzero(self.read(slice(None), 1))
        waste[r] = self.unary(r) + 1
        depth = self.depth - waste
        r = np.flatnonzero(type_ == 0)
        if len(r):
            out[:, r] = self.signed(r, depth[r])
        r = np.flatnonzero(type_ == 1)
        for i in range(int(self.size[r].max()) if len(r) else 0):
            live = r[self.size[r] > i]
            out[i, live] = self.signed(live, depth[live])
        fixed, lpc = (type_ >= 8) & (type_ <= 12), type_ >= 32
        if (~(fixed | lpc | (type_ < 2))).any():
            raise Corrupt("a reserved subframe type")
        self._predicted(out, np.flatnonzero(fixed | lpc), np.where(lpc, type_ - 31, type_ - 8), lpc, depth)
        out <<= waste
        self.pos = -(-self.pos // 8) * 8
        end = self.pos >> 3
        told = self.read(slice(None), 16)
        if (crc(self.raw, self.begin, end, 16) != told).any():
            raise Corrupt("a frame's checksum differs")
        return out.T

    def _predicted(self, out: np.ndarray, rows: np.ndarray, order: np.ndarray, lpc: np.ndarray, depth: np.ndarray) -> None:
        """Subframes of fixed and linear predictors: warm-up, coefficients, all residuals in step, then the predictions by kind."""
        if not len(rows):
            return
        rows = rows[np.argsort(-self.size[rows], kind="stable")]  # so that the live ones are a prefix
        order, lpc, depth, size = order[rows], lpc[rows], depth[rows], self.size[rows]
        most = int(order.max())
        for i in range(most):
            r = np.flatnonzero(order > i)
            out[i, rows[r]] = self.signed(rows[r], depth[r])
        coef, shift = np.zeros((len(rows), most), np.int64), np.zeros(len(rows), np.int64)
        for o, c in FIXED.items():
            coef[np.flatnonzero(~lpc & (order == o))[:, None], np.arange(len(c))] = c
        r = np.flatnonzero(lpc)
        if len(r):
            precision = self.read(rows[r], 4) + 1
            shift[r] = self.signed(rows[r], 5)
            for i in range(int(order[r].max())):
                q = np.flatnonzero(order[r] > i)
                coef[r[q], i] = self.signed(rows[r[q]], precision[q])
        if (shift < 0).any():
            raise Corrupt("a negative shift")
        method = self.read(rows, 2)
        if (method > 1).any():
            raise Corrupt("a reserved residual coding")
        parts_ = self.read(rows, 4)
        res = self._residuals(rows, order, size, size >> parts_, 4 + method, bool(parts_.any()))
        kinds = np.concatenate([order[:, None], shift[:, None], coef], 1)
        _, kind = np.unique(kinds, axis=0, return_inverse=True)
        for v in range(int(kind.max()) + 1):
            these = np.flatnonzero(kind.ravel() == v)
            p, s, c = int(order[these[0]]), int(shift[these[0]]), coef[these[0]]
            x = res[:, these]
            x[:p] = out[:p, rows[these]]
            if p:
                taps = [(j, int(c[j])) for j in range(p) if c[j]]
                for i in range(p, int(size[these[0]])):
                    sum_ = np.zeros(len(these), np.int64)
                    for j, t in taps:
                        sum_ += x[i - 1 - j] if t == 1 else x[i - 1 - j] * t
                    x[i] += sum_ >> s
            out[:, rows[these]] = x

    def _residuals(self, rows: np.ndarray, order: np.ndarray, size: np.ndarray, part: np.ndarray, width: np.ndarray, parted: bool) -> np.ndarray:
        res = np.zeros((int(self.size.max()), len(rows)), np.int64)
        most, least = int(order.max()), int(order.min())
        k, plain_bits, plain = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64), False
        pos, live = self.pos[rows], len(rows)
        for i in range(least, int(size[0])):
            while live and size[live - 1] <= i:
                live -= 1
            if i <= most or parted:
                due = i == order[:live]
                if parted:
                    due |= (i > order[:live]) & (i % np.maximum(part[:live], 1) == 0)
                d = np.flatnonzero(due)
                if len(d):
                    self.pos[rows] = pos
                    k[d], plain_bits[d] = self.read(rows[d], width[d]), -1
                    e = d[k[d] == (1 << width[d]) - 1]
                    if len(e):
                        plain_bits[e], plain = self.read(rows[e], 5), True
                    pos = self.pos[rows]
            if i >= most and not plain:
                p, kk = pos[:live], k[:live]
                v = self.wide[p >> 3] << (p & 7).astype(np.uint64)
                q = 1075 - ((v >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)  # zeros before the stop bit
                used = q + 1 + kk
                if used.max(initial=0) > 53:
                    res[i, :live] = self._far(rows[:live], p, kk, pos[:live])
                    continue
                rest = (v << (q + 1).astype(np.uint64)) >> (64 - kk).astype(np.uint64)
                z = (q << kk) | rest.astype(np.int64)
                pos[:live] = p + used
                res[i, :live] = (z >> 1) ^ -(z & 1)
                continue
            go = np.flatnonzero(order[:live] <= i)
            coded, raw = go[plain_bits[go] < 0], go[plain_bits[go] > 0]
            if len(coded):
                p = pos[coded]
                res[i, coded] = self._far(rows[coded], p, k[coded], p)
                pos[coded] = p
            if len(raw):
                self.pos[rows[raw]] = pos[raw]
                res[i, raw] = self.signed(rows[raw], plain_bits[raw])
                pos[raw] = self.pos[rows[raw]]
        self.pos[rows] = pos
        return res

    def _far(self, rows: np.ndarray, p: np.ndarray, k: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Codes of any length, part by part; writes where they end to pos."""
        self.pos[rows] = p
        q = self.unary(rows)
        low, has = np.zeros(len(rows), np.int64), np.flatnonzero(k > 0)
        low[has] = self.read(rows[has], k[has])
        pos[:] = self.pos[rows]
        z = (q << k) | low
        return (z >> 1) ^ -(z & 1)


def _indexed(raw: np.ndarray, lo: int, hi: int, first: int) -> np.ndarray:
    """Where frames of a stream may begin: a sync code, a right header checksum, and frame numbers that count from `first`; found without decoding."""
    at = lo + np.flatnonzero((raw[lo : hi - 1] == 0xFF) & ((raw[lo + 1 : hi] & 0xFE) == 0xF8))
    out, due = [], first
    for p in at.tolist():
        head = raw[p : p + 16].tobytes()
        lead = head[4] if len(head) > 4 else 0
        width = 1 if lead < 0x80 else next((w for w in range(2, 8) if lead < (0xFF << (7 - w)) & 0xFF), 7)
        if lead < 0x80:
            number = lead
        else:
            number = lead & ((1 << (7 - width)) - 1)
            for b in head[5 : 4 + width]:
                number = number << 6 | b & 0x3F
        code, rate = head[2] >> 4, head[2] & 15
        end = 4 + width + {6: 1, 7: 2}.get(code, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
        c = 0
        for b in head[:end]:
            c = int(CRC8[c ^ b])
        if number == due and len(head) > end and c == head[end]:
            out.append(p)
            due += 1
    return np.array(out, np.int64)


def decode(streams: list[bytes], most_frames: int = 8192) -> list[np.ndarray]:
    """Samples of each mono stream; every checksum and the MD5 are verified.

    All frames of fixed-block streams are found by their headers and decoded together. Where the frames so found do not fill a stream without a gap (a header's
    image inside a frame, variable blocks), the stream is decoded frame after frame instead.
    """
    heads = [metadata(s) for s in streams]
    if any(h["channels"] != 1 for h in heads):
        raise Corrupt("more than one channel")
    raw = np.frombuffer(b"".join(streams), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    out: list[np.ndarray | None] = [None if h["samples"] else np.zeros(0, np.int64) for h in heads]
    todo = [(d, _indexed(raw, int(start[d]) + h["frames_at"], int(start[d + 1]), 0)) for d, h in enumerate(heads) if h["samples"]]
    while todo:
        some, n = [], 0
        while todo and (not some or n + len(todo[-1][1]) <= most_frames):
            some.append(todo.pop())
            n += len(some[-1][1])
        lo, hi = min(int(start[d]) for d, _ in some), max(int(start[d + 1]) for d, _ in some)
        begin = np.concatenate([b for _, b in some]) - lo
        try:
            frames = Frames(raw[lo:hi], begin, np.concatenate([np.full(len(b), heads[d]["bits"]) for d, b in some]))
            got, end = frames.decode(), (frames.pos >> 3) + lo
        except Corrupt:
            continue  # frame after frame below, which says what is wrong
        i = 0
        for d, b in some:
            j = i + len(b)
            if len(b) and (end[i : j - 1] == b[1:]).all() and end[j - 1] == start[d + 1] and frames.size[i:j].sum() == heads[d]["samples"]:
                x = got[i:j]
                out[d] = x.ravel() if (frames.size[i:j] == x.shape[1]).all() else np.concatenate([r[:m] for r, m in zip(x, frames.size[i:j])])
            i = j
    for d, h in enumerate(heads):
        if out[d] is None:
            out[d] = seek(streams[d], 0, h["samples"])
        wide = -(-h["bits"] // 8)
        x = out[d]
        pcm = x.astype(np.int8).tobytes() if wide == 1 else x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
        if h["md5"] != bytes(16) and hashlib.md5(pcm).digest() != h["md5"]:
            raise Corrupt("the stream's MD5 differs")
    return out


def seek(stream: bytes, sample: int, count: int) -> np.ndarray:
    """`count` samples from `sample` on, decoded from the nearest seek point before."""
    h = metadata(stream)
    if not 0 <= sample <= sample + count <= h["samples"]:
        raise ValueError("outside the stream")
    at, offset, _ = max([p for p in h["seek"] if p[0] <= sample], default=(0, 0, 0))
    raw, out, pos = np.frombuffer(stream, np.uint8), [], h["frames_at"] + offset
    frames, begin = None, at
    while at < sample + count:
        if frames is None:
            frames = Frames(raw, np.array([pos]), np.array([h["bits"]]))
        else:
            frames.begin, frames.pos, frames.depth = np.array([pos]), np.array([pos * 8]), np.array([h["bits"]])
        out.append(frames.decode()[0, : int(frames.size[0])])
        at, pos = at + len(out[-1]), int(frames.pos[0] >> 3)
    return np.concatenate(out)[sample - begin : sample - begin + count] if out else np.zeros(0, np.int64)


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def text_to_flac(docs: DataFrame, key: str = "doc_id", text: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each text, padded with zeros to a positive multiple of 64, as a FLAC stream. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in slices(off, slice_bytes):
                texts = [raw[p:q].tobytes() for p, q in zip(off[i:j], off[i + 1 : j + 1])]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([pad(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def flac_features(media: DataFrame, slice_bytes: int = 1 << 20) -> DataFrame:
    """media with the decoded payload's length, SHA-256, checksum of its last 64 bytes, that of the stored form, and a feature of the signal.

    Every frame's checksums and the MD5 are verified; a stream that fails ends the job with what differs. The feature has mean absolute sample,
    mean square and zero crossings (of samples against their mean) in exact integers over the length. Rows are independent; repeated rows get one result each;
    null media counts as a null payload (all null); an empty table gives no rows; further columns stay. Equal streams give equal values.
    """
    names = media.columns
    at = names.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, off = utf8(b.column(at))
            for i, j in slices(off, slice_bytes):
                some = b.column(at)[i:j].to_pylist()
                known = [s for s in some if s is not None]
                samples = iter(decode(known))
                rows = []
                for s in some:
                    if s is None:
                        rows.append((None,) * 6)
                        continue
                    x = next(samples)
                    payload = (x + 128).astype(np.uint8).tobytes()
                    level = x * len(x) - int(x.sum())
                    cross = int(((level[1:] >= 0) != (level[:-1] >= 0)).sum())
                    feature = f"abs={int(np.abs(x).sum())}/{len(x)};sq={int((x * x).sum())}/{len(x)};zc={cross}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(s), hashlib.sha256(s).hexdigest(), feature))
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*[b.column(c)[i:j] for c in range(len(names)) if c != at], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*[n for n in names if n != "media"], *NEW])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")
    return media.mapInArrow(run, (kept + ", " if kept else "") + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NEW = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def pcm_blocks(media: DataFrame, block: int = 4096) -> DataFrame:
    """(…, block_no, first_sample, n_samples, pcm): the decoded PCM of each stream in blocks, little endian at the stream's width, each with the offset of its first sample."""
    names = media.columns
    at = names.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = b.column(at)[i].as_py()
                if s is None:
                    continue
                wide = -(-metadata(s)["bits"] // 8)
                x = decode([s])[0].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide]
                starts = list(range(0, len(x), block))
                rest = [pa.concat_arrays([b.column(c)[i : i + 1]] * len(starts)) if starts else b.column(c)[:0] for c in range(len(names)) if c != at]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(range(len(starts)), pa.int64()), pa.array(starts, pa.int64()), pa.array([min(block, len(x) - p) for p in starts], pa.int64()), pa.array([x[p : p + block].tobytes() for p in starts], pa.binary())],
                    names=[*[n for n in names if n != "media"], "block_no", "first_sample", "n_samples", "pcm"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")
    return media.mapInArrow(run, (kept + ", " if kept else "") + "block_no long, first_sample long, n_samples long, pcm binary")

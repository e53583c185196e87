"""Exact removal of repeated windows over a distributed corpus: the rounds that both substring operators share.

A window is n consecutive symbols (bytes or words) of one document. Its trigger is the least hash among
its runs of k symbols, so equal windows have equal triggers. A maximal run of window starts with one
trigger is a phrase: its text from the first start to the end of the last window. Neighbouring phrases overlap
by n - 1 symbols, every window lies in exactly one phrase, and equal windows lie in phrases of one trigger.

Round 0 packs documents into slices of a few MB, written once. Round 1 sends (trigger, phrase hash, document)
of each distinct phrase of a slice to a bin of triggers and hears back: 0, nothing else has the trigger; 1, the same
phrase is in a smaller document; 2, other phrases of other documents have the trigger; 3, so many that one task
should not hold them. Round 2 sends the texts of phrases of code 2 to the group of their trigger, and
each window of phrases of code 3 to a group by its whole content, where the operator's own index compares them symbol by symbol.
Round 3 meets the slice again and cuts. Texts cross the network compressed, once in each of the rounds 2 and 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import inverse, mix, parts, powers, slices, staged, utf8

_B = 0x9E3779B97F4A7C15 | 1
_SEED = 0x51ED270B
_MIX_LEN = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True

SLICE = "inst long, ids binary, ok binary, lens binary, size long, blob binary"
ASK = "dest int, inst long, part int, keys binary, hashes binary, docs binary"
TOLD = "inst long, part int, codes binary, many long"
FRAGMENT = "dest int, inst long, docs binary, starts binary, lens binary, blob binary"
FOUND = "inst long, first binary, last binary"


@dataclass(frozen=True)
class Plan:
    """n, k: symbols of a window and of a trigger. words: symbols are words, else bytes. heavy: phrases of a trigger, one for each slice that asks, beyond which its windows are split."""

    n: int
    k: int
    words: bool
    heavy: int = 50_000
    slice_bytes: int = 2 << 20
    bin_units: int = 1_500_000
    group_windows: int = 400_000


def pack(docs: DataFrame, key: str, text: str, plan: Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, codec = TaskContext.get().partitionId(), 0, pa.Codec("zstd", compression_level=3)
        for b in batches:
            raw, off = utf8(b.column(1))
            ids = b.column(0).cast(pa.int64())
            ok = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in slices(off, plan.slice_bytes):
                piece = raw[off[i] : off[j]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 32) + at], pa.int64()), pa.array([ids[i:j].tobytes()], pa.binary()), pa.array([ok[i:j].tobytes()], pa.binary()),
                        pa.array([np.diff(off[i : j + 1]).tobytes()], pa.binary()), pa.array([len(piece)], pa.int64()), pa.array([codec.compress(piece, asbytes=True)], pa.binary()),
                    ],
                    names=["inst", "ids", "ok", "lens", "size", "blob"],
                )
                at += 1

    return staged(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SLICE), "slices")


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, given by where they begin and end: eight bytes at a time through a finaliser, those of over 64 bytes by BLAKE2.

    No sum of powers of a base modulo 2^64 is used, in which long words of two letters can collide whatever the base is.
    """
    size = end - begin
    h = mix(size.astype(np.uint64) * _MIX_LEN)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))
    for k in range(0, 64, 8):
        at = np.flatnonzero((size > k) & (size <= 64))
        if not len(at):
            continue
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        chunk = eight[begin[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[at] = mix((h[at] ^ chunk) * np.uint64(_B) + _MIX_LEN)
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Slice:
    """A slice's documents, as bytes and as symbols. Words are kept with one space behind each."""

    def __init__(self, ids: bytes, ok: bytes, lens: bytes, size: int, blob: bytes, plan: Plan):
        self.plan = plan
        self.ids, self.ok = np.frombuffer(ids, np.int64), np.frombuffer(ok, np.uint8).astype(bool)
        raw = np.frombuffer(pa.Codec("zstd").decompress(blob, size), np.uint8) if size else np.zeros(0, np.uint8)
        self.read(raw, np.frombuffer(lens, np.int64))

    @classmethod
    def of_fragments(cls, raw: np.ndarray, lens: np.ndarray, docs: np.ndarray, plan: Plan) -> Slice:
        self = cls.__new__(cls)
        self.plan, self.ids, self.ok = plan, docs, np.ones(len(docs), bool)
        self.read(raw, lens)
        return self

    def read(self, raw: np.ndarray, lens: np.ndarray) -> None:
        off = np.concatenate([[0], np.cumsum(lens)])
        if not self.plan.words:
            self.raw, self.off, self.sym_off, self.sym = raw, off, off, _BYTES[raw]
            return
        # a separator after every document, so that no word crosses; then one space behind every word and no other
        off = off + np.arange(len(off))
        buf = np.full(len(raw) + len(lens), 0x20, np.uint8)
        inside = np.ones(len(buf), bool)
        inside[off[1:] - 1] = False
        buf[inside] = raw
        gap = _GAP[buf]
        before = np.concatenate([[True], gap[:-1]])
        begin, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        keep = ~gap
        keep[end] = True
        buf[end] = 0x20
        place = np.cumsum(keep) - 1
        self.raw, self.begin, self.end = buf[keep], place[begin], place[end]
        self.sym_off = np.searchsorted(begin, off)
        self.off = np.concatenate([self.begin, [len(self.raw)]])[self.sym_off]
        self.sym = word_hashes(self.raw, self.begin, self.end)

    def windows(self, every: bool = False) -> np.ndarray:
        """Which symbols start a window, of documents with an id unless `every`."""
        n = self.plan.n
        count = np.diff(self.sym_off) - n + 1
        has = (count > 0) & (every | self.ok)
        step = np.zeros(len(self.sym) + 1, np.int8)
        step[self.sym_off[:-1][has]] += 1
        step[(self.sym_off[:-1] + count)[has]] -= 1
        return np.cumsum(step[:-1], dtype=np.int8).astype(bool)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each phrase: first and last window start, trigger, hash, document (row of the slice)."""
        n, k, x = self.plan.n, self.plan.k, self.sym
        valid = self.windows()
        if not valid.any():
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none
        gram, have, left, span, base = None, 0, k, 1, _B
        step = x
        while left:  # the hash of k symbols from those of 1, 2, 4, ...
            if left & 1:
                gram = step if gram is None else gram[: len(x) - have - span + 1] * np.uint64(pow(_B, span, 1 << 64)) + step[have : have + len(x) - have - span + 1]
                have += span
            left >>= 1
            if left:
                step = step[: len(step) - span] * np.uint64(base) + step[span:]
                base, span = base * base % (1 << 64), span * 2
        least = mix(gram)
        reach, want = 1, n - k + 1
        while reach < want:
            more = min(reach, want - reach)
            least = np.minimum(least[: len(least) - more], least[more:])
            reach += more
        m = len(least)
        valid = valid[:m]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        a = np.flatnonzero(new)
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | new[1:]
        b = np.flatnonzero(stop)
        lo, hi = (self.begin[a], self.end[b + n - 1]) if self.plan.words else (a, b + n)
        view, digest = memoryview(self.raw.data), xxhash.xxh3_64_intdigest
        h = np.fromiter((digest(view[i:j], _SEED) for i, j in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
        return a, b, least[a], h, np.searchsorted(self.sym_off, a, "right") - 1

    def questions(self, bins: int) -> tuple[np.ndarray, ...]:
        """Phrases as above; then for each the row of its asker, whether a smaller document of the slice has it, and the askers by bin, with their bins."""
        a, b, trigger, h, doc = self.phrases()
        ids = self.ids[doc]
        order = np.lexsort((a, ids, h ^ trigger))
        same = (h ^ trigger)[order]
        head = np.ones(len(order), bool)
        head[1:] = (same[1:] != same[:-1]) | (trigger[order][1:] != trigger[order][:-1])
        asker = np.empty(len(order), np.int64)
        asker[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        copy = ids > ids[asker]
        asks = np.flatnonzero(asker == np.arange(len(asker)))
        bin_ = (mix(trigger[asks] ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(bins)).astype(np.int64)
        asks = asks[np.argsort(bin_, kind="stable")]
        bin_.sort()
        return a, b, trigger, h, doc, asker, copy, asks, bin_


def _cut(bin_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(bin_)) + 1
    for i, j in zip([0, *edges], [*edges, len(bin_)]):
        if j > i:
            yield int(bin_[i]), int(i), int(j)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compresses better."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, dtype: type) -> np.ndarray:
    w = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(w, -1).T).view(dtype).ravel()


def _slice(row: dict, plan: Plan) -> Slice:
    return Slice(row["ids"], row["ok"], row["lens"], row["size"], row["blob"], plan)


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield {name: table.column(name)[i].as_py() for name in table.schema.names}


def _out(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def ask(packed: DataFrame, plan: Plan, bins: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                s = _slice(row, plan)
                _, _, trigger, h, doc, _, _, asks, bin_ = s.questions(bins)
                key = (mix(trigger[asks]) >> np.uint64(32)).astype(np.uint32)
                ids, hash7 = s.ids[doc[asks]], h[asks].view(np.uint8).reshape(-1, 8)[:, :7]
                out = [(b, row["inst"], b, key[i:j].tobytes(), hash7[i:j].tobytes(), _planes(ids[i:j])) for b, i, j in _cut(bin_)]
                if out:
                    yield _out(out, ASK)

    return packed.mapInArrow(run, ASK)


def _judge(key: np.ndarray, h: np.ndarray, doc: np.ndarray, heavy: int) -> np.ndarray:
    """Codes of the phrases of a bin; see the module."""
    order = np.lexsort((doc, h, key))
    k, p, d = key[order], h[order], doc[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], p[1:] != p[:-1]])
    first = np.flatnonzero(new)
    each = np.diff([*first, len(d)])
    # all askers of a phrase's least document: a row may be repeated in several slices
    least = d == np.repeat(d[first], each)
    # phrases that differ under one trigger: compared unless all their first documents are one
    keys = np.flatnonzero(new_key[first])
    lo, hi = np.minimum.reduceat(d[first], keys), np.maximum.reduceat(d[first], keys)
    size = np.add.reduceat(least.astype(np.int64), np.flatnonzero(new_key))
    kind = np.where(hi > lo, np.where(size > heavy, 3, 2), 0).astype(np.uint8)
    code = np.where(least, np.repeat(np.repeat(kind, np.diff([*keys, len(first)])), each), 1).astype(np.uint8)
    out = np.empty_like(code)
    out[order] = code
    return out


def tell(asked: DataFrame, plan: Plan) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = list(_rows(table))
        key = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])
        wide = np.zeros((len(key), 8), np.uint8)
        wide[:, :7] = np.concatenate([np.frombuffer(r["hashes"], np.uint8).reshape(-1, 7) for r in rows])
        doc = np.concatenate([_unplanes(r["docs"], np.int64) for r in rows])
        code = _judge(key, wide.view(np.uint64).ravel(), doc, plan.heavy)
        out, at = [], 0
        for r in rows:
            n = len(r["keys"]) // 4
            mine = code[at : at + n]
            out.append((r["inst"], r["part"], mine.tobytes(), int((mine > 1).sum())))
            at += n
        return pa.Table.from_batches([_out(out, TOLD)])

    return asked.groupBy("dest").applyInArrow(run, TOLD)


def _codes(s: Slice, told: dict[int, bytes], bins: int) -> tuple[np.ndarray, ...]:
    """Of a slice's phrases: first and last start, trigger, document, whether it is the asker, and the code."""
    a, b, trigger, _, doc, asker, copy, asks, bin_ = s.questions(bins)
    code = np.zeros(len(a), np.uint8)
    for bin_at, i, j in _cut(bin_):
        code[asks[i:j]] = np.frombuffer(told[bin_at], np.uint8)
    code = code[asker]
    code[copy] = 1
    return a, b, trigger, doc, asker, code


def _fragments(s: Slice, told: dict[int, bytes], bins: int, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    n = s.plan.n
    a, b, trigger, doc, asker, code = _codes(s, told, bins)
    mine = np.flatnonzero((code > 1) & (asker == np.arange(len(a))))
    light, split = mine[code[mine] == 2], mine[code[mine] == 3]
    first, last, at = a[light], b[light], mix(trigger[light] ^ np.uint64(0x5851F42D4C957F2D))
    if len(split):
        reps = b[split] - a[split] + 1
        each = np.repeat(a[split], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        p, q = powers(_B, len(s.sym)), powers(inverse(_B), len(s.sym))
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s.sym * p[: len(s.sym)], dtype=np.uint64)])
        first, last = np.concatenate([first, each]), np.concatenate([last, each])
        at = np.concatenate([at, mix((c[each + n] - c[each]) * q[each])])
    dest = (at % np.uint64(groups)).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    first, last, dest = first[order], last[order], dest[order]
    begin, end = (s.begin[first], s.end[last + n - 1]) if s.plan.words else (first, last + n)
    docs = s.ids[np.searchsorted(s.sym_off, first, "right") - 1]
    for g, i, j in _cut(dest):
        lens = end[i:j] - begin[i:j]
        where = np.repeat(begin[i:j] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        yield g, docs[i:j], first[i:j], lens, s.raw[where].tobytes()


def _met(packed: DataFrame, *told: DataFrame) -> DataFrame:
    """The slices and what was said of them, as rows of one frame, for grouping by inst."""
    out = packed
    for t in told:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.groupBy("inst")


def _split(table: pa.Table) -> tuple[dict, list[dict], list[dict]]:
    rows = list(_rows(table))
    return next(r for r in rows if r["blob"] is not None), [r for r in rows if r["codes"] is not None], [r for r in rows if r.get("first") is not None]


def fragments(packed: DataFrame, told: DataFrame, plan: Plan, bins: int, groups: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        row, codes, _ = _split(table)
        out = []
        if any(r["many"] for r in codes):
            s = _slice(row, plan)
            for g, docs, first, lens, blob in _fragments(s, {r["part"]: r["codes"] for r in codes}, bins, groups):
                out.append((g, row["inst"], _planes(docs), _planes(first), _planes(lens), blob))
        return pa.Table.from_batches([_out(out, FRAGMENT)])

    return _met(packed, told).applyInArrow(run, FRAGMENT)


def compare(frags: DataFrame, plan: Plan, index: Callable[[Slice, np.ndarray], np.ndarray]) -> DataFrame:
    """index(fragments, window starts) gives each window a class number; windows of one class are equal. Hits are those with a smaller document in their class."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(_rows(table))
        docs = np.concatenate([_unplanes(r["docs"], np.int64) for r in rows])
        first = np.concatenate([_unplanes(r["starts"], np.int64) for r in rows])
        lens = np.concatenate([_unplanes(r["lens"], np.int64) for r in rows])
        inst = np.repeat(np.array([r["inst"] for r in rows]), [len(r["lens"]) // 8 for r in rows])
        s = Slice.of_fragments(np.frombuffer(b"".join(r["blob"] for r in rows), np.uint8), lens, docs, plan)
        at = np.flatnonzero(s.windows(every=True))
        frag = np.searchsorted(s.sym_off, at, "right") - 1
        cls = index(s, at)
        least = np.full(int(cls.max()) + 1 if len(cls) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, docs[frag])
        hit = docs[frag] > least[cls]
        at, frag = at[hit], frag[hit]
        out = []
        if len(at):
            start = first[frag] + at - s.sym_off[frag]
            new = np.concatenate([[True], (frag[1:] != frag[:-1]) | (start[1:] != start[:-1] + 1)])
            head, tail = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
            who, lo, hi = inst[frag[head]], start[head], start[tail]
            order = np.argsort(who, kind="stable")
            who, lo, hi = who[order], lo[order], hi[order]
            edges = np.flatnonzero(np.diff(who)) + 1
            for i, j in zip([0, *edges], [*edges, len(who)]):
                out.append((int(who[i]), _planes(lo[i:j]), _planes(hi[i:j])))
        return pa.Table.from_batches([_out(out, FOUND)])

    return frags.groupBy("dest").applyInArrow(run, FOUND)


def _binary(raw: np.ndarray, mask: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The bytes of raw under mask as one value per document."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(total[off].astype(np.int32).tobytes()), pa.py_buffer(raw[mask].tobytes())])


def cut(packed: DataFrame, told: DataFrame, found: DataFrame, plan: Plan, bins: int) -> DataFrame:
    """(doc_id, n_units, n_removed, spans, kept): what is left of each row's text; spans of symbols, end exclusive."""
    n = plan.n
    kept_type = "string" if plan.words else "binary"
    schema = f"doc_id long, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept {kept_type}"

    def run(table: pa.Table) -> pa.Table:
        row, codes, hits = _split(table)
        s = _slice(row, plan)
        a, b, _, doc, asker, code = _codes(s, {r["part"]: r["codes"] for r in codes}, bins)
        step = np.zeros(len(s.sym) + 1, np.int32)
        one = code == 1
        np.add.at(step, a[one], 1)
        np.add.at(step, b[one] + n, -1)
        # a phrase that occurs again in its document has the verdict of its first place
        mine = np.flatnonzero((code > 1) & (asker == np.arange(len(a))))
        again = np.flatnonzero((code > 1) & (asker != np.arange(len(a))))
        for r in hits:
            lo, hi = _unplanes(r["first"], np.int64), _unplanes(r["last"], np.int64)
            np.add.at(step, lo, 1)
            np.add.at(step, hi + n, -1)
            if len(again):
                owner = mine[np.searchsorted(a[mine], lo, "right") - 1]
                by = np.argsort(asker[again], kind="stable")
                left = np.searchsorted(asker[again][by], owner, "left")
                count = np.searchsorted(asker[again][by], owner, "right") - left
                rep = np.repeat(np.arange(len(lo)), count)
                pick = again[by[np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]]
                shift = a[pick] - a[owner[rep]]
                np.add.at(step, lo[rep] + shift, 1)
                np.add.at(step, hi[rep] + shift + n, -1)
        gone = np.cumsum(step[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        # documents touch each other, so spans are cut at their edges
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        closes = gone.copy()
        closes[:-1] &= ~gone[1:]
        inner = np.unique(s.sym_off[(s.sym_off > 0) & (s.sym_off < len(gone))])
        opens[inner] = gone[inner]
        closes[inner - 1] = gone[inner - 1]
        lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = np.searchsorted(lo, s.sym_off)
        base = np.repeat(s.sym_off[:-1], np.diff(of))
        spans = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64())], names=["start", "end"]))
        if plan.words:
            raw = s.raw
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[s.begin[~gone]] += 1
            edge[s.end[~gone] + 1] -= 1  # with the separator behind
            mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            kept_words = np.flatnonzero(~gone)
            which = np.searchsorted(s.sym_off, kept_words, "right") - 1
            last = np.flatnonzero(np.diff(np.concatenate([which, [-1]])) != 0)
            mask[s.end[kept_words[last]]] = False  # none behind a document's last word
            kept = _binary(raw, mask, s.off, pa.string())
        else:
            kept = _binary(s.raw, ~gone, s.off, pa.binary())
        units = np.diff(s.sym_off)
        return pa.Table.from_arrays([pa.array(s.ids, pa.int64(), mask=~s.ok), pa.array(units, pa.int64()), pa.array(total[s.sym_off[1:]] - total[s.sym_off[:-1]], pa.int64()), spans, kept], names=["doc_id", "n_units", "n_removed", "spans", "kept"])

    return _met(packed, told, found).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str, text: str, plan: Plan, index: Callable[[Slice, np.ndarray], np.ndarray]) -> DataFrame:
    packed = pack(docs, key, text, plan)
    size = int(packed.agg(F.sum("size")).first()[0] or 0)
    units = size / (5.5 if plan.words else 1) * 2 / (plan.n - plan.k + 2)
    bins = parts(units, plan.bin_units)
    told = staged(tell(ask(packed, plan, bins), plan), "told")
    many = int(told.agg(F.sum("many")).first()[0] or 0)
    groups = parts(many * (plan.n - plan.k + 1), plan.group_windows)
    found = compare(fragments(packed, told, plan, bins, groups), plan, index)
    return cut(packed, told, found, plan, bins)

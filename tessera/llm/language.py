"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, utf8

SPAN = 512


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, state 0 the root: its paths are exactly the substrings."""
    nxt: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Model:
    """classes: of each code point, 0 for what separates words. letters: which code points are letters. first: where a phrase goes on its first class, by language.
    A state is the base of its transitions: slots[base + class] holds the base it belongs to, in the upper 32 bits, and the next state. roots: states without transitions."""

    langs: list[str]
    classes: np.ndarray
    letters: np.ndarray
    first: np.ndarray
    slots: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def _pack(auto: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bases of the states, no two alike, and slots with the base and the next state of each transition; the root keeps none."""
    base = np.zeros(len(auto), np.int64)
    edges = [{}, *auto[1:]]
    degree = np.array([len(e) for e in edges])
    many = [s for s in np.argsort(-degree, kind="stable").tolist() if degree[s] > 1]
    room = int(degree[degree > 1].sum()) + 2 * width
    free, taken, low = np.ones(2 * room + width, bool), np.zeros(2 * room + width, bool), 0
    end = 0
    for s in many:
        cs, at = sorted(edges[s]), low
        while True:
            if at + 512 + width > len(free):
                free, taken = np.concatenate([free, np.ones(len(free), bool)]), np.concatenate([taken, np.zeros(len(taken), bool)])
            b = np.flatnonzero(free[at : at + 512]) + at - cs[0]
            b = b[b >= 0]
            b = b[~taken[b]]
            for c in cs[1:]:
                b = b[free[b + c]]
            if len(b):
                break
            at += 512
        base[s] = b[0]
        taken[b[0]] = True
        free[b[0] + np.array(cs)] = False
        end = max(end, int(b[0]) + width)
        while low + 512 < len(free) and free[low : low + 512].sum() < 64:
            low += 512
    # one transition each: slots in a row by falling class, so that no two bases are alike
    one = np.flatnonzero(degree == 1)
    label = np.array([next(iter(edges[s])) for s in one.tolist()], np.int64)
    one, label = one[np.argsort(-label, kind="stable")], -np.sort(-label)
    base[one] = end + width + np.arange(len(one)) - label
    end += 2 * width + len(one)
    none = np.flatnonzero(degree == 0)
    base[none] = end + np.arange(len(none))
    slots = np.full(end + len(none) + width, -1, np.int64)
    for s, e in enumerate(edges):
        for c, to in e.items():
            slots[base[s] + c] = base[s] << 32 | base[to]
    return base, slots


def build(texts: dict[str, str]) -> Model:
    """The model of one reference text per language. Every letter of a reference is a class, whatever its case; letters of none are one more."""
    langs = sorted(texts)
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    code = {c: i + 1 for i, c in enumerate(sorted({x for t in texts.values() for c in t if c.isalpha() for x in c.lower()[0]}))}
    width = len(code) + 2
    classes = np.where(letters, width - 1, 0).astype(np.int32)
    for i in np.flatnonzero(letters).tolist():
        c = code.get(chr(i).lower()[0])
        if c:
            classes[i] = c
    firsts, tables, roots, bits, at = [], [], [], [], 0
    for lang in langs:
        codes = _squeeze(classes[np.frombuffer(texts[lang].encode("utf-32-le", "surrogatepass"), np.uint32)]).tolist()
        auto = suffix_automaton(codes)
        base, slots = _pack(auto, width)
        # a class that the reference lacks is a phrase of its own, which nothing continues, as nothing continues the root
        first = np.full(width, at + base[0], np.int64)
        for c, to in auto[0].items():
            first[c] = at + base[to]
        firsts.append(first)
        tables.append(np.where(slots >= 0, slots + (at << 32 | at), -1))
        roots.append(at + base[0])
        bits.append(math.log2(max(2, len(codes))))
        at += len(slots)
    return Model(langs, classes, letters, np.array(firsts), np.concatenate(tables) if tables else np.zeros(0, np.int64), np.array(roots, np.int64), np.array(bits))


def _squeeze(codes: np.ndarray) -> np.ndarray:
    """Runs of separators as one."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def _points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and their offsets; bytes that are no UTF-8 count as one unknown point each."""
    lead = (raw & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(lead)])
    try:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        return points, total[off]
    except UnicodeDecodeError:
        each = [np.frombuffer(raw[i:j].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i, j in zip(off[:-1], off[1:])]
        return np.concatenate(each) if each else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum([len(e) for e in each])])


def cross_parse(model: Model, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of each text in each language (texts x languages), its normalised length, and whether it has letters.

    All texts advance together, a symbol at a time: a text is laid out in spans of SPAN symbols. Each is parsed from the root, then from the state in which the span before it ends,
    until both parses begin a phrase at the same place, from which on they are one: the phrases are those of one parse of the whole text.
    """
    points, at = _points(raw, off)
    has = np.diff(np.concatenate([[0], np.cumsum(model.letters[points])])[at]) > 0
    codes = model.classes[points]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = codes[first] != 0
    codes, at = codes[keep], np.concatenate([[0], np.cumsum(keep)])[at]
    n = np.diff(at)
    lanes = -(-n // SPAN)
    base = np.concatenate([[0], np.cumsum(lanes)])
    grid = np.zeros(base[-1] * SPAN, np.int32)
    grid[np.arange(len(codes)) + np.repeat(base[:-1] * SPAN - at[:-1], n)] = codes
    # the longest spans first, so that those which still go on stand together
    size = np.full(base[-1], SPAN)
    size[base[1:][n > 0] - 1] = (n - (lanes - 1) * SPAN)[n > 0]
    order = np.argsort(-size, kind="stable")
    steps = np.ascontiguousarray(grid.reshape(-1, SPAN)[order].T)
    going = len(size) - np.searchsorted(np.sort(size), np.arange(SPAN), "right")
    count = np.zeros((len(model.langs), base[-1]), np.int32)
    size = size[order]
    # in the order of the spans: which goes on from which
    place = np.empty(base[-1], np.int64)
    place[order] = np.arange(base[-1])
    later = np.setdiff1d(np.arange(base[-1]), base[:-1])
    after = np.full(base[-1], -1)
    after[place[later - 1]] = place[later]
    for lang, root in enumerate(model.roots):
        state, begins = np.full(base[-1], root), np.zeros(steps.shape, bool)
        for t, m in enumerate(going):
            if not m:
                break
            now, row = state[:m], steps[t, :m]
            to = model.slots[now + row]
            on = to >> 32 == now
            begins[t, :m] = ~on
            state[:m] = np.where(on, to & 0xFFFFFFFF, model.first[lang][row])
        count[lang, order] = begins.sum(0) + _carried(model, lang, steps, begins, size, state, after)
    total = np.concatenate([np.zeros((len(model.langs), 1), np.int64), np.cumsum(count, 1)], 1)
    return (total[:, base[1:]] - total[:, base[:-1]]).T, n, has


def _carried(model: Model, lang: int, steps: np.ndarray, begins: np.ndarray, size: np.ndarray, alone: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The phrases that each span has more than when it is parsed from the root, if it goes on from the state in which the span before it ends.

    begins: where the parses from the root begin phrases; alone: the states in which they end; after: the span that follows each, or -1. A span whose end changes has the next one parsed again.
    """
    more, end = np.zeros(len(size), np.int64), alone.copy()
    before = np.flatnonzero(after >= 0)
    while len(before):
        todo = after[before]
        at, state, d = todo, end[before], np.zeros(len(todo), np.int64)
        moved = []
        for t in range(len(steps)):
            row = steps[t, at]
            to = model.slots[state + row]
            on = to >> 32 == state
            met = ~on & begins[t, at]
            d = d + ~on - begins[t, at]
            state = np.where(on, to & 0xFFFFFFFF, model.first[lang][row])
            over = met | (size[at] == t + 1)
            if over.any():
                done, now = at[over], np.where(met, alone[at], state)[over]
                more[done] = d[over]
                moved.append(done[end[done] != now])
                end[done] = now
                at, state, d = at[~over], state[~over], d[~over]
                if not len(at):
                    break
        changed = np.concatenate(moved)
        before = changed[after[changed] >= 0]
    return more


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None, ref_chars: int = 20_000, excerpt: int = 400, most_langs: int = 200) -> Model:
    """The model of the labelled rows under `train`.

    Bounded sample: per language about 2 x ref_chars / excerpt documents, those whose id has the least hashes, an excerpt of at most `excerpt`
    code points of each at a place set by the hash, together at most ref_chars. More than most_langs labels are refused.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (train if train is not None else F.lit(True)))
    counts = rows.groupBy(F.col(lang).alias("_l")).count().limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not counts:
        return build({})
    want = 2.0 * ref_chars / excerpt
    share = F.coalesce(*[F.when(F.col(lang) == r["_l"], F.lit(min(1.0, want / r["count"]))) for r in counts])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("reference")), F.lit(1 << 32)).cast("double") / F.lit(float(1 << 32))
    where = F.lit(1) + F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("place")), F.greatest(F.lit(1), F.length(text) - F.lit(excerpt - 1)).cast("long")).cast("int")
    got = rows.filter(draw < share).select(F.col(lang).alias("l"), draw.alias("d"), F.col(text).substr(where, F.lit(excerpt)).alias("t")).collect()
    texts: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r["l"], r["d"], r["t"])):
        texts[r["l"]] = (texts.get(r["l"], "") + " " + r["t"])[: ref_chars + 1]
    return build(texts)


def identify(docs: DataFrame, model: Model, text: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """docs without its text, with lang_pred and score.

    A phrase is the longest match of the rest of the text in a language's reference. The language of the least phrases x log2(reference length) / symbols wins
    (ties: the first by name); score is 1 - that / the next language's, 1 if there is only one language. A null text, one without letters, and any text when no
    language was learned is `und` with score 0. Case, digits and signs don't count. Whole texts are parsed; repeated rows get one result each; an empty table
    gives no rows; an input column lang_pred or score is replaced.
    """
    docs = docs.drop("lang_pred", "score")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != text]
    rest = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            raw, off = utf8(b.column(len(names)))
            preds: list[str] = []
            scores: list[np.ndarray] = []
            for i, j in slices(off, slice_bytes):
                lo = off[i]
                if not m.langs:
                    preds += ["und"] * (j - i)
                    scores.append(np.zeros(j - i))
                    continue
                phrases, n, has = cross_parse(m, raw[lo : off[j]], off[i : j + 1] - lo)
                cost = phrases * m.bits / np.maximum(n, 1)[:, None]
                best = cost.argmin(1)
                two = np.sort(cost, 1)[:, :2]
                score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300) if two.shape[1] == 2 else np.ones(j - i)
                preds += [m.langs[x] if h else "und" for x, h in zip(best.tolist(), has.tolist())]
                scores.append(np.where(has, np.clip(score, 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "lang_pred string", "score double"])
    return docs.select(*names, F.col(text).cast("string")).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))

"""Suffix-array dedup by prefix-free parsing over bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import mix
from tessera.llm.repeats import Plan, Slice, remove_repeats


def _doubled(rank: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Ranks of suffixes by all their symbols, from ranks by their first `length`: prefix doubling until no class splits. left: symbols up to each suffix's end."""
    classes = int(rank.max()) + 1 if len(rank) else 0
    while len(rank) and length < left.max():
        more = left > length
        after = np.zeros(len(rank), np.int64)
        at = np.flatnonzero(more)
        after[at] = rank[at + length] + 1
        values, rank = np.unique(rank * (classes + 1) + after, return_inverse=True)
        if len(values) == classes:
            break
        classes, length = len(values), 2 * length
    return rank


def _eight(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number, whose order is the order of the strings, read where it is indexed; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, ">u8", padded.data, strides=(1,))


def _ranks(eight: np.ndarray, at: np.ndarray, left: np.ndarray, depth: int | None, most: int = 16) -> np.ndarray | None:
    """Ranks of strings that begin at the given places and are `left` bytes long, eight more bytes at a time for those still alike, by `depth` bytes at least; None if that takes over `most` steps a string and 10^5."""
    rank, tied, k, work = np.zeros(len(at), np.int64), np.arange(len(at)), -8, 0
    while len(tied) and (depth is None or k + 8 < depth):
        k, work = k + 8, work + len(tied) + 100
        if work > most * len(at) + 100_000:
            return None
        take = np.clip(left[tied] - k, 0, 8).astype(np.uint64)
        value = np.zeros(len(tied), np.uint64)
        some = np.flatnonzero(take)
        value[some] = (eight[at[tied[some]] + k].astype(np.uint64) >> (np.uint64(64) - np.uint64(8) * take[some])) << (np.uint64(64) - np.uint64(8) * take[some])
        order = np.lexsort((take, value, rank[tied]) if k else (take, value))
        r, v, t = rank[tied][order], value[order], take[order]
        group = np.ones(len(order), bool)
        group[1:] = r[1:] != r[:-1]
        new = group.copy()
        new[1:] |= (v[1:] != v[:-1]) | (t[1:] != t[:-1])
        head = np.flatnonzero(new)
        size = np.diff([*head, len(order)])
        start = np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))
        rank[tied[order]] = r + np.repeat(head - start[head], size)
        longer = np.add.reduceat((left[tied[order]] > k + 8).astype(np.int64), head)
        tied = tied[order][np.repeat((size > 1) & (longer > 0), size)]
    return rank


def parse(raw: np.ndarray, window: int = 8, modulus: int = 24) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The prefix-free parse of a text: where its phrases begin, their numbers, and the dictionary.

    A trigger is a place whose `window` bytes (at most 8) have a hash that the modulus divides. A phrase goes from one trigger to the end of the next, so neighbours overlap by `window`
    bytes; the text is followed by `window` zero bytes, which end the last phrase.
    """
    text = np.concatenate([raw, np.zeros(window, np.uint8)])
    hashed = mix((_eight(text)[: len(raw)].astype(np.uint64) >> np.uint64(64 - 8 * window)) + np.uint64(1))
    start = np.unique(np.concatenate([[0], np.flatnonzero(hashed % np.uint64(modulus) == 0)])).astype(np.int64)
    stop = np.concatenate([start[1:], [len(raw)]]) + window
    whole, numbers = text.tobytes(), {}
    number = np.array([numbers.setdefault(whole[i:j], len(numbers)) for i, j in zip(start.tolist(), stop.tolist())], np.int64)
    return start, number, list(numbers)


def corpus_order(raw: np.ndarray, at: np.ndarray, window: int = 8, modulus: int = 24, depth: int | None = None) -> np.ndarray:
    """The order of the suffixes of a text that begin at the given places, from the suffix arrays of its dictionary and of its parse.

    A suffix begins with a proper suffix, longer than a trigger, of its phrase; by the order of those among all suffixes of the dictionary, none of which is a prefix of another,
    and where they are equal by the order of the rest of the parse, the suffixes of the text are in lexicographic order. Given a depth, suffixes that agree in so many bytes stand together in any order.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    start, number, dictionary = parse(raw, window, modulus)
    size = np.array([len(x) for x in dictionary])
    begin = np.concatenate([[0], np.cumsum(size)])
    first = np.empty(len(dictionary), np.int64)
    first[sorted(range(len(dictionary)), key=dictionary.__getitem__)] = np.arange(len(dictionary))
    in_parse = np.concatenate([_doubled(np.unique(first[number], return_inverse=True)[1], np.arange(len(number), 0, -1), 1), [-1]])
    phrase = np.searchsorted(start, at, "right") - 1
    wanted = begin[number[phrase]] + at - start[phrase]
    seen = np.zeros(begin[-1], bool)
    seen[wanted] = True
    places = np.flatnonzero(seen)
    eight = _eight(np.frombuffer(b"".join(dictionary), np.uint8))
    rank = _ranks(eight, places, begin[np.searchsorted(begin, places, "right")] - places, depth)
    if rank is None:
        # long strings without a trigger: all suffixes of the dictionary, by doubling
        left = np.repeat(begin[1:], size) - np.arange(begin[-1])
        short = np.minimum(left, 8).astype(np.uint64)
        value = (eight[: begin[-1]].astype(np.uint64) >> (np.uint64(64) - short * np.uint64(8))) << (np.uint64(64) - short * np.uint64(8))
        order = np.lexsort((short, value))
        new = np.zeros(len(order), np.int64)
        new[1:] = (value[order][1:] != value[order][:-1]) | (short[order][1:] != short[order][:-1])
        every = np.empty(len(order), np.int64)
        every[order] = np.cumsum(new)
        rank = _doubled(every, left, 8)[places]
    return np.lexsort((in_parse[phrase + 1], rank[np.cumsum(seen)[wanted] - 1]))


def _index(s: Slice, at: np.ndarray) -> np.ndarray:
    """The class of equal strings of n bytes of each start: they are neighbours in corpus order, and are compared byte by byte."""
    n, order, eight = s.plan.n, corpus_order(s.raw, at, depth=s.plan.n), _eight(s.raw)
    new = np.zeros(len(order), bool)
    for j, bits in [*((j, 64) for j in range(0, n - 7, 8)), *([(n - n % 8, 8 * (n % 8))] if n % 8 else [])]:
        column = eight[at[order] + j].astype(np.uint64) >> np.uint64(64 - bits)
        new[1:] |= column[1:] != column[:-1]
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new)
    return cls


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, trigger: int = 24, heavy: int = 50_000, **sizes: int) -> DataFrame:
    """(doc_id, n_units, n_removed, spans, kept): UTF-8 bytes without those covered by a string of `length` bytes that also starts in a document of smaller id.

    Rolling hashes of `trigger` bytes cut every text into passages that overlap by length - 1 bytes: a passage ends where the least hash of the coming `length` bytes changes, so
    each string of the length lies in exactly one, and equal strings in passages of one trigger. A passage is kept once, with its least document. Those of one trigger form a text
    of a few MB whose prefix-free parse is taken: phrases from trigger to trigger, the suffix arrays of dictionary and parse, and from both the order of all suffixes, in which equal
    strings are neighbours; the least document of each run decides. Repetitive text thus costs its distinct phrases only.
    Passages are told apart by 32 bits of the trigger's hash and 56 of their own; strings in the suffix arrays are compared byte by byte.

    Matches never cross documents. Null and empty texts have no bytes; rows with a null id lose nothing and cause no removal; rows that share an id don't act on each other;
    repeated rows have one result each; an empty table gives no rows; other columns are not read. kept is binary, as a cut may fall inside a character.
    """
    return remove_repeats(docs, key, text, Plan(n=length, k=min(trigger, length), words=False, heavy=heavy, **sizes), _index)

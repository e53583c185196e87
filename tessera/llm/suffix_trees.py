"""Substring dedup by prefix-partitioned suffix trees over words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.repeats import Plan, Slice, remove_repeats


def subtree(symbols: np.ndarray, left: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of the suffixes that begin at the places `at` of a sequence; left: symbols up to the end of each place's text.

    Returned as leaves in tree order (indices of at) and the depth, in symbols, of the lowest node that joins each leaf with the one before it
    (0 for the first): the internal nodes are the maximal runs over which no depth falls below theirs. Suffixes are ranked by their first 1, 2, 4, ...
    symbols until no rank is shared that a longer look could tell apart; depths are read back from those ranks.
    """
    rank = np.unique(symbols, return_inverse=True)[1]
    levels, length = [rank], 1
    while len(rank) and length < left.max():
        after = np.zeros(len(rank), np.int64)
        more = np.flatnonzero(left > length)
        after[more] = rank[more + length] + 1
        classes = int(rank.max()) + 1
        # a suffix that ends within the look stands apart from one that goes on
        values, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
        levels.append(rank)
        length *= 2
        if len(values) == classes:
            break
    order = np.argsort(rank[at], kind="stable")
    x, y = at[order][:-1], at[order][1:]
    depth = np.zeros(len(order), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        # more than once at the top, where equal ranks may stand for suffixes that are equal to their ends
        while True:
            i, j = x + depth[1:], y + depth[1:]
            fits = (left[x] - depth[1:] >= 1 << level) & (left[y] - depth[1:] >= 1 << level)
            same = np.flatnonzero(fits)
            same = same[levels[level][i[same]] == levels[level][j[same]]]
            depth[1 + same] += 1 << level
            if level < len(levels) - 1 or not len(same):
                break
    return order, depth


def deep_nodes(order: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the number of the topmost node of at least this depth above it; a leaf that has none is its own."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(depth < least) - 1
    return out


def maximal_repeats(symbols: np.ndarray, at: np.ndarray, order: np.ndarray, depth: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first, end) of each internal node of at least this depth whose leaves order[first:end] follow different symbols: its path is a maximal repeat."""
    out, open_ = [], []
    for i, d in enumerate([*depth[1:].tolist(), 0], 1):
        first = i - 1
        while open_ and open_[-1][0] > d:
            deep, first = open_.pop()
            if deep >= least:
                start = at[order[first:i]]
                before = set(symbols[start[start > 0] - 1].tolist())
                if len(before) > 1 or (start == 0).any():
                    out.append((deep, first, i))
        if d and (not open_ or open_[-1][0] < d):
            open_.append((d, first))
    return out


def _index(s: Slice, at: np.ndarray) -> np.ndarray:
    left = np.repeat(s.sym_off[1:], np.diff(s.sym_off)) - np.arange(len(s.sym))
    return deep_nodes(*subtree(s.sym, left, at), s.plan.n)


def remove_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, prefix: int = 4, heavy: int = 50_000, **sizes: int) -> DataFrame:
    """(doc_id, n_units, n_removed, spans, kept): texts without the words covered by a window that also starts in a document of smaller id.

    Suffixes are grouped by a key of variable length, and each group has the suffix tree of its suffixes up to the end of their passages:
    the leaves under an internal node of at least the window's depth are the places of one repeat, and a node with a document below another gives the removed places.
    A group's key is the window's trigger of `prefix` words, the least by hash within the window instead of its first words, so that the windows of a passage share a few keys instead of
    having one each; it lies in all places of a repeat. A trigger with more than `heavy` different contexts is lengthened to the whole window, so that one trigger fills no task. Suffixes whose trigger no other document has, or whose whole
    context stands in a smaller document, hang at no node that has to be built and are settled by hashes beforehand
    (32 bits of the trigger's and 56 of the context's; the trees compare 64-bit hashes of single words).

    Words are runs of [^\\x20\\x09-\\x0D], unchanged. Null and empty texts have no words; rows with a null id lose nothing and cause no removal; rows that share an id
    don't act on each other; ties and repeated rows have one result each; an empty table gives no rows; other columns are not read.
    A window repeated within one document only is no repeat. spans are maximal runs of removed words, end exclusive.
    """
    return remove_repeats(docs, key, text, Plan(n=window, k=min(prefix, window), words=True, heavy=heavy, **sizes), _index)

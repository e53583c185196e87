"""Folds, permutations and bootstrap draws from counts: replicates are random tables with the margins of the cells, so their cost follows groups and values, not records.

A dealt fold, a shuffled label or a drawn record only enters a statistic through how many records of each value a group (and fold) gets. Those counts are drawn
as they would come from records: hypergeometric where records are dealt without replacement, multinomial where with. Seeds come from the key and the
block of replicates, so results depend on no partitioning. The row-level forms in share and decompose give the same laws, number for number
reproducible in SQL; these are for full budgets.
"""

from __future__ import annotations

import hashlib
import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import debias, phipson_smyth
from tessera.operators.share import fold_average
from tessera.operators.staging import settled, tasks

BLOCK = 250
_MOST = 10**9 - 1


def _generator(*key: Any) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, key)).encode()).digest()[:8], "little"))


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """How many of `taken` records come from the good ones. Exact below 10^9 records; above, the nearest whole number of a normal with the same mean and variance, whose error is under 10^-4 of its deviation."""
    good, bad, taken = (np.asarray(x, np.int64) for x in np.broadcast_arrays(good, bad, taken))
    total = good + bad
    if not total.size or total.max() <= _MOST:
        return rng.hypergeometric(good, bad, taken)
    n, g, t = total.astype(float), good.astype(float), taken.astype(float)
    mean = t * g / np.maximum(n, 1)
    sd = np.sqrt(np.maximum(mean * (1 - g / np.maximum(n, 1)) * (n - t) / np.maximum(n - 1, 1), 0))
    far = np.rint(mean + sd * rng.standard_normal(n.shape)).astype(np.int64)
    out = np.clip(far, np.maximum(0, taken - bad), np.minimum(good, taken))
    small = total <= _MOST
    out[small] = rng.hypergeometric(good[small], bad[small], taken[small])
    return out


def _spread(rng: np.random.Generator, room: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n records (...) dealt at random over places with so much room (..., places): a table of that shape; n is the room where all of it is filled."""
    out = np.zeros_like(room)
    left, rest = np.array(n, np.int64), room.sum(-1)
    for i in range(room.shape[-1]):
        rest = rest - room[..., i]
        out[..., i] = hypergeometric(rng, room[..., i], rest, left)
        left = left - out[..., i]
    return out


def shuffled(rng: np.random.Generator, blocks: list[np.ndarray], reps: int) -> np.ndarray:
    """(reps, groups, values): the sum over blocks of tables (groups x values) with the margins of each block's and random entries."""
    out = np.zeros((reps, *blocks[0].shape), np.int64)
    for c in blocks:
        rows, cols = np.flatnonzero(c.sum(1)), np.flatnonzero(c.sum(0))
        room = np.repeat(c[rows].sum(1)[None], reps, 0)
        for v in cols[:-1]:
            got = _spread(rng, room, np.full(reps, c[:, v].sum()))
            out[:, rows, v] += got
            room = room - got
        out[:, rows, cols[-1]] += room
    return out


def dealt_skill(rng: np.random.Generator, tables: np.ndarray, values: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the skill of each table (reps x groups x values), dealt once: groups in random order, their records in random order, round the folds from a random one."""
    reps, groups, _ = tables.shape
    size = tables.sum(2)
    order = rng.random((reps, groups)).argsort(1)
    sorted_ = np.take_along_axis(size, order, 1)
    before = np.empty_like(size)
    np.put_along_axis(before, order, np.cumsum(sorted_, 1) - sorted_, 1)
    first = before + rng.integers(0, folds, (reps, 1))
    d = (np.arange(folds) - first[:, :, None]) % folds
    room = m = (size[:, :, None] + folds - 1 - d) // folds
    s, q = np.zeros(m.shape), np.zeros(m.shape)
    for v, value in enumerate(values):
        got = _spread(rng, room, tables[:, :, v]) if v < len(values) - 1 else room
        room = room - got
        s += got * value
        q += got * value * value
    gm, gs, gq = (x.sum(2, keepdims=True) for x in (m, s, q))
    fm, fs = m.sum(1, keepdims=True), s.sum(1, keepdims=True)
    am, total = gm.sum(1, keepdims=True), gs.sum(1, keepdims=True)
    v = np.where(gm > 1, np.maximum(0, gq - gs * gs / np.maximum(gm, 1)) / np.maximum(gm - 1, 1), 0.0)
    rest = (m * v).sum((1, 2))[:, None] - (m * v).sum(1)
    ok = ((am > fm) & (fm > 0))[:, 0]
    n, out_of = gm - m, np.maximum(am - fm, 1)
    grand = (total - fs) / out_of
    mean = np.where(n > 0, (gs - s) / np.maximum(n, 1), grand)
    miss = lambda x: q - 2 * x * s + m * x * x
    pen = np.where(n > 0, m * v / np.maximum(n, 1), 0.0)
    num = np.where(ok, (miss(mean) - pen).sum(1), 0.0).sum(1)
    den = np.where(ok, miss(grand).sum(1) - fm[:, 0] * rest / out_of[:, 0].astype(float) ** 2, 0.0).sum(1)
    return num, den


def _between(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    m, s = tables.sum(-1), tables @ values
    return np.where(m > 0, s * s / np.maximum(m, 1), 0.0).sum(-1)


def _replicates(cells: DataFrame, by: list[str], kinds: list[tuple[str, int]], schema: str, run: Any, seed: str | None = None) -> DataFrame:
    """run(key, kind, block, first replicate, count, cells) for each block of replicates of each key, in a task of its own."""
    jobs = [(kind, i, i * BLOCK + 1, min(BLOCK, n - i * BLOCK)) for kind, n in kinds for i in range(math.ceil(n / BLOCK))]
    if not jobs:
        jobs = [("none", 0, 1, 0)]
    job = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("block"), F.lit(a).alias("first"), F.lit(n).alias("count")) for k, i, a, n in jobs]))
    spread = cells.withColumn("_j", job).select(*cells.columns, "_j.*")
    types = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in by]
        kind, block, first, count = (pdf[c].iloc[0] for c in ("kind", "block", "first", "count"))
        # rows come in no fixed order
        pdf = pdf.assign(**{c: pdf[c].astype(str) for c in ("grp", "block_") if c in pdf}).sort_values([c for c in ("side", "block_", "grp", "y") if c in pdf], ignore_index=True)
        out = run(_generator(*(key if seed is None else [seed]), kind, block), str(kind), int(first), int(count), pdf)
        return pd.DataFrame({c: [k] * len(next(iter(out.values()))) for c, k in zip(by, key)} | out)

    # so few and small cells would be put into one task, and with them the work of all blocks
    at = [*by, "kind", "block"]
    return spread.repartition(tasks(spread, 0), *at).groupBy(*at).applyInPandas(one, f"{types}, {schema}")


def share(obs: DataFrame, by: list[str], folds: int = 5, repeats: int = 20, perms: int = 999, within: list[str] | None = None, seed: str | None = None, weight: str | None = None) -> DataFrame:
    """(by) -> the columns of share.share, and ss, exceed and p of share.permutation_test, all from cell counts. obs: repeated groups only; of a weight, a row stands for so many records.

    With a seed, keys whose cells are the same get the same numbers; without one, each key has its own. Labels are shuffled inside the blocks of `within`. The permutations of the test are those whose skill makes the null mean.
    """
    block = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within or []]) if within else F.lit("")
    # counted once: the records would be read and joined again for the closed form
    cells = settled(obs.groupBy(*by, block.alias("block_"), "grp", "y").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")))

    def run(rng: np.random.Generator, kind: str, first: int, count: int, pdf: pd.DataFrame) -> dict[str, Any]:
        values, vi = np.unique(pdf["y"].to_numpy(float), return_inverse=True)
        names, gi = np.unique(pdf["grp"], return_inverse=True)
        n = pdf["n"].to_numpy(np.int64)
        blocks = []
        for _, at in pdf.groupby("block_", sort=True).indices.items():
            c = np.zeros((len(names), len(values)), np.int64)
            np.add.at(c, (gi[at], vi[at]), n[at])
            blocks.append(c)
        whole = np.sum(blocks, 0)
        tables = shuffled(rng, blocks, count) if kind == "perm" else np.repeat(whole[None], count, 0)
        num, den = dealt_skill(rng, tables, values, folds)
        skill = np.where(den > 0, 1 - num / np.where(den > 0, den, 1), np.nan)
        return {"kind": [kind] * count, "rep": np.arange(first, first + count), "skill": [None if np.isnan(x) else x for x in skill], "denominator": den, "ss": _between(tables, values), "seen": np.full(count, _between(whole, values))}

    r = _replicates(cells, by, [("fold", repeats), ("perm", perms)], "kind string, rep long, skill double, denominator double, ss double, seen double", run, seed)
    fold, perm = F.col("kind") == "fold", F.col("kind") == "perm"
    when = lambda c, x: F.when(c, F.col(x))
    reach = perm & (F.col("ss") >= F.col("seen") - F.lit(1e-11) * F.abs(F.col("seen")))
    k = r.groupBy(*by).agg(
        F.avg(when(fold, "skill")).alias("kappa"), F.stddev_pop(when(fold, "skill")).alias("cv_sd"), F.avg(when(fold, "denominator")).alias("denominator"),
        F.avg(when(perm, "skill")).alias("null_mean"), F.max("seen").alias("ss"), F.count_if(reach).alias("exceed"),
    )
    k = k.join(fold_average(cells, by, "n"), by)
    ratio = F.col("denominator") / F.nullif(F.col("total"), F.lit(0.0))
    k = k.withColumns({"kappa_adj": debias(F.col("kappa"), F.col("null_mean")), "fold_ratio": ratio, "closed": F.when((F.col("total") > 0) & (ratio > 0), 1 - F.col("within") / (ratio * F.col("total")))})
    return k.select(*by, "kappa", "cv_sd", "null_mean", "kappa_adj", "fold_ratio", "closed", debias(F.col("closed"), F.col("null_mean")).alias("closed_adj"), "ss", "exceed", phipson_smyth(F.col("exceed"), perms).alias("p"))


def bootstrap(obs: DataFrame, by: list[str], a: str, b: str, reps: int) -> DataFrame:
    """(by, rep) -> composition and within of bootstrap pairs of collections, as decompose.bootstrap gives them for records, from multinomial cell counts."""
    cells = obs.filter(F.col("side").isin(a, b)).groupBy(*by, "side", "grp", "y").agg(F.count(F.lit(1)).alias("n"))

    def run(rng: np.random.Generator, kind: str, first: int, count: int, pdf: pd.DataFrame) -> dict[str, Any]:
        names, gi = np.unique(pdf["grp"], return_inverse=True)
        size, total = np.zeros((2, count, len(names))), np.zeros((2, count, len(names)))
        for k, side in enumerate((a, b)):
            at = np.flatnonzero(pdf["side"].to_numpy() == side)
            n = pdf["n"].to_numpy(np.int64)[at]
            if len(at):
                drawn = rng.multinomial(n.sum(), n / n.sum(), count)
                to = np.zeros((len(at), len(names)))
                to[np.arange(len(at)), gi[at]] = 1
                size[k] = drawn @ to
                total[k] = (drawn * pdf["y"].to_numpy(float)[at]) @ to
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.where(size > 0, total / size, np.nan)
            w = size / size.sum(2, keepdims=True)
        rate = np.where(np.isnan(rate), rate[::-1], rate)
        used = (size.sum(0) > 0)[None]
        w, rate = np.where(used, w, 0.0), np.where(used, rate, 0.0)
        comp, inside = ((w[0] - w[1]) * (rate[0] + rate[1]) / 2).sum(1), ((w[0] + w[1]) / 2 * (rate[0] - rate[1])).sum(1)
        null = lambda x: [None if np.isnan(v) else v for v in x]
        return {"rep": np.arange(first, first + count), "composition": null(comp), "within": null(inside)}

    return _replicates(cells, by, [("boot", reps)], "rep long, composition double, within double", run)

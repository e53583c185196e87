"""Numerical kernels over count tables: maximum likelihood of overlapping readings, bounds on the latent ordering, bootstrap intervals of the share.

Each takes what a grouped aggregation leaves of a feature (groups x cells), never its records, and runs in one grouped pandas call.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.special import clopper_pearson, f_quantile, fisher_exact, nnls, t_quantile


def seeded(*key: object) -> np.random.Generator:
    """A generator of a key's own, whatever partition it lands in."""
    return np.random.default_rng(int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:16], 16))


# readings


def npmle(cover: np.ndarray, weight: np.ndarray, tol: float = 1e-9, most: int = 500) -> np.ndarray:
    """Masses of elementary cells that maximise the likelihood of interval readings (rows of cover, with weights that sum to 1), by constrained Newton steps.

    Optimal when no cell's gradient exceeds 1. Masses may not be unique; cumulative masses at the ends of readings are.
    """
    p = np.full(cover.shape[1], 1.0) * (cover.max(0) > 0)
    p /= p.sum()
    for _ in range(most):
        like = cover @ p
        slope = (weight / like) @ cover
        if slope.max() <= 1 + tol:
            break
        use = np.flatnonzero((p > 0) | (slope >= slope.max() - 1e-12))
        root = np.sqrt(weight)
        design = np.concatenate([cover[:, use] * (root / like)[:, None], np.ones((1, len(use)))])
        step = np.zeros_like(p)
        step[use] = nnls(design, np.concatenate([2 * root, [0.0]]))
        if step.sum() <= 0:
            break
        step /= step.sum()
        value, t = weight @ np.log(like), 1.0
        while t > 1e-10:
            trial = cover @ ((1 - t) * p + t * step)
            if (trial > 0).all() and weight @ np.log(trial) >= value:
                break
            t /= 2
        p = (1 - t) * p + t * step
        p[p < 1e-15] = 0
        p /= p.sum()
    return p


def reading_scores(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mid-distribution score of each distinct reading: mass below it and half of its own."""
    cells = int(last.max()) + 1
    at = np.arange(cells)
    cover = ((at >= first[:, None]) & (at <= last[:, None])).astype(float)
    cum = np.concatenate([[0.0], np.cumsum(npmle(cover, n / n.sum()))])
    return cum[first] + (cum[last + 1] - cum[first]) / 2


def npmle_scores(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells of readings.cells with `score`, for readings that may overlap."""
    cols = [*by, "lo", "hi", "n", "first", "last"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "last"]).reset_index(drop=True)
        return pdf.assign(score=reading_scores(pdf["first"].to_numpy(), pdf["last"].to_numpy(), pdf["n"].to_numpy(float)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*cols).schema) + ", score double"
    return cells.select(*cols).groupBy(*by).applyInPandas(run, schema)


# bounds on the latent ordering


class Ordering:
    """Group shares of cells with the rank range of each cell: all orderings of groups inside cells, and the share of rank variance between groups that each gives."""

    def __init__(self, table: np.ndarray, bottom: np.ndarray, top: np.ndarray):
        keep = table.any(0)
        self.counts, low, high = table[:, keep].astype(float), bottom, top
        self.p = self.counts / self.counts.sum()
        self.w, self.cell = self.p.sum(1), self.p.sum(0)
        self.high, self.span = high[keep], (high - low)[keep]
        self.part = self.p / self.cell
        self.alone = self.p @ self.high - (self.p * self.span * self.part).sum(1) / 2
        self.pull = (self.part * (self.cell * self.span)) @ self.part.T

    def point(self, order: np.ndarray) -> np.ndarray:
        """Rank totals of the groups if they stand in this order, the first on top of every cell."""
        above = np.tril(self.pull[np.ix_(order, order)], -1).sum(1)
        out = np.empty(len(order))
        out[order] = self.alone[order] - above
        return out

    def rho(self, x: np.ndarray) -> float:
        return float(12 * (x @ (x / self.w) - 0.25))

    def middle(self) -> np.ndarray:
        return self.p @ (self.high - self.span / 2)

    def merged(self) -> Ordering:
        """Groups of one profile taken together: no ordering tells them apart at the minimum."""
        alike: dict[bytes, np.ndarray] = {}
        for row in self.counts:
            profile = np.round(row / row.sum(), 12).tobytes()
            alike[profile] = alike.get(profile, 0) + row
        return Ordering(np.array(list(alike.values())), self.high - self.span, self.high)

    def least(self, tol: float = 1e-10, most: int = 2000) -> tuple[float, np.ndarray]:
        """Certified lower end of rho, and the group means at the best point. Frank-Wolfe, with the minimum-norm combination of all corners so far found anew at each (by non-negative least squares)."""
        root = np.sqrt(self.w)
        corners = [self.point(np.argsort(self.middle() / self.w, kind="stable"))]
        best, at, x, stale = -np.inf, corners[0], corners[0], 0
        for _ in range(most):
            corner = self.point(np.argsort(x / self.w, kind="stable"))
            gap = max(0.0, 24 * float((x - corner) @ (x / self.w)))
            floor = self.rho(x) - max(gap, tol)
            stale = 0 if floor > best + 1e-14 else stale + 1
            if floor > best:
                best, at = floor, x
            if gap <= tol or stale > 20:
                break
            corners.append(corner)
            a = np.array(corners) / root
            scale = np.sqrt((a * a).sum(1).mean()) or 1.0
            lam = nnls(np.concatenate([(a / scale).T, np.ones((1, len(corners)))]), np.concatenate([np.zeros(a.shape[1]), [1.0]]))
            lam /= lam.sum()
            x = lam @ np.array(corners)
            corners = [c for c, v in zip(corners, lam) if v > 1e-13]
        return max(0.0, best), at / self.w

    def greatest_exact(self) -> float:
        """Largest sum of x^2 / w over all orders, by the sets that can stand on top."""
        g = len(self.w)
        value = np.full(1 << g, -np.inf)
        value[0] = 0.0
        size = np.zeros(1 << g, np.int8)
        for i in range(g):
            size[1 << i : 2 << i] = size[: 1 << i] + 1
        by_size = np.argsort(size, kind="stable")
        edges = np.searchsorted(size[by_size], np.arange(g + 1))
        for k in range(g):
            level = by_size[edges[k] : edges[k + 1]]
            inside = (level[:, None] >> np.arange(g)) & 1
            x = self.alone - inside @ self.pull
            for i in range(g):
                out = inside[:, i] == 0
                to = level[out] | (1 << i)
                np.maximum.at(value, to, value[level[out]] + x[out, i] ** 2 / self.w[i])
        return float(value[-1])

    def greatest_found(self, restarts: int, random: np.random.Generator) -> float:
        """A large sum by moving single groups to their best place until none gains."""
        best = -np.inf
        for s in range(restarts + 1):
            order = np.argsort(-self.middle() / self.w, kind="stable") if not s else random.permutation(len(self.w))
            now = float((self.point(order) ** 2 / self.w).sum())
            moved = True
            while moved:
                moved = False
                for g in list(order):
                    rest = order[order != g]
                    x = self.alone[rest] - np.tril(self.pull[np.ix_(rest, rest)], -1).sum(1)
                    c = self.pull[rest, g]
                    up, down = np.concatenate([[0.0], np.cumsum(x * x / self.w[rest])]), (x - c) ** 2 / self.w[rest]
                    tail = np.concatenate([np.cumsum(down[::-1])[::-1], [0.0]])
                    own = self.alone[g] - np.concatenate([[0.0], np.cumsum(c)])
                    totals = up + tail + own * own / self.w[g]
                    j = int(totals.argmax())
                    if totals[j] > now + 1e-13:
                        order, now, moved = np.insert(rest, j, g), float(totals[j]), True
            best = max(best, now)
        return best

    def greatest_bound(self, found: float, nodes: int = 500) -> float:
        """A certified bound on the largest sum: best-first search over the sets on top; a set's rest is bounded by chords of the squares and by their ranges."""
        g = len(self.w)
        floor = self.alone - (self.pull.sum(1) - np.diag(self.pull))

        def rest_bound(mask: int) -> float:
            r = np.array([i for i in range(g) if not mask >> i & 1])
            if not len(r):
                return 0.0
            on = np.array([i for i in range(g) if mask >> i & 1], int)
            top, low = self.alone[r] - self.pull[np.ix_(r, on)].sum(1), floor[r]
            slope = (low + top) / self.w[r]
            pair = np.minimum(slope[:, None], slope) * self.pull[np.ix_(r, r)]
            chord = slope @ top - (pair.sum() - np.trace(pair)) / 2 - (low * top / self.w[r]).sum()
            return float(min(chord, np.maximum(low * low, top * top) @ (1 / self.w[r])))

        heap, seen, tick = [(-rest_bound(0), 0, 0, 0.0)], {0: 0.0}, itertools.count(1)
        while heap:
            bound, _, mask, value = heapq.heappop(heap)
            if -bound <= found + 1e-12:
                return found
            if nodes <= 0:
                return -bound
            nodes -= 1
            on = [i for i in range(g) if mask >> i & 1]
            for i in range(g):
                if mask >> i & 1:
                    continue
                x = self.alone[i] - self.pull[i, on].sum()
                child, total = mask | 1 << i, value + x * x / self.w[i]
                if child in seen and seen[child] >= total:
                    continue  # this set was reached by an order that is no worse
                seen[child] = total
                if child == (1 << g) - 1:
                    found = max(found, total)
                else:
                    heapq.heappush(heap, (-(total + rest_bound(child)), next(tick), child, total))
        return found

    def greatest(self, rng: np.random.Generator, exact_first: int = 12, exact_last: int = 20) -> tuple[float, float, bool]:
        """Attained and certified upper end of rho, and whether they are one. Up to exact_last groups the sets are enumerated (2^20 x 20 steps) where the search proves too little."""
        to = lambda v: 12 * (v - 0.25)
        if len(self.w) <= exact_first:
            v = self.greatest_exact()
            return to(v), to(v), True
        found = self.greatest_found(10, rng)
        bound = min(self.greatest_bound(found), 1 / 12 + 0.25)  # no share passes 1
        if bound - found > 1e-12 and len(self.w) <= exact_last:
            v = self.greatest_exact()
            return to(v), to(v), True
        return to(found), to(bound), bound - found <= 1e-12


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    share = counts.sum(0) / counts.sum()
    upto = np.cumsum(share)
    return np.maximum(upto - share, 0.0), upto


def split_lower_limit(tables: list[np.ndarray], rng: np.random.Generator, splits: int = 25, alpha: float = 0.05) -> float:
    """A lower confidence limit of the share between groups, from group x cell tables per stratum.

    Records are halved at random inside (group, stratum); one half chooses a direction (the group means at the lower end), the other estimates the share along it by the
    pairs of groups of which one reads below the other; the variance comes from the whole table, smoothed. Both halves take turns; the estimates of all splits are averaged before the quantile.
    """
    n_cell = np.array([t.sum(1) for t in tables]).T
    n, w = n_cell.sum(), n_cell.sum(1) / n_cell.sum()
    est, sds, dfs = [], [], []
    for _ in range(splits):
        halves = ([], [])
        for t in tables:
            first = np.zeros_like(t)
            for g in range(len(t)):
                m = int(t[g].sum())
                k = m // 2 + (int(rng.random() < 0.5) if m % 2 else 0)
                if k:
                    first[g] = rng.multivariate_hypergeometric(t[g].astype(int), k)
            halves[0].append(first)
            halves[1].append(t - first)
        for pick, judge in (halves, halves[::-1]):
            e, v, df = 0.0, 0.0, math.inf
            whole = np.concatenate(pick, 1)
            there = whole.sum(1) > 0
            if there.sum() >= 2:
                low, high = zip(*[_ranges(t) if t.sum() else (np.zeros(t.shape[1]), np.zeros(t.shape[1])) for t in pick])
                z = np.zeros(len(w))
                z[there] = Ordering(whole[there], np.concatenate(low), np.concatenate(high)).least()[1] - 0.5
                z[~there] = (w[there] @ z[there]) / w[there].sum()
                z -= w @ z
                scale = w @ (z * z)
                if scale > 1e-15:
                    e, v, df = _along(z, judge, tables, n_cell, n)
                    e, v = e / math.sqrt(scale), v / scale
            est.append(e)
            sds.append(math.sqrt(v))
            dfs.append(df)
    mean, sd = float(np.mean(est)), float(np.mean(sds))
    if not sd > 0:
        return max(0.0, 12 * mean * abs(mean)) if mean > 0 else 0.0
    finite = [d for d in dfs if math.isfinite(d)]
    edge = mean - t_quantile(1 - alpha, max(1.0, float(np.median(finite))) if finite else math.inf) * sd
    return 12 * edge * edge if edge > 0 else 0.0


def _along(z: np.ndarray, part: list[np.ndarray], full: list[np.ndarray], n_cell: np.ndarray, n: float) -> tuple[float, float, float]:
    """Estimate, variance and degrees of freedom of the covariance of ranks with z."""
    total, terms, dfs = 0.0, [], []
    for s, (b, f) in enumerate(zip(part, full)):
        here = n_cell[:, s]
        if not here.any():
            continue
        below = np.triu(np.ones((b.shape[1], b.shape[1])), 1)  # cells are in order
        mb, mf = b.sum(1), f.sum(1)
        gap = z[:, None] - z
        weight = np.where((gap > 0) & (mf > 0)[:, None] & (mf > 0), np.outer(here, here / here.sum()) / n * gap, 0.0)
        fb, ff = b / np.maximum(mb, 1)[:, None], f / np.maximum(mf, 1)[:, None]
        both = np.outer(mb > 0, mb > 0)
        under = (fb @ below @ fb.T).T
        total += float(np.where(both, weight * (under - 0.5), -0.5 * weight).sum())
        used = np.where(both, weight, 0.0)
        phi = used @ (ff @ below) + used.T @ (ff @ below.T)
        for g in np.flatnonzero(mb > 0):
            law = (f[g] + 1 / f.shape[1]) / (mf[g] + 1)
            var = float(law @ (phi[g] - law @ phi[g]) ** 2) * mf[g] / max(mf[g] - 1, 1)
            terms.append(var / mb[g])
            dfs.append(mf[g])
        pairs = np.outer(mf, mf)
        theta = ((ff @ below @ ff.T).T * pairs + 0.5) / (pairs + 1)
        second = float(np.where(both, used**2 * theta * (1 - theta) / np.maximum(np.outer(mb, mb), 1), 0.0).sum())
        # of pairs, as exact as their number
        terms += [second] * (second > 0)
        dfs += [math.inf] * (second > 0)
    t = np.array(terms)
    v = float(t.sum())
    spread = float((t * t / np.array(dfs)).sum()) if terms else 0.0
    return total, v, v * v / spread if spread > 0 else math.inf


BOUNDS = "lower double, upper double, upper_bound double, upper_exact boolean, midpoint double, resolution double, lower_limit double, n long, n_groups long"


def latent_bounds(counts: DataFrame, by: list[str], splits: int = 25) -> DataFrame:
    """(by) -> bounds on the share of the latent ordering between groups, from counts (by, stratum, grp, run, n)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in by]
        groups = sorted(pdf["grp"].unique())
        tables, low, high = [], [], []
        for _, part in sorted(pdf.groupby("stratum"), key=lambda x: str(x[0])):
            runs = sorted(part["run"].unique())
            t = np.zeros((len(groups), len(runs)))
            np.add.at(t, (np.searchsorted(groups, part["grp"].to_numpy()), np.searchsorted(runs, part["run"].to_numpy())), part["n"].to_numpy(float))
            tables.append(t)
            a, b = _ranges(t)
            low.append(a)
            high.append(b)
        o = Ordering(np.concatenate(tables, 1), np.concatenate(low), np.concatenate(high))
        rng = seeded("bounds", *key)
        lower = o.merged().least()[0]
        upper, bound, exact = o.greatest(rng)
        limit = min(split_lower_limit(tables, rng, splits), lower)
        row = [*key, lower, upper, bound, exact, o.rho(o.middle()), 1 - float(o.cell @ o.span**2), limit, int(pdf["n"].sum()), len(groups)]
        return pd.DataFrame([row], columns=[*by, *[f.split()[0] for f in BOUNDS.split(", ")]])

    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by) + ", " + BOUNDS
    return counts.groupBy(*by).applyInPandas(run, schema)


# interval of the share


def _closed(c: np.ndarray, v: np.ndarray, ratio: float) -> float:
    m, s, q = c.sum(1), c @ v, c @ (v * v)
    total = q.sum() - s.sum() ** 2 / m.sum()
    return 1 - float((np.maximum(q - s * s / m, 0) * m / np.maximum(m - 1, 1)).sum()) / (ratio * total) if total > 1e-12 and ratio > 0 else math.nan


def _jackknife(c: np.ndarray, v: np.ndarray, allowed: np.ndarray, ratio: float, null: float) -> float:
    """Infinitesimal-jackknife standard error of the closed form under smoothed laws, in moments up to the fourth."""
    m, n = c.sum(1), c.sum()
    v = (v - (c.sum(0) @ v) / n) / (math.sqrt(max((c.sum(0) @ v**2) / n - ((c.sum(0) @ v) / n) ** 2, 1e-300)))
    pow_ = np.array([v**j for j in range(1, 5)]).T
    s1, s2 = c @ v, c @ v**2
    f = m / np.maximum(m - 1, 1)
    num = float((f * (s2 - s1 * s1 / m)).sum())
    mean = s1.sum() / n
    total = s2.sum() - n * mean * mean
    if not (total > 0 and ratio > 0 and null < 1):
        return math.nan
    k = 1 / (ratio * total * total * (1 - null))
    one, two = 2 * f * total * s1 / m - 2 * num * mean, num - f * total
    mu = (c @ pow_ + (allowed @ pow_) / allowed.sum(1, keepdims=True)) / (m + 1)[:, None]
    m1, m2, m3, m4 = mu.T
    linear, square, both = m2 - m1 * m1, m4 - m2 * m2, m3 - m1 * m2
    var = (one * one * linear) + (two * two * square) + 2 * (one * two * both)
    return math.sqrt(float((m * m / np.maximum(m - 1, 1) * np.maximum(k * k * var, 0)).sum()))


def _scored(values: np.ndarray, stratum: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Values about the mean of their stratum."""
    out = values.astype(float).copy()
    for s in np.unique(stratum):
        i = stratum == s
        if weights[i].sum() > 0:
            out[i] -= weights[i] @ out[i] / weights[i].sum()
    return out


def single_group_gain(c: np.ndarray, v: np.ndarray, ratio: float, null: float, angles: int = 64) -> float:
    """By how much the share could grow if one group's law moved inside its empirical-likelihood region; directions in the plane of mean and second moment, each followed to the region's edge."""
    n, y = c.sum(), v - (c.sum(0) @ v) / c.sum()
    scale = math.sqrt(float(c.sum(0) @ y**2) / n)
    if not scale > 0:
        return math.nan
    y = y / scale
    m, s1, s2 = c.sum(1), c @ y, c @ y**2
    f, ss = m / np.maximum(m - 1, 1), np.maximum(s2 - s1 * s1 / m, 0)
    num, t1, t2 = float((f * ss).sum()), float(s1.sum()), float(s2.sum())
    base, best = 1 - num / (ratio * (t2 - t1 * t1 / n)), -math.inf
    for g in range(len(m)):
        use = c[g] > 0
        ph, yy = c[g][use] / m[g], y[use]
        radius = f_quantile(0.95, 1, max(m[g] - 1, 1.0)) / (2 * m[g])

        def edge(theta: float, g: int = g, ph: np.ndarray = ph, yy: np.ndarray = yy, radius: float = radius) -> float:
            d = math.cos(theta) * yy + math.sin(theta) * yy * yy
            lo, hi = -30.0, 30.0
            for _ in range(40):
                mid = (lo + hi) / 2
                q = ph / (d.max() + math.exp(mid) - d)
                far = float(ph @ (np.log(ph) - np.log(q))) + math.log(q.sum()) > radius
                lo, hi = (mid, hi) if far else (lo, mid)
            q = ph / (d.max() + math.exp(hi) - d)
            q /= q.sum()
            mu, m2 = float(q @ yy), float(q @ yy**2)
            total = t2 - s2[g] + m[g] * m2 - (t1 - s1[g] + m[g] * mu) ** 2 / n
            return 1 - (num - f[g] * ss[g] + m[g] * (m2 - mu * mu)) / (ratio * total) if total > 0 else -math.inf

        scan = [edge(2 * math.pi * k / angles) for k in range(angles)]
        k = int(np.argmax(scan))
        a, b, r = 2 * math.pi * (k - 1) / angles, 2 * math.pi * (k + 1) / angles, (math.sqrt(5) - 1) / 2
        best = max(best, scan[k])
        for _ in range(20):
            x, z = b - r * (b - a), a + r * (b - a)
            ex, ez = edge(x), edge(z)
            best = max(best, ex, ez)
            a, b = (a, z) if ex >= ez else (x, b)
    return (best - base) / (1 - null) if math.isfinite(best) else math.nan


def share_interval(c: np.ndarray, values: np.ndarray, stratum: np.ndarray, adj: float, ratio: float, null: float, cv_sd: float, repeats: int, draws: int, perms: int, rng: np.random.Generator) -> tuple[float, float, float, int]:
    """Low, high, standard error and usable draws of a smoothed bootstrap-t interval, widened to the spread of studentised permuted shares."""
    g, k = c.shape
    seen = np.zeros((g, int(stratum.max()) + 1), bool)
    for s in range(seen.shape[1]):
        seen[:, s] = c[:, stratum == s].sum(1) > 0
    allowed = seen[:, stratum].astype(float)
    m = c.sum(1)
    law = (c + allowed / allowed.sum(1, keepdims=True)) / (m + 1)[:, None]
    v0 = _scored(values, stratum, c.sum(0))
    vw = _scored(values, stratum, law.T @ m)
    mu, m2, w = law @ vw, law @ vw**2, m / m.sum()
    apart, inside = float(w @ mu**2 - (w @ mu) ** 2), float(w @ (m2 - mu * mu))
    truth = apart / (apart + inside)
    noise = cv_sd / math.sqrt(repeats) / (1 - null) if repeats > 1 and math.isfinite(cv_sd) else 0.0
    shuffled, studs = [], []
    for _ in range(perms):
        p = np.zeros_like(c)
        for s in range(seen.shape[1]):
            i = np.flatnonzero(stratum == s)
            left = c[:, i].sum(0).astype(int)
            for row in range(g):
                take = int(c[row, i].sum())
                if take:
                    got = rng.multivariate_hypergeometric(left, take)
                    p[row, i] = got
                    left = left - got
        shuffled.append((_closed(p, v0, ratio), p))
    null_var = float(np.var([x for x, _ in shuffled], ddof=1)) / (1 - null) ** 2 if perms > 1 else 0.0
    added = noise * noise + null_var
    se = math.sqrt(_jackknife(c, v0, allowed, ratio, null) ** 2 + added)
    if not (math.isfinite(se) and se > 0 and math.isfinite(truth)):
        return math.nan, math.nan, math.nan, 0
    for x, p in shuffled:
        e = math.sqrt(_jackknife(p, v0, allowed, ratio, null) ** 2 + added)
        studs.append(((x - null) / (1 - null) + rng.normal(0, noise)) / e)
    t = []
    for _ in range(draws):
        d = np.array([rng.multinomial(int(m[i]), law[i] / law[i].sum()) for i in range(g)], float)
        v = _scored(values, stratum, d.sum(0))
        x, e = _closed(d, v, ratio), math.sqrt(_jackknife(d, v, allowed, ratio, null) ** 2 + added)
        if math.isfinite(x) and math.isfinite(e) and e > 0:
            t.append(((x - null) / (1 - null) + rng.normal(0, noise) - truth) / e)
    if len(t) < max(2, 0.9 * draws):
        return math.nan, math.nan, se, len(t)
    lo, hi = np.quantile(t, [0.025, 0.975])
    if len(studs) > 1:
        a, b = np.quantile(studs, [0.025, 0.975])
        lo, hi = min(lo, a), max(hi, b)
    high, gain = adj - se * lo, single_group_gain(c, v0, ratio, null)
    if math.isfinite(gain):
        high = max(high, adj + gain)
    return min(1.0, max(0.0, adj - se * hi)), min(1.0, max(0.0, high)), se, len(t)


def share_intervals(cells: DataFrame, shares: DataFrame, by: list[str], repeats: int, draws: int = 199, perms: int = 99) -> DataFrame:
    """(by) -> low, high, se, draws, from cells (by, grp, stratum, y, n) and the shares of share.share."""
    cols = ["kappa_adj", "fold_ratio", "null_mean", "cv_sd"]
    joined = cells.join(F.broadcast(shares.select(*by, *cols)), by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in by]
        gi = np.unique(pdf["grp"], return_inverse=True)
        si = np.unique(pdf["stratum"].astype(str), return_inverse=True)
        cats, ci = np.unique(np.array(list(zip(si[1], pdf["y"]))), axis=0, return_inverse=True)
        c = np.zeros((len(gi[0]), len(cats)))
        np.add.at(c, (gi[1], ci.ravel()), pdf["n"].to_numpy(float))
        adj, ratio, null, sd = (float(pdf[x].iloc[0]) if pd.notna(pdf[x].iloc[0]) else math.nan for x in cols)
        out = share_interval(c, cats[:, 1], cats[:, 0].astype(int), adj, ratio, null, sd, repeats, draws, perms, seeded("share", *key)) if math.isfinite(adj) else (math.nan, math.nan, math.nan, 0)
        return pd.DataFrame([[*key, *out]], columns=[*by, "low", "high", "se", "draws"])

    schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by) + ", low double, high double, se double, draws long"
    return joined.groupBy(*by).applyInPandas(run, schema)


# small tables


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)])


@F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
def clopper_pearson_limits(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    rows = [clopper_pearson(int(x), int(y)) if y else (math.nan, math.nan) for x, y in zip(k, n)]
    return pd.DataFrame(rows, columns=["lower", "upper"])


def mutual_information(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information of two labelings and their entropies, in nats, from the contingency counts."""
    n = pairs.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = pairs.count()
    na, nb = n.groupBy(a).agg(F.sum("c").alias("ca")), n.groupBy(b).agg(F.sum("c").alias("cb"))
    j = n.join(na, a).join(nb, b)
    # each entropy term counts once per pair with its share of the label's records
    part = F.col("c") / total
    return j.agg(
        F.sum(part * F.log(F.col("c") * total / (F.col("ca") * F.col("cb")))).alias("mi"), (-F.sum(part * F.log(F.col("ca") / total))).alias("h_a"), (-F.sum(part * F.log(F.col("cb") / total))).alias("h_b")
    )

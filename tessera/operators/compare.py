"""Two labelings of the same records: six arms from what each can use to what both can, and the terms between them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import untyped
from tessera.operators import counted
from tessera.operators.ingest import scorable_labels
from tessera.operators.share import share
from tessera.operators.staging import settled, small

ARMS = ("available_a", "common_a", "scorable_a", "scorable_b", "common_b", "available_b")
TERMS = ("selection_from_a", "singletons_under_a", "labels_on_scorable", "singletons_under_b", "selection_to_b")


def counted_pairs(records: DataFrame) -> DataFrame:
    """(label_a, label_b, y, named) -> n: records with an outcome, by all that the arms and their contrasts depend on; whether they have an id."""
    seen = records.filter(F.col("y").isNotNull())
    return settled(seen.groupBy("label_a", "label_b", "y", F.col("id").isNotNull().alias("named")).agg(F.count(F.lit(1)).alias("n")))


def _placed(seen: DataFrame, pairs: DataFrame, named: Column) -> DataFrame:
    """seen with arm, grp and stratum, once for each arm that can use it. Which records are scorable is decided by their two labels, looked up in the pairs (label_a, label_b, n), not by id."""
    has_a, has_b = ~untyped(F.col("label_a")), ~untyped(F.col("label_b"))
    r = seen
    for labels, c in zip(scorable_labels(pairs, "label_a", "label_b"), ("label_a", "label_b")):
        r = r.join(small(labels.withColumn(f"_{c}", F.lit(True))), c, "left")
    core = F.coalesce(F.col("_label_a") & F.col("_label_b"), F.lit(False)) & named
    use = {"available_a": has_a, "common_a": has_a & has_b, "scorable_a": core, "scorable_b": core, "common_b": has_a & has_b, "available_b": has_b}
    out = r.select(*seen.columns, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(a)) for a, c in use.items()]))).alias("arm"))
    return out.withColumns({"grp": F.when(F.col("arm").endswith("_a"), F.col("label_a")).otherwise(F.col("label_b")), "stratum": F.lit("all")})


def arms(records: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(arm, id, y, grp, stratum): records (id, y, label_a, label_b) with an outcome, once for each arm that can use them."""
    seen = records.filter(F.col("y").isNotNull())
    pairs = seen.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n")) if pairs is None else pairs.groupBy("label_a", "label_b").agg(F.sum("n").alias("n"))
    return _placed(seen, pairs, F.col("id").isNotNull()).select("arm", "id", "y", "grp", "stratum")


def arm_counts(pairs: DataFrame) -> DataFrame:
    """The same as counts, pairs with arm, grp and stratum: a row stands for n records."""
    return _placed(pairs, pairs.groupBy("label_a", "label_b").agg(F.sum("n").alias("n")), F.col("named"))


def scored(arm: DataFrame, n: Column | None = None) -> DataFrame:
    # sizes are counted map-side first and then met, so that no group has to stand in one task
    size = F.count(F.lit(1)) if n is None else F.sum(n)
    return arm.join(small(arm.groupBy("arm", "grp").agg(size.alias("_m")).filter("_m >= 2").select("arm", "grp")), ["arm", "grp"], "left_semi").select(*arm.columns)


def digests(arm: DataFrame) -> DataFrame:
    """(arm) -> records, and a digest of their ids that needs no list of them: the sum of 48-bit hashes."""
    h = F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("decimal(38,0)")
    return arm.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("digest"))


def arm_truth(records: DataFrame) -> DataFrame:
    """(arm) -> share of the label under rates smoothed in the cells of both labels, (s + 1/2) / (n + 1)."""
    seen = records.filter(F.col("y").isNotNull())
    cell = [F.coalesce("label_a", F.lit("")).alias("ka"), F.coalesce("label_b", F.lit("")).alias("kb")]
    rate = seen.groupBy(*cell).agg(((F.sum("y") + 0.5) / (F.count(F.lit(1)) + 1)).alias("q"))
    keyed = seen.select("id", *cell).join(rate, ["ka", "kb"]).select("id", "q")
    g = scored(arms(records)).join(keyed, "id").groupBy("arm", "grp").agg(F.count(F.lit(1)).alias("m"), F.avg("q").alias("mu"))
    g = g.withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy("arm")))
    a = g.groupBy("arm").agg(F.sum(F.col("w") * F.col("mu") * (1 - F.col("mu"))).alias("within"), (F.sum(F.col("w") * F.col("mu") * F.col("mu")) - F.pow(F.sum(F.col("w") * F.col("mu")), F.lit(2))).alias("between"))
    return a.select("arm", (F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0))).alias("truth"))


def arm_shares(records: DataFrame, folds: int = 5, repeats: int = 5, perms: int = 9) -> DataFrame:
    return share(scored(arms(records)), ["arm"], folds, repeats, perms)


CONTRASTS = (*TERMS, "change_on_common", "total")
_CONTRAST = np.array([*(np.eye(6)[i + 1] - np.eye(6)[i] for i in range(5)), np.eye(6)[4] - np.eye(6)[1], np.eye(6)[5] - np.eye(6)[0]])


def arm_cells(counts: DataFrame) -> DataFrame:
    """(arm, cell, grp, n, s): the records (counts of them) of each arm's repeated groups by the pair of labels, which decides on every arm."""
    pair = F.to_json(F.struct("label_a", "label_b"), {"ignoreNullFields": "false"}).alias("cell")
    return counts.filter("named").groupBy("arm", pair, "grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("s"))


class _Arm:
    """One arm over the cells it scores."""

    def __init__(self, cells: np.ndarray, grp: np.ndarray, share: dict[str, float], repeats: int):
        self.cells, self.ratio, self.null = cells, share["fold_ratio"], share["null_mean"]
        self.names, self.group = np.unique(grp, return_inverse=True)
        sd = share["cv_sd"]
        self.spread = sd / math.sqrt(repeats) / (1 - self.null) if math.isfinite(sd) else 0.0

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.group, x[self.cells], len(self.names))

    def value(self, n: np.ndarray, s: np.ndarray) -> float:
        m, p = self.sums(n), self.sums(s)
        total = p.sum() * (1 - p.sum() / m.sum()) if len(m) else 0.0
        if not total > 0:
            return math.nan
        closed = 1 - ((p - p * p / m) * m / np.maximum(m - 1, 1)).sum() / (self.ratio * total)
        return (closed - self.null) / (1 - self.null)

    def gap(self, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        """By how much the derivative of the share to a record's weight is larger at outcome 1 than at 0, for each cell."""
        m, p = self.sums(n), self.sums(s)
        inside, f, df = p - p * p / m, m / np.maximum(m - 1, 1), -1 / np.maximum(m - 1, 1) ** 2
        mean, total, num = p.sum() / m.sum(), p.sum() * (1 - p.sum() / m.sum()), (f * inside).sum()
        d = [-((df * inside + f * (y - p / m) ** 2) * total - num * (y - mean) ** 2) / (self.ratio * total * total) / (1 - self.null) for y in (0.0, 1.0)]
        out = np.zeros(len(n))
        out[self.cells] = (d[1] - d[0])[self.group]
        return out

    def truth(self, n: np.ndarray, rate: np.ndarray) -> float:
        m = self.sums(n)
        mu, w = self.sums(n * rate) / m, m / m.sum()
        inside, apart = float(w @ (mu * (1 - mu))), float(w @ (mu - w @ mu) ** 2)
        return apart / (apart + inside) if apart + inside > 0 else math.nan


def paired_intervals(counts: DataFrame, shares: DataFrame, repeats: int = 20, draws: int = 999) -> DataFrame:
    """(contrast) -> estimate, se, lower, upper, draws of the five terms, the change on common records and the total: paired bootstrap-t.

    Outcomes are redrawn in every cell of both labels at its rate (s + 1/2) / (n + 1), once for all arms, as counts. Each arm's closed-form share of the drawn counts, with the spread
    of its fold assignments added (once for arms that score the same records under the same label), is set against the truth of those rates and divided by the contrast's
    standard error in the draw: an infinitesimal jackknife over records. Fewer than nine in ten usable draws give no limits. One task has the table of label pairs, whose size does not follow the records.
    """
    cells = arm_cells(counts).join(F.broadcast(shares.select("arm", "kappa_adj", "fold_ratio", "null_mean", "cv_sd")), "arm")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "arm"], ignore_index=True)
        names, at = np.unique(pdf["cell"], return_inverse=True)
        n, s = np.zeros(len(names)), np.zeros(len(names))
        n[at], s[at] = pdf["n"].to_numpy(float), pdf["s"].to_numpy(float)
        rate = (s + 0.5) / (n + 1)
        out = lambda est, se, lo, hi, k: pd.DataFrame({"contrast": CONTRASTS, "estimate": est, "se": se, "lower": lo, "upper": hi, "draws": k})
        none = np.full(7, np.nan)
        parts, points = [], []
        for arm in ARMS:
            mine = np.flatnonzero(pdf["arm"].to_numpy() == arm)
            first = pdf.iloc[mine[0]] if len(mine) else None
            if first is None or pd.isna([first[c] for c in ("kappa_adj", "fold_ratio", "null_mean")]).any() or not first["fold_ratio"] > 0:
                return out(none, none, none, none, 0)
            parts.append(_Arm(at[mine], pdf["grp"].to_numpy()[mine].astype(str), {c: float(first[c]) for c in ("fold_ratio", "null_mean", "cv_sd")}, repeats))
            points.append(float(first["kappa_adj"]))
        keys = [(arm[-1], p.cells.tobytes()) for arm, p in zip(ARMS, parts)]
        lead = [keys.index(k) for k in keys]
        noise_of = np.array([[sum(c[j] for j in range(6) if lead[j] == i) for i in range(6)] for c in _CONTRAST])
        spread = np.array([p.spread for p in parts])

        def error(s_: np.ndarray) -> np.ndarray:
            q = (s_ + 0.5) / (n + 1)
            gap = _CONTRAST @ np.stack([p.gap(n, s_) for p in parts])
            return np.sqrt((n * n / np.maximum(n - 1, 1) * q * (1 - q) * gap * gap).sum(1) + ((noise_of * spread) ** 2).sum(1))

        estimate, truth = _CONTRAST @ np.array(points), _CONTRAST @ np.array([p.truth(n, rate) for p in parts])
        if not np.isfinite([p.value(n, s) for p in parts]).all() or not np.isfinite(truth).all():
            return out(estimate, none, none, none, 0)
        se, rng, t = error(s), np.random.default_rng(20_240_617), []
        for _ in range(draws):
            drawn = rng.binomial(n.astype(np.int64), rate).astype(float)
            noise = rng.standard_normal(6) * spread
            value = np.array([p.value(n, drawn) for p in parts]) + noise[lead]
            if np.isfinite(value).all():
                e = error(drawn)
                t.append(np.where(e > 0, (_CONTRAST @ value - truth) / np.where(e > 0, e, 1), 0.0))
        if len(t) < max(2, 0.9 * draws):
            return out(estimate, se, none, none, len(t))
        lo, hi = np.quantile(t, [0.025, 0.975], axis=0)
        return out(estimate, se, estimate - se * hi, estimate - se * lo, len(t))

    return cells.groupBy(F.lit(1).alias("_one")).applyInPandas(run, "contrast string, estimate double, se double, lower double, upper double, draws long")


def comparison(records: DataFrame, folds: int = 5, repeats: int = 20, perms: int = 999, draws: int = 999) -> tuple[DataFrame, DataFrame]:
    """(arms, contrasts) of two labelings. Arms that score the same records under the same label have the same share. Shares and contrasts are computed from counts of records by outcome and pair of labels, which one pass over the records gives."""
    pairs = counted_pairs(records)
    counts = settled(scored(arm_counts(pairs), F.col("n")))
    shares = settled(counted.share(counts, ["arm"], folds, repeats, perms, seed="comparison", weight="n"))
    every = arms(records, pairs)
    sizes = digests(every).join(every.groupBy("arm").agg(F.sum("y").cast("long").alias("n_positive")), "arm")
    return sizes.join(shares, "arm", "left"), settled(paired_intervals(counts, shares, repeats, draws))


def terms(shares: DataFrame, value: str = "kappa_adj") -> DataFrame:
    """One row: the five steps from the first arm to the last, the change on common records, the total and what the steps leave of it."""
    at = {a: F.max(F.when(F.col("arm") == a, F.col(value))) for a in ARMS}
    steps = {t: at[y] - at[x] for t, x, y in zip(TERMS, ARMS, ARMS[1:])}
    out = shares.agg(*[v.alias(k) for k, v in steps.items()], (at["common_b"] - at["common_a"]).alias("change_on_common"), (at["available_b"] - at["available_a"]).alias("total"))
    return out.withColumn("residual", F.col("total") - sum((F.col(t) for t in TERMS[1:]), F.col(TERMS[0])))

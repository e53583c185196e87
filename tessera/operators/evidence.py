"""E-values that group labels predict a binary outcome: shrunk rates, split and sequential likelihood ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import dealt, digest
from tessera.functions.stats import e_bh, k_log, log_mean_exp
from tessera.operators.share import replicated
from tessera.operators.staging import settled, tasks

CLIP = 1e-6


def shrunk(cells: DataFrame, by: list[str], n: str = "n", s: str = "s") -> DataFrame:
    """cells (by, group, n, s; n may be 0) with p, the group's rate shrunk to the common one by the ANOVA estimate of the spread between groups, within [1e-6, 1 - 1e-6].

    Also n_train and g_train. Groups without records, and families of fewer than two groups or without replication, get the common rate.
    """
    w = Window.partitionBy(*by)
    nn, ss = F.col(n).cast("double"), F.col(s)
    has = F.col(n) > 0
    c = cells.withColumns({"n_train": F.sum(n).over(w), "g_train": F.count(F.when(has, 1)).over(w), "_s": F.sum(s).over(w), "_n2": F.sum(F.col(n) * F.col(n)).over(w), "_r": F.sum(F.when(has, ss * ss / nn)).over(w)})
    N, G = F.col("n_train").cast("double"), F.col("g_train").cast("double")
    grand = F.col("_s") / F.nullif(N, F.lit(0.0))
    msw = (F.col("_s") - F.col("_r")) / F.nullif(N - G, F.lit(0.0))
    msb = (F.col("_r") - F.col("_s") * F.col("_s") / N) / F.nullif(G - 1, F.lit(0.0))
    n0 = (N - F.col("_n2") / N) / F.nullif(G - 1, F.lit(0.0))
    tau = F.greatest(F.lit(0.0), (msb - msw) / F.greatest(n0, F.lit(1e-12)))
    denom = tau + msw / F.greatest(nn, F.lit(1.0))
    b = F.when(has & (denom > 0), tau / denom).otherwise(0.0)
    p = F.when(has & (G >= 2) & (N - G >= 1), grand + b * (ss / F.nullif(nn, F.lit(0.0)) - grand)).otherwise(grand)
    return c.withColumn("p", F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))).drop("_s", "_n2", "_r")


def _log_ratio(scored: DataFrame, by: list[str], n: str, s: str) -> DataFrame:
    """(by) -> term: log-likelihood of the tested records under p less that under their own common rate."""
    k, m = F.sum(s), F.sum(n)
    alt = F.sum(F.col(s) * F.log("p") + (F.col(n) - F.col(s)) * F.log1p(-F.col("p")))
    null: Column = k_log(k, k / m) + k_log(m - k, (m - k) / m)
    return scored.filter(F.col(n) > 0).groupBy(*by).agg((alt - null).alias("term"), m.alias("n_test"))


def split_e_values(obs: DataFrame, by: list[str], folds: int = 5, repeats: int = 20) -> DataFrame:
    """(by) -> log_e, the log of the mean over splits of the likelihood ratio of held-out records, and n_splits. Folds are hashed record by record. Strata are no part of it and single records stay."""
    # a settled table of few bytes is read by few tasks, so records are spread before they are repeated; the counts are used three times
    o = obs.select(*by, "id", "grp", "y")
    spread = o.repartition(tasks(o, 0))
    r = replicated(spread, repeats).withColumn("_h", digest("efold", F.col("rep"), F.col("id"))).withColumn("fold", dealt("_h", folds))
    c = settled(r.groupBy(*by, "rep", "fold", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")))
    all_folds = c.select(*by, "rep", "fold").distinct().join(c.select(*by, "rep", "grp").distinct(), [*by, "rep"])
    c = all_folds.join(c, [*by, "rep", "fold", "grp"], "left").fillna(0, ["n", "s"])
    w = Window.partitionBy(*by, "rep", "grp")
    c = c.withColumns({"tn": F.sum("n").over(w) - F.col("n"), "ts": F.sum("s").over(w) - F.col("s")})
    p = shrunk(c, [*by, "rep", "fold"], "tn", "ts").filter("n_train > 0")
    return log_mean_exp(_log_ratio(p, [*by, "rep", "fold"], "n", "s"), by, "term", "log_e")


def sequential(obs: DataFrame, by: list[str], batch: str = "batch", place: Column | None = None, least: int = 2) -> DataFrame:
    """(by, batch) -> term, running log_e and its peak: each batch is predicted from all before it.

    Only counts by batch and group are needed. `place` orders the batches (by default by number). A batch without records to test, with fewer than `least` before it or
    fewer than two groups there, adds nothing.
    """
    c = obs.filter(F.col(batch).isNotNull()).groupBy(*by, batch, "grp").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))
    return sequential_counts(c, by, batch, place, least)


def sequential_counts(c: DataFrame, by: list[str], batch: str = "batch", place: Column | None = None, least: int = 2) -> DataFrame:
    """As sequential, from one row of counts n and s per (by, batch, grp)."""
    place = place if place is not None else F.col(batch).cast("double")
    grid = c.select(*by, batch).distinct().join(c.select(*by, "grp").distinct(), by)
    c = grid.join(c, [*by, batch, "grp"], "left").fillna(0, ["n", "s"]).withColumn("_o", place)
    before = Window.partitionBy(*by, "grp").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({"tn": F.coalesce(F.sum("n").over(before), F.lit(0)), "ts": F.coalesce(F.sum("s").over(before), F.lit(0.0))})
    p = shrunk(c, [*by, batch], "tn", "ts")
    terms = _log_ratio(p.filter(F.col("n_train") >= least).filter("g_train >= 2"), [*by, batch], "n", "s")
    sizes = c.groupBy(*by, batch, "_o").agg(F.sum("n").alias("n_batch"))
    run = Window.partitionBy(*by).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    out = sizes.join(terms.drop("n_test"), [*by, batch], "left").withColumn("term", F.coalesce("term", F.lit(0.0)))
    out = out.withColumn("log_e", F.sum("term").over(run))
    return out.withColumn("peak", F.max("log_e").over(run)).select(*by, batch, "n_batch", "term", "log_e", "peak")


def anytime(paths: DataFrame, by: list[str], family: list[str], alpha: float = 0.05) -> DataFrame:
    """(family, by) -> peak of the running log e-value and whether it ever reaches log(m / alpha)."""
    p = paths.groupBy(*family, *by).agg(F.max("log_e").alias("peak_log_e"))
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    return p.withColumn("m", m).withColumn("rejected", F.col("peak_log_e") >= F.log(F.col("m") / F.lit(alpha)))


def looks(paths: DataFrame, by: list[str], batch: str = "batch", place: Column | None = None, alpha: float = 0.05) -> DataFrame:
    """(by, batch) -> the running log e-value at each look and whether the step-up rule over all tests rejects then. A test without records in an intake stands as it did."""
    at = place if place is not None else F.col(batch).cast("double")
    every = paths.select(batch).distinct().join(F.broadcast(paths.select(*by).distinct()), F.lit(True))
    run = Window.partitionBy(*by).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    filled = every.join(paths.select(*by, batch, "log_e"), [*by, batch], "left").withColumn("_o", at).withColumn("log_e", F.coalesce(F.last("log_e", ignorenulls=True).over(run), F.lit(0.0)))
    return e_bh(filled.select(*by, batch, "log_e"), "log_e", [batch], alpha)


def combined(values: DataFrame, by: list[str], e: str = "e") -> DataFrame:
    """(by) -> product and mean of e-values. A zero makes the product zero; an infinite and a zero together are refused."""
    top, low = F.max(e), F.min(e)
    inf = F.lit(float("inf"))
    product = F.when((top == inf) & (low == 0), F.raise_error(F.lit("an infinite e-value times a zero one is undefined")).cast("double")).when(low == 0, 0.0).otherwise(F.exp(F.sum(F.log(F.col(e)))))
    w = values.withColumn("_top", F.max(e).over(Window.partitionBy(*by)))
    mean = F.when(F.max("_top").isin(0.0, float("inf")), F.max("_top")).otherwise(F.max("_top") * F.avg(F.col(e) / F.col("_top")))
    return w.groupBy(*by).agg(product.alias("product"), mean.alias("mean"), F.count(F.lit(1)).alias("n"))

"""Adequacy of traits, groups and features; between-group statistics; what incomplete observation allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import untyped
from tessera.operators.staging import small

RARE = 20


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))


def usable(obs: DataFrame) -> DataFrame:
    """Rows with a finite outcome and a label: what every estimator keeps."""
    return obs.filter(finite("y") & ~untyped(F.col("grp")))


def repeated(obs: DataFrame, by: list[str]) -> DataFrame:
    """usable rows whose group has at least two of them."""
    u = usable(obs)
    # sizes are counted map-side first and then met, so that no group has to stand in one task, and records don't travel to few of them
    return u.join(small(u.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("_m")).filter("_m >= 2")), [*by, "grp"], "left_semi")


def trait_adequacy(obs: DataFrame, by: list[str]) -> DataFrame:
    seen = F.count(F.when(finite("y"), 1))
    pos = F.coalesce(F.sum(F.when(finite("y"), F.col("y"))), F.lit(0.0)).cast("long")
    out = obs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - seen).alias("n_missing"), pos.alias("n_positive"), (pos / F.nullif(seen, F.lit(0))).alias("prevalence"), F.least(pos, seen - pos).alias("n_minor"))
    state = F.when(F.col("n") == F.col("n_missing"), "empty").when(F.col("n_minor") == 0, "constant").when(F.col("n_minor") < RARE, "rare").otherwise("adequate")
    return out.withColumn("state", state)


def group_adequacy(obs: DataFrame, by: list[str]) -> DataFrame:
    """Of the labels, whatever the outcome: typed and untyped records, groups, singletons, informative groups, support and n0."""
    sizes = obs.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m")).withColumn("t", ~untyped(F.col("grp")))
    m = F.when(F.col("t"), F.col("m"))
    big = F.when(F.col("t") & (F.col("m") >= 2), F.col("m"))
    n, g = F.coalesce(F.sum(m), F.lit(0)), F.count(m)
    return sizes.groupBy(*by).agg(
        F.sum("m").alias("n"), n.alias("n_typed"), (F.sum("m") - n).alias("n_untyped"), g.alias("n_groups"), F.count(F.when(m == 1, 1)).alias("n_singletons"), F.count(big).alias("n_informative"),
        (F.coalesce(F.sum(big), F.lit(0)) / F.nullif(n, F.lit(0))).alias("support"),
        F.when(g > 1, (n - F.sum(m * m) / n) / (g - 1)).alias("n0"),
    )


def smallest_groups(obs: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    sizes = obs.filter(~untyped(F.col("grp"))).groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("m", "grp"))).filter(F.col("place") <= k)


def feasibility(obs: DataFrame, by: list[str]) -> DataFrame:
    """Of each feature: what the estimators would retain, and why they would refuse or warn."""
    sizes = usable(obs).groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"))
    big = F.when(F.col("m") >= 2, F.col("m"))
    pos, kept = F.coalesce(F.sum(F.when(F.col("m") >= 2, F.col("s"))), F.lit(0.0)).cast("long"), F.coalesce(F.sum(big), F.lit(0))
    out = sizes.groupBy(*by).agg(kept.alias("retained"), (kept / F.sum("m")).alias("support"), F.count(big).alias("groups_repeated"), F.least(pos, kept - pos).alias("n_minor"))
    out = obs.select(*by).distinct().join(out, by, "left").fillna(0, ["retained", "groups_repeated", "n_minor"])
    fail = F.array_compact(F.array(F.when(F.col("retained") < 2, "too few records"), F.when(F.col("groups_repeated") < 2, "fewer than two repeated groups"), F.when((F.col("retained") >= 2) & (F.col("n_minor") == 0), "constant outcome")))
    warn = F.when((F.col("n_minor") > 0) & (F.col("n_minor") < RARE), "rare outcome")
    return out.withColumns({"refused": F.array_join(fail, "; "), "warned": F.coalesce(warn, F.lit(""))})


def group_sums(obs: DataFrame, by: list[str]) -> DataFrame:
    """(by, grp) -> m, s, q: all that between-group statistics need; one partial aggregation."""
    return obs.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))


def anova(obs: DataFrame, by: list[str]) -> DataFrame:
    """Between-group sum of squares (raw and about the mean), in-sample R2, ANOVA component, F, Kruskal-like share of repeated groups."""
    cells = group_sums(repeated(obs, by), by)
    n, s, q, g = F.sum("m"), F.sum("s"), F.sum("q"), F.count(F.lit(1))
    raw = F.sum(F.col("s") * F.col("s") / F.col("m"))
    a = cells.groupBy(*by).agg(n.alias("n"), g.alias("n_groups"), raw.alias("ss_raw"), (raw - s * s / n).alias("ss_between"), (q - s * s / n).alias("ss_total"), ((n - F.sum(F.col("m") * F.col("m")) / n) / F.nullif(g - 1, F.lit(0))).alias("n0"))
    a = a.withColumns({"msb": F.col("ss_between") / F.nullif(F.col("n_groups") - 1, F.lit(0)), "msw": (F.col("ss_total") - F.col("ss_between")) / F.nullif(F.col("n") - F.col("n_groups"), F.lit(0))})
    comp = F.greatest(F.lit(0.0), (F.col("msb") - F.col("msw")) / F.nullif(F.col("n0"), F.lit(0.0)))
    return a.withColumns({"r2": F.when(F.col("ss_total") > 0, F.col("ss_between") / F.col("ss_total")), "component": comp, "icc": F.when(comp + F.col("msw") > 0, comp / (comp + F.col("msw"))), "f": F.when(F.col("msw") > 0, F.col("msb") / F.col("msw"))})


def group_structure(obs: DataFrame, by: list[str]) -> DataFrame:
    cells = group_sums(repeated(obs, by), by)
    share = F.col("m") / F.sum("m").over(Window.partitionBy(*by))
    return cells.withColumn("w", share).groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups_repeated"), (F.lit(1.0) / F.sum(F.col("w") * F.col("w"))).alias("effective_groups"), F.max("w").alias("largest_share"))


def within_variance(obs: DataFrame, by: list[str]) -> DataFrame:
    return usable(obs).groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("s2"))


def centred(obs: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes less the mean of their stratum."""
    return obs.withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy(*by, "stratum")))


def kruskal(values: DataFrame, by: list[str]) -> DataFrame:
    """(by) -> n, groups and H with the correction for ties, of values (y) between groups."""
    # ranks follow from the counts of values, so records are never put in order; ties in doubles, as their cubes pass 2^63 at some 10^8 records
    c = values.groupBy(*by, "grp", "y").agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumns({"_upto": F.sum("c").over(Window.partitionBy(*by).orderBy("y")), "_t": F.sum("c").over(Window.partitionBy(*by, "y")).cast("double")}).withColumn("_mid", F.col("_upto") - (F.col("_t") - 1) / 2)
    whole = c.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("_t") * F.col("_t") - 1)).alias("ties"))
    parts = c.groupBy(*by, "grp").agg((F.pow(F.sum(F.col("c") * F.col("_mid")), F.lit(2)) / F.sum("c")).alias("p")).groupBy(*by).agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n_groups"))
    h = F.lit(12.0) / (F.col("n") * (F.col("n") + F.lit(1.0))) * F.col("p") - 3 * (F.col("n") + 1)
    return whole.join(parts, by).select(*by, "n", "n_groups", (h / F.nullif(1 - F.col("ties") / F.nullif(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n"), F.lit(0.0)), F.lit(0.0))).alias("h"))


def finite_bounds(obs: DataFrame, by: list[str]) -> DataFrame:
    """Prevalence of a finite collection with missing outcomes: r / N to (r + N - n) / N."""
    n, pos = F.count(F.when(finite("y"), 1)), F.coalesce(F.sum(F.when(finite("y"), F.col("y"))), F.lit(0.0))
    size = F.count(F.lit(1))
    return obs.groupBy(*by).agg(size.alias("size"), n.alias("n"), pos.cast("long").alias("positive"), (pos / F.nullif(n, F.lit(0))).alias("observed"), (pos / size).alias("lower"), ((pos + size - n) / size).alias("upper"))


def difference_bounds(obs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Bounds on the difference of prevalence between sides a and b, each side bounded on its own."""
    bounds = finite_bounds(obs.filter(F.col("side").isin(a, b)), [*by, "side"])
    one = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return bounds.groupBy(*by).agg((one(a, "lower") - one(b, "upper")).alias("lower"), (one(a, "upper") - one(b, "lower")).alias("upper"), (one(a, "observed") - one(b, "observed")).alias("observed"))


def two_cells(obs: DataFrame, by: list[str]) -> DataFrame:
    """Limits of an order of one cut, from the prevalence and the group rates alone: the share of the label at mid-scores and how much of the order the two cells leave open."""
    c = obs.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"))
    n, pos = F.sum("m"), F.sum("s")
    raw = F.sum(F.col("s") * F.col("s") / F.col("m"))
    p = pos / n
    return c.groupBy(*by).agg(n.alias("n"), (3 * (raw / n - p * p)).alias("midpoint"), (3 * p * (1 - p)).alias("resolution"))


def untyped_share(obs: DataFrame, by: list[str]) -> DataFrame:
    return obs.groupBy(*by).agg(F.avg(untyped(F.col("grp")).cast("double")).alias("missing_share"), F.count(F.lit(1)).alias("n"))


def effective_dimension(obs: DataFrame, key: str = "id") -> DataFrame:
    """(sum of eigenvalues)^2 / sum of their squares of the features' correlation matrix, over records with every feature: p^2 / sum of r^2, so no eigenvalues are needed. Constant features are left out."""
    p = obs.select("feature").distinct()
    k = p.agg(F.count(F.lit(1)).alias("_k"))
    full = obs.filter(finite("y")).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(key))).join(F.broadcast(k), F.col("_c") == F.col("_k")).select(key, "feature", "y")
    spread = full.groupBy("feature").agg(F.stddev_pop("y").alias("sd")).filter("sd > 0").select("feature")
    full = full.join(F.broadcast(spread), "feature")
    a, b = full.select(key, F.col("feature").alias("fa"), F.col("y").alias("ya")), full.select(key, F.col("feature").alias("fb"), F.col("y").alias("yb"))
    r = a.join(b, key).groupBy("fa", "fb").agg(F.corr("ya", "yb").alias("r"))
    return r.agg(F.countDistinct("fa").alias("n_features"), (F.pow(F.countDistinct("fa").cast("double"), F.lit(2)) / F.sum(F.col("r") * F.col("r"))).alias("effective"))

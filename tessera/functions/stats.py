"""Statistical column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def phipson_smyth(exceed: Column, draws: Column | int) -> Column:
    """(b + 1) / (B + 1): a permutation p that is never zero."""
    return (exceed + F.lit(1)).cast("double") / (F.lit(1) + draws)


def debias(skill: Column, control: Column) -> Column:
    """(skill - control) / (1 - control), null where the control reaches one."""
    return F.when(control < 1.0, (skill - control) / (F.lit(1.0) - control))


def k_log(k: Column, p: Column) -> Column:
    """k ln p with 0 ln 0 = 0."""
    return F.when(k == 0, F.lit(0.0)).otherwise(k * F.log(p))


def log_mean_exp(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """One row per group: ln of the mean of exp(x), taken from the group's maximum so that nothing overflows."""
    top = df.withColumn("_top", F.max(x).over(Window.partitionBy(*by)))
    return top.groupBy(*by).agg((F.max("_top") + F.log(F.avg(F.exp(F.col(x) - F.col("_top"))))).alias(name), F.count(F.lit(1)).alias("n_splits"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = k / n
    mid, half = p + F.lit(z * z) / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    return (mid - half) / (1 + F.lit(z * z) / n), (mid + half) / (1 + F.lit(z * z) / n)


def harmonic(m: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i)


def budget(m: Column, alpha: float) -> Column:
    """The fewest permutations at which the smallest p can pass the step-up under any dependence among m tests."""
    return (F.ceil(m * harmonic(m) / F.lit(alpha) - F.lit(1e-9)) - F.lit(1)).cast("long")


def step_up(tests: DataFrame, p: str = "p", by: list[str] | None = None, arbitrary: bool = False, q: float = 0.05) -> DataFrame:
    """tests with `adjusted` and `rejected`: Benjamini-Hochberg, or Benjamini-Yekutieli under arbitrary dependence. Null p stay null and leave the family."""
    by = by or []
    family = Window.partitionBy(*by)
    known = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    order = family.orderBy(F.col(p), *[c for c in tests.columns if c not in (*by, p)])
    ranked = known.withColumns({"_rank": F.row_number().over(order), "_m": F.count(F.lit(1)).over(family)})
    scale = harmonic(F.col("_m")) if arbitrary else F.lit(1.0)
    raw = ranked.withColumn("_raw", F.col(p) * scale * F.col("_m") / F.col("_rank"))
    down = family.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    done = raw.withColumn("adjusted", F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_rank", "_m", "_raw")
    rest = tests.filter(F.col(p).isNull() | F.isnan(p)).withColumn("adjusted", F.lit(None).cast("double"))
    return done.unionByName(rest).withColumn("rejected", F.coalesce(F.col("adjusted") <= q, F.lit(False)))


def e_bh(tests: DataFrame, log_e: str = "log_e", by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """tests with m, n_rejected, threshold and rejected: the largest k of which the k-th largest e-value is at least m / (alpha k). A null counts as e = 0 and stays in m."""
    by = by or []
    family = Window.partitionBy(*by)
    value = F.coalesce(F.when(F.isnan(log_e), F.lit(None)).otherwise(F.col(log_e)), F.lit(float("-inf")))
    order = family.orderBy(F.desc("_v"), *[c for c in tests.columns if c not in by])
    ranked = tests.withColumn("_v", value).withColumns({"_k": F.row_number().over(order), "m": F.count(F.lit(1)).over(family)})
    passes = F.when(F.col("_v") >= F.log(F.col("m") / (F.lit(alpha) * F.col("_k"))), F.col("_k"))
    found = ranked.withColumn("n_rejected", F.coalesce(F.max(passes).over(family), F.lit(0)).cast("long"))
    return found.withColumns({"rejected": F.col("_k") <= F.col("n_rejected"), "threshold": F.when(F.col("n_rejected") > 0, F.col("m") / (F.lit(alpha) * F.col("n_rejected")))}).drop("_v", "_k")


def lond(p: Column, alpha: float = 0.05, beta: Column | None = None) -> Column:
    """For p-values in order: array of whether each is rejected at level beta_j (D + 1), D the rejections before it. beta_j defaults to 6 alpha / (pi^2 j^2)."""
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        j = F.size(acc["out"]) + F.lit(1)
        level = (F.element_at(beta, j) if beta is not None else F.lit(6.0 * alpha / 9.869604401089358) / (j * j)) * (acc["d"] + F.lit(1))
        hit = F.coalesce(x <= level, F.lit(False))
        return F.struct((acc["d"] + hit.cast("int")).alias("d"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.aggregate(p, start, step, lambda acc: acc["out"])

"""Smaller operators on the way from laboratory exports to calls, and summaries of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_list(df: DataFrame, key: str, listed: str) -> DataFrame:
    """(id, feature, call) from "drug=CALL,drug=CALL" texts; ND is dropped, and a drug called in two ways has a null call."""
    pair = F.explode(F.split(F.col(listed), r"\s*,\s*"))
    p = df.select(F.col(key).alias("id"), pair.alias("p"))
    p = p.select("id", F.trim(F.regexp_extract("p", "^([^=]+)=", 1)).alias("feature"), F.upper(F.trim(F.regexp_extract("p", "=(.*)$", 1))).alias("call"))
    p = p.filter("feature <> '' AND call <> '' AND call <> 'ND'")
    return p.groupBy("id", "feature").agg(F.when(F.min("call") == F.max("call"), F.min("call")).alias("call"))


def after_marker(c: Column, marker: str) -> Column:
    """What follows a marker in a name, in lower case; empty where there is none."""
    return F.when(F.contains(F.lower(c), F.lit(marker)), F.trim(F.substring_index(F.lower(c), marker, -1))).otherwise("")


def leading_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"^(\d{4})", 1), F.lit("")).cast("int")


def period(year: Column, edges: list[int]) -> Column:
    """The label first-last of the period that a year falls in; edges are first years, the last is exclusive."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:]):
        out = F.when(year.between(a, b - 1), f"{a}-{b - 1}").otherwise(out)
    return out


def first_rule(c: Column, rules: list[tuple[str, str]], default: str = "unclassified") -> Column:
    """The class of the first rule whose words the text contains."""
    out = None
    for words, name in rules:
        hit = F.contains(F.lower(c), F.lit(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def rule_audit(df: DataFrame, value: str, cls: str, axes: list[str]) -> DataFrame:
    """(axis, label, cls) -> values and rows of each class, over all and along each axis, in one pass of grouping sets."""
    sets = [[cls], *[[cls, a] for a in axes]]
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [cls, *axes]]).agg(F.countDistinct(value).alias("n_values"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    name, label = F.lit("all"), F.lit("all")
    for i, a in enumerate(axes):
        here = (F.lit((1 << len(axes)) - 1) - F.col("g")) == (1 << (len(axes) - 1 - i))
        name, label = F.when(here, a).otherwise(name), F.when(here, F.col(a)).otherwise(label)
    return g.select(name.alias("axis"), label.alias("label"), F.col(cls).alias("cls"), "n_values", "n")


def decided_call(value: Column, sign: Column, cut: Column) -> Column:
    """1 above a cut-off, 0 at or below it, by value and sign; null where the sign leaves it open."""
    return (
        F.when(sign.isin("<", "<="), F.when(value <= cut, 0)).when(sign == ">", F.when(value >= cut, 1)).when(sign == ">=", F.when(value > cut, 1)).when(value.isNotNull(), (value > cut).cast("int"))
    )


def wild_type_mode(bins: DataFrame, by: list[str], least: float = 0.05) -> DataFrame:
    """(by) -> the lowest bin that is higher than both neighbours and holds at least `least` of the readings; bins (by, k, n), k one apart."""
    w = Window.partitionBy(*by).orderBy("k")
    b = bins.withColumns({"_p": F.when(F.lag("k").over(w) == F.col("k") - 1, F.lag("n").over(w)).otherwise(0), "_q": F.when(F.lead("k").over(w) == F.col("k") + 1, F.lead("n").over(w)).otherwise(0), "_t": F.sum("n").over(Window.partitionBy(*by))})
    return b.filter((F.col("n") > F.col("_p")) & (F.col("n") > F.col("_q")) & (F.col("n") >= least * F.col("_t"))).groupBy(*by).agg(F.min("k").alias("mode"))


def log_normal_cut(bins: DataFrame, by: list[str], z: float = 2.3263478740408408) -> DataFrame:
    """(by) -> the cut-off that 99 % of a log-normal fitted to the readings up to one doubling above the wild-type mode lie below.

    The fit is by moments of the folded left half about the mode, which needs no iteration and no reading beyond the mode's upper neighbour.
    """
    m = wild_type_mode(bins, by)
    left = bins.join(m, by).filter(F.col("k") <= F.col("mode"))
    half = F.when(F.col("k") == F.col("mode"), F.col("n") / 2).otherwise(F.col("n"))
    a = left.withColumn("h", half).groupBy(*by, "mode").agg(F.sqrt(F.sum(F.col("h") * F.pow(F.col("k") - F.col("mode"), F.lit(2))) / F.sum("h") + F.lit(1 / 12)).alias("sd"))
    return a.select(*by, "mode", "sd", F.ceil(F.col("mode") + F.lit(z) * F.col("sd")).cast("long").alias("cut"))


def carried(marks: DataFrame, key: str, patterns: dict[str, str], mark: str = "mark") -> DataFrame:
    """(id, one 0/1 column per class) whether any mark of a record matches the class's pattern."""
    return marks.groupBy(key).agg(*[F.max(F.col(mark).rlike(p).cast("int")).alias(n) for n, p in patterns.items()])


def _correlation(x: str, y: str, n: str) -> Column:
    """corr of x and y that stand for n records each, `_m<x>` and `_m<y>` being their means; NaN of one record, as corr gives."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = lambda f: F.sum(F.when(both, F.col(n) * f))
    dx, dy = F.col(x) - F.col(f"_m{x}"), F.col(y) - F.col(f"_m{y}")
    return F.when(s(F.lit(1)) == 1, F.lit(float("nan"))).otherwise(s(dx * dy) / F.nullif(F.sqrt(s(dx * dx) * s(dy * dy)), F.lit(0.0)))


def concordance(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by) -> Pearson and Spearman correlation and pairs in the same and in opposite order, from the counts of distinct (x, y)."""
    n = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("c"))
    # ranks follow from the counts: the records up to a value (peers included) less half of its others
    mid = lambda v: F.sum("c").over(Window.partitionBy(*by).orderBy(v)) - (F.sum("c").over(Window.partitionBy(*by, v)) - 1) / 2
    r = n.withColumns({"_rx": mid(x), "_ry": mid(y)})
    known = lambda v: F.when((F.col(x).isNotNull() & F.col(y).isNotNull()) if v in (x, y) else F.lit(True), F.col("c"))
    r = r.withColumns({f"_m{v}": F.sum(known(v) * F.col(v)).over(Window.partitionBy(*by)) / F.sum(known(v)).over(Window.partitionBy(*by)) for v in (x, y, "_rx", "_ry")})
    r = r.groupBy(*by).agg(_correlation(x, y, "c").alias("pearson"), _correlation("_rx", "_ry", "c").alias("spearman"), F.sum("c").alias("n"))
    a, b = n.select(*by, F.col(x).alias("xa"), F.col(y).alias("ya"), F.col("c").alias("ca")), n.select(*by, F.col(x).alias("xb"), F.col(y).alias("yb"), F.col("c").alias("cb"))
    p = a.join(b, by).filter("xa < xb").groupBy(*by).agg(F.sum(F.when(F.col("ya") < F.col("yb"), F.col("ca") * F.col("cb")).otherwise(0)).alias("same"), F.sum(F.when(F.col("ya") > F.col("yb"), F.col("ca") * F.col("cb")).otherwise(0)).alias("opposite"))
    return r.join(p, by, "left")


def repeated_looks(looks: DataFrame) -> DataFrame:
    """Summary of runs (run, look, feature, null, rejected): the share of runs with any false rejection, ever and per look, and the mean share of true effects found by the last look."""
    per = looks.groupBy("run", "look").agg(F.max((F.col("rejected") & F.col("null")).cast("int")).alias("false_"), (F.sum((F.col("rejected") & ~F.col("null")).cast("int")) / F.nullif(F.sum((~F.col("null")).cast("int")), F.lit(0))).alias("power"))
    run = per.groupBy("run").agg(F.max("false_").alias("ever"), F.avg("false_").alias("per_look"), F.max_by("power", "look").alias("power"))
    return run.agg(F.avg("ever").alias("false_ever"), F.avg("per_look").alias("false_per_look"), F.avg("power").alias("power"), F.count(F.lit(1)).alias("runs"))


def stability(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by) -> median, range and spread of an estimate over seeds."""
    return values.groupBy(*by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n"))


def verdict(k: Column, n: Column, lower: Column, upper: Column, need: float, slack: float) -> Column:
    """Whether a rate of k in n meets a required coverage: met, missed, or open between its limits."""
    return F.when(lower >= need - slack, "met").when(upper < need, "missed").otherwise("open")


def cohort(spark_range: DataFrame, groups: int, spread: float, prevalence: float, seed: str = "cohort") -> DataFrame:
    """(id, feature, y, grp) made from hashed numbers: a group's rate is the prevalence moved by up to `spread`; for load tests of any size."""
    from tessera.functions.hashing import uniform

    g = (F.col("id") % groups).cast("string")
    rate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(prevalence) + F.lit(spread) * (2 * uniform(seed + "-group", F.lit(0), g) - 1)))
    return spark_range.select(F.col("id").cast("string").alias("id"), F.lit("made").alias("feature"), (uniform(seed, F.lit(1), F.col("id")) < rate).cast("double").alias("y"), F.concat(F.lit("g"), g).alias("grp"))

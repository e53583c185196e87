"""The difference of prevalence between two collections, split into composition and change within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.operators import share
from tessera.operators.staging import settled, tasks

GATE = 0.9


def sides(obs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, grp) -> n and s of both sides, shares w and rates p; a group that one side lacks takes the other's rate there."""
    one = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, c)), F.lit(0.0))
    g = obs.filter(F.col("side").isin(a, b)).groupBy(*keys, "grp").agg(one(a, F.lit(1.0)).alias("na"), one(b, F.lit(1.0)).alias("nb"), one(a, F.col("y")).alias("sa"), one(b, F.col("y")).alias("sb"))
    w = Window.partitionBy(*keys)
    ra, rb = F.when(F.col("na") > 0, F.col("sa") / F.col("na")), F.when(F.col("nb") > 0, F.col("sb") / F.col("nb"))
    return g.withColumns({"wa": F.col("na") / F.nullif(F.sum("na").over(w), F.lit(0.0)), "wb": F.col("nb") / F.nullif(F.sum("nb").over(w), F.lit(0.0)), "pa": F.coalesce(ra, rb), "pb": F.coalesce(rb, ra), "shared": (F.col("na") > 0) & (F.col("nb") > 0)})


def kitagawa(obs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys) -> composition, within, difference, support of shared groups on each side, and what of the composition they carry."""
    comp = (F.col("wa") - F.col("wb")) * (F.col("pa") + F.col("pb")) / 2
    within = (F.col("wa") + F.col("wb")) / 2 * (F.col("pa") - F.col("pb"))
    on = lambda x: F.coalesce(F.sum(F.when(F.col("shared"), x)), F.lit(0.0))
    out = sides(obs, keys, a, b).groupBy(*keys).agg(
        F.sum(comp).alias("composition"), F.sum(within).alias("within"), (F.sum("sa") / F.nullif(F.sum("na"), F.lit(0.0)) - F.sum("sb") / F.nullif(F.sum("nb"), F.lit(0.0))).alias("difference"), on(F.col("wa")).alias("support_a"), on(F.col("wb")).alias("support_b"),
        on(comp).alias("composition_shared"), F.count_if("shared").alias("n_shared"), F.count_if(F.col("nb") == 0).alias("only_a"), F.count_if(F.col("na") == 0).alias("only_b"), F.sum("na").cast("long").alias("n_a"), F.sum("nb").cast("long").alias("n_b"),
    )
    return out.withColumns({"nonshared": F.col("composition") - F.col("composition_shared"), "shared_support": F.least("support_a", "support_b"), "residual": F.col("difference") - F.col("composition") - F.col("within")}).withColumn("admitted", F.col("shared_support") >= GATE)


def label_coverage(obs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys) -> the three 2 x 2 tables: labelled by side, and outcome by labelled on each side."""
    from tessera.functions.text import untyped

    t = ~untyped(F.col("grp"))
    known = F.col("y").isNotNull()
    cell = lambda a_, b_, c_=None: F.count_if(a_ & b_ if c_ is None else a_ & b_ & c_)
    out = {}
    for name, side in (("a", a), ("b", b)):
        s = F.col("side") == side
        out |= {f"{name}_labelled": cell(s, t), f"{name}_unlabelled": cell(s, ~t), f"{name}_labelled_known": cell(s, t, known), f"{name}_labelled_positive": cell(s, t, F.coalesce(F.col("y") == 1, F.lit(False)))}
    return obs.groupBy(*keys).agg(*[v.alias(k) for k, v in out.items()])


def resampled(obs: DataFrame, keys: list[str], a: str, b: str, reps: int, unit: str | None = None, stream: str = "boot") -> DataFrame:
    """(keys, side, rep, grp) -> n, s: records and outcomes of bootstrap collections, of each side as many records (or units with all their records) as it has, drawn with replacement by hashed numbers.

    A draw looks up what it drew and is summed at once; draws are neither listed by record nor broadcast.
    """
    who = unit or "id"
    o = obs.filter(F.col("side").isin(a, b)).groupBy(*keys, "side", F.col(who).alias("id"), "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    o, rows, _ = share.placed(o.groupBy(*keys, "side", "id").agg(F.collect_list(F.struct("grp", "n", "s")).alias("_drawn")), [*keys, "side"])
    o = settled(o.drop("id"))
    slots = share.replicated(o.select(*keys, "side", "_s", "_k", "_m").repartition(tasks(o, rows * reps), "_s", "_k"), reps)
    key = F.concat_ws("|", *[F.col(k) for k in keys], F.col("side"), F.col("_k").cast("string"))
    drawn = slots.select("rep", "_s", (F.floor(uniform(stream, F.col("rep"), key) * F.col("_m")) + 1).cast("long").alias("_k"))
    found = o.drop("_m")
    picked = drawn.join(F.broadcast(found) if rows <= share.BROADCAST else found.hint("merge"), ["_s", "_k"])
    return picked.select(*keys, "side", "rep", F.inline("_drawn")).groupBy(*keys, "side", "rep", "grp").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def bootstrap(obs: DataFrame, keys: list[str], a: str, b: str, reps: int, unit: str | None = None) -> DataFrame:
    """(keys, rep) -> composition and within of each bootstrap pair of collections; records count as often as they were drawn, so nothing is written out twice."""
    r = resampled(obs, keys, a, b, reps, unit)
    k = [*keys, "rep"]
    one = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c).cast("double"))), F.lit(0.0))
    g = r.groupBy(*k, "grp").agg(one(a, "n").alias("na"), one(b, "n").alias("nb"), one(a, "s").alias("sa"), one(b, "s").alias("sb"))
    w = Window.partitionBy(*k)
    ra, rb = F.when(F.col("na") > 0, F.col("sa") / F.col("na")), F.when(F.col("nb") > 0, F.col("sb") / F.col("nb"))
    g = g.withColumns({"wa": F.col("na") / F.nullif(F.sum("na").over(w), F.lit(0.0)), "wb": F.col("nb") / F.nullif(F.sum("nb").over(w), F.lit(0.0)), "pa": F.coalesce(ra, rb), "pb": F.coalesce(rb, ra)})
    return g.groupBy(*k).agg(F.sum((F.col("wa") - F.col("wb")) * (F.col("pa") + F.col("pb")) / 2).alias("composition"), F.sum((F.col("wa") + F.col("wb")) / 2 * (F.col("pa") - F.col("pb"))).alias("within"))


def interval(draws: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(keys) -> percentile limits (linear interpolation) and the two-sided bootstrap p with one added."""
    q = (1 - level) / 2
    b = F.count(F.lit(1))
    tail = F.least(F.count_if(F.col(value) <= 0), F.count_if(F.col(value) >= 0))
    return draws.groupBy(*keys).agg(F.expr(f"percentile({value}, {q})").alias("lower"), F.expr(f"percentile({value}, {1 - q})").alias("upper"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.least(F.lit(1.0), 2.0 * (tail + 1) / (b + 1)).alias("p"))


def alternatives(draws: DataFrame, points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys) -> basic interval and the share of draws below the point, from which a bias-corrected one starts."""
    p = points.select(*keys, F.col(value).alias("point"))
    i = interval(draws, keys, value).join(p, keys)
    below = draws.join(p, keys).groupBy(*keys).agg(F.avg((F.col(value) < F.col("point")).cast("double")).alias("below"))
    return i.join(below, keys).select(*keys, (2 * F.col("point") - F.col("upper")).alias("basic_lower"), (2 * F.col("point") - F.col("lower")).alias("basic_upper"), "below")

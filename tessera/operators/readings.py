"""Interval-censored readings: panels of wells, intervals, cells, mid-distribution scores, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.staging import settled, small

INF = float("inf")
NEAR = 0.25


def lattice(readings: DataFrame, by: list[str], wells: list[float] | None = None) -> DataFrame:
    """(by) -> kind, wells (log2, ascending). Given wells; else every doubling from the least to the greatest if all readings are near one; else the values recorded."""
    if wells is not None:
        logs = F.array(*[F.log2(F.lit(float(w))) for w in wells])
        return readings.select(*by).distinct().withColumns({"kind": F.lit("given"), "wells": logs})
    v = F.log2("value")
    k = F.rint(v)
    a = readings.filter("value > 0").groupBy(*by).agg(F.every(F.abs(v - k) <= NEAR).alias("doubling"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.collect_set(v).alias("seen"))
    steps = F.transform(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int")), lambda x: x.cast("double"))
    return a.select(*by, F.when(F.col("doubling"), "doubling").otherwise("recorded").alias("kind"), F.when(F.col("doubling"), steps).otherwise(F.array_sort("seen")).alias("wells"))


def _index(v: Column) -> Column:
    """Place of a reading on its lattice, from 0."""
    at = lambda x: F.array_position(F.col("wells"), x).cast("int") - 1
    nearest = F.array_min(F.transform(F.col("wells"), lambda w, i: F.struct(F.abs(w - v).alias("d"), i.alias("p"))))["p"]
    return F.when(F.col("kind") == "doubling", at(F.rint(v))).when(F.col("kind") == "recorded", at(v)).otherwise(nearest)


def intervals(readings: DataFrame, by: list[str], wells: list[float] | None = None, ends_censored: bool = True, signs: bool = True) -> DataFrame:
    """readings (value, op) with lo and hi on log2: (the well below, the well], open beyond the ends if they are censored.

    A sign overrides: = is the well's own interval, > is above the value, >= above the well below, < and <= up to the value. A blank on the top well is the
    well's own interval if any reading of the panel has > or >= there, as the laboratory then says when it is beyond. Null where there is no positive value. `by` may hold the panel.
    """
    # read three times: for the lattices, for what is said of their top wells, and for the intervals
    readings = settled(readings)
    # a panel has few wells, so its lattice travels to the readings, and so does what is said of its top well
    r = readings.join(small(lattice(readings, by, wells)), by, "left").withColumn("_v", F.when(F.col("value") > 0, F.log2("value")))
    r = r.withColumns({"_i": _index(F.col("_v")), "_n": F.size("wells")})
    well, first = F.element_at("wells", F.col("_i") + 1), F.element_at("wells", 1)
    below = F.when(F.col("_i") > 0, F.element_at("wells", F.greatest(F.col("_i"), F.lit(1)))).otherwise(first - 1)
    top = F.col("_i") == F.col("_n") - 1
    lo = F.when((F.col("_i") == 0) & F.lit(ends_censored), F.lit(-INF)).otherwise(below)
    hi = F.when(top & F.lit(ends_censored), F.lit(INF)).otherwise(well)
    if signs:
        op = F.coalesce("op", F.lit(""))
        beyond = r.filter(op.isin(">", ">=") & top).select(*by).distinct().withColumn("_told", F.lit(True))
        r = r.join(small(beyond), by, "left")
        told = F.coalesce("_told", F.lit(False))
        own = (op == "=") | ((op == "") & top & told)
        lo, hi = (
            F.when(own | (op == ">="), below).when(op == ">", F.col("_v")).when(op.isin("<", "<="), F.lit(-INF)).otherwise(lo),
            F.when(own, well).when(op.isin(">", ">="), F.lit(INF)).when(op.isin("<", "<="), F.col("_v")).otherwise(hi),
        )
    known = F.col("_v").isNotNull()
    return r.withColumns({"lo": F.when(known, lo), "hi": F.when(known, hi)}).drop("_v", "_i", "_n", "_told", "wells", "kind")


def geometry(readings: DataFrame, by: list[str], wells: list[float] | None = None) -> DataFrame:
    """Of each panel: kind, wells, ends, shares on the end wells, recorded values, ratios of neighbours."""
    lat = lattice(readings, by, wells)
    r = readings.filter("value > 0").join(small(lat), by).withColumn("_v", F.log2("value")).withColumn("_i", _index(F.col("_v")))
    a = r.groupBy(*by).agg(F.avg((F.col("_i") == 0).cast("double")).alias("share_on_lowest"), F.avg((F.col("_i") == F.size("wells") - 1).cast("double")).alias("share_on_highest"), F.array_sort(F.collect_set("value")).alias("seen"))
    ratios = F.when(F.size("seen") > 1, F.zip_with(F.slice("seen", 2, F.size("seen") - 1), F.slice("seen", 1, F.size("seen") - 1), lambda x, y: F.round(x / y, 3))).otherwise(F.array().cast("array<double>"))
    return lat.join(a, by).select(
        *by, "kind", F.size("wells").alias("n_wells"), F.pow(F.lit(2.0), F.element_at("wells", 1)).alias("lowest"), F.pow(F.lit(2.0), F.element_at("wells", -1)).alias("highest"), "share_on_lowest", "share_on_highest",
        F.size("seen").alias("n_recorded"), F.size(F.array_distinct(ratios)).alias("n_ratios"),
    )


def binary_intervals(obs: DataFrame, cut: float = 0.0) -> DataFrame:
    """A call as a reading: 0 up to the cut-off, 1 above it."""
    return obs.withColumns({"lo": F.when(F.col("y") == 1, F.lit(cut)).when(F.col("y") == 0, F.lit(-INF)), "hi": F.when(F.col("y") == 1, F.lit(INF)).when(F.col("y") == 0, F.lit(cut))})


def dilution_table(r: DataFrame, by: list[str]) -> DataFrame:
    """Readings by group and interval, with the interval's place in the order: open below first, open above after its lower end."""
    n = r.filter("lo IS NOT NULL").groupBy(*by, "grp", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("lo") == -INF, F.col("hi")).when(F.col("hi") == INF, F.col("lo") + 0.5).otherwise(F.col("hi"))
    low = F.when(F.col("lo") == -INF, F.lit(0)).otherwise(F.lit(1))
    return n.withColumn("place", F.dense_rank().over(Window.partitionBy(*by).orderBy(key, low, "lo", "hi")))


def coarsen(r: DataFrame, cuts: list[float]) -> DataFrame:
    """Intervals widened to kept cut points: the largest at or below lo, the least at or above hi."""
    c = F.array(*[F.lit(float(x)) for x in sorted(cuts)])
    lo, hi = F.array_max(F.filter(c, lambda x: x <= F.col("lo"))), F.array_min(F.filter(c, lambda x: x >= F.col("hi")))
    return r.withColumns({"clo": F.coalesce(lo, F.lit(-INF)), "chi": F.coalesce(hi, F.lit(INF))})


def cells(r: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi) -> n, first, last: readings on the sequence gap, end point, gap, ... of their stratum's finite ends."""
    # counted before they are filtered, and once: a filter on the ends is pushed below them, where each mention of a place looks it up anew
    u = settled(r.groupBy(*by, "lo", "hi").agg(F.count(F.lit(1)).alias("n"))).filter("lo IS NOT NULL AND NOT (lo = double('-infinity') AND hi = double('infinity'))")
    ends = u.select(*by, F.explode(F.array("lo", "hi")).alias("e")).filter(F.abs("e") < INF).distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy("e")) - 1
    ends = ends.withColumns({"i": place, "m": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    m = ends.select(*by, "m").distinct()
    a, b = ends.select(*by, F.col("e").alias("lo"), F.col("i").alias("ia")), ends.select(*by, F.col("e").alias("hi"), F.col("i").alias("ib"))
    j = u.join(m, by, "left").join(a, [*by, "lo"], "left").join(b, [*by, "hi"], "left")
    first = F.when(F.col("lo") == F.col("hi"), 2 * F.col("ia") + 1).otherwise(2 * F.coalesce("ia", F.lit(-1)) + 2)
    last = F.when(F.col("lo") == F.col("hi"), 2 * F.col("ia") + 1).when(F.col("hi") == INF, 2 * F.coalesce("m", F.lit(0))).otherwise(2 * F.col("ib") + 1)
    return j.select(*by, "lo", "hi", "n", first.cast("int").alias("first"), last.cast("int").alias("last"))


def runs(c: DataFrame, by: list[str]) -> DataFrame:
    """cells with `run`, the number of the merged cell: readings that overlap in a chain share one (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("_new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(0))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def mid_scores(c: DataFrame, by: list[str]) -> DataFrame:
    """Disjoint readings with their mid-distribution score: the share below and half their own. Overlapping ones (overlap true) get none here; see kernels.npmle_scores."""
    w = Window.partitionBy(*by).orderBy("first", "last")
    chain = runs(c, by).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*by, "run")))
    total, upto = F.sum("n").over(Window.partitionBy(*by)), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    overlap = F.max(F.col("_same") > 1).over(Window.partitionBy(*by))
    return chain.withColumns({"overlap": overlap, "score": F.when(~overlap, (upto - F.col("n") / 2) / total)}).drop("_same", "run")


def cell_ranges(c: DataFrame, by: list[str]) -> DataFrame:
    """(by, run) -> n, low, high: the ranks that a merged cell spans, as shares."""
    r = runs(c, by).groupBy(*by, "run").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*by))
    return r.withColumns({"low": (F.sum("n").over(w) - F.col("n")) / total, "high": F.sum("n").over(w) / total})


def pairs_below(c: DataFrame, by: list[str]) -> DataFrame:
    """(by) -> pairs of distinct readings and of records of which one lies wholly below the other. Distinct readings of a stratum are few; records are counted by their products."""
    a = c.select(*by, F.col("first").alias("fa"), F.col("last").alias("la"), F.col("n").alias("na"))
    b = c.select(*by, F.col("first").alias("fb"), F.col("last").alias("lb"), F.col("n").alias("nb"))
    return a.join(b, by).filter("la < fb").groupBy(*by).agg(F.count(F.lit(1)).alias("reading_pairs"), F.sum(F.col("na") * F.col("nb")).alias("record_pairs"))


def counts(r: DataFrame, c: DataFrame, by: list[str], grp: str = "grp") -> DataFrame:
    """(by, grp, run) -> n: groups by merged cells, what the bounds are computed from."""
    place = runs(c, by).select(*by, "lo", "hi", "run")
    return r.join(F.broadcast(place), [*by, "lo", "hi"]).groupBy(*by, F.col(grp).alias("grp"), "run").agg(F.count(F.lit(1)).alias("n"))


def resolution(r: DataFrame, c: DataFrame, stratum: list[str], by: list[str]) -> DataFrame:
    """(by) -> midpoint share 12 (sum w (e - 1/2)^2) of groups by the middle of their ranges, and the panel's resolution 1 - sum P D^2; strata weigh by their records."""
    k = counts(r, c, stratum).join(F.broadcast(cell_ranges(c, stratum).select(*stratum, "run", F.col("n").alias("cell"), "low", "high")), [*stratum, "run"])
    g = k.groupBy(*by, "grp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("low") + F.col("high")) / 2).alias("e"))
    g = g.groupBy(*by).agg(F.sum("n").alias("whole"), F.sum(F.col("e") * F.col("e") / F.col("n")).alias("q"))
    p = k.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("high") - F.col("low"), F.lit(2))).alias("d"))
    return g.join(p, by).select(*by, g["whole"].alias("n"), (F.lit(12.0) * (F.col("q") / F.col("whole") - 0.25)).alias("midpoint_share"), (1 - F.col("d") / F.col("n")).alias("resolution"))


def rank_share(scored: DataFrame, by: list[str]) -> DataFrame:
    """12 sum w (mean score - 1/2)^2 over groups, of (by, grp, score) records."""
    g = scored.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"), F.avg("score").alias("u"))
    return g.groupBy(*by).agg(F.sum("m").alias("n"), (F.lit(12.0) * F.sum(F.col("m") * F.pow(F.col("u") - 0.5, F.lit(2))) / F.sum("m")).alias("rank_share"))

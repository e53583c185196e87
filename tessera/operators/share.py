"""How much of an outcome a group label accounts for out of sample: dealt folds, skill from cell sums, permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import digest, uniform
from tessera.functions.stats import debias, phipson_smyth
from tessera.operators.staging import settled, small, tasks

MOST = 1_000_000  # records that are sorted together
BROADCAST = 500_000


def replicated(df: DataFrame, reps: int, name: str = "rep") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(reps))))


def dealt_folds(obs: DataFrame, by: list[str], folds: int, stream: str = "fold") -> DataFrame:
    """Record by record, for frames that have rep (dealt_cells gives the sums without it): obs with `fold`: groups in random order, members in random order, dealt round from a random fold.

    A record's place is the size of the groups before its own plus its place inside its group, so no sort spans a whole replicate.
    """
    h = obs.withColumn("_h", digest(stream, F.col("rep"), F.col("id")))
    g = h.groupBy(*by, "rep", "grp").agg(F.min("_h").alias("_g"), F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*by, "rep").orderBy("_g", "grp").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_g", "_m")
    at = F.row_number().over(Window.partitionBy(*by, "rep", "grp").orderBy("_h", "id"))
    start = F.floor(uniform(stream + "-start", F.col("rep"), F.lit("0")) * folds)
    return h.withColumn("_at", at).join(g, [*by, "rep", "grp"]).withColumn("fold", F.pmod(F.col("_before") + F.col("_at") - 1 + start, F.lit(folds)).cast("int")).drop("_h", "_at", "_before")


def permuted(obs: DataFrame, by: list[str], within: list[str], stream: str = "perm") -> DataFrame:
    """Of frames that have rep, a whole block in one window (relabelled bounds it): labels shuffled inside blocks, the k-th record by id takes the label of the k-th by hash."""
    block = [*by, *within, "rep"]
    a = obs.withColumn("_k", F.row_number().over(Window.partitionBy(*block).orderBy("id")))
    b = obs.select(*block, "grp", F.row_number().over(Window.partitionBy(*block).orderBy(digest(stream, F.col("rep"), F.col("id")), "id")).alias("_k"))
    return a.drop("grp").join(b, [*block, "_k"]).drop("_k")


def _digits(most: int) -> int:
    """Hex digits of a hash that split so many records into parts of at most MOST on average."""
    return 0 if most <= MOST else math.ceil(math.log(most / MOST, 16) - 1e-9)


def _bucket(h: str, digits: int) -> Column:
    return F.conv(F.substring(F.hex(h), 1, digits), 16, 10).cast("int") if digits else F.lit(0)


def _hashed(df: DataFrame, stream: str) -> DataFrame:
    # 16 bytes sort as their 32 hex digits do
    return df.withColumn("_h", F.unhex(digest(stream, F.col("rep"), F.col("id"))))


def _chunks(df: DataFrame, keys: list[str], most: int, rows: int, reps: int) -> DataFrame:
    """df with rep, in tasks that have all records of their keys and replicates: records travel once for several replicates and are multiplied behind the exchange."""
    size = max(1, min(reps, MOST // (8 * max(most, 1))))
    spread = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // size)))).repartition(tasks(df, rows * reps, MOST), *keys, "_c")
    return spread.withColumn("rep", F.explode(F.sequence(F.col("_c") * size + 1, F.least((F.col("_c") + 1) * size, F.lit(reps))))).withColumn("rep", F.col("rep").cast("int"))


def placed(obs: DataFrame, block: list[str]) -> tuple[DataFrame, int, int]:
    """obs with `_s`, a number of its block, `_k`, its place there by id, and `_m`, the block's records; all records, and those of the largest block. Records of a block that is null in part are left out.

    Ids are put in order by ranges, so that no block has to stand in one task.
    """
    o = obs.repartitionByRange(*block, "id").sortWithinPartitions(*block, "id").withColumn("_i", F.monotonically_increasing_id())
    o = settled(o).withColumn("_p", F.shiftright("_i", 33))
    piece = o.groupBy(*block, "_p").agg(F.min("_i").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before, whole = Window.partitionBy(*block).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*block)
    piece = small(piece.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_s": F.min("_lo").over(whole), "_m": F.sum("_n").over(whole)}))
    rows, most = piece.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_m"), F.lit(0))).first()
    return o.join(piece, [*block, "_p"]).withColumn("_k", F.col("_i") - F.col("_lo") + F.col("_before") + 1).drop("_i", "_p", "_lo", "_n", "_before"), rows, most


def relabelled(obs: DataFrame, by: list[str], within: list[str], perms: int, stream: str = "perm") -> DataFrame:
    """(by, rep, id, y, grp) of permuted(replicated(obs, perms), by, within, stream). A large block's hashes are sorted in parts by their first digits, whose sizes are counted before."""
    block = [*by, *within]
    o, rows, most = placed(obs.select(*block, "id", "grp", "y"), block)
    o, digits = settled(o), _digits(most)
    b = o.select("_s", F.col("_k").alias("_own"), "id", "grp")
    if digits:
        b = _hashed(replicated(b, perms), stream).withColumn("_b", _bucket("_h", digits))
        part = b.groupBy("_s", "rep", "_b").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_s", "rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        part = small(part.select("_s", "rep", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), BROADCAST)
        b = b.drop("id").repartition(tasks(o, rows * perms, MOST), "_s", "rep", "_b").withColumn("_at", F.row_number().over(Window.partitionBy("_s", "rep", "_b").orderBy("_h", "_own")))
        b = b.select("_s", "rep", "_b", "grp", "_at").join(part, ["_s", "rep", "_b"]).select("_s", "rep", "grp", (F.col("_at") + F.col("_before")).cast("long").alias("_k"))
    else:
        b = _hashed(_chunks(b, ["_s"], most, rows, perms), stream)
        b = b.select("_s", "rep", "grp", F.row_number().over(Window.partitionBy("_s", "_c", "rep").orderBy("_h", "_own")).cast("long").alias("_k"))
    a = o.select("_s", "_k", *by, "id", "y")
    # the optimizer takes rows made by explode for few: it would broadcast them
    return b.join(F.broadcast(a) if rows <= BROADCAST else a.hint("merge"), ["_s", "_k"]).drop("_s", "_k")


def dealt_cells(obs: DataFrame, by: list[str], folds: int, stream: str, digits: int, keys: list[str]) -> DataFrame:
    """(by, rep, fold, grp) -> m, s, q of the folds that dealt_folds gives. obs: with rep, all records of a group, or of its part by the first digits of the hash, in one task by `keys`.

    A part's records are dealt round from 0 and its sums turned by the records before it, so records meet no other table.
    """
    k = [*by, "rep", "grp"]
    at = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", "id")) - 1
    c = obs.withColumn("_r", F.pmod(at, F.lit(folds)))
    c = c.groupBy(*keys, "_b", "_r").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"), F.min("_h").alias("_h"))
    if digits:
        before = Window.partitionBy(*k).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
        c = c.withColumn("_r", F.pmod(F.col("_r") + F.coalesce(F.sum("m").over(before), F.lit(0)), F.lit(folds)))
    g = c.groupBy(*k).agg(F.min("_h").alias("_g"), F.sum("m").alias("_m"), F.collect_list(F.struct("_r", "m", "s", "q")).alias("_cells"))
    before = Window.partitionBy(*by, "rep").orderBy("_g", "grp").rowsBetween(Window.unboundedPreceding, -1)
    start = F.floor(uniform(stream + "-start", F.col("rep"), F.lit("0")) * folds)
    g = g.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).select(*k, "_before", F.inline("_cells"))
    return g.withColumn("fold", F.pmod(F.col("_before") + F.col("_r") + start, F.lit(folds)).cast("int")).groupBy(*k, "fold").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def _largest(obs: DataFrame, by: list[str]) -> tuple[int, int]:
    """Records, and those of the largest group."""
    m = obs.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"))
    return m.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()


def skill(folded: DataFrame, by: list[str]) -> DataFrame:
    """(by, rep) -> numerator, denominator, skill of predicting held-out records by the mean of their group elsewhere, both corrected for the noise of the means."""
    return skill_of_cells(folded.groupBy(*by, "rep", "fold", "grp").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")), by)


def skill_of_cells(c: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "rep"]
    wg, wf, wa = Window.partitionBy(*keys, "grp"), Window.partitionBy(*keys, "fold"), Window.partitionBy(*keys)
    c = c.withColumns({"gm": F.sum("m").over(wg), "gs": F.sum("s").over(wg), "gq": F.sum("q").over(wg), "fm": F.sum("m").over(wf), "fs": F.sum("s").over(wf), "am": F.sum("m").over(wa), "as_": F.sum("s").over(wa)})
    c = c.withColumn("v", F.when(F.col("gm") > 1, F.greatest(F.lit(0.0), F.col("gq") - F.col("gs") * F.col("gs") / F.col("gm")) / (F.col("gm") - 1)).otherwise(0.0))
    # all training counts times variances, less the fold's own
    c = c.withColumns({"mv": F.sum(F.col("m") * F.col("v")).over(wa), "fv": F.sum(F.col("m") * F.col("v")).over(wf)})
    c = c.filter((F.col("am") > F.col("fm")) & (F.col("fm") > 0))
    n, grand = F.col("gm") - F.col("m"), (F.col("as_") - F.col("fs")) / (F.col("am") - F.col("fm"))
    mean = F.when(n > 0, (F.col("gs") - F.col("s")) / n).otherwise(grand)
    miss: Column = lambda x: F.col("q") - 2 * x * F.col("s") + F.col("m") * x * x
    c = c.withColumns({"sse": miss(mean), "sst": miss(grand), "pen": F.when(n > 0, F.col("m") * F.col("v") / n).otherwise(0.0)})
    f = c.groupBy(*keys, "fold").agg(F.sum("sse").alias("sse"), F.sum("sst").alias("sst"), F.sum("pen").alias("pen"), (F.max("fm") * F.max(F.col("mv") - F.col("fv")) / F.pow(F.max(F.col("am") - F.col("fm")).cast("double"), F.lit(2))).alias("pen0"))
    out = f.groupBy(*keys).agg(F.sum(F.col("sse") - F.col("pen")).alias("numerator"), F.sum(F.col("sst") - F.col("pen0")).alias("denominator"))
    return out.withColumn("skill", F.when(F.col("denominator") > 0, 1 - F.col("numerator") / F.col("denominator")))


def cv_skill(obs: DataFrame, by: list[str], folds: int = 5, repeats: int = 20) -> DataFrame:
    """(by) -> mean and spread of skill over repeats, and the mean denominator. obs: repeated groups only."""
    o = settled(obs.select(*by, "id", "grp", "y"))
    rows, most = _largest(o, by)
    if digits := _digits(most):
        keys = [*by, "rep", "grp"]
        r = _hashed(replicated(o, repeats), "fold").withColumn("_b", _bucket("_h", digits)).repartition(tasks(o, rows * repeats, MOST), *keys, "_b")
    else:
        keys = [*by, "grp", "_c", "rep"]
        r = _hashed(_chunks(o, [*by, "grp"], most, rows, repeats), "fold").withColumn("_b", F.lit(0))
    s = skill_of_cells(dealt_cells(r, by, folds, "fold", digits, keys), by)
    return s.groupBy(*by).agg(F.avg("skill").alias("kappa"), F.stddev_pop("skill").alias("cv_sd"), F.avg("denominator").alias("denominator"))


def control(obs: DataFrame, by: list[str], folds: int = 5, perms: int = 99, within: list[str] | None = None) -> DataFrame:
    """(by) -> mean skill of permuted labels, each dealt once."""
    o = settled(obs.select(*by, *(within or []), "id", "grp", "y"))
    rows, most = _largest(o, by)
    p, digits, keys = relabelled(o, by, within or [], perms), _digits(most), [*by, "rep", "grp"]
    if digits:
        p = _hashed(p, "permfold").withColumn("_b", _bucket("_h", digits)).repartition(tasks(o, rows * perms, MOST), *keys, "_b")
    else:
        p = _hashed(p.repartition(tasks(o, rows * perms, MOST), *keys), "permfold").withColumn("_b", F.lit(0))
    return skill_of_cells(dealt_cells(p, by, folds, "permfold", digits, keys), by).groupBy(*by).agg(F.avg("skill").alias("null_mean"))


def fold_average(obs: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by) -> sum of m^2 / (m - 1) x within-group variance sums, and the total sum of squares: the closed form's parts."""
    n = F.col(weight) if weight else F.lit(1)
    g = obs.groupBy(*by, "grp").agg(F.sum(n).cast("long").alias("m"), F.sum(n * F.col("y")).alias("s"), F.sum(n * F.col("y") * F.col("y")).alias("q"))
    within = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("m"))
    return g.groupBy(*by).agg(F.sum(within * F.col("m") / F.greatest(F.col("m") - 1, F.lit(1))).alias("within"), (F.sum("q") - F.pow(F.sum("s"), F.lit(2)) / F.sum("m")).alias("total"))


def share(obs: DataFrame, by: list[str], folds: int = 5, repeats: int = 20, perms: int = 99, within: list[str] | None = None) -> DataFrame:
    """(by) -> kappa, null_mean, kappa_adj, fold_ratio and the closed form's share of it."""
    obs = settled(obs.select(*by, *(within or []), "id", "grp", "y"))
    k = cv_skill(obs, by, folds, repeats).join(control(obs, by, folds, perms, within), by).join(fold_average(obs, by), by)
    ratio = F.col("denominator") / F.nullif(F.col("total"), F.lit(0.0))
    k = k.withColumns({"kappa_adj": debias(F.col("kappa"), F.col("null_mean")), "fold_ratio": ratio, "closed": F.when((F.col("total") > 0) & (ratio > 0), 1 - F.col("within") / (ratio * F.col("total")))})
    return k.select(*by, "kappa", "cv_sd", "null_mean", "kappa_adj", "fold_ratio", "closed", debias(F.col("closed"), F.col("null_mean")).alias("closed_adj"))


def permutation_test(obs: DataFrame, by: list[str], perms: int = 99, within: list[str] | None = None, stream: str = "perm") -> DataFrame:
    """(by) -> between-group sum of squares, permutations that reach it (ties within 1e-11 count) and (b + 1) / (B + 1)."""
    stat = lambda d, keys: d.groupBy(*keys, "grp").agg((F.pow(F.sum("y"), F.lit(2)) / F.count(F.lit(1))).alias("t")).groupBy(*keys).agg(F.sum("t").alias("ss"))
    obs = settled(obs.select(*by, *(within or []), "id", "grp", "y"))
    seen = stat(obs, by)
    null = stat(relabelled(obs, by, within or [], perms, stream), [*by, "rep"]).withColumnRenamed("ss", "null_ss")
    b = F.count_if(F.col("null_ss") >= F.col("ss") - F.lit(1e-11) * F.abs(F.col("ss")))
    return null.join(seen, by).groupBy(*by, "ss").agg(b.alias("exceed")).withColumn("p", phipson_smyth(F.col("exceed"), perms))


def smoothed_share(obs: DataFrame, by: list[str]) -> DataFrame:
    """(by) -> the share of the smoothed law: each group's counts plus one spread over the categories seen in its strata, over m + 1. obs: repeated groups; categories are (stratum, y)."""
    cats = obs.select(*by, "stratum", "y").distinct()
    seen = obs.select(*by, "grp", "stratum").distinct()
    sizes = obs.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"))
    grid = seen.join(cats, [*by, "stratum"]).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*by, "grp")))
    n = obs.groupBy(*by, "grp", "stratum", "y").agg(F.count(F.lit(1)).alias("c"))
    law = grid.join(n, [*by, "grp", "stratum", "y"], "left").join(sizes, [*by, "grp"]).withColumn("p", (F.coalesce("c", F.lit(0)) + F.lit(1.0) / F.col("k")) / (F.col("m") + 1))
    g = law.groupBy(*by, "grp", "m").agg(F.sum(F.col("p") * F.col("y")).alias("mu"), F.sum(F.col("p") * F.col("y") * F.col("y")).alias("m2"))
    w = F.col("m") / F.sum("m").over(Window.partitionBy(*by))
    g = g.withColumn("w", w)
    a = g.groupBy(*by).agg((F.sum(F.col("w") * F.col("mu") * F.col("mu")) - F.pow(F.sum(F.col("w") * F.col("mu")), F.lit(2))).alias("between"), F.sum(F.col("w") * (F.col("m2") - F.col("mu") * F.col("mu"))).alias("within"))
    return a.withColumn("share", F.when(F.col("between") + F.col("within") > 0, F.col("between") / (F.col("between") + F.col("within"))))


def derivatives(obs: DataFrame, by: list[str], ratio: float, null_mean: float) -> DataFrame:
    """(by, grp, y) -> the share's derivative to a record of that group and value: by how much one more such record would move it."""
    g = obs.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    g = g.withColumns({"within": F.col("q") - F.col("s") * F.col("s") / F.col("m"), "f": F.col("m") / F.greatest(F.col("m") - 1, F.lit(1)), "df": F.lit(-1.0) / F.pow(F.greatest(F.col("m") - 1, F.lit(1)).cast("double"), F.lit(2))})
    a = g.groupBy(*by).agg(F.sum(F.col("f") * F.col("within")).alias("N"), F.sum("q").alias("_q"), F.sum("s").alias("_s"), F.sum("m").alias("_m"))
    a = a.select(*by, F.col("N").alias("num"), (F.col("_s") / F.col("_m")).alias("ybar"), (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_m")).alias("tot"))
    v = obs.select(*by, "y").distinct()
    j = g.join(v, by).join(F.broadcast(a), by)
    dn = F.col("df") * F.col("within") + F.col("f") * F.pow(F.col("y") - F.col("s") / F.col("m"), F.lit(2))
    d = -(dn * F.col("tot") - F.col("num") * F.pow(F.col("y") - F.col("ybar"), F.lit(2))) / (F.lit(ratio) * F.col("tot") * F.col("tot")) / F.lit(1.0 - null_mean)
    return j.select(*by, "grp", "y", F.when(F.col("tot") > 0, d).alias("derivative"))

"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

_BROADCAST_SOURCES = 100_000
_BLOCK = 10_000


def uniform(*key: Column | str) -> Column:
    """A uniform number of [0, 1) from 48 bits of an md5 of the key, the same in any SQL engine with md5."""
    text = F.concat_ws("|", *[F.coalesce((k if isinstance(k, Column) else F.lit(k)).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k with u < P(X <= k) for X ~ Poisson(rate), as a long, summed term by term; 0 where rate is not positive.

    The sum ends at rate + 12 sqrt(rate) + 30, beyond which less than 2^-48 of the mass lies. Over a rate of 700, where exp(-rate) would vanish, it
    starts at rate - 12 sqrt(rate), below which less than exp(-72) lies, with terms relative to the first and u scaled by their sum.
    """
    reach = F.lit(12.0) * F.sqrt(rate)
    last = F.ceil(rate + reach + F.lit(30.0)).cast("long")

    def summed(first: Column, p0: Column, target: Column | None) -> Column:
        start = F.struct(first.alias("k"), p0.alias("p"), p0.alias("c"))

        def more(acc: Column, i: Column) -> Column:
            p = acc["p"] * rate / i.cast("double")
            on = F.struct(i.alias("k"), p.alias("p"), (acc["c"] + p).alias("c"))
            return on if target is None else F.when(target < acc["c"], acc).otherwise(on)

        return F.aggregate(F.sequence(first + F.lit(1), last), start, more, lambda acc: acc["c"] if target is None else acc["k"])

    low = F.floor(rate - reach).cast("long")
    far = summed(low, F.lit(1.0), u * summed(low, F.lit(1.0), None))
    return F.when(rate > F.lit(700.0), far).when(rate > F.lit(0.0), summed(F.lit(0).cast("long"), F.exp(-rate), u)).otherwise(F.lit(0).cast("long"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", total: float | None = None) -> DataFrame:
    """(source, rows, rate): rate = weight x total / rows, with the weights of the sources present normalised to 1.

    Without weights every source weighs the same. A source that has none gets rate 0. The total is that of docs unless given.
    A null source is a source of its own (key None).
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        weighed = counts.withColumn("_w", F.lit(1.0))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            hit = F.col("_source").isNull() if name is None else F.col("_source") == F.lit(name)
            w = F.when(hit, F.lit(float(value))).otherwise(w)
        weighed = counts.withColumn("_w", w)
    weighed = staged(weighed, "sources")
    whole = weighed.agg(F.sum("_w").alias("w"), F.sum("_rows").alias("n")).first()
    n = float(total if total is not None else whole["n"] or 0)
    share = F.col("_w") / F.lit(whole["w"]) * F.lit(n) / F.col("_rows").cast("double") if whole["w"] else F.lit(0.0)
    return weighed.select("_source", "_rows", share.alias("_rate"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, key: str = "doc_id", source: str = "source", seed: str = "mix", total: float | None = None) -> DataFrame:
    """Every document as often as its Poisson count says, in a global random order; adds _rate, _copies, _copy and _order.

    The count of a document inverts the Poisson distribution with its source's mean rate at a uniform number
    hashed from seed and key, so it depends on no partitioning and is the same after a lost task. _copy runs
    from 0; _order is the hash by which the rows are sorted over all partitions. Documents with count 0 go.
    Repeated rows get the same count each; null keys hash as an empty key; an empty table gives no rows; an input
    column with one of the new names, or _source, _rows, _part, _salt, is replaced.
    The totals of sources meet the rows by a broadcast while there are at most 100,000 sources, else by a
    join of which the large side is salted 32 ways.
    """
    docs = docs.drop("_rate", "_copies", "_copy", "_order", "_source", "_rows", "_part", "_salt")
    rates = source_rates(docs, weights, source, total)
    few = rates.limit(_BROADCAST_SOURCES + 1).count() <= _BROADCAST_SOURCES
    names = docs.columns
    if few:
        joined = docs.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col("_source")))
    else:
        salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        keyed = docs.withColumn("_part", F.pmod(F.xxhash64(F.col(key)), F.lit(32)).cast("int"))
        joined = keyed.join(salted, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_salt")))
    counted = joined.withColumn("_copies", poisson_inverse(uniform(seed, F.col(key)), F.col("_rate"))).filter(F.col("_copies") > 0)
    # copies in blocks, so that no row needs an array of them all
    blocks = counted.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_copies") - F.lit(1), F.lit(0)), F.lit(_BLOCK).cast("long"))))
    copies = blocks.withColumn("_copy", F.explode(F.sequence(F.col("_part"), F.least(F.col("_part") + F.lit(_BLOCK), F.col("_copies")) - F.lit(1))))
    ordered = copies.withColumn("_order", F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("_copy").cast("string"))))
    return ordered.select(*names, "_rate", "_copies", "_copy", "_order").orderBy("_order")



"""Sharding by jump consistent hashing (Lamping and Veach), in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_M = 2862933555777941757
_LOW = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * _M + 1 modulo 2^64 on two 32-bit halves; no intermediate passes 2^63, as ANSI mode asks."""
    mh, ml = F.lit(_M >> 32), F.lit(_M & _LOW)
    p0 = lo.bitwiseAND(F.lit(0xFFFF)) * ml
    p1 = F.shiftright(lo, 16) * ml
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    cross = hi.bitwiseAND(F.lit(0xFFFF)) * ml + F.shiftleft((F.shiftright(hi, 16) * ml).bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftright(low, 32) + F.shiftright(p1, 16) + (lo * mh).bitwiseAND(F.lit(_LOW)) + cross
    return high.bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long key; a null key counts as 0.

    The loop runs over at most `shards` jumps (each moves to a larger bucket), so it is exact for every count.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(_LOW)).alias("hi"), key.bitwiseAND(F.lit(_LOW)).alias("lo"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def jump(acc: Column, _: Column) -> Column:
        hi, lo = _step(acc["hi"], acc["lo"])
        stepped = F.struct(hi.alias("hi"), lo.alias("lo"))
        then = F.transform(
            F.array(stepped),
            lambda s: F.struct(
                s["hi"].alias("hi"), s["lo"].alias("lo"), acc["j"].alias("b"), F.floor((acc["j"] + F.lit(1)) * (F.lit(2147483648.0) / (F.shiftright(s["hi"], 1) + F.lit(1)).cast("double"))).cast("long").alias("j")
            ),
        )[0]
        return F.when(acc["j"] < F.lit(shards), then).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda acc: acc["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_range: int = 50_000, grown: bool = True) -> DataFrame:
    """docs with _size, _crc, _shard, _slot and _grown_shard; every input column stays.

    The law is `key`: key and shard count alone decide, and with one more shard rows move only into
    that shard. Slots count from 0 without gaps in each shard, in the order of key, checksum and size. They
    need no sort of a whole shard in one task: keys fall into ranges (cut points from an approximate
    percentile, at most 4096), a key that fills a range of its own (null is one) into 256 by checksum, rows are numbered inside (shard, range), and the counts of earlier ranges,
    a table of at most shards x 4096 x 256 rows and in practice a few more than there are ranges, are added. Only rows that agree in key, checksum and size must meet.
    Null keys count as key 0 for the shard and come first in the order; null texts have no bytes and checksum 0; repeated rows get
    slots of their own; an empty table gives no rows; an input column with one of the new names, or
    _range, _at, _before, is replaced.
    """
    docs = docs.drop("_size", "_crc", "_shard", "_slot", "_grown_shard", "_range", "_part", "_at", "_before")
    out = docs.withColumns(
        {
            "_size": (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(8)).cast("long"),
            "_crc": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")),
            "_shard": jump_shard(F.col(key), shards),
        }
    )
    if grown:
        out = out.withColumn("_grown_shard", jump_shard(F.col(key), shards + 1))
    ranges = min(4096, docs.count() // rows_per_range + 1)
    cuts: list[int] = []
    hot: list[int] = []
    if ranges > 1:
        at = ",".join(str(i / ranges) for i in range(1, ranges))
        found = docs.agg(F.expr(f"approx_percentile(`{key}`, array({at}), 100000)")).first()[0]
        hot = sorted({a for a, b in zip(found or [], (found or [])[1:]) if a == b})
        cuts = sorted({*(found or []), *(k - 1 for k in hot if k > -(1 << 63))})
    place = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    out = out.withColumn("_range", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place).cast("int"))
    alone = F.col(key).isNull() | F.coalesce(F.col(key).isin(hot), F.lit(False))
    out = out.withColumn("_part", F.when(alone, F.shiftright("_crc", 24)).otherwise(F.lit(0)).cast("int"))
    counts = out.groupBy("_shard", "_range", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_shard", "_range", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_shard", "_range", "_part").orderBy(F.col(key).asc_nulls_first(), "_crc", "_size")
    numbered = out.withColumn("_at", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["_shard", "_range", "_part"]).withColumn("_slot", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_at", "_before", "_range", "_part")

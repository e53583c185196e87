"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly; built-in expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged, words_of

#: Rows up to which a side of two or three narrow columns is broadcast: 500,000 x about 40 bytes, 20 MB.
BROADCAST_ROWS = 500_000


def _width(n: Column, width: int) -> Column:
    return F.least(n, F.lit(width))


def _hashes(words: Column, k: int) -> Column:
    """A 64-bit hash of each run of k words."""
    runs = F.sequence(F.lit(0), F.size(words) - F.lit(k))
    return F.when(F.size(words) >= k, F.transform(runs, lambda i: F.xxhash64(F.lit(k), *[words[i + F.lit(j)] for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, k: Column) -> Column:
    """The distinct runs of k words, as words joined by a space."""
    runs = F.sequence(F.lit(1), F.size(words) - k + F.lit(1))
    return F.when(F.size(words) >= k, F.array_distinct(F.transform(runs, lambda i: F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<string>"))


#: Positions of a signature. Items of fewer shingles are looked up whole.
POSITIONS = 32


def least_hits(positions: int, threshold: float, miss: float = 1e-9) -> int:
    """The most agreeing positions that an item of containment >= threshold still has, missed with at most this probability: a quantile of the binomial distribution."""
    below, k = 0.0, 0
    while k < positions:
        below += math.comb(positions, k) * threshold**k * (1 - threshold) ** (positions - k)
        if below > miss:
            break
        k += 1
    return max(1, k)


def item_sketches(items: DataFrame, item_id: str, text: str, width: int, threshold: float, positions: int = POSITIONS) -> DataFrame:
    """(item, k, n, part, least, need, s, weight): the MinHash signature of each item as the shingles that attain its minima, and at how many positions each does.

    Items are partitioned by the power of two of their shingle count. A partition sets what a document must show, as an ensemble of containment indexes does, seen
    from the short side: in partitions that the signature can hold whole, all shingles are looked up and `need` = ceil(threshold n) of them make a candidate; above, the minima
    of `positions` hash functions are, each of which a document of containment c has with probability c, and `need` follows from the binomial distribution. `least` is the fewest shingles that a document
    must have to reach the threshold. As minima are looked up in a document's whole shingle set, the length of a document costs no recall, and one shingle that many documents share makes no candidate.
    """
    one = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    one = one.withColumn("k", _width(F.size("w"), width))
    hashed = one.withColumn("h", F.array_distinct(F.coalesce(*[F.when(F.col("k") == k, _hashes(F.col("w"), k)) for k in range(1, width + 1)])))
    sized = hashed.select("item", "k", "h", F.size("h").alias("n")).withColumn("part", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    whole = F.pow(F.lit(2.0), (F.col("part") + 1).cast("double")) <= F.lit(float(positions))
    minima = F.transform(F.sequence(F.lit(1), F.lit(positions)), lambda j: F.array_min(F.transform(F.col("h"), lambda s: F.struct(F.xxhash64(j, s).alias("v"), s.alias("s"))))["s"])
    least = F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int")
    out = sized.select("item", "k", "part", "n", least.alias("least"), F.when(whole, least).otherwise(F.lit(least_hits(positions, threshold))).alias("need"), F.explode(F.when(whole, F.col("h")).otherwise(minima)).alias("s"))
    return out.groupBy("item", "k", "part", "n", "least", "need", "s").agg(F.count(F.lit(1)).alias("weight"))


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every document and item of which the document holds at least `threshold` of the distinct word shingles.

    1. Sketch: see item_sketches. 2. Candidates: every shingle of every document is looked up among the
    minima; a document that shows as many of them as the item's partition asks for is a candidate. 3. Verification: the shingles
    of the candidate documents and items are compared as strings.
    The minima and the candidates' ids are broadcast while they have at most BROADCAST_ROWS rows, and
    joined by a shuffle beyond. An item of fewer than five words is one shingle of all its words. Null and empty texts hold
    nothing; items without words are in no document; rows with the same id (null is one) count as one
    document, of which the best row counts; the same holds for items; empty tables give no rows.
    """
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_item_text"))
    sketch = staged(item_sketches(items, "item_id", "_item_text", width, threshold), "sketch")
    widths = sorted(r[0] for r in sketch.select("k").distinct().collect())  # at most `width` values
    base = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w"))
    empty = base.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_item"), F.lit(0.0).alias("containment")).limit(0)
    if not widths:
        return empty
    hashes = F.concat(*[_hashes(F.col("w"), k) for k in widths]) if len(widths) > 1 else _hashes(F.col("w"), widths[0])
    probes = base.select("doc_id", F.size("w").alias("nw"), F.explode(hashes).alias("s"))
    minima = sketch.select(F.col("item").alias("item_id"), "least", "need", "s", "weight")
    near = minima if sketch.count() > BROADCAST_ROWS else F.broadcast(minima)
    hits = probes.join(near, "s").filter(F.col("nw") >= F.col("least"))
    # a shingle counts once a document, however often it is there
    shown = hits.groupBy("doc_id", "item_id", "s").agg(F.max("weight").alias("weight"), F.max("need").alias("need"))
    found = staged(shown.groupBy("doc_id", "item_id").agg(F.sum("weight").alias("hits"), F.min("need").alias("need")).filter(F.col("hits") >= F.col("need")).select("doc_id", "item_id"), "candidates")
    few = found.count() <= BROADCAST_ROWS
    ids = found.select(F.col("doc_id").alias("_id"), F.col("item_id").alias("_item"))
    pairs = base.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")))
    wanted = items.withColumn("_w", words_of(F.col("_item_text"))).withColumn("_k", _width(F.size("_w"), width))
    wanted = wanted.select("item_id", "_k", _shingles(F.col("_w"), F.col("_k")).alias("_sh"))
    both = pairs.join(F.broadcast(wanted) if items.count() <= 20_000 else wanted, F.col("_item").eqNullSafe(F.col("item_id")))
    shared = F.size(F.array_intersect(F.col("_sh"), _shingles(F.col("w"), F.col("_k"))))
    exact = both.select("doc_id", "item_id", shared.alias("n_shared"), F.size("_sh").alias("n_item"))
    exact = exact.withColumn("containment", F.col("n_shared").cast("double") / F.col("n_item").cast("double")).filter(F.col("containment") >= threshold)
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def drop_leaks(docs: DataFrame, items: DataFrame, **how: object) -> DataFrame:
    """docs without those that hold an item; rows that share an id (null is one) go together."""
    leaks = staged(find_leaks(docs, items, **how).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    key = str(how.get("doc_id", "doc_id"))
    side = F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks
    return docs.join(side, docs[key].eqNullSafe(side["_leak"]), "left_anti")

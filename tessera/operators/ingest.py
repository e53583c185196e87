"""From raw tables to canonical long frames: reshaping, keys, recoding, duplicates, joins with explicit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DUPLICATES
from tessera.functions import text
from tessera.operators.staging import settled, small, tasks


SIGNS = ("=", "", *(s + e for s in "<>" for e in ("", "=")))


class Refused(ValueError):
    """Input that an analysis must not silently repair."""


def tidy(df: DataFrame) -> DataFrame:
    """Headers without outer blanks; rows of nothing but blanks go."""
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})
    blank = None
    for c in df.columns:
        one = F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) == ""
        blank = one if blank is None else blank & one
    return df.filter(~blank) if blank is not None else df


def require_keys(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    bad = df.filter(F.greatest(F.lit(False), *[text.token(F.col(k)) == "" for k in keys])).limit(1).count()
    if bad:
        raise Refused(f"{what} has records with a blank {' or '.join(keys)}")
    return df


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None, variable: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; nulls stay rows."""
    return df.unpivot(ids, values or [c for c in df.columns if c not in ids], variable, value)


def panel(calls: DataFrame, universe: DataFrame, features: list[str], key: str = "id") -> DataFrame:
    """Long to wide over all ids of the universe and all features, nulls where nothing is known."""
    wide = calls.groupBy(key).pivot("feature", features).agg(F.first("y", ignorenulls=True))
    return universe.select(key).join(wide, key, "left")


def recode(calls: DataFrame, kind: str, intermediate: str | None = None, call: str = "call") -> DataFrame:
    """calls with y (0, 1, null) and meaning."""
    return calls.withColumns({"y": text.call_value(F.col(call), kind, intermediate), "meaning": text.call_meaning(F.col(call), kind)})


def call_registry(calls: DataFrame, kind: str, intermediate: str | None = None, call: str = "call", key: str = "id") -> DataFrame:
    """Per feature: rows read, distinct ids, missing, unreadable and dropped calls, ids with a value."""
    r = recode(calls, kind, intermediate, call)
    unread = F.col("meaning").startswith("unknown:")
    dropped = F.lit(False) if kind in ("wt_nwt", "binary") else (F.coalesce(text.canonical_call(F.col(call), kind) == "i", F.lit(False)) & F.col("y").isNull())
    return r.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows_read"), F.countDistinct(key).alias("n_ids"), F.count_if(F.col("meaning") == "missing").alias("n_missing"), F.count_if(unread).alias("n_unreadable"),
        F.count_if(dropped).alias("n_dropped"), F.countDistinct(F.when(F.col("y").isNotNull(), F.col(key))).alias("n_readable"),
    )


def unreadable(calls: DataFrame, kind: str, call: str = "call") -> DataFrame:
    return recode(calls, kind, None, call).filter(F.col("meaning").startswith("unknown:")).groupBy(text.token(F.col(call)).alias("token")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_report(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: repeated rows, identical ones, keys and rows in conflict. Two levels of grouping, so no key's rows meet in one set."""
    # most keys are their only row, so they are not gathered before the exchange, and both groupings share it
    df = df.select(*keys, *values)
    df = df.repartition(tasks(df, df.count(), 250_000), *keys)
    per = df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("v"))
    return per.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate_rows"), F.coalesce(F.sum(F.col("n") - F.col("v")), F.lit(0)).alias("n_identical_collapsed"),
        F.count_if(F.col("v") > 1).alias("n_conflicting_keys"), F.coalesce(F.sum(F.when(F.col("v") > 1, F.col("n"))), F.lit(0)).alias("n_conflicting_rows"),
    )


def resolve_duplicates(df: DataFrame, keys: list[str], values: list[str], policy: str = "error", positive: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """One row per key. `error` refuses conflicts, `drop_conflicts` removes their keys, `positive_wins` takes the largest of `positive`, or the first row in `order` where there is none."""
    if policy not in DUPLICATES:
        raise ValueError(f"{policy!r} is no way to resolve duplicates")
    if policy == "positive_wins" and positive:
        return df.groupBy(*keys).agg(F.max(positive).alias(positive))
    if policy != "positive_wins":
        odd = df.select(*keys, *values).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_v")).filter("_v > 1").select(*keys)
        if policy == "error":
            first = odd.orderBy(*keys).limit(5).collect()
            if first:
                raise Refused(f"conflicting records, for example {[tuple(r) for r in first]}; correct the source or choose drop_conflicts or positive_wins")
        else:
            df = df.join(odd, keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col(c) for c in sorted(df.columns)]))
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def join_report(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """One row of a full outer join's counts by key: matched, only left, only right, rate."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full_outer")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return j.agg(both.alias("matched"), F.count(F.when(F.col("_b").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_right"), (both / F.nullif(F.count("_a"), F.lit(0))).alias("rate"))


def near_matches(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys without an exact partner that would have one but for blanks, case or leading zeros. Reported, never repaired."""
    a = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")
    b = right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti")
    a, b = a.select(F.col(key).alias("left_id"), text.near_key(F.col(key)).alias("_k")), b.select(F.col(key).alias("right_id"), text.near_key(F.col(key)).alias("_k"))
    return a.join(b, "_k").select("left_id", "right_id")


def longest_contained(names: DataFrame, idents: DataFrame, name: str, ident: str, most: int = 100_000) -> DataFrame:
    """Of each name the longest identifier that it contains (ties: the first by text). The identifiers, a dictionary, are broadcast only if at most `most`; a longer one is refused."""
    d = idents.select(ident).distinct()
    if d.limit(most + 1).count() > most:
        raise Refused(f"more than {most} identifiers for a containment join")
    j = names.select(name).distinct().join(F.broadcast(d), F.contains(F.col(name), F.col(ident)))
    w = Window.partitionBy(name).orderBy(F.desc(F.length(ident)), ident)
    return j.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(name, ident)


def scorable(records: DataFrame, a: str, b: str, key: str = "id") -> DataFrame:
    """The largest set of records of which each has at least one other with its label under a and one under b: drop the others until nothing changes."""
    typed = records.filter(~text.untyped(F.col(a)) & ~text.untyped(F.col(b)))
    for left, c in zip(scorable_labels(typed.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), a, b), (a, b)):
        typed = typed.join(small(left), c, "left_semi")
    return typed.select(*records.columns)


def scorable_labels(pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The labels under a, and those under b, that scorable records have; from pairs (a, b, n)."""
    # whether a record stays depends on its pair of labels alone, so the pairs are counted once and records travel no more
    now = settled(pairs.filter(~text.untyped(F.col(a)) & ~text.untyped(F.col(b))).select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col("n").alias("_n")))
    size = now.count()
    while True:
        for c in ("_a", "_b"):
            now = now.join(small(now.groupBy(c).agg(F.sum("_n").alias("_m")).filter("_m >= 2").select(c)), c, "left_semi")
        now = settled(now)
        smaller = now.count()
        if smaller == size:
            break
        size = smaller
    return now.select(F.col("_a").alias(a)).distinct(), now.select(F.col("_b").alias(b)).distinct()


def split_units(cells: DataFrame, unit: str = "unit") -> DataFrame:
    """cells with the unit read as one spelling, and whether the row is in another unit than mg/L."""
    u = text.unit_of(F.col(unit))
    return cells.withColumns({"unit_read": u, "other_unit": ~u.isin("", "mg/L")})


def parse_cells(cells: DataFrame, value: str = "value", op: str = "op") -> DataFrame:
    """cells with number and sign; `clash` where the sign in the cell and the recorded one differ; numbers that aren't positive become null."""
    inline = text.cell_sign(F.col(value))
    given = F.replace(F.replace(F.trim(F.coalesce(F.col(op), F.lit(""))), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    number = text.cell_number(F.col(value))
    return cells.withColumns(
        {
            "number": text.once(number, lambda x: F.when(x > 0, x)), "sign": F.when(given != "", given).otherwise(inline), "clash": (given != "") & (inline != "") & (given != inline),
            "bad_sign": ~F.when(given != "", given).otherwise(inline).isin(*SIGNS),
        }
    )


def reading_registry(cells: DataFrame, key: str = "id") -> DataFrame:
    """Per feature: rows, ids, missing and unparseable cells, rows in other units, distinct wells, ids with a number."""
    missing = text.among(F.col("value"), text.CELL_MISSING)
    c = cells.select("feature", F.col(key).alias("_id"), "number", missing.alias("_missing"), "other_unit")
    one = c.repartition(tasks(c, c.count(), 250_000), "feature", "_id").groupBy("feature", "_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_missing").alias("_miss"), F.count_if(~F.col("_missing") & F.col("number").isNull()).alias("_bad"), F.count_if("other_unit").alias("_unit"), F.count("number").alias("_read"),
    )
    r = one.groupBy("feature").agg(
        F.sum("_n").alias("rows_read"), F.count("_id").alias("n_ids"), F.sum("_miss").alias("n_missing"), F.sum("_bad").alias("n_unparseable"), F.sum("_unit").alias("n_other_unit"), F.count_if(F.col("_id").isNotNull() & (F.col("_read") > 0)).alias("n_readable"),
    )
    w = c.groupBy("feature", F.round("number", 6).alias("_w")).agg(F.count(F.lit(1)).alias("_c")).groupBy(F.col("feature").alias("_f")).agg(F.array_join(F.array_sort(F.collect_set("_w")), " ").alias("wells"))
    return r.join(w, F.col("feature").eqNullSafe(F.col("_f"))).select("feature", "rows_read", "n_ids", "n_missing", "n_unparseable", "n_other_unit", "wells", "n_readable")


def off_panel(cells: DataFrame, wells: list[float], value: str = "number", tolerance: float = 0.25) -> DataFrame:
    """Readings further than `tolerance` doublings from every tested well."""
    # a filter is pushed below the column that it reads, and each mention of it there is computed anew
    far = text.once(F.log2(F.col(value)), lambda v: F.array_min(F.transform(F.array(*[F.log2(F.lit(float(w))) for w in wells]), lambda w: F.abs(v - w))))
    return cells.filter(far > tolerance)


def date_coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of the values that look like dates, over all columns in one pass."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.filter(text.date_like(F.col("value"))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def batch_order(labels: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, place): by number if every label is one, else by text."""
    d = labels.filter(F.col(batch).isNotNull()).select(F.col(batch).alias("batch")).distinct()
    v = F.col("batch").try_cast("double")
    every = Window.partitionBy()
    d = d.withColumn("_num", F.when(F.every(v.isNotNull() & ~F.isnan(v)).over(every), v))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.col("_num").asc_nulls_first(), "batch"))).select("batch", "place")


def unit_or_self(df: DataFrame, unit: str = "unit", key: str = "id") -> DataFrame:
    return df.withColumn(unit, F.when(text.untyped(F.col(unit)), F.concat(F.lit("__record__"), F.col(key))).otherwise(F.col(unit)))


def crossed(columns: list[str]) -> Column:
    """A stratum label of several: a / b / c."""
    return F.concat_ws(" / ", *columns)

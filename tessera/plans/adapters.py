"""The driver's tables as canonical frames, and the same as SQL: obs (id, feature, y, grp, stratum, unit, batch, side), and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.staging import tasks

OBS = ["id", "feature", "y", "grp", "stratum", "unit", "batch", "side"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders: whether finished and whether urgent, by nation; stratum priority, unit customer, batch year, side early or late."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    year = F.year("o_orderdate")
    wide = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").cast("string").alias("id"),
            (F.col("o_orderstatus") == "F").cast("double").alias("finished"),
            (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"),
            F.col("n_name").alias("grp"),
            F.col("c_mktsegment").alias("stratum"),
            F.col("o_custkey").cast("string").alias("unit"),
            year.cast("string").alias("batch"),
            F.when(year <= 1997, "early").when(year >= 1999, "late").alias("side"),
        )
    )
    return wide.unpivot(["id", "grp", "stratum", "unit", "batch", "side"], ["finished", "urgent"], "feature", "y").select(*OBS)


ORDERS_OBS = """orders_wide AS (
    SELECT o_orderkey::VARCHAR AS id, (o_orderstatus = 'F')::INT::DOUBLE AS finished, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS urgent, n_name AS grp,
           c_mktsegment AS stratum, o_custkey::VARCHAR AS unit, year(o_orderdate)::VARCHAR AS batch,
           CASE WHEN year(o_orderdate) <= 1997 THEN 'early' WHEN year(o_orderdate) >= 1999 THEN 'late' END AS side
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
obs AS (SELECT id, 'finished' AS feature, finished AS y, grp, stratum, unit, batch, side FROM orders_wide
        UNION ALL SELECT id, 'urgent', urgent, grp, stratum, unit, batch, side FROM orders_wide)"""


def docs_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents: the labels quality and toxic (null where none was given), by source; stratum language, batch id modulo 8, side English or not."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    wide = d.join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
        F.col("source").alias("grp"),
        F.col("lang").alias("stratum"),
        F.concat(F.lit("u"), (F.col("doc_id") % 100).cast("string")).alias("unit"),
        (F.col("doc_id") % 8).cast("string").alias("batch"),
        F.when(F.col("lang") == "en", "en").otherwise("rest").alias("side"),
    )
    return wide.unpivot(["id", "grp", "stratum", "unit", "batch", "side"], ["quality", "toxic"], "feature", "y").select(*OBS)


DOCS_OBS = """docs_wide AS (
    SELECT doc_id::VARCHAR AS id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, source AS grp, lang AS stratum, 'u' || (doc_id % 100)::VARCHAR AS unit,
           (doc_id % 8)::VARCHAR AS batch, CASE WHEN lang = 'en' THEN 'en' ELSE 'rest' END AS side
    FROM documents LEFT JOIN labels USING (doc_id)),
obs AS (SELECT id, 'quality' AS feature, quality AS y, grp, stratum, unit, batch, side FROM docs_wide
        UNION ALL SELECT id, 'toxic', toxic, grp, stratum, unit, batch, side FROM docs_wide)"""


def items_mic(spark: SparkSession, sf: str, doubling: bool = False) -> DataFrame:
    """Line items as readings: the quantity (or its nearest power of two), by brand; panel the ship status, stratum status and return flag. One reading per order line key, the least."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    value = F.pow(F.lit(2.0), F.rint(F.log2(F.col("l_quantity").cast("double")))) if doubling else F.col("l_quantity").cast("double")
    j = li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), value.alias("value"), F.col("p_brand").alias("grp"), F.col("p_type").alias("grp2"), F.col("l_linestatus").alias("panel"),
        F.concat_ws(" / ", "l_linestatus", "l_returnflag").alias("stratum"),
        F.when(F.col("l_quantity") >= 49, ">").when(F.col("l_quantity") <= 2, "<=").otherwise("").alias("op"),
    )
    # most ids are their only row, so they are not sorted and gathered before the exchange
    j = j.repartition(tasks(li, li.count()), "id")
    return j.groupBy("id").agg(F.min(F.struct("value", "grp", "grp2", "panel", "stratum", "op")).alias("r")).select("id", "r.*").withColumn("feature", F.lit("quantity"))


def items_mic_sql(doubling: bool = False) -> str:
    value = "pow(2.0, round_even(log2(l_quantity::DOUBLE), 0))" if doubling else "l_quantity::DOUBLE"
    return f"""items AS (
    SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, {value} AS value, p_brand AS grp, p_type AS grp2, l_linestatus AS panel, l_linestatus || ' / ' || l_returnflag AS stratum,
           CASE WHEN l_quantity >= 49 THEN '>' WHEN l_quantity <= 2 THEN '<=' ELSE '' END AS op
    FROM lineitem JOIN part ON l_partkey = p_partkey),
readings AS (SELECT id, value, grp, grp2, panel, stratum, op, 'quantity' AS feature FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value, grp, grp2, panel, stratum, op) AS rn FROM items) WHERE rn = 1)"""


def two_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(id, y, label_a, label_b): brand and type as two labelings of orders, the return as outcome, of each order's lines the least; every eleventh id lacks one or the other label."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("id"), (F.col("l_returnflag") == "R").cast("double").alias("y"),
        F.when(F.col("l_orderkey") % 11 != 3, F.concat_ws("/", "p_brand", (F.col("l_orderkey") % 97).cast("string"))).alias("label_a"), F.when(F.col("l_orderkey") % 11 != 5, F.col("p_type")).alias("label_b"),
    )
    return j.groupBy("id").agg(F.min(F.struct("y", "label_a", "label_b")).alias("r")).select("id", "r.*")


TWO_LABELS = """lab AS (
    SELECT l_orderkey::VARCHAR AS id, (l_returnflag = 'R')::INT::DOUBLE AS y,
           CASE WHEN l_orderkey % 11 <> 3 THEN p_brand || '/' || (l_orderkey % 97)::VARCHAR END AS label_a, CASE WHEN l_orderkey % 11 <> 5 THEN p_type END AS label_b
    FROM lineitem JOIN part ON l_partkey = p_partkey),
two AS (SELECT id, y, label_a, label_b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY y, label_a NULLS FIRST, label_b NULLS FIRST) AS rn FROM lab) WHERE rn = 1)"""

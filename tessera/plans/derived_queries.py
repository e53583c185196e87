"""Registered queries of the derived operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import counted, decompose, derived, quality
from tessera.plans.adapters import DOCS_OBS, docs_obs, items_mic, items_mic_sql, table
from tessera.plans.catalogue import BY, r6, register, rounded

register(
    "call_list",
    """WITH l AS (SELECT o_orderkey % 500 AS id, CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS feature, CASE WHEN o_orderstatus = 'F' THEN 'R' WHEN o_orderstatus = 'O' THEN 'S' ELSE 'ND' END AS call FROM orders)
    SELECT id, feature, CASE WHEN min(call) = max(call) THEN min(call) END AS call FROM l WHERE call <> 'ND' GROUP BY 1, 2""",
)(
    lambda spark, sf: derived.call_list(
        table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 500).alias("id")).agg(F.concat_ws(" , ", F.collect_list(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "x").when(F.col("o_orderkey") % 3 == 1, "y").otherwise("z"), F.lit("="), F.when(F.col("o_orderstatus") == "F", "r").when(F.col("o_orderstatus") == "O", "S").otherwise("nd")))).alias("l")),
        "id", "l",
    )
)
register("name_parts", "SELECT lower(string_split(p_name, ' ')[-1]) AS tail, count(*) AS n FROM part GROUP BY 1")(
    lambda spark, sf: table(spark, sf, "part").groupBy(derived.after_marker(F.concat_ws(" ser. ", F.lit("Org"), F.element_at(F.split("p_name", " "), -1)), "ser.").alias("tail")).agg(F.count(F.lit(1)).alias("n"))
)
register(
    "periods",
    "SELECT CASE WHEN year(o_orderdate) BETWEEN 1992 AND 1994 THEN '1992-1994' WHEN year(o_orderdate) BETWEEN 1995 AND 1999 THEN '1995-1999' END AS period, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1, 2",
)(lambda spark, sf: table(spark, sf, "orders").select(derived.leading_year(F.col("o_orderdate")).alias("year")).groupBy(derived.period(F.col("year"), [1992, 1995, 2000]).alias("period"), "year").agg(F.count(F.lit(1)).alias("n")))
_RULES = [("brand#1", "one"), ("brand#2", "two"), ("brand#3", "three")]
_CLS = "CASE WHEN contains(lower(p_brand), 'brand#1') THEN 'one' WHEN contains(lower(p_brand), 'brand#2') THEN 'two' WHEN contains(lower(p_brand), 'brand#3') THEN 'three' ELSE 'unclassified' END"
register(
    "rule_audit",
    f"""WITH p AS (SELECT p_brand, p_type, (p_size % 3)::VARCHAR AS size, {_CLS} AS cls FROM part)
    SELECT 'all' AS axis, 'all' AS label, cls, count(DISTINCT p_brand) AS n_values, count(*) AS n FROM p GROUP BY cls UNION ALL SELECT 'p_type', p_type, cls, count(DISTINCT p_brand), count(*) FROM p GROUP BY p_type, cls
    UNION ALL SELECT 'size', size, cls, count(DISTINCT p_brand), count(*) FROM p GROUP BY size, cls""",
)(lambda spark, sf: derived.rule_audit(table(spark, sf, "part").select("p_brand", "p_type", (F.col("p_size") % 3).cast("string").alias("size"), derived.first_rule(F.col("p_brand"), _RULES).alias("cls")), "p_brand", "cls", ["p_type", "size"]))
register("decided_calls", f"WITH {items_mic_sql()} SELECT op, CASE WHEN op IN ('<', '<=') THEN CASE WHEN value <= 20 THEN 0 END WHEN op = '>' THEN CASE WHEN value >= 20 THEN 1 END WHEN op = '>=' THEN CASE WHEN value > 20 THEN 1 END ELSE (value > 20)::INT END AS call, count(*) AS n FROM readings GROUP BY 1, 2")(
    lambda spark, sf: items_mic(spark, sf).groupBy("op", derived.decided_call(F.col("value"), F.col("op"), F.lit(20.0)).alias("call")).agg(F.count(F.lit(1)).alias("n"))
)
_BINS = f"{items_mic_sql(True)}, bins AS (SELECT stratum, log2(value)::BIGINT AS k, count(*) + CASE WHEN log2(value) = 1 THEN 100000 ELSE 0 END AS n FROM readings GROUP BY 1, 2, value)"


def _bins(spark, sf):
    return items_mic(spark, sf, True).groupBy("stratum", F.log2("value").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.col("n") + F.when(F.col("k") == 1, 100000).otherwise(0))


_MODE = "w AS (SELECT *, coalesce(lag(n) OVER o, 0) AS p, coalesce(lead(n) OVER o, 0) AS q, sum(n) OVER (PARTITION BY stratum) AS t FROM bins WINDOW o AS (PARTITION BY stratum ORDER BY k)), mo AS (SELECT stratum, min(k) AS mode FROM w WHERE n > p AND n > q AND n >= 0.05 * t GROUP BY 1)"
register("wild_type_mode", f"WITH {_BINS}, {_MODE} SELECT * FROM mo")(lambda spark, sf: derived.wild_type_mode(_bins(spark, sf), ["stratum"]))
register(
    "fitted_cut",
    f"""WITH {_BINS}, {_MODE}, l AS (SELECT stratum, mode, k, CASE WHEN k = mode THEN n / 2 ELSE n END AS h FROM bins JOIN mo USING (stratum) WHERE k <= mode), s AS (SELECT stratum, mode, sqrt(sum(h * pow(k - mode, 2)) / sum(h) + 1 / 12) AS sd FROM l GROUP BY 1, 2)
    SELECT stratum, mode, {r6('sd', 'sd')}, ceil(mode + 2.3263478740408408 * sd)::BIGINT AS "cut" FROM s""",
)(lambda spark, sf: rounded(derived.log_normal_cut(_bins(spark, sf), ["stratum"])))
register("carried_marks", "SELECT ps.source, max((lang = 'en')::INT) AS english, max((lang IN ('de', 'fr'))::INT) AS other FROM documents ps GROUP BY 1")(
    lambda spark, sf: derived.carried(table(spark, sf, "documents"), "source", {"english": "^en$", "other": "^(de|fr)$"}, "lang")
)
register(
    "concordance",
    f"""WITH v AS (SELECT l_returnflag AS flag, l_quantity::DOUBLE AS x, (l_linenumber)::DOUBLE AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2 AS ry FROM v),
    c AS (SELECT flag, x, y, count(*) AS c FROM v GROUP BY ALL), p AS (SELECT a.flag, sum(CASE WHEN a.y < b.y THEN a.c * b.c ELSE 0 END)::BIGINT AS same, sum(CASE WHEN a.y > b.y THEN a.c * b.c ELSE 0 END)::BIGINT AS opposite FROM c a JOIN c b ON a.flag = b.flag AND a.x < b.x GROUP BY 1)
    SELECT flag, {r6('corr(x, y)', 'pearson')}, {r6('corr(rx, ry)', 'spearman')}, count(*) AS n, any_value(same) AS same, any_value(opposite) AS opposite FROM r JOIN p USING (flag) GROUP BY 1""",
)(lambda spark, sf: rounded(derived.concordance(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y")), ["flag"], "x", "y")))
_LOOKS = "looks AS (SELECT (c_custkey % 40)::INT AS run, (c_custkey // 40 % 8)::INT AS look, c_custkey AS feature, c_custkey % 3 > 0 AS is_null, (c_custkey * 7919) % 23 = 0 AS rejected FROM customer)"
register(
    "repeated_looks",
    f"""WITH {_LOOKS}, p AS (SELECT run, look, max((rejected AND is_null)::INT) AS f, sum((rejected AND NOT is_null)::INT) / nullif(sum((NOT is_null)::INT), 0) AS pw FROM looks GROUP BY 1, 2), r AS (SELECT run, max(f) AS ever, avg(f) AS per, max_by(pw, look) AS pw FROM p GROUP BY 1)
    SELECT {r6('avg(ever)', 'false_ever')}, {r6('avg(per)', 'false_per_look')}, {r6('avg(pw)', 'power')}, count(*) AS runs FROM r""",
)(lambda spark, sf: rounded((lambda k: derived.repeated_looks(table(spark, sf, "customer").select((k % 40).alias("run"), (F.floor(k / 40) % 8).alias("look"), k.alias("feature"), (k % 3 > 0).alias("null"), ((k * 7919) % 23 == 0).alias("rejected"))))(F.col("c_custkey"))))
register("seed_stability", f"SELECT l_returnflag AS flag, {r6('quantile_cont(l_quantity::DOUBLE, 0.5)', 'median')}, min(l_quantity::DOUBLE) AS least, max(l_quantity::DOUBLE) AS most, {r6('stddev_samp(l_quantity::DOUBLE)', 'sd')}, count(*) AS n FROM lineitem GROUP BY 1")(
    lambda spark, sf: rounded(derived.stability(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("v")), ["flag"], "v"))
)
_U = "('0x' || substr(md5({0}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0"
register(
    "made_cohort",
    f"""WITH r AS (SELECT unnest(generate_series(0, 19999)) AS id), y AS (SELECT 'g' || (id % 12)::VARCHAR AS grp, ({_U.format("'cohort|1|' || id::VARCHAR")} < least(1.0, greatest(0.0, 0.3 + 0.2 * (2 * ({_U.format("'cohort-group|0|' || (id % 12)::VARCHAR")}) - 1))))::INT::DOUBLE AS y FROM r)
    SELECT grp, count(*) AS m, sum(y) AS s FROM y GROUP BY 1""",
)(lambda spark, sf: derived.cohort(spark.range(20000), 12, 0.2, 0.3).groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s")))
register(
    "inner_one_to_one",
    "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1, 2",
)(
    lambda spark, sf: table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    .join(table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey")), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))
)


@register("boot_alternatives")
def boot_alternatives(spark, sf):
    o = quality.usable(docs_obs(spark, sf))
    return rounded(decompose.alternatives(counted.bootstrap(o, BY, "en", "rest", 2000), decompose.kitagawa(o, BY, "en", "rest"), BY, "within"))


register(
    "pooled_and_levels",
    f"""WITH {DOCS_OBS}, u AS (SELECT * FROM obs WHERE y IS NOT NULL) SELECT 'all' AS level, feature, count(*) AS n, sum(y) AS positive FROM u GROUP BY 2 UNION ALL SELECT stratum, feature, count(*), sum(y) FROM u GROUP BY 1, 2""",
)(
    lambda spark, sf: quality.usable(docs_obs(spark, sf)).groupingSets([[F.col("feature")], [F.col("feature"), F.col("stratum")]], F.col("feature"), F.col("stratum")).agg(F.coalesce(F.col("stratum"), F.lit("all")).alias("level"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive")).select("level", "feature", "n", "positive")
)

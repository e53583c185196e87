"""Registered queries of the reading operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import readings
from tessera.plans.adapters import items_mic, items_mic_sql
from tessera.plans.catalogue import r6, register, rounded


def _r(doubling: bool):
    return lambda spark, sf: items_mic(spark, sf, doubling)


def _ends(df: DataFrame) -> DataFrame:
    """Open ends as text, so that both engines write them alike."""
    e = lambda c: F.when(F.col(c) == float("-inf"), "below").when(F.col(c) == float("inf"), "above").otherwise(F.round(c, 6).cast("decimal(18,6)").cast("string"))
    return df.withColumns({c: e(c) for c in ("lo", "hi", "clo", "chi") if c in df.columns})


def _end_sql(c: str) -> str:
    return f"CASE WHEN {c} = '-inf'::DOUBLE THEN 'below' WHEN {c} = 'inf'::DOUBLE THEN 'above' ELSE round({c}, 6)::DECIMAL(18, 6)::VARCHAR END AS {c}"


def intervals_sql(doubling: bool, by: str) -> str:
    """Intervals of all readings; by: the columns of a panel."""
    well = f"""lat AS (SELECT {by}, {'rint' if doubling else 'lv'} AS w FROM (SELECT {by}, log2(value) AS lv, round_even(log2(value), 0) AS rint FROM readings))"""
    if doubling:
        wells = f"""span AS (SELECT {by}, min(w) AS a, max(w) AS b FROM lat GROUP BY ALL), wells AS (SELECT {by}, unnest(generate_series(a::BIGINT, b::BIGINT))::DOUBLE AS w FROM span)"""
    else:
        wells = f"""wells AS (SELECT DISTINCT {by}, w FROM lat)"""
    on = " AND ".join(f"r.{c} = x.{c}" for c in by.split(", "))
    value = "round_even(log2(value), 0)" if doubling else "log2(value)"
    return f"""{items_mic_sql(doubling)}, {well}, {wells},
    placed AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS k, lag(w, 1) OVER (PARTITION BY {by} ORDER BY w) AS prev, min(w) OVER (PARTITION BY {by}) AS bottom FROM wells),
    j AS (SELECT r.*, log2(value) AS v, x.w, x.i, x.k, coalesce(x.prev, x.bottom - 1) AS below, x.i = x.k - 1 AS top FROM readings r JOIN placed x ON {on} AND x.w = {value}),
    t AS (SELECT *, max(top AND op IN ('>', '>=')) OVER (PARTITION BY {by}) AS told FROM j),
    iv AS (SELECT id, feature, grp, grp2, panel, stratum, value, op,
        CASE WHEN op = '=' OR (op = '' AND top AND told) OR op = '>=' THEN below WHEN op = '>' THEN v WHEN op IN ('<', '<=') THEN '-inf'::DOUBLE WHEN i = 0 THEN '-inf'::DOUBLE ELSE below END AS lo,
        CASE WHEN op = '=' OR (op = '' AND top AND told) THEN w WHEN op IN ('>', '>=') THEN 'inf'::DOUBLE WHEN op IN ('<', '<=') THEN v WHEN top THEN 'inf'::DOUBLE ELSE w END AS hi FROM t)"""


def plain_sql(doubling: bool) -> str:
    """As intervals_sql within each stratum, without signs: disjoint readings."""
    return intervals_sql(doubling, "feature, stratum").replace("'quantity' AS feature FROM", "'quantity' AS feature FROM").replace(
        "CASE WHEN op = '=' OR (op = '' AND top AND told) OR op = '>=' THEN below WHEN op = '>' THEN v WHEN op IN ('<', '<=') THEN '-inf'::DOUBLE WHEN i = 0", "CASE WHEN i = 0"
    ).replace("CASE WHEN op = '=' OR (op = '' AND top AND told) THEN w WHEN op IN ('>', '>=') THEN 'inf'::DOUBLE WHEN op IN ('<', '<=') THEN v WHEN top THEN", "CASE WHEN top THEN")


def plain(spark: SparkSession, sf: str, doubling: bool) -> DataFrame:
    return readings.intervals(items_mic(spark, sf, doubling), ["feature", "stratum"], signs=False)


CELLS_SQL = """u AS (SELECT stratum, lo, hi, count(*) AS n FROM iv GROUP BY ALL),
    e AS (SELECT DISTINCT stratum, x FROM (SELECT stratum, lo AS x FROM u UNION ALL SELECT stratum, hi FROM u) WHERE isfinite(x)),
    p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS m FROM e), mm AS (SELECT DISTINCT stratum, m FROM p),
    cells AS (SELECT u.stratum, u.lo, u.hi, u.n, (2 * coalesce(a.i, -1) + 2)::INT AS first, (CASE WHEN u.hi = 'inf'::DOUBLE THEN 2 * mm.m ELSE 2 * b.i + 1 END)::INT AS last
        FROM u JOIN mm USING (stratum) LEFT JOIN p a ON a.stratum = u.stratum AND a.x = u.lo LEFT JOIN p b ON b.stratum = u.stratum AND b.x = u.hi),
    chain AS (SELECT *, coalesce((first > max(last) OVER (PARTITION BY stratum ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS fresh FROM cells),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY stratum ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM chain),
    ranges AS (SELECT stratum, run, n, (sum(n) OVER w - n) / sum(n) OVER (PARTITION BY stratum) AS low, sum(n) OVER w / sum(n) OVER (PARTITION BY stratum) AS high
        FROM (SELECT stratum, run, sum(n) AS n FROM runs GROUP BY ALL) WINDOW w AS (PARTITION BY stratum ORDER BY run ROWS UNBOUNDED PRECEDING))"""
S = ["stratum"]

for _d, _tag in ((False, "recorded"), (True, "doubling")):
    register(
        f"panel_geometry_{_tag}",
        f"""WITH {items_mic_sql(_d)}, s AS (SELECT feature, panel, {'round_even(log2(value), 0)' if _d else 'log2(value)'} AS w, value FROM readings), b AS (SELECT feature, panel, min(w) AS a, max(w) AS z, count(DISTINCT w) AS k, count(DISTINCT value) AS nv FROM s GROUP BY ALL),
        q AS (SELECT feature, panel, count(DISTINCT r) AS n_ratios FROM (SELECT feature, panel, round(value / lag(value) OVER (PARTITION BY feature, panel ORDER BY value), 3) AS r FROM (SELECT DISTINCT feature, panel, value FROM s)) GROUP BY ALL)
        SELECT feature, panel, '{_tag}' AS kind, ({'z - a + 1' if _d else 'k'})::INT AS n_wells, {r6('pow(2.0, a)', 'lowest')}, {r6('pow(2.0, z)', 'highest')}, {r6('avg((w = a)::INT)', 'share_on_lowest')}, {r6('avg((w = z)::INT)', 'share_on_highest')},
               any_value(nv)::INT AS n_recorded, any_value(n_ratios)::INT AS n_ratios FROM s JOIN b USING (feature, panel) JOIN q USING (feature, panel) GROUP BY feature, panel, a, z, k""",
    )(lambda spark, sf, d=_d: rounded(readings.geometry(items_mic(spark, sf, d), ["feature", "panel"])))
    register(f"intervals_{_tag}", f"WITH {intervals_sql(_d, 'feature')} SELECT value, op, {_end_sql('lo')}, {_end_sql('hi')}, count(*) AS n FROM iv GROUP BY value, op, iv.lo, iv.hi")(
        lambda spark, sf, d=_d: _ends(readings.intervals(items_mic(spark, sf, d), ["feature"])).groupBy("value", "op", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    )
    register(f"intervals_by_panel_{_tag}", f"WITH {intervals_sql(_d, 'feature, panel')} SELECT panel, value, op, {_end_sql('lo')}, {_end_sql('hi')}, count(*) AS n FROM iv GROUP BY panel, value, op, iv.lo, iv.hi")(
        lambda spark, sf, d=_d: _ends(readings.intervals(items_mic(spark, sf, d), ["feature", "panel"])).groupBy("panel", "value", "op", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    )
    register(
        f"dilution_table_{_tag}",
        f"""WITH {intervals_sql(_d, 'feature')}, n AS (SELECT feature, grp, lo, hi, count(*) AS n FROM iv GROUP BY ALL)
        SELECT feature, grp, {_end_sql('lo')}, {_end_sql('hi')}, n, (dense_rank() OVER (PARTITION BY feature ORDER BY CASE WHEN n.lo = '-inf'::DOUBLE THEN n.hi WHEN n.hi = 'inf'::DOUBLE THEN n.lo + 0.5 ELSE n.hi END, (n.lo <> '-inf'::DOUBLE)::INT, n.lo, n.hi))::INT AS place FROM n""",
    )(lambda spark, sf, d=_d: _ends(readings.dilution_table(readings.intervals(items_mic(spark, sf, d), ["feature"]), ["feature"])))
    register(f"overlap_runs_{_tag}", f"WITH {intervals_sql(_d, 'feature')}, {CELLS_SQL} SELECT stratum, {_end_sql('lo')}, {_end_sql('hi')}, n, first, last, run::BIGINT AS run FROM runs")(
        lambda spark, sf, d=_d: _ends(readings.runs(readings.cells(readings.intervals(items_mic(spark, sf, d), ["feature"]), S), S))
    )
    register(f"pair_below_{_tag}", f"WITH {intervals_sql(_d, 'feature')}, {CELLS_SQL} SELECT a.stratum, count(*) AS reading_pairs, sum(a.n * b.n)::BIGINT AS record_pairs FROM cells a JOIN cells b ON a.stratum = b.stratum AND a.last < b.first GROUP BY 1")(
        lambda spark, sf, d=_d: readings.pairs_below(readings.cells(readings.intervals(items_mic(spark, sf, d), ["feature"]), S), S)
    )
    register(f"mid_scores_{_tag}", f"WITH {plain_sql(_d)}, {CELLS_SQL} SELECT stratum, {_end_sql('lo')}, {_end_sql('hi')}, n, {r6('(sum(n) OVER (PARTITION BY stratum ORDER BY first, last ROWS UNBOUNDED PRECEDING) - n / 2) / sum(n) OVER (PARTITION BY stratum)', 'score')} FROM cells")(
        lambda spark, sf, d=_d: rounded(_ends(readings.mid_scores(readings.cells(plain(spark, sf, d), S), S).select("stratum", "lo", "hi", "n", "score")))
    )
    register(f"cell_ranges_{_tag}", f"WITH {plain_sql(_d)}, {CELLS_SQL} SELECT stratum, run::BIGINT AS run, n::BIGINT AS n, {r6('low', 'low')}, {r6('high', 'high')} FROM ranges")(
        lambda spark, sf, d=_d: rounded(readings.cell_ranges(readings.cells(plain(spark, sf, d), S), S))
    )
    register(
        f"panel_resolution_{_tag}",
        f"""WITH {plain_sql(_d)}, {CELLS_SQL}, k AS (SELECT iv.grp, r.stratum, r.run, count(*) AS n FROM iv JOIN runs r USING (stratum, lo, hi) GROUP BY ALL), z AS (SELECT k.grp, k.n, low, high FROM k JOIN ranges USING (stratum, run)),
        g AS (SELECT grp, sum(n) AS n, sum(n * (low + high) / 2) AS e FROM z GROUP BY 1)
        SELECT 'quantity' AS feature, (SELECT sum(n) FROM g)::BIGINT AS n, {r6('12.0 * ((SELECT sum(e * e / n) FROM g) / (SELECT sum(n) FROM g) - 0.25)', 'midpoint_share')}, {r6('1 - (SELECT sum(n * pow(high - low, 2)) / sum(n) FROM z)', 'resolution')}""",
    )(lambda spark, sf, d=_d: rounded((lambda r: readings.resolution(r.withColumn("stratum", F.col("stratum")), readings.cells(r, ["feature", "stratum"]), ["feature", "stratum"], ["feature"]))(plain(spark, sf, d))))
    register(
        f"sample_rank_share_{_tag}",
        f"""WITH {plain_sql(_d)}, {CELLS_SQL}, s AS (SELECT stratum, lo, hi, (sum(n) OVER (PARTITION BY stratum ORDER BY first, last ROWS UNBOUNDED PRECEDING) - n / 2) / sum(n) OVER (PARTITION BY stratum) AS score FROM cells),
        g AS (SELECT grp, count(*) AS m, avg(score) AS u FROM iv JOIN s USING (stratum, lo, hi) GROUP BY 1) SELECT 'quantity' AS feature, sum(m)::BIGINT AS n, {r6('12.0 * sum(m * pow(u - 0.5, 2)) / sum(m)', 'rank_share')} FROM g""",
    )(lambda spark, sf, d=_d: rounded((lambda r: readings.rank_share(r.join(F.broadcast(readings.mid_scores(readings.cells(r, S), S).select("stratum", "lo", "hi", "score")), ["stratum", "lo", "hi"]), ["feature"]))(plain(spark, sf, d))))

register(
    "coarsen_readings",
    f"""WITH {intervals_sql(True, 'feature')}, c AS (SELECT lo, hi, coalesce(list_max(list_filter([1.0, 3.0, 5.0]::DOUBLE[], lambda x: x <= lo)), '-inf'::DOUBLE) AS clo, coalesce(list_min(list_filter([1.0, 3.0, 5.0]::DOUBLE[], lambda x: x >= hi)), 'inf'::DOUBLE) AS chi FROM iv)
    SELECT {_end_sql('lo')}, {_end_sql('hi')}, {_end_sql('clo')}, {_end_sql('chi')}, count(*) AS n FROM c GROUP BY c.lo, c.hi, c.clo, c.chi""",
)(lambda spark, sf: _ends(readings.coarsen(readings.intervals(items_mic(spark, sf, True), ["feature"]), [1.0, 3.0, 5.0])).groupBy("lo", "hi", "clo", "chi").agg(F.count(F.lit(1)).alias("n")))
register("binary_intervals", f"""SELECT CASE WHEN quality = 0 THEN 'below' WHEN quality = 1 THEN round(0.5, 6)::DECIMAL(18, 6)::VARCHAR END AS lo, CASE WHEN quality = 1 THEN 'above' WHEN quality = 0 THEN round(0.5, 6)::DECIMAL(18, 6)::VARCHAR END AS hi, count(*) AS n FROM labels GROUP BY quality""")(
    lambda spark, sf: _ends(readings.binary_intervals(spark.read.parquet(f"{sf}/labels.parquet").select(F.col("quality").cast("double").alias("y")), 0.5)).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))
)

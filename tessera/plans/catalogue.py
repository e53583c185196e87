"""Queries that the driver runs, by name, and the SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import quality
from tessera.plans.adapters import DOCS_OBS, ORDERS_OBS, docs_obs, orders_obs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BY = ["feature"]


def register(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few digits (and no negative zero), as sums in another order differ in the last bits."""
    r: Callable[[str], Column] = lambda c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)
    return df.select(*[r(c).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


TYPED = "(grp IS NOT NULL AND lower(trim(grp)) NOT IN ('', 'nan', 'na', 'none', '<na>', 'nat', 'null', 'n/a', '__missing__'))"
USABLE = f"usable AS (SELECT * FROM obs WHERE y IS NOT NULL AND {TYPED}), repeated AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, grp) AS m FROM usable) WHERE m >= 2)"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


for _tag, _obs, _sql in (("docs", docs_obs, DOCS_OBS), ("orders", orders_obs, ORDERS_OBS)):

    def _q(f: Callable[..., DataFrame], obs: Callable[[SparkSession, str], DataFrame] = _obs) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf: rounded(f(obs(spark, sf), BY))

    register(
        f"trait_adequacy_{_tag}",
        f"""WITH {_sql}, a AS (SELECT feature, count(*) AS n, count(*) - count(y) AS n_missing, coalesce(sum(y), 0)::BIGINT AS n_positive, count(y) AS seen FROM obs GROUP BY 1)
        SELECT feature, n, n_missing, n_positive, {r6('n_positive / nullif(seen, 0)', 'prevalence')}, least(n_positive, seen - n_positive) AS n_minor,
               CASE WHEN n = n_missing THEN 'empty' WHEN least(n_positive, seen - n_positive) = 0 THEN 'constant' WHEN least(n_positive, seen - n_positive) < 20 THEN 'rare' ELSE 'adequate' END AS state FROM a""",
    )(_q(quality.trait_adequacy))
    register(
        f"group_adequacy_{_tag}",
        f"""WITH {_sql}, s AS (SELECT feature, grp, count(*) AS m, {TYPED} AS t FROM obs GROUP BY 1, 2)
        SELECT feature, sum(m)::BIGINT AS n, coalesce(sum(m) FILTER (WHERE t), 0)::BIGINT AS n_typed, (sum(m) - coalesce(sum(m) FILTER (WHERE t), 0))::BIGINT AS n_untyped, count(*) FILTER (WHERE t) AS n_groups,
               count(*) FILTER (WHERE t AND m = 1) AS n_singletons, count(*) FILTER (WHERE t AND m >= 2) AS n_informative,
               {r6('coalesce(sum(m) FILTER (WHERE t AND m >= 2), 0) / nullif(sum(m) FILTER (WHERE t), 0)', 'support')},
               {r6('CASE WHEN count(*) FILTER (WHERE t) > 1 THEN (sum(m) FILTER (WHERE t) - sum(m * m) FILTER (WHERE t) / sum(m) FILTER (WHERE t)) / (count(*) FILTER (WHERE t) - 1) END', 'n0')} FROM s GROUP BY 1""",
    )(_q(quality.group_adequacy))
    register(
        f"smallest_groups_{_tag}",
        f"""WITH {_sql}, s AS (SELECT feature, grp, count(*) AS m FROM obs WHERE {TYPED} GROUP BY 1, 2)
        SELECT * FROM (SELECT feature, grp, m, row_number() OVER (PARTITION BY feature ORDER BY m, grp)::INT AS place FROM s) WHERE place <= 10""",
    )(_q(quality.smallest_groups))
    register(
        f"feature_feasibility_{_tag}",
        f"""WITH {_sql}, {USABLE}, s AS (SELECT feature, grp, count(*) AS m, sum(y) AS s FROM usable GROUP BY 1, 2),
        a AS (SELECT feature, coalesce(sum(m) FILTER (WHERE m >= 2), 0)::BIGINT AS retained, coalesce(sum(m) FILTER (WHERE m >= 2), 0) / sum(m) AS support, count(*) FILTER (WHERE m >= 2) AS groups_repeated, coalesce(sum(s) FILTER (WHERE m >= 2), 0)::BIGINT AS pos FROM s GROUP BY 1)
        SELECT feature, retained, {r6('support', 'support')}, groups_repeated, least(pos, retained - pos) AS n_minor,
               concat_ws('; ', CASE WHEN retained < 2 THEN 'too few records' END, CASE WHEN groups_repeated < 2 THEN 'fewer than two repeated groups' END, CASE WHEN retained >= 2 AND least(pos, retained - pos) = 0 THEN 'constant outcome' END) AS refused,
               CASE WHEN least(pos, retained - pos) BETWEEN 1 AND 19 THEN 'rare outcome' ELSE '' END AS warned FROM a""",
    )(_q(quality.feasibility))
    register(
        f"anova_component_{_tag}",
        f"""WITH {_sql}, {USABLE}, c AS (SELECT feature, grp, count(*) AS m, sum(y) AS s, sum(y * y) AS q FROM repeated GROUP BY 1, 2),
        a AS (SELECT feature, sum(m)::BIGINT AS n, count(*) AS g, sum(s * s / m) AS raw, sum(s * s / m) - sum(s) * sum(s) / sum(m) AS ssb, sum(q) - sum(s) * sum(s) / sum(m) AS sst, (sum(m) - sum(m * m) / sum(m)) / (count(*) - 1) AS n0 FROM c GROUP BY 1),
        b AS (SELECT *, ssb / nullif(g - 1, 0) AS msb, (sst - ssb) / nullif(n - g, 0) AS msw FROM a), d AS (SELECT *, greatest(0.0, (msb - msw) / n0) AS comp FROM b)
        SELECT feature, n, g AS n_groups, {r6('raw', 'ss_raw')}, {r6('ssb', 'ss_between')}, {r6('sst', 'ss_total')}, {r6('n0', 'n0')}, {r6('msb', 'msb')}, {r6('msw', 'msw')},
               {r6('CASE WHEN sst > 0 THEN ssb / sst END', 'r2')}, {r6('comp', 'component')}, {r6('CASE WHEN comp + msw > 0 THEN comp / (comp + msw) END', 'icc')}, {r6('CASE WHEN msw > 0 THEN msb / msw END', 'f')} FROM d""",
    )(_q(quality.anova))
    register(
        f"group_structure_{_tag}",
        f"""WITH {_sql}, {USABLE}, c AS (SELECT feature, grp, count(*) AS m FROM repeated GROUP BY 1, 2), w AS (SELECT feature, m / sum(m) OVER (PARTITION BY feature) AS w FROM c)
        SELECT feature, count(*) AS n_groups_repeated, {r6('1.0 / sum(w * w)', 'effective_groups')}, {r6('max(w)', 'largest_share')} FROM w GROUP BY 1""",
    )(_q(quality.group_structure))
    register(f"within_variance_{_tag}", f"WITH {_sql}, {USABLE} SELECT feature, grp, count(*) AS m, {r6('coalesce(var_samp(y), 0)', 's2')} FROM usable GROUP BY 1, 2")(_q(quality.within_variance))
    register(
        f"finite_bounds_{_tag}",
        f"""WITH {_sql} SELECT feature, count(*) AS size, count(y) AS n, coalesce(sum(y), 0)::BIGINT AS positive, {r6('coalesce(sum(y), 0) / nullif(count(y), 0)', 'observed')}, {r6('coalesce(sum(y), 0) / count(*)', 'lower')},
        {r6('(coalesce(sum(y), 0) + count(*) - count(y)) / count(*)', 'upper')} FROM obs GROUP BY 1""",
    )(_q(quality.finite_bounds))
    register(f"untyped_share_{_tag}", f"WITH {_sql} SELECT feature, {r6(f'avg((NOT {TYPED})::INT)', 'missing_share')}, count(*) AS n FROM obs GROUP BY 1")(_q(quality.untyped_share))
    register(
        f"effective_dimension_{_tag}",
        f"""WITH {_sql}, f AS (SELECT id, feature, y FROM (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM obs WHERE y IS NOT NULL) WHERE c = (SELECT count(DISTINCT feature) FROM obs)),
        g AS (SELECT * FROM f WHERE feature IN (SELECT feature FROM f GROUP BY 1 HAVING stddev_pop(y) > 0)),
        r AS (SELECT a.feature AS fa, b.feature AS fb, corr(a.y, b.y) AS r FROM g a JOIN g b USING (id) GROUP BY 1, 2)
        SELECT count(DISTINCT fa) AS n_features, {r6('pow(count(DISTINCT fa), 2) / sum(r * r)', 'effective')} FROM r""",
    )(lambda spark, sf, obs=_obs: rounded(quality.effective_dimension(obs(spark, sf))))
    _a, _b = ("en", "rest") if _tag == "docs" else ("early", "late")
    register(
        f"difference_bounds_{_tag}",
        f"""WITH {_sql}, b AS (SELECT feature, side, coalesce(sum(y), 0) / nullif(count(y), 0) AS o, coalesce(sum(y), 0) / count(*) AS l, (coalesce(sum(y), 0) + count(*) - count(y)) / count(*) AS u FROM obs WHERE side IN ('{_a}', '{_b}') GROUP BY 1, 2)
        SELECT a.feature, {r6('a.l - b.u', 'lower')}, {r6('a.u - b.l', 'upper')}, {r6('a.o - b.o', 'observed')} FROM b a JOIN b b ON a.feature = b.feature WHERE a.side = '{_a}' AND b.side = '{_b}'""",
    )(lambda spark, sf, obs=_obs, a=_a, b=_b: rounded(quality.difference_bounds(obs(spark, sf), BY, a, b)))
    register(
        f"centred_ss_{_tag}",
        f"""WITH {_sql}, {USABLE}, c AS (SELECT feature, grp, y - avg(y) OVER (PARTITION BY feature, stratum) AS y FROM repeated), s AS (SELECT feature, grp, sum(y) AS s, count(*) AS m FROM c GROUP BY 1, 2)
        SELECT feature, {r6('sum(s * s / m)', 'ss')} FROM s GROUP BY 1""",
    )(lambda spark, sf, obs=_obs: rounded(quality.group_sums(quality.centred(quality.repeated(obs(spark, sf), BY), BY), BY).groupBy("feature").agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("ss"))))

"""Registered queries of the share, evidence, decomposition and comparison operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import compare, decompose, evidence, quality, share
from tessera.plans.adapters import DOCS_OBS, ORDERS_OBS, TWO_LABELS, docs_obs, orders_obs, table, two_labels
from tessera.plans.catalogue import BY, USABLE, r6, register, rounded
from tessera.plans.ingest_queries import FIXPOINT

U = "('0x' || substr(md5({0}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0"


def reps(n: int) -> str:
    return f"(SELECT unnest(generate_series(1, {n}))::VARCHAR AS rep)"


def folds_sql(src: str, out: str, by: str, k: int, stream: str = "fold") -> str:
    """src (by, rep, id, grp, y) with dealt folds as out."""
    return f"""{out}_h AS (SELECT *, md5('{stream}|' || rep || '|' || id) AS h FROM {src}), {out}_g AS (SELECT *, min(h) OVER (PARTITION BY {by}, rep, grp) AS g FROM {out}_h),
    {out} AS (SELECT *, ((row_number() OVER (PARTITION BY {by}, rep ORDER BY g, grp, h, id) - 1 + floor({U.format(f"'{stream}-start|' || rep || '|0'")} * {k})::BIGINT) % {k})::INT AS fold FROM {out}_g)"""


def perm_sql(src: str, out: str, by: str, stream: str = "perm") -> str:
    """src (by, rep, id, grp, y, ...) with labels shuffled inside (by, rep)."""
    return f"""{out}_a AS (SELECT * EXCLUDE (grp), row_number() OVER (PARTITION BY {by}, rep ORDER BY id) AS k FROM {src}),
    {out}_b AS (SELECT {by}, rep, grp, row_number() OVER (PARTITION BY {by}, rep ORDER BY md5('{stream}|' || rep || '|' || id), id) AS k FROM {src}),
    {out} AS (SELECT a.*, b.grp FROM {out}_a a JOIN {out}_b b ON a.k = b.k AND a.rep = b.rep AND {' AND '.join(f'a.{c} = b.{c}' for c in by.split(', '))})"""


def skill_sql(src: str, out: str, by: str) -> str:
    k = f"{by}, rep"
    return f"""{out}_c AS (SELECT {k}, fold, grp, count(*) AS m, sum(y) AS s, sum(y * y) AS q FROM {src} GROUP BY ALL),
    {out}_w AS (SELECT *, sum(m) OVER g AS gm, sum(s) OVER g AS gs, sum(q) OVER g AS gq, sum(m) OVER f AS fm, sum(s) OVER f AS fs, sum(m) OVER a AS am, sum(s) OVER a AS tot FROM {out}_c WINDOW g AS (PARTITION BY {k}, grp), f AS (PARTITION BY {k}, fold), a AS (PARTITION BY {k})),
    {out}_v AS (SELECT *, CASE WHEN gm > 1 THEN greatest(0.0, gq - gs * gs / gm) / (gm - 1) ELSE 0.0 END AS v FROM {out}_w),
    {out}_x AS (SELECT *, sum(m * v) OVER (PARTITION BY {k}) - sum(m * v) OVER (PARTITION BY {k}, fold) AS rest, (tot - fs) / nullif(am - fm, 0) AS grand, CASE WHEN gm > m THEN (gs - s) / (gm - m) ELSE (tot - fs) / nullif(am - fm, 0) END AS mean FROM {out}_v),
    {out}_f AS (SELECT {k}, fold, sum(q - 2 * mean * s + m * mean * mean) - sum(CASE WHEN gm > m THEN m * v / (gm - m) ELSE 0.0 END) AS num, sum(q - 2 * grand * s + m * grand * grand) - max(fm) * max(rest) / pow(max(am - fm), 2) AS den FROM {out}_x WHERE am > fm GROUP BY ALL),
    {out} AS (SELECT {k}, sum(num) AS numerator, sum(den) AS denominator, CASE WHEN sum(den) > 0 THEN 1 - sum(num) / sum(den) END AS skill FROM {out}_f GROUP BY ALL)"""


def share_sql(obs: str, by: str, k: int, repeats: int, perms: int) -> str:
    """obs (by, id, grp, y) -> table sh with all parts of the share."""
    return f"""r1 AS (SELECT {by}, rep, id, grp, y FROM {obs}, {reps(repeats)}), {folds_sql('r1', 'f1', by, k)}, {skill_sql('f1', 'k1', by)},
    r2 AS (SELECT {by}, rep, id, grp, y FROM {obs}, {reps(perms)}), {perm_sql('r2', 'p2', by)}, {folds_sql('p2', 'f2', by, k, 'permfold')}, {skill_sql('f2', 'k2', by)},
    ka AS (SELECT {by}, avg(skill) AS kappa, stddev_pop(skill) AS cv_sd, avg(denominator) AS denominator FROM k1 GROUP BY ALL), kb AS (SELECT {by}, avg(skill) AS null_mean FROM k2 GROUP BY ALL),
    fg AS (SELECT {by}, grp, count(*) AS m, sum(y) AS s, sum(y * y) AS q FROM {obs} GROUP BY ALL),
    fa AS (SELECT {by}, sum(greatest(0.0, q - s * s / m) * m / greatest(m - 1, 1)) AS within, sum(q) - pow(sum(s), 2) / sum(m) AS total FROM fg GROUP BY ALL),
    sh0 AS (SELECT *, denominator / total AS ratio, CASE WHEN null_mean < 1 THEN (kappa - null_mean) / (1 - null_mean) END AS kappa_adj, 1 - within / (denominator / total * total) AS closed FROM ka JOIN kb USING ({by}) JOIN fa USING ({by})),
    sh AS (SELECT *, CASE WHEN null_mean < 1 THEN (closed - null_mean) / (1 - null_mean) END AS closed_adj FROM sh0)"""


SHARE_COLUMNS = ", ".join(r6(c, n) for c, n in (("kappa", "kappa"), ("cv_sd", "cv_sd"), ("null_mean", "null_mean"), ("kappa_adj", "kappa_adj"), ("ratio", "fold_ratio"), ("closed", "closed"), ("closed_adj", "closed_adj")))

for _tag, _obs, _sql in (("docs", docs_obs, DOCS_OBS), ("orders", orders_obs, ORDERS_OBS)):
    # at default budgets where DuckDB can repeat them row by row; orders in full are in share_counted_orders and result_rows_orders
    _r, _p = (20, 999) if _tag == "docs" else (2, 3)
    _rep = lambda spark, sf, obs=_obs: quality.repeated(obs(spark, sf), BY)
    _rs = f"{_sql}, {USABLE}"
    register(f"cv_skill_{_tag}", f"WITH {_rs}, r1 AS (SELECT feature, rep, id, grp, y FROM repeated, {reps(_r)}), {folds_sql('r1', 'f1', 'feature', 5)}, {skill_sql('f1', 'k1', 'feature')} SELECT feature, {r6('avg(skill)', 'kappa')}, {r6('stddev_pop(skill)', 'cv_sd')}, {r6('avg(denominator)', 'denominator')} FROM k1 GROUP BY 1")(
        lambda spark, sf, f=_rep, r=_r: rounded(share.cv_skill(f(spark, sf), BY, 5, r))
    )
    register(
        f"perm_control_{_tag}",
        f"WITH {_rs}, r2 AS (SELECT feature, rep, id, grp, y FROM repeated, {reps(_p)}), {perm_sql('r2', 'p2', 'feature')}, {folds_sql('p2', 'f2', 'feature', 5, 'permfold')}, {skill_sql('f2', 'k2', 'feature')} SELECT feature, {r6('avg(skill)', 'null_mean')} FROM k2 GROUP BY 1",
    )(lambda spark, sf, f=_rep, p=_p: rounded(share.control(f(spark, sf), BY, 5, p)))
    register(f"share_debiased_{_tag}", f"WITH {_rs}, {share_sql('repeated', 'feature', 5, _r, _p)} SELECT feature, {SHARE_COLUMNS} FROM sh")(lambda spark, sf, f=_rep, r=_r, p=_p: rounded(share.share(f(spark, sf), BY, 5, r, p)))
    for _name, _within in (("perm_test", []), ("perm_test_strata", ["stratum"]), ("perm_test_units", ["stratum", "unit"])):
        _by = ", ".join(["feature", *_within])
        register(
            f"{_name}_{_tag}",
            f"""WITH {_rs}, r2 AS (SELECT feature, stratum, unit, rep, id, grp, y FROM repeated, {reps(_p)}), {perm_sql('r2', 'p2', _by)},
            s AS (SELECT feature, sum(t) AS ss FROM (SELECT feature, grp, pow(sum(y), 2) / count(*) AS t FROM repeated GROUP BY ALL) GROUP BY 1), n AS (SELECT feature, rep, sum(t) AS ss FROM (SELECT feature, rep, grp, pow(sum(y), 2) / count(*) AS t FROM p2 GROUP BY ALL) GROUP BY ALL)
            SELECT s.feature, {r6('s.ss', 'ss')}, count(*) FILTER (WHERE n.ss >= s.ss - 1e-11 * abs(s.ss)) AS exceed, {r6(f'(count(*) FILTER (WHERE n.ss >= s.ss - 1e-11 * abs(s.ss)) + 1) / ({_p} + 1)', 'p')} FROM s JOIN n USING (feature) GROUP BY s.feature, s.ss""",
        )(lambda spark, sf, f=_rep, p=_p, w=_within: rounded(share.permutation_test(f(spark, sf), BY, p, w)))
    register(
        f"smoothed_law_share_{_tag}",
        f"""WITH {_rs}, grid AS (SELECT g.feature, g.grp, c.stratum, c.y, count(*) OVER (PARTITION BY g.feature, g.grp) AS k FROM (SELECT DISTINCT feature, grp, stratum FROM repeated) g JOIN (SELECT DISTINCT feature, stratum, y FROM repeated) c USING (feature, stratum)),
        n AS (SELECT feature, grp, stratum, y, count(*) AS c FROM repeated GROUP BY ALL), sz AS (SELECT feature, grp, count(*) AS m FROM repeated GROUP BY ALL),
        l AS (SELECT grid.feature, grid.grp, grid.y, m, (coalesce(c, 0) + 1.0 / k) / (m + 1) AS p FROM grid LEFT JOIN n USING (feature, grp, stratum, y) JOIN sz ON sz.feature = grid.feature AND sz.grp = grid.grp),
        g AS (SELECT feature, grp, m, sum(p * y) AS mu, sum(p * y * y) AS m2 FROM l GROUP BY ALL), w AS (SELECT *, m / sum(m) OVER (PARTITION BY feature) AS w FROM g),
        a AS (SELECT feature, sum(w * mu * mu) - pow(sum(w * mu), 2) AS b, sum(w * (m2 - mu * mu)) AS i FROM w GROUP BY 1)
        SELECT feature, {r6('b', 'between')}, {r6('i', 'within')}, {r6('b / (b + i)', 'share')} FROM a""".replace("AS between", 'AS "between"'),
    )(lambda spark, sf, f=_rep: rounded(share.smoothed_share(f(spark, sf), BY)))
    register(
        f"share_derivatives_{_tag}",
        f"""WITH {_rs}, g AS (SELECT feature, grp, count(*) AS m, sum(y) AS s, sum(y * y) AS q, sum(y * y) - sum(y) * sum(y) / count(*) AS i FROM repeated GROUP BY ALL),
        a AS (SELECT feature, sum(m / greatest(m - 1, 1) * i) AS num, sum(s) / sum(m) AS ybar, sum(q) - sum(s) * sum(s) / sum(m) AS tot FROM g GROUP BY 1), v AS (SELECT DISTINCT feature, y FROM repeated)
        SELECT g.feature, grp, v.y, {r6('-((-1.0 / pow(greatest(m - 1, 1), 2) * i + m / greatest(m - 1, 1) * pow(v.y - s / m, 2)) * tot - num * pow(v.y - ybar, 2)) / (0.8 * tot * tot) / 0.99', 'derivative')} FROM g JOIN v USING (feature) JOIN a ON a.feature = g.feature""",
    )(lambda spark, sf, f=_rep: rounded(share.derivatives(f(spark, sf), BY, 0.8, 0.01)))

    # evidence
    _cells = lambda spark, sf, obs=_obs: quality.usable(obs(spark, sf)).groupBy("feature", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))

    def shrunk_sql(cells: str, out: str, by: str, n: str, s: str) -> str:
        return f"""{out}_t AS (SELECT *, sum({n}) OVER w AS n_train, count(*) FILTER (WHERE {n} > 0) OVER w AS g_train, sum({s}) OVER w AS ts_, sum({n} * {n}) OVER w AS n2, sum(CASE WHEN {n} > 0 THEN {s} * {s} / {n} END) OVER w AS rr FROM {cells} WINDOW w AS (PARTITION BY {by})),
        {out}_m AS (SELECT *, ts_ / nullif(n_train, 0) AS grand, (ts_ - rr) / nullif(n_train - g_train, 0) AS msw, (rr - ts_ * ts_ / nullif(n_train, 0)) / nullif(g_train - 1, 0) AS msb, (n_train - n2 / nullif(n_train, 0)) / nullif(g_train - 1, 0) AS n0 FROM {out}_t),
        {out}_u AS (SELECT *, greatest(0.0, (msb - msw) / greatest(n0, 1e-12)) AS tau FROM {out}_m),
        {out} AS (SELECT *, least(greatest(CASE WHEN {n} > 0 AND g_train >= 2 AND n_train - g_train >= 1 THEN grand + CASE WHEN tau + msw / greatest({n}, 1) > 0 THEN tau / (tau + msw / greatest({n}, 1)) ELSE 0.0 END * ({s} / nullif({n}, 0) - grand) ELSE grand END, 1e-6), 1 - 1e-6) AS p FROM {out}_u)"""

    _cell_sql = "cells AS (SELECT feature, grp, count(*) AS n, sum(y) AS s FROM usable GROUP BY ALL)"
    register(f"eb_group_rates_{_tag}", f"WITH {_rs}, {_cell_sql}, {shrunk_sql('cells', 'e', 'feature', 'n', 's')} SELECT feature, grp, n, {r6('s', 's')}, n_train::BIGINT AS n_train, g_train, {r6('p', 'p')} FROM e")(
        lambda spark, sf, c=_cells: rounded(evidence.shrunk(c(spark, sf), BY))
    )
    ratio_sql = "sum({s} * ln(p) + ({n} - {s}) * ln(1 - p)) - (CASE WHEN sum({s}) > 0 THEN sum({s}) * ln(sum({s}) / sum({n})) ELSE 0 END + CASE WHEN sum({n}) > sum({s}) THEN (sum({n}) - sum({s})) * ln(1 - sum({s}) / sum({n})) ELSE 0 END)"
    sequential_sql = (
        f"""c0 AS (SELECT feature, batch, grp, count(*) AS n, sum(y) AS s FROM usable GROUP BY ALL), c AS (SELECT b.feature, b.batch, g.grp, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM (SELECT DISTINCT feature, batch FROM c0) b JOIN (SELECT DISTINCT feature, grp FROM c0) g USING (feature) LEFT JOIN c0 ON c0.feature = b.feature AND c0.batch = b.batch AND c0.grp = g.grp),
        t AS (SELECT *, coalesce(sum(n) OVER w, 0) AS tn, coalesce(sum(s) OVER w, 0) AS ts FROM c WINDOW w AS (PARTITION BY feature, grp ORDER BY batch::DOUBLE ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), {shrunk_sql('t', 'e', 'feature, batch', 'tn', 'ts')},
        x AS (SELECT feature, batch, {ratio_sql.format(n='n', s='s')} AS term FROM e WHERE n > 0 AND n_train >= 2 AND g_train >= 2 GROUP BY ALL), z AS (SELECT feature, batch, sum(n)::BIGINT AS n_batch FROM c GROUP BY ALL),
        q AS (SELECT z.feature, z.batch, n_batch, coalesce(term, 0) AS term, sum(coalesce(term, 0)) OVER (PARTITION BY z.feature ORDER BY z.batch::DOUBLE ROWS UNBOUNDED PRECEDING) AS log_e FROM z LEFT JOIN x ON x.feature = z.feature AND x.batch = z.batch)
        {{0}}"""
    )
    SEQUENTIAL_SQL = sequential_sql.format(f"SELECT feature, batch, n_batch, {r6('term', 'term')}, {r6('log_e', 'log_e')}, {r6('max(log_e) OVER (PARTITION BY feature ORDER BY batch::DOUBLE ROWS UNBOUNDED PRECEDING)', 'peak')} FROM q")
    register(f"sequential_e_process_{_tag}", f"WITH {_rs}, {SEQUENTIAL_SQL}")(lambda spark, sf, obs=_obs: rounded(evidence.sequential(quality.usable(obs(spark, sf)), BY)))
    register(
        f"e_bh_by_look_{_tag}",
        f"WITH {_rs}, "
        + sequential_sql.format(
            f"""SELECT feature, batch, {r6('log_e', 'log_e')}, m, top AS n_rejected, k <= top AS rejected, {r6('CASE WHEN top > 0 THEN m / (0.05 * top) END', 'threshold')}
            FROM (SELECT *, coalesce(max(CASE WHEN log_e >= ln(m / (0.05 * k)) THEN k END) OVER (PARTITION BY batch), 0) AS top
                  FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY log_e DESC, feature) AS k, count(*) OVER (PARTITION BY batch) AS m FROM q))"""
        ),
    )(lambda spark, sf, obs=_obs: rounded(evidence.looks(evidence.sequential(quality.usable(obs(spark, sf)), BY), BY)))
    register(
        f"two_cells_{_tag}",
        f"WITH {_rs}, c AS (SELECT feature, grp, count(*) AS m, sum(y) AS s FROM usable GROUP BY ALL) SELECT feature, sum(m)::BIGINT AS n, {r6('3 * (sum(s * s / m) / sum(m) - pow(sum(s) / sum(m), 2))', 'midpoint')}, {r6('3 * sum(s) / sum(m) * (1 - sum(s) / sum(m))', 'resolution')} FROM c GROUP BY 1",
    )(lambda spark, sf, obs=_obs: rounded(quality.two_cells(quality.usable(obs(spark, sf)), BY)))
    register(
        f"split_e_value_{_tag}",
        f"""WITH {_rs}, r AS (SELECT feature, rep, grp, y, floor({U.format("'efold|' || rep || '|' || id")} * 5)::INT AS fold FROM usable, {reps(_r)}), c0 AS (SELECT feature, rep, fold, grp, count(*) AS n, sum(y) AS s FROM r GROUP BY ALL),
        c AS (SELECT b.feature, b.rep, b.fold, g.grp, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM (SELECT DISTINCT feature, rep, fold FROM c0) b JOIN (SELECT DISTINCT feature, rep, grp FROM c0) g USING (feature, rep) LEFT JOIN c0 ON c0.feature = b.feature AND c0.rep = b.rep AND c0.fold = b.fold AND c0.grp = g.grp),
        t AS (SELECT *, sum(n) OVER w - n AS tn, sum(s) OVER w - s AS ts FROM c WINDOW w AS (PARTITION BY feature, rep, grp)), {shrunk_sql('t', 'e', 'feature, rep, fold', 'tn', 'ts')},
        x AS (SELECT feature, rep, fold, {ratio_sql.format(n='n', s='s')} AS term FROM e WHERE n > 0 AND n_train > 0 GROUP BY ALL), m AS (SELECT feature, max(term) AS top FROM x GROUP BY 1)
        SELECT feature, {r6('max(top) + ln(avg(exp(term - top)))', 'log_e')}, count(*) AS n_splits FROM x JOIN m USING (feature) GROUP BY 1""",
    )(lambda spark, sf, obs=_obs, r=_r: rounded(evidence.split_e_values(quality.usable(obs(spark, sf)), BY, 5, r)))

    # decomposition
    _a, _b = ("en", "rest") if _tag == "docs" else ("early", "late")
    _side = f"g AS (SELECT feature, grp, count(*) FILTER (WHERE side = '{_a}')::DOUBLE AS na, count(*) FILTER (WHERE side = '{_b}')::DOUBLE AS nb, coalesce(sum(y) FILTER (WHERE side = '{_a}'), 0) AS sa, coalesce(sum(y) FILTER (WHERE side = '{_b}'), 0) AS sb FROM usable WHERE side IN ('{_a}', '{_b}') GROUP BY ALL)"
    _kit = "k AS (SELECT *, na / sum(na) OVER (PARTITION BY {0}) AS wa, nb / sum(nb) OVER (PARTITION BY {0}) AS wb, coalesce(sa / nullif(na, 0), sb / nullif(nb, 0)) AS pa, coalesce(sb / nullif(nb, 0), sa / nullif(na, 0)) AS pb, na > 0 AND nb > 0 AS shared FROM g)"
    _comp, _with = "(wa - wb) * (pa + pb) / 2", "(wa + wb) / 2 * (pa - pb)"
    register(
        f"kitagawa_{_tag}",
        f"""WITH {_rs}, {_side}, {_kit.format('feature')}, a AS (SELECT feature, sum({_comp}) AS c, sum({_with}) AS w, sum(sa) / sum(na) - sum(sb) / sum(nb) AS d, coalesce(sum(wa) FILTER (WHERE shared), 0) AS ua, coalesce(sum(wb) FILTER (WHERE shared), 0) AS ub,
            coalesce(sum({_comp}) FILTER (WHERE shared), 0) AS cs, count(*) FILTER (WHERE shared) AS n_shared, count(*) FILTER (WHERE nb = 0) AS only_a, count(*) FILTER (WHERE na = 0) AS only_b, sum(na)::BIGINT AS n_a, sum(nb)::BIGINT AS n_b FROM k GROUP BY 1)
        SELECT feature, {r6('c', 'composition')}, {r6('w', 'within')}, {r6('d', 'difference')}, {r6('ua', 'support_a')}, {r6('ub', 'support_b')}, {r6('cs', 'composition_shared')}, n_shared, only_a, only_b, n_a, n_b, {r6('c - cs', 'nonshared')}, {r6('least(ua, ub)', 'shared_support')}, {r6('d - c - w', 'residual')}, least(ua, ub) >= 0.9 AS admitted FROM a""",
    )(lambda spark, sf, obs=_obs, a=_a, b=_b: rounded(decompose.kitagawa(quality.usable(obs(spark, sf)), BY, a, b)))
    register(
        f"label_coverage_{_tag}",
        f"WITH {_sql} SELECT feature, "
        + ", ".join(f"count(*) FILTER (WHERE side = '{s}') AS {n}_labelled, 0::BIGINT AS {n}_unlabelled, count(y) FILTER (WHERE side = '{s}') AS {n}_labelled_known, count(*) FILTER (WHERE side = '{s}' AND y = 1) AS {n}_labelled_positive" for n, s in (("a", _a), ("b", _b)))
        + " FROM obs GROUP BY 1",
    )(lambda spark, sf, obs=_obs, a=_a, b=_b: decompose.label_coverage(obs(spark, sf), BY, a, b))
    for _unit in ("id", "unit"):
        _nb = 999 if _tag == "docs" else 3
        _bsql = f"""{_rs}, o AS (SELECT * FROM usable WHERE side IN ('{_a}', '{_b}')), base AS (SELECT DISTINCT feature, side, {_unit} AS who FROM o),
        rk AS (SELECT *, row_number() OVER (PARTITION BY feature, side ORDER BY who) AS k, count(*) OVER (PARTITION BY feature, side) AS n FROM base),
        dr AS (SELECT feature, side, rep, (floor({U.format("'boot|' || rep || '|' || feature || '|' || side || '|' || k::VARCHAR")} * n) + 1)::BIGINT AS k FROM rk, {reps(_nb)}), tm AS (SELECT feature, side, rep, k, count(*) AS times FROM dr GROUP BY ALL),
        pk AS (SELECT feature, side, rep, times, rk.who FROM tm JOIN rk USING (feature, side, k)), rs AS (SELECT o.feature, o.side, rep, times, grp, y FROM pk JOIN o ON o.feature = pk.feature AND o.side = pk.side AND o.{_unit} = pk.who),
        g AS (SELECT feature, rep, grp, coalesce(sum(times) FILTER (WHERE side = '{_a}'), 0)::DOUBLE AS na, coalesce(sum(times) FILTER (WHERE side = '{_b}'), 0)::DOUBLE AS nb, coalesce(sum(times * y) FILTER (WHERE side = '{_a}'), 0) AS sa, coalesce(sum(times * y) FILTER (WHERE side = '{_b}'), 0) AS sb FROM rs GROUP BY ALL),
        {_kit.format('feature, rep')}, bo AS (SELECT feature, rep::INT AS rep, sum({_comp}) AS composition, sum({_with}) AS "within" FROM k GROUP BY ALL)"""
        _n = {"id": "boot_components", "unit": "boot_cluster"}[_unit]
        register(f"{_n}_{_tag}", f"WITH {_bsql} SELECT feature, rep, {r6('composition', 'composition')}, {r6('\"within\"', '\"within\"')} FROM bo")(
            lambda spark, sf, obs=_obs, a=_a, b=_b, n=_nb, u=_unit: rounded(decompose.bootstrap(quality.usable(obs(spark, sf)), BY, a, b, n, u))
        )
        if _unit == "id":
            register(
                f"boot_interval_{_tag}",
                f"""WITH {_bsql} SELECT feature, {r6('quantile_cont(composition, 0.025)', 'lower')}, {r6('quantile_cont(composition, 0.975)', 'upper')}, {r6('avg(composition)', 'mean')}, {r6('stddev_samp(composition)', 'sd')},
                {r6('least(1.0, 2.0 * (least(count(*) FILTER (WHERE composition <= 0), count(*) FILTER (WHERE composition >= 0)) + 1) / (count(*) + 1))', 'p')} FROM bo GROUP BY 1""",
            )(lambda spark, sf, obs=_obs, a=_a, b=_b, n=_nb: rounded(decompose.interval(decompose.bootstrap(quality.usable(obs(spark, sf)), BY, a, b, n), BY, "composition")))

# multiplicity: tests are one per source of documents, by how its toxicity departs


def tests(spark: SparkSession, sf: str) -> DataFrame:
    """A made p-value and log e-value per source: any numbers serve the step-up rules."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("k"))
    return d.select("source", ((F.col("k") * 7919) % 1009 / F.lit(1009.0) * F.when(F.col("k") % 3 == 0, F.lit(0.01)).otherwise(1.0)).alias("p"), (((F.col("k") * 104729) % 997) / F.lit(100.0)).alias("log_e"), (F.col("k") % 2).cast("string").alias("family"))


TESTS = """d AS (SELECT source, sum(doc_id) AS k FROM documents GROUP BY 1),
    t AS (SELECT source, ((k * 7919) % 1009) / 1009.0::DOUBLE * CASE WHEN k % 3 = 0 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS p, ((k * 104729) % 997) / 100.0::DOUBLE AS log_e, (k % 2)::VARCHAR AS family FROM d)"""
for _arb, _name in ((False, "bh_adjust"), (True, "by_adjust")):
    _scale = "(SELECT sum(1.0 / i) FROM (SELECT unnest(generate_series(1, m)) AS i))" if _arb else "1.0"
    register(
        _name,
        f"""WITH {TESTS}, h AS (SELECT family, m, sum(1.0 / i) AS hm FROM (SELECT family, count(*) AS m FROM t GROUP BY 1), LATERAL (SELECT unnest(generate_series(1, m)) AS i) GROUP BY ALL),
        r AS (SELECT t.*, row_number() OVER (PARTITION BY t.family ORDER BY p, source, log_e) AS k, h.m, {'h.hm' if _arb else '1.0'} AS c FROM t JOIN h USING (family)),
        a AS (SELECT *, least(1.0, min(p * c * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)
        SELECT source, family, {r6('p', 'p')}, {r6('log_e', 'log_e')}, {r6('adj', 'adjusted')}, adj <= 0.05 AS rejected FROM a""",
    )(lambda spark, sf, arb=_arb: rounded(stats.step_up(tests(spark, sf), "p", ["family"], arb)))
register(
    "e_bh",
    f"""WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY log_e DESC, source, p, log_e) AS k, count(*) OVER (PARTITION BY family) AS m FROM t),
    x AS (SELECT *, coalesce(max(CASE WHEN log_e >= ln(m / (0.05 * k)) THEN k END) OVER (PARTITION BY family), 0) AS top FROM r)
    SELECT source, family, {r6('p', 'p')}, {r6('log_e', 'log_e')}, m, top AS n_rejected, k <= top AS rejected, {r6('CASE WHEN top > 0 THEN m / (0.05 * top) END', 'threshold')} FROM x""",
)(lambda spark, sf: rounded(stats.e_bh(tests(spark, sf), "log_e", ["family"])))
register(
    "anytime_bonferroni",
    f"""WITH {TESTS}, x0 AS (SELECT family, source, max(log_e) AS peak FROM t GROUP BY ALL), x AS (SELECT *, count(*) OVER (PARTITION BY family) AS m FROM x0) SELECT family, source, {r6('peak', 'peak_log_e')}, m, peak >= ln(m / 0.05) AS rejected FROM x""",
)(lambda spark, sf: rounded(evidence.anytime(tests(spark, sf), ["source"], ["family"])))
register("combine_evalues", f"""WITH {TESTS}, e AS (SELECT family, exp(log_e / 10) AS e FROM t) SELECT family, {r6('exp(sum(ln(e)))', 'product')}, {r6('avg(e)', 'mean')}, count(*) AS n FROM e GROUP BY 1""")(
    lambda spark, sf: rounded(evidence.combined(tests(spark, sf).select("family", F.exp(F.col("log_e") / 10).alias("e")), ["family"]))
)
register(
    "lond",
    f"""WITH {TESTS}, s AS (SELECT family, list(p ORDER BY source) AS ps FROM t GROUP BY 1),
    f AS (SELECT family, list_reduce([{{'d': 0, 'j': 0, 'p': 0.0::DOUBLE, 'o': ''}}] || list_transform(ps, lambda x: {{'d': 0, 'j': 0, 'p': x, 'o': ''}}),
        lambda a, b: {{'d': a.d + (b.p <= 6.0 * 0.05 / 9.869604401089358 / ((a.j + 1) * (a.j + 1)) * (a.d + 1))::INT, 'j': a.j + 1, 'p': b.p, 'o': a.o || (CASE WHEN b.p <= 6.0 * 0.05 / 9.869604401089358 / ((a.j + 1) * (a.j + 1)) * (a.d + 1) THEN '1' ELSE '0' END)}}).o AS rejected FROM s) SELECT * FROM f""",
)(lambda spark, sf: tests(spark, sf).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("source", "p"))).alias("t")).select("family", F.array_join(F.transform(stats.lond(F.transform("t", lambda x: x["p"])), lambda b: b.cast("int").cast("string")), "").alias("rejected")))
register("permutation_budget", "SELECT m::BIGINT AS m, (ceil(m * (SELECT sum(1.0 / i) FROM (SELECT unnest(generate_series(1, m)) AS i)) / 0.05 - 1e-9) - 1)::BIGINT AS least FROM (SELECT unnest(generate_series(1, 25)) AS m)")(
    lambda spark, sf: spark.range(1, 26).select(F.col("id").alias("m"), stats.budget(F.col("id"), 0.05).alias("least"))
)
register("wilson_interval", f"SELECT source, {r6('(k / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)', 'lower')}, {r6('(k / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)', 'upper')} FROM (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE lang = 'en')::DOUBLE AS k FROM documents GROUP BY 1)")(
    lambda spark, sf: rounded((lambda d: d.select("source", stats.wilson(F.col("k"), F.col("n"))[0].alias("lower"), stats.wilson(F.col("k"), F.col("n"))[1].alias("upper")))(table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("lang") == "en").cast("double").alias("k"))))
)
register(
    "kruskal_wallis",
    f"""WITH v AS (SELECT l_returnflag AS grp, l_linestatus AS feature, l_quantity::DOUBLE AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS mid, count(*) OVER (PARTITION BY feature, y) AS t FROM v),
    w AS (SELECT feature, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY 1), p AS (SELECT feature, sum(q) AS p, count(*) AS g FROM (SELECT feature, grp, pow(sum(mid), 2) / count(*) AS q FROM r GROUP BY ALL) GROUP BY 1)
    SELECT feature, n, g AS n_groups, {r6('(12.0 / (n * (n + 1.0)) * p - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n))', 'h')} FROM w JOIN p USING (feature)""",
)(lambda spark, sf: rounded(quality.kruskal(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("feature"), F.col("l_quantity").cast("double").alias("y")), BY)))

# two labelings
_ARMS = f"""{TWO_LABELS}, {FIXPOINT}, arms AS (SELECT unnest(list_filter(['available_a', 'common_a', 'scorable_a', 'scorable_b', 'common_b', 'available_b'], lambda a: CASE WHEN a = 'available_a' THEN two.label_a IS NOT NULL WHEN a = 'available_b' THEN two.label_b IS NOT NULL
    WHEN starts_with(a, 'common') THEN two.label_a IS NOT NULL AND two.label_b IS NOT NULL ELSE s8.id IS NOT NULL END)) AS arm, two.id, two.y, two.label_a, two.label_b FROM two LEFT JOIN s8 USING (id)),
    arm0 AS (SELECT arm, id, y, CASE WHEN ends_with(arm, '_a') THEN label_a ELSE label_b END AS grp FROM arms), scored AS (SELECT arm, id, y, grp FROM (SELECT *, count(*) OVER (PARTITION BY arm, grp) AS m FROM arm0) WHERE m >= 2)"""
register("arm_digest", f"WITH {_ARMS} SELECT arm, count(*) AS n, sum(('0x' || substr(md5(id), 1, 12))::UBIGINT::HUGEINT)::VARCHAR AS digest FROM arm0 GROUP BY 1")(lambda spark, sf: compare.digests(compare.arms(two_labels(spark, sf))))
register(
    "arm_truth",
    f"""WITH {_ARMS}, q AS (SELECT id, (sum(y) OVER c + 0.5) / (count(*) OVER c + 1) AS q FROM two WINDOW c AS (PARTITION BY coalesce(label_a, ''), coalesce(label_b, ''))),
    g AS (SELECT arm, grp, count(*) AS m, avg(q) AS mu FROM scored JOIN q USING (id) GROUP BY ALL), w AS (SELECT *, m / sum(m) OVER (PARTITION BY arm) AS w FROM g), a AS (SELECT arm, sum(w * mu * (1 - mu)) AS i, sum(w * mu * mu) - pow(sum(w * mu), 2) AS b FROM w GROUP BY 1)
    SELECT arm, {r6('b / (b + i)', 'truth')} FROM a""",
)(lambda spark, sf: rounded(compare.arm_truth(two_labels(spark, sf))))
_CMP = f"{_ARMS}, {share_sql('scored', 'arm', 5, 2, 3)}"
register("compare_arms", f"WITH {_CMP} SELECT arm, {SHARE_COLUMNS} FROM sh")(lambda spark, sf: rounded(compare.arm_shares(two_labels(spark, sf), 5, 2, 3)))
_AT = {a: f"max(CASE WHEN arm = '{a}' THEN kappa_adj END)" for a in compare.ARMS}
register(
    "compare_terms",
    f"WITH {_CMP} SELECT " + ", ".join(r6(f"{_AT[y]} - {_AT[x]}", t) for t, x, y in zip(compare.TERMS, compare.ARMS, compare.ARMS[1:])) + f", {r6(_AT['common_b'] + ' - ' + _AT['common_a'], 'change_on_common')}, {r6(_AT['available_b'] + ' - ' + _AT['available_a'], 'total')}, 0.0::DOUBLE AS residual FROM sh",
)(lambda spark, sf: rounded(compare.terms(compare.arm_shares(two_labels(spark, sf), 5, 2, 3))))

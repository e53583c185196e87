"""Registered queries of the ingest operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ingest
from tessera.plans.adapters import ORDERS_OBS, TWO_LABELS, orders_obs, table, two_labels
from tessera.plans.catalogue import r6, register, rounded

WORDS = {"clinical_sir": ("R", "i", " Susceptible", "ND", "?"), "undeclared": ("Resistant", "intermediate", "susceptible", "n/a", "x1"), "wt_nwt": ("NWT", "wild type", "WT", "-", "maybe"), "binary": ("1", "0.0", "0", "", "2")}


def item_calls(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Return flags of line items in the words of a vocabulary, with some missing and some unreadable."""
    r, a, n, missing, odd = (F.lit(w) for w in WORDS[kind])
    flag = F.col("l_returnflag")
    call = F.when(F.col("l_orderkey") % 17 == 0, missing).when(F.col("l_orderkey") % 23 == 0, odd).when(flag == "R", r).when(flag == "A", a).otherwise(n)
    li = table(spark, sf, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("feature"), call.alias("call"))


def calls_sql(kind: str) -> str:
    r, a, n, missing, odd = WORDS[kind]
    return f"""calls AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, 'm' || (l_suppkey % 5)::VARCHAR AS feature,
        CASE WHEN l_orderkey % 17 = 0 THEN '{missing}' WHEN l_orderkey % 23 = 0 THEN '{odd}' WHEN l_returnflag = 'R' THEN '{r}' WHEN l_returnflag = 'A' THEN '{a}' ELSE '{n}' END AS call FROM lineitem)"""


def recoded_sql(kind: str, middle: str) -> str:
    r, a, n, missing, odd = (w.strip().lower() for w in WORDS[kind])
    names = {"clinical_sir": ("r", "i", "s"), "undeclared": ("r", "i", "s"), "wt_nwt": ("1", "0", "0"), "binary": ("1", "0", "0")}[kind]
    return f"""{calls_sql(kind)}, tok AS (SELECT *, lower(trim(call)) AS t FROM calls),
        rec AS (SELECT id, feature, call, t, CASE t WHEN '{r}' THEN 1.0 WHEN '{a}' THEN {middle} WHEN '{n}' THEN 0.0 END AS y,
               CASE t WHEN '{missing}' THEN 'missing' WHEN '{r}' THEN '{names[0]}' WHEN '{a}' THEN '{names[1]}' WHEN '{n}' THEN '{names[2]}' ELSE 'unknown:' || t END AS meaning FROM tok)"""


MIDDLE = {"clinical_sir": "0.0", "undeclared": "1.0", "wt_nwt": "0.0", "binary": "0.0"}
for _kind in WORDS:
    register(f"call_recode_{_kind}", f"WITH {recoded_sql(_kind, MIDDLE[_kind])} SELECT feature, meaning, y::DOUBLE AS y, count(*) AS n FROM rec GROUP BY 1, 2, 3")(
        lambda spark, sf, k=_kind: ingest.recode(item_calls(spark, sf, k), k).groupBy("feature", "meaning", "y").agg(F.count(F.lit(1)).alias("n"))
    )
    register(
        f"call_registry_{_kind}",
        f"""WITH {recoded_sql(_kind, MIDDLE[_kind])} SELECT feature, count(*) AS rows_read, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE meaning = 'missing') AS n_missing,
        count(*) FILTER (WHERE meaning LIKE 'unknown:%') AS n_unreadable, 0::BIGINT AS n_dropped, count(DISTINCT CASE WHEN y IS NOT NULL THEN id END) AS n_readable FROM rec GROUP BY 1""",
    )(lambda spark, sf, k=_kind: ingest.call_registry(item_calls(spark, sf, k), k))
for _policy, _value in (("drop", "NULL::DOUBLE"), ("non_susceptible", "1.0"), ("susceptible", "0.0")):
    register(f"call_intermediate_{_policy}", f"WITH {recoded_sql('clinical_sir', _value)} SELECT feature, count(y) AS n, coalesce(sum(y), 0)::DOUBLE AS positive FROM rec GROUP BY 1")(
        lambda spark, sf, p=_policy: ingest.recode(item_calls(spark, sf, "clinical_sir"), "clinical_sir", p).groupBy("feature").agg(F.count("y").alias("n"), F.sum("y").alias("positive"))
    )
register("unreadable_calls", f"WITH {recoded_sql('clinical_sir', '0.0')} SELECT t AS token, count(*) AS n FROM rec WHERE meaning LIKE 'unknown:%' GROUP BY 1")(lambda spark, sf: ingest.unreadable(item_calls(spark, sf, "clinical_sir"), "clinical_sir"))

_DUP = f"""WITH {recoded_sql('clinical_sir', '0.0')}, per AS (SELECT id, meaning, count(*) AS n, max(y) AS y FROM (SELECT id, 'calls' AS feature, meaning, y FROM rec) GROUP BY 1, 2),
    keys AS (SELECT id, sum(n) AS n, count(*) AS v, max(y) AS y FROM per GROUP BY 1)"""


def _one_feature(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.recode(item_calls(spark, sf, "clinical_sir"), "clinical_sir").withColumn("feature", F.lit("calls")).select("id", "feature", "meaning", "y")


register(
    "dup_report",
    f"{_DUP} SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicate_rows, coalesce(sum(n - v), 0)::BIGINT AS n_identical_collapsed, count(*) FILTER (WHERE v > 1) AS n_conflicting_keys, coalesce(sum(n) FILTER (WHERE v > 1), 0)::BIGINT AS n_conflicting_rows FROM keys",
)(lambda spark, sf: ingest.duplicate_report(_one_feature(spark, sf), ["id", "feature"], ["meaning"]))
register("dup_drop_conflicts", f"{_DUP} SELECT k.id, p.meaning, p.y::DOUBLE AS y FROM keys k JOIN per p USING (id) WHERE v = 1")(
    lambda spark, sf: ingest.resolve_duplicates(_one_feature(spark, sf), ["id", "feature"], ["meaning"], "drop_conflicts").select("id", "meaning", "y")
)
register("dup_positive_wins", f"{_DUP} SELECT id, y::DOUBLE AS y FROM keys")(lambda spark, sf: ingest.resolve_duplicates(_one_feature(spark, sf), ["id", "feature"], ["meaning"], "positive_wins", positive="y").select("id", "y"))


# reshaping and joins


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") == "F").cast("double").alias("finished"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_totalprice") > 150000).cast("double")).alias("large"))


_WIDE = "w AS (SELECT o_orderkey::VARCHAR AS id, (o_orderstatus = 'F')::INT::DOUBLE AS finished, CASE WHEN o_orderkey % 5 > 0 THEN (o_totalprice > 150000)::INT::DOUBLE END AS large FROM orders)"
register("melt_wide", f"WITH {_WIDE} SELECT id, 'finished' AS feature, finished AS value FROM w UNION ALL SELECT id, 'large', large FROM w")(lambda spark, sf: ingest.melt(_wide(spark, sf), ["id"]))
register("pivot_panel", f"WITH {_WIDE}, u AS (SELECT id FROM w UNION SELECT 'x' || c_custkey::VARCHAR FROM customer) SELECT u.id, finished, large FROM u LEFT JOIN w USING (id)")(
    lambda spark, sf: ingest.panel(
        ingest.melt(_wide(spark, sf), ["id"], value="y"), _wide(spark, sf).select("id").union(table(spark, sf, "customer").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")))).distinct(), ["finished", "large"]
    )
)


def _two_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Order customers, and customers under ids that are sometimes padded with zeros or in another case."""
    a = table(spark, sf, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("id"))
    k = F.col("c_custkey")
    b = table(spark, sf, "customer").select(F.when(k % 7 == 0, F.concat(F.lit("c"), k.cast("string"))).when(k % 11 == 0, F.concat(F.lit("0C"), k.cast("string"))).otherwise(F.concat(F.lit("C"), k.cast("string"))).alias("id"))
    return a, b


_SIDES = """a AS (SELECT 'C' || o_custkey::VARCHAR AS id FROM orders),
    b AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'c' || c_custkey::VARCHAR WHEN c_custkey % 11 = 0 THEN '0C' || c_custkey::VARCHAR ELSE 'C' || c_custkey::VARCHAR END AS id FROM customer)"""
register("universe_union", f"WITH {_SIDES} SELECT id FROM a UNION SELECT id FROM b")(lambda spark, sf: (lambda s: s[0].union(s[1]).distinct())(_two_sides(spark, sf)))
register("ids_only_left", f"WITH {_SIDES} SELECT id FROM a EXCEPT SELECT id FROM b")(lambda spark, sf: (lambda s: s[0].subtract(s[1]))(_two_sides(spark, sf)))
register("ids_joined", f"WITH {_SIDES} SELECT id FROM a INTERSECT SELECT id FROM b")(lambda spark, sf: (lambda s: s[0].intersect(s[1]))(_two_sides(spark, sf)))
register("ids_semi", f"WITH {_SIDES} SELECT id, count(*) AS n FROM a WHERE id IN (SELECT id FROM b) GROUP BY 1")(lambda spark, sf: (lambda s: s[0].join(s[1], "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")))(_two_sides(spark, sf)))
register("near_match", f"WITH {_SIDES}, x AS (SELECT id FROM a EXCEPT SELECT id FROM b), y AS (SELECT id FROM b EXCEPT SELECT id FROM a) SELECT x.id AS left_id, y.id AS right_id FROM x JOIN y ON ltrim(lower(trim(x.id)), '0') = ltrim(lower(trim(y.id)), '0')")(
    lambda spark, sf: (lambda s: ingest.near_matches(*s))(_two_sides(spark, sf))
)
register(
    "join_report",
    f"""WITH {_SIDES}, x AS (SELECT DISTINCT id FROM a), y AS (SELECT DISTINCT id FROM b), j AS (SELECT x.id AS a, y.id AS b FROM x FULL JOIN y USING (id))
    SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right, {r6('count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(a)', 'rate')} FROM j""",
)(lambda spark, sf: (lambda s: rounded(ingest.join_report(*s)))(_two_sides(spark, sf)))
register(
    "contains_join_longest",
    """WITH idents AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS ident FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] FROM part),
    j AS (SELECT DISTINCT p_name AS name, ident FROM part JOIN idents ON contains(p_name, ident))
    SELECT name, ident FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(ident) DESC, ident) AS k FROM j) WHERE k = 1""",
)(
    lambda spark, sf: (
        lambda p: ingest.longest_contained(
            p.select(F.col("p_name").alias("name")), p.select(F.explode(F.split("p_name", " ")).alias("ident")).union(p.select(F.concat_ws(" ", F.get(F.split("p_name", " "), 0), F.get(F.split("p_name", " "), 1)))), "name", "ident"
        )
    )(table(spark, sf, "part"))
)
_STEP = "SELECT id, y, label_a, label_b FROM (SELECT *, count(*) OVER (PARTITION BY label_a) AS ca, count(*) OVER (PARTITION BY label_b) AS cb FROM {0}) WHERE ca >= 2 AND cb >= 2"
FIXPOINT = "s0 AS (SELECT * FROM two WHERE label_a IS NOT NULL AND label_b IS NOT NULL), " + ", ".join(f"s{i} AS ({_STEP.format(f's{i - 1}')})" for i in range(1, 9))
register("fixpoint_both_labelings", f"WITH {TWO_LABELS}, {FIXPOINT} SELECT id, label_a, label_b FROM s8")(lambda spark, sf: ingest.scorable(two_labels(spark, sf), "label_a", "label_b").select("id", "label_a", "label_b"))
register("labels_common", f"WITH {TWO_LABELS} SELECT (label_a IS NOT NULL) AS under_a, (label_b IS NOT NULL) AS under_b, count(*) AS n FROM two GROUP BY 1, 2")(
    lambda spark, sf: two_labels(spark, sf).groupBy((~text.untyped(F.col("label_a"))).alias("under_a"), (~text.untyped(F.col("label_b"))).alias("under_b")).agg(F.count(F.lit(1)).alias("n"))
)

# cells of dilution tables, made of line items

CELL = """CASE l_linenumber % 6 WHEN 0 THEN '<=' || l_quantity::INT::VARCHAR WHEN 1 THEN '≥ ' || l_quantity::INT::VARCHAR WHEN 2 THEN l_quantity::INT::VARCHAR || ',5' WHEN 3 THEN l_quantity::INT::VARCHAR || '/9.5' WHEN 4 THEN '>' || l_quantity::INT::VARCHAR ELSE 'nd' END"""
UNIT = """CASE l_linenumber % 4 WHEN 0 THEN 'mg / L' WHEN 1 THEN 'ug/mL' WHEN 2 THEN 'mm' ELSE '' END"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 6
    value = F.when(k == 0, F.concat(F.lit("<="), q)).when(k == 1, F.concat(F.lit("≥ "), q)).when(k == 2, F.concat(q, F.lit(",5"))).when(k == 3, F.concat(q, F.lit("/9.5"))).when(k == 4, F.concat(F.lit(">"), q)).otherwise("nd")
    u = F.col("l_linenumber") % 4
    unit = F.when(u == 0, "mg / L").when(u == 1, "ug/mL").when(u == 2, "mm").otherwise("")
    op = F.when(F.col("l_linenumber") % 6 == 2, ">").otherwise("")
    raw = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("feature"), value.alias("value"), unit.alias("unit"), op.alias("op"))
    return ingest.parse_cells(ingest.split_units(raw))


CELLS = f"""raw AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, 'm' || (l_suppkey % 5)::VARCHAR AS feature, {CELL} AS value, {UNIT} AS unit, CASE WHEN l_linenumber % 6 = 2 THEN '>' ELSE '' END AS op FROM lineitem),
    plain AS (SELECT *, replace(replace(value, '≤', '<='), '≥', '>=') AS v FROM raw),
    cells AS (SELECT id, feature, value, CASE WHEN unit = 'mm' THEN 'mm' WHEN unit = '' THEN '' ELSE 'mg/L' END AS unit_read, unit = 'mm' AS other_unit,
        CASE WHEN op <> '' THEN op ELSE regexp_extract(v, '^(<=|>=|<|>)', 1) END AS sign,
        try_cast(regexp_replace(regexp_replace(trim(regexp_replace(v, '^(<=|>=|<|>)', '')), '^([0-9]+),([0-9]+)$', '\\1.\\2'), '^([0-9.]+)/[0-9.]+$', '\\1') AS DOUBLE) AS number FROM plain)"""
register("cells_parsed", f"WITH {CELLS} SELECT feature, unit_read, other_unit, sign, number, count(*) AS n FROM cells GROUP BY ALL")(lambda spark, sf: cells(spark, sf).groupBy("feature", "unit_read", "other_unit", "sign", "number").agg(F.count(F.lit(1)).alias("n")))
register(
    "reading_registry",
    f"""WITH {CELLS} SELECT feature, count(*) AS rows_read, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE value = 'nd') AS n_missing, 0::BIGINT AS n_unparseable, count(*) FILTER (WHERE other_unit) AS n_other_unit,
    count(DISTINCT number) AS n_wells, count(DISTINCT CASE WHEN number IS NOT NULL THEN id END) AS n_readable FROM cells GROUP BY 1""",
)(lambda spark, sf: ingest.reading_registry(cells(spark, sf)).withColumn("n_wells", F.size(F.split("wells", " ")).cast("long")).drop("wells"))
register("off_panel", f"WITH {CELLS} SELECT id, number FROM cells WHERE number > 0 AND list_min(list_transform([1, 2, 4, 8, 16, 32], lambda w: abs(log2(number) - log2(w)))) > 0.25")(
    lambda spark, sf: ingest.off_panel(cells(spark, sf).filter("number > 0"), [1, 2, 4, 8, 16, 32]).select("id", "number")
)
register("unit_filter", f"WITH {CELLS} SELECT other_unit, count(*) AS n, count(number) AS with_number FROM cells GROUP BY 1")(lambda spark, sf: cells(spark, sf).groupBy("other_unit").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("with_number")))
_DATES = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN (day(o_orderdate))::VARCHAR || '-' || ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(o_orderdate)] ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'mar/' || day(o_orderdate)::VARCHAR ELSE 'x' END AS b FROM orders"


def _dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    months = F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")])
    a = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("-", F.dayofmonth("o_orderdate").cast("string"), F.element_at(months, F.month("o_orderdate")))).otherwise(F.col("o_orderstatus"))
    b = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("mar/"), F.dayofmonth("o_orderdate").cast("string"))).otherwise("x")
    return o.select(a.alias("a"), b.alias("b"))


register("date_coerced", f"""WITH d AS ({_DATES}), l AS (SELECT 'a' AS "column", a AS value FROM d UNION ALL SELECT 'b', b FROM d) SELECT "column", value, count(*) AS n FROM l WHERE value LIKE '%-%' OR value LIKE 'mar/%' GROUP BY 1, 2""")(
    lambda spark, sf: ingest.date_coerced(_dates(spark, sf), ["a", "b"])
)
register("batch_order", f"WITH {ORDERS_OBS} SELECT batch, row_number() OVER (ORDER BY batch::DOUBLE)::INT AS place FROM (SELECT DISTINCT batch FROM obs)")(lambda spark, sf: ingest.batch_order(orders_obs(spark, sf)))
register("unit_or_self", "SELECT CASE WHEN o_custkey % 3 = 0 THEN '__record__' || o_orderkey::VARCHAR ELSE o_custkey::VARCHAR END AS unit, count(*) AS n FROM orders GROUP BY 1")(
    lambda spark, sf: ingest.unit_or_self(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_custkey") % 3 == 0, F.lit(" NA ")).otherwise(F.col("o_custkey").cast("string")).alias("unit"))).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
)
register("crossed_strata", "SELECT l_linestatus || ' / ' || l_returnflag || ' / ' || l_linenumber::VARCHAR AS stratum, count(*) AS n FROM lineitem GROUP BY 1")(lambda spark, sf: table(spark, sf, "lineitem").groupBy(ingest.crossed(["l_linestatus", "l_returnflag", "l_linenumber"]).alias("stratum")).agg(F.count(F.lit(1)).alias("n")))
register("names_unified", "SELECT CASE n_nationkey % 4 WHEN 0 THEN 'ampicillin' WHEN 1 THEN 'gentamicin' WHEN 2 THEN 'trimethoprim-sulfamethoxazole' ELSE 'Other Thing' END AS name, count(*) AS n FROM nation GROUP BY 1")(
    lambda spark, sf: table(spark, sf, "nation").groupBy(text.unified_name(F.when(F.col("n_nationkey") % 4 == 0, " AMP (MIC)").when(F.col("n_nationkey") % 4 == 1, "gen").when(F.col("n_nationkey") % 4 == 2, "SXT [disk]").otherwise(" Other Thing ")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
)
register("formula_guard", """SELECT CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name WHEN c_custkey % 3 = 1 THEN '-' || c_custkey::VARCHAR ELSE c_name END AS cell FROM customer""")(
    lambda spark, sf: table(spark, sf, "customer").select(text.formula_safe(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("="), F.col("c_name"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("-"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))).alias("cell"))
)

"""Registered queries of the kernels, the stream and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config, from_dict
from tessera.operators import compare, counted, decompose, evidence, kernels, quality, readings
from tessera.operators.staging import settled, shared_folder
from tessera.plans import run
from tessera.plans.adapters import DOCS_OBS, docs_obs, items_mic, orders_obs, table, two_labels
from tessera.plans.catalogue import BY, register, rounded
from tessera.plans.share_queries import SEQUENTIAL_SQL
from tessera.streaming import sequential as stream


def configured(name: str, levels: tuple[str, str]) -> Config:
    """Default budgets: 20 repeats, 999 draws, 999 permutations."""
    return from_dict(
        {
            "dataset": {"name": name, "metadata": "-", "group_column": "grp", "calls": "-", "batch_column": "batch", "contrast_column": "side", "contrast_levels": list(levels)},
        }
    )


@register("result_rows")
def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(run.results(docs_obs(spark, sf).withColumn("level", F.lit("all")), configured("docs", ("en", "rest"))))


@register("result_rows_orders")
def result_rows_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(run.results(orders_obs(spark, sf).withColumn("level", F.lit("all")), configured("orders", ("early", "late"))))


@register("result_rows_by_level")
def result_rows_by_level(spark: SparkSession, sf: str) -> DataFrame:
    """Everything again per language: the level is one more key."""
    obs = docs_obs(spark, sf).withColumn("level", F.explode(F.array(F.lit("all"), F.col("stratum"))))
    return rounded(run.results(obs, configured("docs", ("en", "rest"))))


@register("status_summary")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return run.status_summary(run.results(docs_obs(spark, sf).withColumn("level", F.lit("all")), configured("docs", ("en", "rest"))))


@register("offsetting_features")
def offsetting_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(run.offsetting(run.decompositions(orders_obs(spark, sf).withColumn("level", F.lit("all")), configured("orders", ("early", "late")))))


@register("share_counted_orders")
def share_counted_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The share and its test on orders at default budgets."""
    return rounded(counted.share(quality.repeated(orders_obs(spark, sf), BY), BY))


@register("boot_counted_orders")
def boot_counted_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(decompose.interval(counted.bootstrap(quality.usable(orders_obs(spark, sf)), BY, "early", "late", 2000), BY, "composition"))


@register("compare_intervals")
def compare_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The whole comparison of two labelings at default budgets: its contrasts with paired intervals."""
    return rounded(compare.comparison(two_labels(spark, sf))[1])


@register("share_full")
def share_full(spark: SparkSession, sf: str) -> DataFrame:
    rep = quality.repeated(docs_obs(spark, sf), BY)
    sh = counted.share(rep, BY)
    cells = rep.groupBy("feature", "grp", F.lit("all").alias("stratum"), "y").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sh.join(kernels.share_intervals(cells, sh, BY, 20, 999, 999), BY))


@register("order_share_full")
def order_share_full(spark: SparkSession, sf: str) -> DataFrame:
    by = ["feature", "stratum"]
    r = settled(readings.intervals(items_mic(spark, sf, True), ["feature"]).select(*by, "grp", "lo", "hi"))
    sc = kernels.npmle_scores(readings.cells(r, by), by)
    scored = r.join(F.broadcast(sc.select(*by, "lo", "hi", "score")), [*by, "lo", "hi"]).withColumn("y", F.col("score"))
    return rounded(counted.share(quality.repeated(scored, BY), BY, within=["stratum"]))


@register("npmle_scores")
def npmle_scores(spark: SparkSession, sf: str) -> DataFrame:
    by = ["feature", "stratum"]
    return rounded(kernels.npmle_scores(readings.cells(readings.intervals(items_mic(spark, sf, True), ["feature"]), by), by))


@register("latent_bounds")
def latent_bounds(spark: SparkSession, sf: str) -> DataFrame:
    by = ["feature", "stratum"]
    r = readings.intervals(items_mic(spark, sf, True).withColumn("grp", F.col("grp2")), ["feature"])
    return rounded(kernels.latent_bounds(readings.counts(r, readings.cells(r, by), by), BY))


@register("call_bounds")
def call_bounds(spark: SparkSession, sf: str) -> DataFrame:
    c = quality.usable(docs_obs(spark, sf)).groupBy("feature", F.lit("all").alias("stratum"), "grp", F.col("y").cast("int").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(kernels.latent_bounds(c, BY))


@register(
    "fisher_exact",
    f"""WITH {DOCS_OBS}, t AS (SELECT feature, count(*) FILTER (WHERE side = 'en' AND y = 1) AS a, count(y) FILTER (WHERE side = 'en') AS n, count(*) FILTER (WHERE y = 1) AS k, count(y) AS total FROM obs GROUP BY 1),
    x AS (SELECT *, unnest(generate_series(greatest(0, k + n - total), least(n, k))) AS i FROM t),
    l AS (SELECT *, lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(total - k + 1) - lgamma(n - i + 1) - lgamma(total - k - n + i + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1) AS lp FROM x)
    SELECT feature, round(least(1.0, sum(exp(lp)) FILTER (WHERE lp <= seen + 1e-7)), 6) + 0.0 AS p FROM (SELECT *, max(CASE WHEN i = a THEN lp END) OVER (PARTITION BY feature) AS seen FROM l) GROUP BY 1""",
)
def fisher(spark: SparkSession, sf: str) -> DataFrame:
    c = decompose.label_coverage(docs_obs(spark, sf), BY, "en", "rest")
    col = lambda n: F.col(n)
    return rounded(c.select("feature", kernels.fisher_p(col("a_labelled_positive"), col("a_labelled_known") - col("a_labelled_positive"), col("b_labelled_positive"), col("b_labelled_known") - col("b_labelled_positive")).alias("p")))


@register("clopper_pearson")
def clopper(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("k"))
    return rounded(d.select("source", "k", "n", kernels.clopper_pearson_limits("k", "n").alias("c")).select("source", "k", "n", "c.lower", "c.upper"))


register(
    "mutual_information",
    """WITH n AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(c) OVER () AS t, sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb FROM n)
    SELECT round(sum(c / t * ln(c * t / (ca * cb))), 6) + 0.0 AS mi, round(-sum(c / t * ln(ca / t)), 6) + 0.0 AS h_a, round(-sum(c / t * ln(cb / t)), 6) + 0.0 AS h_b FROM t""",
)(lambda spark, sf: rounded(kernels.mutual_information(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")))


def event_obs(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("feature"), (F.col("user_id") % 20).cast("string").alias("grp"), (F.col("value") > 50).cast("double").alias("y"), F.col("ts").cast("timestamp").alias("ts"))


@register(
    "sequential_batch_events",
    f"""WITH obs AS (SELECT event_id::VARCHAR AS id, event_type AS feature, (user_id % 20)::VARCHAR AS grp, (value > 50)::INT::DOUBLE AS y, epoch(date_trunc('day', ts))::BIGINT::VARCHAR AS batch FROM events),
    usable AS (SELECT * FROM obs WHERE y IS NOT NULL), {SEQUENTIAL_SQL}""",
)
def sequential_batch_events(spark: SparkSession, sf: str) -> DataFrame:
    """Daily intakes of events in one batch: what the stream must equal."""
    o = event_obs(table(spark, sf, "events")).withColumn("batch", F.date_trunc("day", "ts").cast("long").cast("string"))
    return rounded(evidence.sequential(o, BY))


@register("sequential_stream")
def sequential_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a stream over the events' file, all that is available, then the decisions of its state."""
    work = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{abs(hash(sf)) % 10**8}-{id(sf)}"
    src = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(sf)
    q = stream.start(event_obs(src), f"{work}/state", f"{work}/checkpoint", late="60 days")
    q.awaitTermination()
    return rounded(stream.decisions(spark, f"{work}/state"))

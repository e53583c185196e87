"""Sequential evidence on a stream: counts by intake and group, late records set aside, the same numbers as the batch operator."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.evidence import anytime, looks, sequential_counts

SCHEMA = "feature string, grp string, batch string, n long, s double"


def intakes(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days", key: str = "id") -> DataFrame:
    """(feature, grp, batch, n, s) of a stream (id, feature, grp, y, ts): tumbling windows of event time as intakes; a record counts once within the watermark, and records later than it are dropped instead of changing past factors."""
    e = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key, "feature"])
    w = F.window(time, width)
    c = e.groupBy(w.alias("w"), "feature", "grp").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))
    return c.select("feature", "grp", F.col("w.start").cast("timestamp").cast("long").cast("string").alias("batch"), "n", "s")


def start(events: DataFrame, state: str, checkpoint: str, width: str = "1 day", late: str = "2 days", once: bool = True) -> StreamingQuery:
    """Keeps the counts of all intakes in a table at `state`: each micro-batch adds the new totals of the intakes that it changed, under its number, so that a repeated one replaces itself."""

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    q = intakes(events, width=width, late=late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (q.trigger(availableNow=True) if once else q).start()


def late_rows(query: StreamingQuery) -> int:
    """How many rows the stream set aside because they came after the watermark, over the progress that it still knows."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in json.loads(p.json if hasattr(p, "json") else json.dumps(p))["stateOperators"])


def looks_so_far(spark: SparkSession, state: str, alpha: float = 0.05) -> DataFrame:
    """Which features the step-up rule rejects at each look of the stream."""
    return looks(sequential_counts(counts(spark, state), ["feature"]), ["feature"], alpha=alpha)


def counts(spark: SparkSession, state: str) -> DataFrame:
    """The latest totals of each intake."""
    df = spark.read.schema(SCHEMA + ", epoch long").option("basePath", state).parquet(state)
    return df.groupBy("feature", "batch", "grp").agg(F.max_by(F.struct("n", "s"), "epoch").alias("c")).select("feature", "batch", "grp", "c.n", "c.s")


def decisions(spark: SparkSession, state: str, alpha: float = 0.05) -> DataFrame:
    """Where the stream stands: peaks of the running evidence and which features are rejected at any look so far."""
    paths = sequential_counts(counts(spark, state), ["feature"])
    return anytime(paths.withColumn("family", F.lit("all")), ["feature"], ["family"], alpha)

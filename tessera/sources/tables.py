"""Tables as they come: separated text, single-sheet workbooks; every column a string, nothing inferred."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import Config, ConfigError, doubling_wells
from tessera.functions import text
from tessera.operators import ingest

_SHEET = "{*}"  # any namespace


def separator(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon and tab in the header line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(",;\t", key=line.count) if any(s in line for s in ",;\t") else ","


def read_text(spark: SparkSession, path: str, what: str = "table", drop_malformed: bool = False) -> DataFrame:
    try:
        sep = separator(spark, path)
        df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"', mode="DROPMALFORMED" if drop_malformed else "PERMISSIVE", nullValue="\u0000", emptyValue="")
    except Exception as e:
        raise ConfigError(f"{what} {path} can't be read: {str(e).splitlines()[0]}") from e
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    return ingest.tidy(df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]))


def read_workbook(spark: SparkSession, path: str, what: str = "table") -> DataFrame:
    """The one sheet of a workbook; more than one is refused. Workbooks are small by format (a million rows), so the driver reads them."""
    try:
        with zipfile.ZipFile(path) as z:
            sheets = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
            if not sheets or sheets[1:]:
                raise ConfigError(f"one sheet is read, and {path} ({what}) holds {len(sheets)} sheets")
            shared = ["".join(t.text or "" for t in si.findall(f".//{_SHEET}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
            rows: list[dict[int, str]] = []
            for row in ET.fromstring(z.read(sheets[0])).findall(f".//{_SHEET}row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(row.findall(f".//{_SHEET}c")):
                    ref = "".join(x for x in c.get("r", "") if x.isalpha())
                    at = 0
                    for x in ref:
                        at = at * 26 + ord(x) - 64
                    v = c.find(_SHEET + "v")
                    value = "".join(t.text or "" for t in c.findall(f".//{_SHEET}t")) if c.get("t") == "inlineStr" else "" if v is None else v.text or ""
                    cells[at - 1 if ref else i] = shared[int(value)] if c.get("t") == "s" and value else value
                rows.append(cells)
    except (zipfile.BadZipFile, ET.ParseError, KeyError, OSError) as e:
        raise ConfigError(f"{what} {path} is no readable workbook: {e}") from e
    if not rows:
        raise ConfigError(f"{what} {path} is empty")
    names = [rows[0].get(i, "") for i in range(max(rows[0], default=-1) + 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return ingest.tidy(spark.createDataFrame([tuple(r.get(i, "") for i in range(len(names))) for r in rows[1:]], schema))


def read_table(spark: SparkSession, path: str, what: str = "table") -> DataFrame:
    """By its ending: a workbook, Parquet, or separated text."""
    ending = path.lower().rstrip("/").rpartition(".")[2]
    if ending in ("xlsm", "xlsx"):
        return read_workbook(spark, path, what)
    if ending == "parquet":
        df = spark.read.parquet(path)
        return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    return read_text(spark, path, what)


def located(cfg: Config, name: str) -> str:
    """A table's path: relative ones start at data_dir."""
    return name if name.startswith("/") or "://" in name else f"{cfg.dataset.data_dir}/{name}"


def need(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ConfigError(f"{what} lacks {', '.join(absent)}; it has {', '.join(df.columns)}")
    return df


def members(spark: SparkSession, cfg: Config) -> DataFrame:
    """(id, grp, stratum, unit, batch, side, level): the metadata's analysis columns, one row per id, missing values as null."""
    d = cfg.dataset
    want = {"grp": d.group_column, "stratum": d.stratum_column, "unit": d.cluster_column, "batch": d.batch_column, "side": d.contrast_column, "level": d.stratify_by}
    raw = need(read_table(spark, located(cfg, d.metadata), "metadata"), [d.id_column, *[c for c in want.values() if c]], "metadata")
    ingest.require_keys(raw, [d.id_column], "metadata")
    value = lambda c: F.when(~text.among(F.col(f"`{c}`"), text.METADATA_MISSING), F.trim(F.col(f"`{c}`"))) if c else F.lit(None).cast("string")
    df = raw.select(F.col(f"`{d.id_column}`").alias("id"), *[value(c).alias(k) for k, c in want.items()])
    return ingest.resolve_duplicates(df, ["id"], list(want), "positive_wins" if d.duplicate_policy == "positive_wins" else d.duplicate_policy)


def calls(spark: SparkSession, cfg: Config) -> DataFrame:
    """(id, feature, y): the call table, long or wide, recoded, one row per key."""
    d = cfg.dataset
    key = d.call_id_column or d.id_column
    raw = read_table(spark, located(cfg, d.calls), "calls")
    if d.call_feature_columns:
        long = ingest.melt(need(raw, [key, *d.call_feature_columns], "calls"), [key], list(d.call_feature_columns), "feature", "call").withColumnRenamed(key, "id")
    else:
        need(raw, [key, d.feature_column, d.call_column], "calls")
        long = raw.select(F.col(f"`{key}`").alias("id"), F.col(f"`{d.feature_column}`").alias("feature"), F.col(f"`{d.call_column}`").alias("call"))
    ingest.require_keys(long, ["id", "feature"], "calls")
    r = ingest.recode(long.withColumn("feature", text.unified_name(F.col("feature"))), d.call_kind, d.intermediate)
    refuse_unreadable(r, d.call_kind)
    one = ingest.resolve_duplicates(r, ["id", "feature"], ["meaning"], d.duplicate_policy, positive="y")
    return one.select("id", "feature", "y")


def dilutions(spark: SparkSession, cfg: Config) -> DataFrame:
    """(id, feature, value, op, panel, stratum): the dilution table, parsed; other units set aside."""
    d = cfg.dataset
    key = d.reading_id_column or d.id_column
    raw = read_table(spark, located(cfg, d.readings), "readings")
    # a panel or covariate that the readings lack is taken from the metadata; where both have one, the reading's own stands unless it is blank
    asked = [c for c in (d.panel_column, *d.covariate_columns) if c]
    meta = read_table(spark, located(cfg, d.metadata), "metadata")
    borrowed = [c for c in asked if c in meta.columns and c != d.id_column]
    if borrowed:
        per = meta.groupBy(F.col(f"`{d.id_column}`").alias("_meta_id")).agg(*[F.max(F.trim(F.col(f"`{c}`"))).alias(f"_meta_{i}") for i, c in enumerate(borrowed)])
        raw = raw.join(per, F.col(f"`{key}`") == F.col("_meta_id"), "left").drop("_meta_id")
        for i, c in enumerate(borrowed):
            own = F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
            raw = raw.withColumn(c, F.coalesce(own, F.col(f"_meta_{i}"), F.lit(""))).drop(f"_meta_{i}")
    extra = [c for c in (d.operator_column, d.unit_column, *asked) if c]
    need(raw, [key, *extra, *(d.reading_feature_columns or (d.reading_feature_column, d.value_column))], "readings")
    if d.reading_feature_columns:
        raw = ingest.melt(raw.select(key, *extra, *d.reading_feature_columns), [key, *extra], list(d.reading_feature_columns), "feature", "value")
    else:
        raw = raw.withColumnsRenamed({d.reading_feature_column: "feature", d.value_column: "value"})
    col = lambda c: F.col(f"`{c}`") if c else F.lit("")
    strata = [col(c) for c in ([d.panel_column] if d.panel_column else []) + list(d.covariate_columns)]
    cells = raw.select(
        F.col(f"`{key}`").alias("id"), text.unified_name(F.col("feature")).alias("feature"), "value", col(d.operator_column).alias("op"), col(d.unit_column).alias("unit"), col(d.panel_column).alias("panel"),
        (F.concat_ws(" / ", *strata) if strata else F.lit("all")).alias("stratum"),
    )
    parsed = ingest.parse_cells(ingest.split_units(cells)).filter(~F.col("other_unit"))
    wrong = parsed.filter(F.col("clash") | F.col("bad_sign")).limit(1).collect()
    if wrong:
        raise ingest.Refused(f"a sign in the cell and the recorded operator disagree or are unknown, as in {wrong[0]['value']!r} of {wrong[0]['id']}")
    refuse_readings(parsed, bool(asked), wells_of(cfg))
    r = parsed.select("id", "feature", F.col("number").alias("value"), F.col("sign").alias("op"), "panel", "stratum")
    return ingest.resolve_duplicates(r, ["id", "feature"], ["value", "op"], "error" if d.duplicate_policy == "error" else "drop_conflicts")


def wells_of(cfg: Config) -> dict[str, list[float]]:
    """The wells of each feature: doublings from the first to the last of its declared range, or those declared one by one, which win."""
    return {f: doubling_wells(*r) for f, r in cfg.dataset.well_ranges.items()} | cfg.dataset.wells


def refuse_readings(parsed: DataFrame, strata: bool, wells: dict[str, list[float]]) -> None:
    """Refuses what an order can't be read from: a censoring sign without a number, a reading without the label of its stratum, and one far from every declared well of its feature."""
    bad = {
        "a censoring sign stands before no positive number": parsed.filter(F.col("sign").rlike("[<>]") & F.col("number").isNull()),
        "the label of a stratum is missing": parsed.filter(F.col("number").isNotNull() & F.exists(F.split("stratum", " / "), lambda x: F.trim(x) == "")) if strata else parsed.limit(0),
    }
    for feature, w in wells.items():
        bad[f"the wells of {feature} don't hold the value"] = ingest.off_panel(parsed.filter(F.col("feature") == text.unified_name(F.lit(feature))), w)
    for why, rows in bad.items():
        first = rows.select("id", "feature", "value").orderBy("id", "feature", "value").limit(3).collect()
        if first:
            raise ingest.Refused(f"{why}, as in {', '.join(f'{r.value!r} of {r.id} ({r.feature})' for r in first)}; {rows.count()} in all")


def refuse_unreadable(calls_: DataFrame, kind: str) -> None:
    """Refuses a table of which the declared vocabulary reads no call, and names those that would read them all."""
    found = calls_.filter(F.col("meaning") != "missing").agg(F.count_if(~F.col("meaning").startswith("unknown:")).alias("read"), F.count_if(F.col("meaning").startswith("unknown:")).alias("bad")).first()
    if found["bad"] and not found["read"]:
        words = [r["t"] for r in calls_.filter(F.col("meaning").startswith("unknown:")).groupBy(F.substring("meaning", 9, 1000).alias("t")).count().orderBy(F.desc("count"), "t").limit(50).collect()]
        fits = text.fitting_kinds(words, kind)
        raise ingest.Refused(f"no call is one of {kind}, as in {', '.join(map(repr, words[:3]))}" + (f"; {' or '.join(fits)} reads them" if fits else ""))


def comparison_records(df: DataFrame, key: str, outcome: str, label_a: str, label_b: str) -> DataFrame:
    """(id, y, label_a, label_b) of a table with one row per record: outcomes 0, 1 or a word for none, ids that occur once. Anything else is refused."""
    need(df, [key, outcome, label_a, label_b], "the comparison table")
    raw = F.trim(F.col(f"`{outcome}`").cast("string"))
    none = raw.isNull() | F.lower(raw).isin("", "nan", "na", "n/a", "null")
    out = df.select(F.trim(F.col(f"`{key}`").cast("string")).alias("id"), F.when(~none, raw).alias("_raw"), F.when(~none, raw.try_cast("double")).alias("y"), F.col(f"`{label_a}`").cast("string").alias("label_a"), F.col(f"`{label_b}`").cast("string").alias("label_b"))
    odd = out.filter(F.col("_raw").isNotNull() & ~F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False))).limit(1).collect()
    if odd:
        raise ingest.Refused(f"outcomes must be 0 or 1, not {odd[0]['_raw']!r} of {odd[0]['id']}")
    blank = out.filter(F.col("id").isNull() | F.col("id").isin("", "nan", "<NA>", "NaT")).limit(1).count()
    twice = out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("id").limit(1).collect()
    if blank or twice:
        raise ingest.Refused("records without an id" if blank else f"the id {twice[0]['id']!r} occurs {twice[0]['n']} times")
    return out.drop("_raw")


def observations(spark: SparkSession, cfg: Config) -> DataFrame:
    """(id, feature, y, grp, stratum, unit, batch, side, level) of all ids that calls or readings name."""
    c = calls(spark, cfg)
    universe = c.select("id").distinct()
    features = c.select("feature").distinct()
    # every feature of every id, as a call that is absent is a missing outcome and no negative one
    grid = universe.join(F.broadcast(features), F.lit(True))
    obs = grid.join(c, ["id", "feature"], "left").join(members(spark, cfg), "id", "left")
    obs = ingest.unit_or_self(obs) if cfg.dataset.cluster_column else obs.withColumn("unit", F.col("id"))
    return obs.withColumn("stratum", F.coalesce("stratum", F.lit("all")))

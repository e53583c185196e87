"""A configured analysis: from the tables to one result row per feature and analysis."""

from __future__ import annotations

import dataclasses
import hashlib
import platform
import re
from functools import reduce
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Config, load
from tessera.functions.stats import e_bh, step_up
from tessera.operators import compare, counted, decompose, evidence, ingest, kernels, quality, readings
from tessera.operators.staging import settled
from tessera.sources import sinks, tables

FIELDS = {
    "level": "string", "feature": "string", "analysis": "string", "status": "string", "reason": "string", "estimate": "double", "lower": "double", "upper": "double", "p": "double", "q": "double", "selected": "boolean",
    "log_e": "double", "batch": "string", "n": "long", "n_groups": "long", "support": "double", "prevalence": "double", "null_mean": "double", "se": "double", "draws": "long", "exact": "boolean", "conclusion": "string",
}
KEYS = ["level", "feature"]
VERSION = "0.2.0"


def rows(df: DataFrame, analysis: str, **cols: Column | str | None) -> DataFrame:
    """Result rows with every field, typed nulls where the analysis has none."""
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in cols.items()}
    out = {"level": F.col("level"), "feature": F.col("feature"), "analysis": F.lit(analysis)} | given
    df = df.select(*[(out[k] if k in out and out[k] is not None else F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])
    known = F.coalesce("estimate", "lower", "upper", "log_e").isNotNull()
    full = (F.col("lower") <= 0) & (F.col("upper") >= 1)
    status = F.when(~known, "unavailable").when(F.coalesce(full, F.lit(False)), "full_range").otherwise("computed")
    return df.withColumns({"status": status, "reason": F.coalesce("reason", F.when(~known, F.lit("not estimable")))})


def concluded(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """What a row lets one say: established by a lower end above zero with an adjusted p, by a lower confidence limit above zero, or by selection of an e-value or component."""
    kind, yes = F.col("analysis"), lambda c: F.coalesce(c, F.lit(False))
    good = yes((F.col("lower") > 0) & (F.coalesce("q", "p") <= alpha)) | yes(kind.endswith("lower_limit") & (F.col("lower") > 0)) | yes((kind.endswith("evidence") | kind.startswith("decomposition")) & F.col("selected"))
    said = F.when(F.col("status") == "unavailable", "not estimable").when(kind == "finite_collection_prevalence", "described").when(good, "established").when(F.col("status") == "full_range", "whole range").otherwise("not established")
    return df.withColumn("conclusion", F.coalesce("conclusion", said))


def contrast_rows(use: DataFrame, cfg: Config) -> list[DataFrame]:
    """The two parts of the difference between the contrasted collections; use: usable observations."""
    if not (cfg.contrast.enabled and cfg.dataset.contrast_levels):
        return []
    out = []
    a, b = cfg.dataset.contrast_levels
    k = decompose.kitagawa(use, KEYS, a, b)
    draws = settled(decompose.bootstrap(use, KEYS, a, b, cfg.contrast.draws, "unit") if cfg.dataset.cluster_column else counted.bootstrap(use, KEYS, a, b, cfg.contrast.draws))
    k = settled(k)
    for part in ("composition", "within"):
        i = decompose.interval(draws, KEYS, part).join(k.select(*KEYS, part, "admitted", "shared_support", "n_a", "n_b"), KEYS)
        i = step_up(i, "p", ["level"], True, cfg.contrast.q)
        out.append(rows(i, f"decomposition_{part}", estimate=part, lower="lower", upper="upper", p="p", q="adjusted", selected=F.col("rejected") & F.col("admitted"), n=F.col("n_a") + F.col("n_b"), support="shared_support", se="sd", reason=F.when(~F.col("admitted"), F.lit("groups shared by both collections hold too little"))))
    return out


def call_rows(obs: DataFrame, cfg: Config, intervals: bool = True, bounds: bool = True) -> list[DataFrame]:
    """Analyses of calls; obs (level, feature, id, y, grp, stratum, unit, batch, side). Each analysis is a job of its own over the settled observations."""
    obs = settled(obs)
    s, use, rep = cfg.share, quality.usable(obs), quality.repeated(obs, KEYS)
    out = [rows(quality.finite_bounds(obs, KEYS), "finite_collection_prevalence", estimate="observed", lower="lower", upper="upper", n="n", prevalence="observed")]
    feas = quality.feasibility(obs, KEYS).select(*KEYS, "retained", "support", "groups_repeated", "refused")
    ok = feas.filter("refused = ''").select(*KEYS)
    rep = settled(rep.join(F.broadcast(ok), KEYS))
    if s.enabled:
        strata = ["stratum"] if cfg.dataset.stratum_column else []
        base = quality.centred(rep, KEYS) if strata else rep
        sh = settled(counted.share(base, KEYS, s.folds, s.repeats, s.perms, strata))
        if cfg.dataset.cluster_column:
            # the test keeps records of one unit together in their stratum, the null mean only the stratum
            own = counted.share(base, KEYS, s.folds, 0, s.perms, [*strata, "unit"]).select(*KEYS, "p")
            sh = settled(sh.drop("p").join(own, KEYS))
        j = feas.join(sh, KEYS, "left")
        if intervals:
            cells = rep.groupBy(*KEYS, "grp", "stratum", "y").agg(F.count(F.lit(1)).alias("n"))
            j = j.join(kernels.share_intervals(cells, sh, KEYS, s.repeats, s.draws, s.perms), KEYS, "left")
        else:
            j = j.withColumns({c: F.lit(None).cast("double") for c in ("low", "high", "se")} | {"draws": F.lit(None).cast("long")})
        j = step_up(j, "p", ["level"], True, cfg.contrast.q)
        out.append(rows(j, "collection_membership", estimate="kappa_adj", lower=F.nanvl("low", F.lit(None).cast("double")), upper=F.nanvl("high", F.lit(None).cast("double")), p="p", q="adjusted", selected="rejected", n="retained", n_groups="groups_repeated", support="support", null_mean="null_mean", se="se", draws="draws", reason=F.nullif(F.col("refused"), F.lit(""))))
    if bounds:
        c = use.groupBy(*KEYS, "stratum", "grp", F.col("y").cast("int").alias("run")).agg(F.count(F.lit(1)).alias("n"))
        b = settled(kernels.latent_bounds(c, KEYS))
        out += [
            rows(b, "call_latent_bounds", lower="lower", upper="upper_bound", exact="upper_exact", n="n", n_groups="n_groups"),
            rows(b, "call_latent_lower_limit", lower="lower_limit", n="n", n_groups="n_groups"),
        ]
    if cfg.evidence.enabled:
        e = e_bh(evidence.split_e_values(use, KEYS, cfg.evidence.folds, cfg.evidence.repeats), "log_e", ["level"], cfg.evidence.alpha)
        out.append(rows(e, "group_evidence", estimate=F.exp("log_e"), log_e="log_e", selected="rejected", draws="n_splits"))
    if cfg.dataset.batch_column or cfg.dataset.name == "orders":
        q = evidence.sequential(use, KEYS)
        last = q.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(F.col("batch").cast("double"))))).filter("_k = 1")
        out.append(rows(last, "sequential_group_evidence", estimate=F.exp("log_e"), log_e="log_e", batch="batch", selected=F.col("peak") >= F.log(F.lit(1 / cfg.evidence.alpha))))
    return out + contrast_rows(use, cfg)


def reading_rows(r: DataFrame, cfg: Config) -> list[DataFrame]:
    """Analyses of readings; r (level, feature, id, grp, stratum, lo, hi)."""
    by = [*KEYS, "stratum"]
    r = settled(r.filter(F.col("lo").isNotNull()))
    known = r.withColumn("y", F.lit(1.0))
    cells = settled(readings.cells(r, by))
    scored = r.join(kernels.npmle_scores(cells, by).select(*by, "lo", "hi", "score"), [*by, "lo", "hi"]).withColumn("y", F.col("score"))
    rep = settled(quality.repeated(scored, KEYS))
    sh = settled(counted.share(rep, KEYS, cfg.share.folds, cfg.share.repeats, cfg.share.perms, ["stratum"]))
    p = step_up(sh, "p", ["level"], True, cfg.contrast.q)
    counts = readings.counts(quality.usable(known), cells, by)
    b = settled(kernels.latent_bounds(counts.select(*by, "grp", F.col("run").cast("int").alias("run"), "n"), KEYS))
    return [
        rows(p, "reading_order", estimate="kappa_adj", p="p", q="adjusted", selected="rejected", null_mean="null_mean"),
        rows(b, "reading_latent_bounds", lower="lower", upper="upper_bound", exact="upper_exact", n="n", n_groups="n_groups"), rows(b, "reading_latent_lower_limit", lower="lower_limit", n="n", n_groups="n_groups"),
    ]


def completed(parts: list[DataFrame], features: DataFrame) -> DataFrame:
    """All result rows, and for each feature an unavailable row of every analysis that gave none: a refusal is a row."""
    out = reduce(DataFrame.unionByName, map(settled, parts))
    kinds = out.select("analysis").distinct()
    absent = features.join(F.broadcast(kinds), F.lit(True)).join(out.select(*KEYS, "analysis").distinct(), [*KEYS, "analysis"], "left_anti")
    rest = absent.select(*[F.col(k) if k in (*KEYS, "analysis") else F.lit({"status": "unavailable", "reason": "no usable records"}.get(k)).cast(t).alias(k) for k, t in FIELDS.items()])
    return concluded(out.unionByName(rest))


def results(obs: DataFrame, cfg: Config, intervals: bool = True, bounds: bool = True) -> DataFrame:
    return completed(call_rows(obs, cfg, intervals, bounds), obs.select(*KEYS).distinct())


def decompositions(obs: DataFrame, cfg: Config) -> DataFrame:
    """The rows of results whose analysis is a decomposition, without the others' work: none of them enters these."""
    if not (cfg.contrast.enabled and cfg.dataset.contrast_levels):
        raise ValueError("no contrast is configured")
    obs = settled(obs)
    return completed(contrast_rows(quality.usable(obs), cfg), obs.select(*KEYS).distinct())


def status_summary(out: DataFrame) -> DataFrame:
    return out.groupBy("analysis").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("computed", "full_range", "unavailable")])


def offsetting(out: DataFrame) -> DataFrame:
    """Features whose composition and within-group change have opposite signs."""
    p = out.filter(F.col("analysis").startswith("decomposition_")).groupBy(*KEYS).agg(*[F.max(F.when(F.col("analysis") == f"decomposition_{x}", F.col("estimate"))).alias(x) for x in ("composition", "within")])
    return p.filter(F.col("composition") * F.col("within") < 0)


def provenance(spark: SparkSession, cfg: Config) -> dict[str, Any]:
    """What a run can be repeated from: its whole configuration, the versions it ran on, and the streams of its random numbers."""
    return {
        "config": dataclasses.asdict(cfg), "versions": {"tessera": VERSION, "spark": spark.version, "python": platform.python_version(), "numpy": np.__version__},
        "streams": {"counted": "sha256(key, kind, block of replicates)", "rows": "md5(stream, replicate, id)", "kernels": "sha256(stream, key)"},
    }


def run(spark: SparkSession, config: str | Config, out: str | None = None) -> DataFrame:
    """The result rows of a configured analysis, published to `out` if given. If it fails, why stands beside `out`."""
    cfg = load(config) if isinstance(config, str) else config
    if not out:
        return _run(spark, cfg, None)
    sinks.preflight(out)
    try:
        return _run(spark, cfg, out)
    except Exception as e:
        sinks.record_failure(out, e)
        raise


def _run(spark: SparkSession, cfg: Config, out: str | None) -> DataFrame:
    parts: list[DataFrame] = []
    features: list[DataFrame] = []
    if cfg.dataset.calls:
        obs = tables.observations(spark, cfg).withColumn("level", F.coalesce(F.col("level"), F.lit("all")))
        if cfg.dataset.stratify_by:
            obs = obs.withColumn("level", F.explode(F.array_distinct(F.array(F.lit("all"), F.col("level")))))
        parts += call_rows(obs, cfg)
        features.append(obs.select(*KEYS).distinct())
    if cfg.dataset.readings and cfg.readings.enabled:
        d = tables.dilutions(spark, cfg)
        by = ["feature", "panel"] if cfg.dataset.panel_column else ["feature"]
        wells = tables.wells_of(cfg)
        plain = d.filter(~F.col("feature").isin(list(wells))) if wells else d
        iv = readings.intervals(plain, by, ends_censored=cfg.readings.ends_censored)
        for name, w in wells.items():
            iv = iv.unionByName(readings.intervals(d.filter(F.col("feature") == name), by, w, cfg.readings.ends_censored))
        r = iv.join(tables.members(spark, cfg).select("id", "grp"), "id", "left").withColumn("level", F.lit("all"))
        parts += reading_rows(r, cfg)
        features.append(r.select(*KEYS).distinct())
    df = completed(parts, reduce(DataFrame.unionByName, features).distinct())
    if out:
        def fill(stage: Path) -> None:
            sinks.write_csv(df, stage / "results.csv", ["level", "feature", "analysis"])
            for level in [r.level for r in df.select("level").distinct().orderBy("level").collect()] if cfg.dataset.stratify_by else []:
                (stage / "levels").mkdir(exist_ok=True)
                sinks.write_csv(df.filter(F.col("level") == level), stage / "levels" / f"{re.sub(r'[^A-Za-z0-9_-]+', '_', level)}-{hashlib.sha256(level.encode()).hexdigest()[:8]}.csv", ["feature", "analysis"])
            record: dict[str, Any] = {"schema_version": sinks.SCHEMA_VERSION, "dataset": cfg.dataset.name, "provenance": provenance(spark, cfg), "status": [r.asDict() for r in status_summary(df).orderBy("analysis").collect()]}
            sinks.write_json(record, stage / "record.json")
            (stage / "report.md").write_text(report(df), encoding="utf-8")

        sinks.publish(out, fill)
    return df


def compare_labelings(spark: SparkSession, path: str, key: str, outcome: str, label_a: str, label_b: str, out: str | None = None, folds: int = 5, repeats: int = 20, perms: int = 999, draws: int = 999) -> tuple[DataFrame, DataFrame]:
    """Two labelings of the records of a table, compared; published to `out` as comparison.json, arms.csv, contrasts.csv and report.md if given."""
    if label_a == label_b:
        raise ValueError("the two labels must be different columns")
    if folds < 2 or repeats < 1 or perms < 1 or draws < 0:
        raise ValueError("at least two folds, one repeat and one permutation are required, and no negative number of draws")
    if out:
        sinks.preflight(out)
    records = settled(tables.comparison_records(tables.read_table(spark, path, "the comparison table"), key, outcome, label_a, label_b))
    arm, contrast = compare.comparison(records, folds, repeats, perms, draws)
    if out:
        def fill(stage: Path) -> None:
            sinks.write_csv(arm, stage / "arms.csv", ["arm"])
            sinks.write_csv(contrast, stage / "contrasts.csv", ["contrast"])
            rows_ = {"arms": [r.asDict() for r in arm.orderBy("arm").collect()], "contrasts": [r.asDict() for r in contrast.orderBy("contrast").collect()]}
            sinks.write_json({"schema_version": sinks.SCHEMA_VERSION, "label_a": label_a, "label_b": label_b, "settings": {"folds": folds, "repeats": repeats, "permutations": perms, "draws": draws}} | rows_, stage / "comparison.json")
            num = lambda v: "" if v is None or v != v else f"{v:.4g}"
            lines = [f"# {label_a} and {label_b}", "", "| arm | records | share | p |", "|---|---|---|---|", *(f"| {r['arm']} | {r['n']} | {num(r['kappa_adj'])} | {num(r['p'])} |" for r in rows_["arms"])]
            lines += ["", "| contrast | estimate | lower | upper |", "|---|---|---|---|", *(f"| {r['contrast']} | {num(r['estimate'])} | {num(r['lower'])} | {num(r['upper'])} |" for r in rows_["contrasts"])]
            (stage / "report.md").write_text("\n".join([*lines, ""]), encoding="utf-8")

        sinks.publish(out, fill)
    return arm, contrast


def check(spark: SparkSession, cfg: Config, out: str | None = None) -> dict[str, Any]:
    """What the tables of a configuration hold, without any analysis; published to `out` as check.json and check.md if given."""
    if out:
        sinks.preflight(out)
    if cfg.dataset.calls:
        found = quality.feasibility(tables.observations(spark, cfg), ["feature"]).orderBy("feature").collect()
        left = tables.calls(spark, cfg)
    else:
        left = tables.dilutions(spark, cfg)
        found = left.groupBy("feature").count().orderBy("feature").collect()
    result = {"features": [r.asDict() for r in found], "join": ingest.join_report(left, tables.members(spark, cfg)).first().asDict()}
    if out:
        def fill(stage: Path) -> None:
            sinks.write_json({"schema_version": sinks.SCHEMA_VERSION, "dataset": cfg.dataset.name, "provenance": provenance(spark, cfg)} | result, stage / "check.json")
            j = result["join"]
            lines = ["# Input check", "", f"{j['matched']} ids have metadata, {j['only_left']} have none, and {j['only_right']} stand in the metadata alone.", ""]
            for f in result["features"]:
                why = f.get("refused")
                lines.append(f"- {f['feature']}: " + (f"left out, {why}." if why else "can be analysed." if "refused" in f else f"{f['count']} readings."))
            (stage / "check.md").write_text("\n".join([*lines, ""]), encoding="utf-8")

        sinks.publish(out, fill)
    return result


def report(df: DataFrame) -> str:
    """The result rows as a Markdown table per feature."""
    lines, at, shown = ["# Results", ""], None, ("analysis", "estimate", "lower", "upper", "p", "q", "conclusion")
    num = lambda v: "" if v is None else f"{v:.4g}"
    for r in df.orderBy("level", "feature", "analysis").toLocalIterator():
        if (r.level, r.feature) != at:
            at = (r.level, r.feature)
            lines += ["", f"## {r.feature} ({r.level})", "", "| " + " | ".join(shown) + " |", "|" + "---|" * len(shown)]
        lines.append(f"| {r.analysis} | {num(r.estimate)} | {num(r.lower)} | {num(r.upper)} | {num(r.p)} | {num(r.q)} | {r.conclusion} |")
    return "\n".join([*lines, ""])

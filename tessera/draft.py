"""A first configuration from the tables themselves: what each column is likely to be, for a person to check."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.tables import read_table

#: Role -> words by which a column's name gives it away, the likeliest first; words of one or two letters count only whole.
ROLES = {
    "id": ("id", "isolate", "strain", "sample", "record"), "group": ("lineage", "cluster", "group", "type", "st", "clone"), "batch": ("year", "date", "intake", "batch", "period"), "unit": ("farm", "herd", "ward", "site"),
    "feature": ("agent", "antibiotic", "drug", "antimicrobial", "feature"), "call": ("call", "phenotype", "interpretation", "sir"), "value": ("mic", "value", "reading", "concentration"), "panel": ("panel", "lab", "laboratory"),
}
ROWS = 2000


def role_of(columns: list[str], role: str, taken: set[str]) -> str | None:
    free = [c for c in columns if c not in taken]
    for word in ROLES[role]:
        for c in free:
            if c.strip().lower() == word:
                return c
        for c in free:
            parts = re.findall("[0-9a-z]+", c.lower())
            if word in parts or (len(word) > 2 and word in c.lower()):
                return c
    return None


def roles(columns: list[str], wanted: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for r in wanted:
        c = role_of(columns, r, set(out.values()))
        if c:
            out[r] = c
    return out


def profile(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float | list[str]]]:
    """Of each column, over the first rows: distinct tokens (at most 50) and the share that reads as a concentration."""
    some = df.limit(ROWS)
    aggs = []
    for c in columns:
        known = ~text.among(F.col(f"`{c}`"), text.CELL_MISSING)
        aggs += [F.slice(F.array_sort(F.collect_set(F.when(known, text.token(F.col(f"`{c}`"))))), 1, 50).alias(f"t_{c}"), F.avg(F.when(known, text.cell_number(F.col(f"`{c}`")).isNotNull().cast("double"))).alias(f"n_{c}")]
    r = some.agg(*aggs).first()
    return {c: {"tokens": list(r[f"t_{c}"]), "numeric": float(r[f"n_{c}"] or 0)} for c in columns}


def draft(spark: SparkSession, metadata: str, calls: str | None = None, readings: str | None = None, name: str = "draft") -> str:
    """YAML of a configuration that fits the tables."""
    m = read_table(spark, metadata, "metadata")
    got = roles(m.columns, ["id", "group", "batch", "unit"])
    d: dict[str, object] = {"name": name, "metadata": metadata, "id_column": got.get("id", m.columns[0]), "group_column": got.get("group", m.columns[-1])}
    d |= {k: got[r] for k, r in (("batch_column", "batch"), ("cluster_column", "unit")) if r in got}
    for path, what in ((calls, "calls"), (readings, "readings")):
        if not path:
            continue
        t = read_table(spark, path, what)
        want = ["id", "feature", "call" if what == "calls" else "value", *(["panel"] if what == "readings" else [])]
        got = roles(t.columns, want)
        d[what] = path
        p = profile(t, t.columns)
        if "feature" in got and want[2] in got:
            d |= {"feature_column": got["feature"], "call_column": got["call"]} if what == "calls" else {"reading_feature_column": got["feature"], "value_column": got["value"]}
            seen = p[got[want[2]]]["tokens"]
        else:
            wide = [c for c in t.columns if c != got.get("id") and (p[c]["numeric"] > 0.6 if what == "readings" else text.fitting_kinds(list(p[c]["tokens"])))]
            d["call_feature_columns" if what == "calls" else "reading_feature_columns"] = wide
            seen = sorted({x for c in wide for x in p[c]["tokens"]})
        if what == "calls":
            kinds = text.fitting_kinds(list(seen))
            d["call_kind"] = kinds[0] if kinds else "undeclared"
        if "panel" in got and what == "readings":
            d["panel_column"] = got["panel"]
    return yaml.safe_dump({"dataset": {k: v for k, v in d.items() if v is not None}}, sort_keys=False, allow_unicode=True)

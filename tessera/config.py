"""An analysis as one YAML mapping with closed sets of keys, checked before any table is read."""

from __future__ import annotations

import dataclasses
import difflib
from dataclasses import dataclass, field
from typing import Any

import yaml

from tessera.functions.text import CALLS

#: What to do with records of one key that differ: refuse, drop the key, or let the positive (or first) one stand.
DUPLICATES = frozenset("positive_wins drop_conflicts error".split())


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Dataset:
    name: str
    metadata: str
    group_column: str
    data_dir: str = "."
    id_column: str = "id"
    calls: str | None = None
    call_id_column: str | None = None
    feature_column: str = "feature"
    call_column: str = "call"
    call_feature_columns: tuple[str, ...] = ()
    call_kind: str = "undeclared"
    intermediate: str | None = None
    duplicate_policy: str = "error"
    stratum_column: str | None = None
    readings: str | None = None
    reading_id_column: str | None = None
    reading_feature_column: str = "feature"
    value_column: str = "value"
    operator_column: str | None = None
    reading_feature_columns: tuple[str, ...] = ()
    unit_column: str | None = None
    units: dict[str, str] = field(default_factory=dict)
    panel_column: str | None = None
    covariate_columns: tuple[str, ...] = ()
    wells: dict[str, list[float]] = field(default_factory=dict)
    well_ranges: dict[str, list[float]] = field(default_factory=dict)
    contrast_column: str | None = None
    contrast_levels: tuple[str, ...] = ()
    batch_column: str | None = None
    stratify_by: str | None = None
    cluster_column: str | None = None


@dataclass(frozen=True)
class Share:
    enabled: bool = True
    folds: int = 5
    repeats: int = 20
    draws: int = 999
    perms: int = 999


@dataclass(frozen=True)
class Contrast:
    enabled: bool = True
    draws: int = 2000
    q: float = 0.05
    least_support: float = 0.9
    label_alpha: float = 0.05


@dataclass(frozen=True)
class Readings:
    enabled: bool = True
    ends_censored: bool = True


@dataclass(frozen=True)
class Evidence:
    alpha: float = 0.05
    repeats: int = 20
    folds: int = 5
    enabled: bool = True


@dataclass(frozen=True)
class Config:
    dataset: Dataset
    share: Share = Share()
    contrast: Contrast = Contrast()
    readings: Readings = Readings()
    evidence: Evidence = Evidence()


class _Once(yaml.SafeLoader):
    """A loader that refuses a key given twice."""

    def construct_mapping(self, node: yaml.MappingNode, deep: bool = False) -> dict:
        seen: set[Any] = set()
        for key, _ in node.value:
            k = self.construct_object(key, deep=deep)
            if k in seen:
                raise ConfigError(f"the key {k!r} stands twice (line {key.start_mark.line + 1})")
            seen.add(k)
        return super().construct_mapping(node, deep)


def _typed(name: str, value: Any, default: Any, kind: str) -> Any:
    if kind == "bool":
        if not isinstance(value, bool):
            raise ConfigError(f"{name} must be true or false")
    elif kind == "int":
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise ConfigError(f"{name} must be a whole number of at least 0")
    elif kind == "float":
        if type(value) not in (int, float):
            raise ConfigError(f"{name} must be a number")
        value = float(value)
    elif kind.startswith("tuple"):
        value = tuple(map(str, [value] if isinstance(value, str) else value or ()))
    elif kind.startswith("str"):
        value = None if value is None and "None" in kind else str(value)
    return value


def _section(cls: type, given: Any, where: str) -> Any:
    if given is None:
        given = {}
    if not isinstance(given, dict):
        raise ConfigError(f"{where} must be a mapping")
    fields = {f.name: f for f in dataclasses.fields(cls)}
    for k in given:
        if k not in fields:
            near = difflib.get_close_matches(str(k), fields, 1)
            raise ConfigError(f"{where}.{k} is unknown" + (f"; did you mean {near[0]}?" if near else ""))
    missing = [f.name for f in fields.values() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and f.name not in given]
    if missing:
        raise ConfigError(f"{where} lacks {', '.join(missing)}")
    return cls(**{k: _typed(f"{where}.{k}", v, None, str(fields[k].type)) for k, v in given.items()})


def from_dict(given: dict[str, Any]) -> Config:
    sections = {"dataset": Dataset, "share": Share, "contrast": Contrast, "readings": Readings, "evidence": Evidence}
    for k in given or {}:
        if k not in sections:
            near = difflib.get_close_matches(str(k), sections, 1)
            raise ConfigError(f"the section {k!r} is unknown" + (f"; did you mean {near[0]}?" if near else ""))
    cfg = Config(**{k: _section(c, (given or {}).get(k), k) for k, c in sections.items()})
    d = cfg.dataset
    if not (d.calls or d.readings):
        raise ConfigError("dataset names neither calls nor readings")
    if d.call_kind not in CALLS:
        raise ConfigError(f"unknown call_kind {d.call_kind!r}")
    if d.duplicate_policy not in DUPLICATES:
        raise ConfigError(f"unknown duplicate_policy {d.duplicate_policy!r}")
    if bool(d.contrast_column) != bool(d.contrast_levels) or (d.contrast_levels and len(set(d.contrast_levels)) != 2):
        raise ConfigError("a contrast needs a column and exactly two different levels")
    for name, w in d.wells.items():
        if not w or any(not isinstance(x, (int, float)) or x <= 0 for x in w) or any(b <= a for a, b in zip(w, w[1:])):
            raise ConfigError(f"the wells of {name} must be positive and increasing")
    for name, r in d.well_ranges.items():
        if len(r) != 2 or any(not isinstance(x, (int, float)) for x in r) or not 0 < r[0] < r[1]:
            raise ConfigError(f"the range of wells of {name} must be its first and last, positive and increasing")
    if cfg.share.folds < 2 or cfg.evidence.folds < 2:
        raise ConfigError("at least two folds are required")
    if not 0 < cfg.contrast.q < 1 or not 0 < cfg.evidence.alpha < 1:
        raise ConfigError("q and alpha must lie between 0 and 1")
    return cfg


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        given = yaml.load(f, Loader=_Once)  # noqa: S506 - derived from SafeLoader
    if not isinstance(given, dict):
        raise ConfigError(f"{path} holds no mapping")
    return from_dict(given)


def doubling_wells(first: float, last: float) -> list[float]:
    """Every doubling from the first well to the last."""
    out = [float(first)]
    while out[-1] < last * 0.75:
        out.append(out[-1] * 2)
    return out

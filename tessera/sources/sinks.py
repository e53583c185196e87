"""What a run leaves behind: published whole or not at all."""

from __future__ import annotations

import csv
import hashlib
import json
import math
import os
import tempfile
import traceback
from collections.abc import Callable
from pathlib import Path
from shutil import copy2, rmtree
from typing import Any

from pyspark.sql import DataFrame

SCHEMA_VERSION = "1.0"


def plain(v: Any) -> Any:
    """A value of strict JSON: non-finite numbers are null, unknown types an error."""
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(v.asDict(recursive=True))
    raise TypeError(f"{type(v).__name__} has no place in a record")


def safe_cell(v: Any) -> str:
    """A CSV cell that no spreadsheet runs as a formula."""
    s = "" if v is None else repr(v) if isinstance(v, float) else str(v)
    if s[:1] in ("=", "+", "-", "@", "\t", "\r") and s[:1]:
        try:
            float(s)
        except ValueError:
            return "'" + s
    return s


def preflight(target: str) -> Path:
    """Refuses destinations that publishing could harm, before any work."""
    p = Path(target)
    if p.is_symlink():
        raise ValueError(f"{target} is a link")
    if p.exists() and p.resolve() == Path.cwd().resolve():
        raise ValueError("the output can't be the working directory")
    if p.exists() and (not p.is_dir() or any(p.iterdir()) and not (p / "manifest.json").exists()):
        raise ValueError(f"{target} holds other files than an earlier run's")
    parent = p.resolve().parent
    if not parent.is_dir() or not os.access(parent, os.W_OK):
        raise ValueError(f"{parent} can't be written")
    return p


def keep_foreign(old: Path, stage: Path) -> None:
    """Copies what the last run didn't write, by its manifest, from the old folder to the new one; a new file of the same name stands."""
    if not (old / "manifest.json").exists():
        return
    own = {*json.loads((old / "manifest.json").read_text(encoding="utf-8")).get("sha256", {}), "manifest.json"}
    for f in sorted(old.rglob("*")):
        name, to = str(f.relative_to(old)), stage / f.relative_to(old)
        if f.is_symlink() and name not in own and not to.exists():
            to.parent.mkdir(parents=True, exist_ok=True)
            to.symlink_to(os.readlink(f))
        elif f.is_dir():
            if not any(x.startswith(name + os.sep) for x in own):
                to.mkdir(parents=True, exist_ok=True)
        elif f.is_file() and name not in own and not to.exists():
            to.parent.mkdir(parents=True, exist_ok=True)
            copy2(f, to)


def record_failure(target: str, error: BaseException) -> Path:
    """Writes why a run ended beside its target, which stays as it was: an earlier run's results are never touched."""
    p = Path(target).resolve()
    at = p.with_name(p.name + ".failure.json")
    write_json({"schema_version": SCHEMA_VERSION, "error": type(error).__name__, "message": str(error), "traceback": traceback.format_exception(error)}, at)
    return at


def publish(target: str, fill: Callable[[Path], None]) -> None:
    """Fills a folder beside the target and swaps it in; files of the target that the run doesn't own stay, and a failure leaves the target as it was."""
    p = preflight(target)
    stage = Path(tempfile.mkdtemp(prefix=f".{p.name}-", dir=p.resolve().parent))
    old = stage.with_name(stage.name + "-old")
    try:
        fill(stage)
        files = {str(f.relative_to(stage)): hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(stage.rglob("*")) if f.is_file()}
        keep_foreign(p, stage)
        (stage / "manifest.json").write_text(json.dumps({"schema_version": SCHEMA_VERSION, "sha256": files}, indent=1, sort_keys=True))
        if p.exists():
            p.rename(old)
        try:
            stage.rename(p)
        except OSError:
            if old.exists():
                old.rename(p)
            raise
    except BaseException:
        rmtree(stage, ignore_errors=True)
        raise
    rmtree(old, ignore_errors=True)


def write_csv(df: DataFrame, path: Path, order: list[str]) -> int:
    """Result rows are few: they are sorted, streamed to the driver and written as UTF-8 with a signature."""
    n = 0
    with path.open("w", newline="", encoding="utf-8-sig") as target:
        w = csv.writer(target)
        w.writerow(df.columns)
        for r in df.orderBy(*order).toLocalIterator():
            w.writerow([safe_cell(v) for v in r])
            n += 1
    return n


def write_json(value: Any, path: Path) -> None:
    path.write_text(json.dumps(plain(value), ensure_ascii=False, indent=1, sort_keys=True, allow_nan=False), encoding="utf-8")


def read_record(path: str) -> dict[str, Any]:
    with open(path, "rb") as f:
        record = json.load(f)
    if record.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"{path} has schema {record.get('schema_version')!r}, not {SCHEMA_VERSION!r}")
    return record

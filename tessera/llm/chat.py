"""Chat formatting: a fingerprint of a record's nested field paths selects the declarative mapping to canonical turns."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name; required and optional leaf paths; then either a list of turns (path of the list, of role and of text inside) or single fields with their roles, in order.
MAPPINGS: list[dict[str, Any]] = [
    {"name": "messages", "required": ["messages[].content", "messages[].role"], "optional": ["system"], "list": ("messages", "role", "content"), "first": [("system", "system")]},
    {"name": "conversations", "required": ["conversations[].from", "conversations[].value"], "optional": ["system"], "list": ("conversations", "from", "value"), "first": [("system", "system")]},
    {"name": "turn rows", "required": ["turns[].role", "turns[].text"], "optional": ["turns[].turn"], "list": ("turns", "role", "text"), "first": []},
    {"name": "instruction", "required": ["instruction", "output"], "optional": ["input", "system"], "fields": [("system", "system"), (("instruction", "input"), "user"), ("output", "assistant")]},
    {"name": "prompt", "required": ["prompt", "completion"], "optional": ["system"], "fields": [("system", "system"), ("prompt", "user"), ("completion", "assistant")]},
    {"name": "prompt and response", "required": ["prompt", "response"], "optional": ["system"], "fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
    {"name": "question", "required": ["question", "answer"], "optional": ["context", "system"], "fields": [("system", "system"), (("context", "question"), "user"), ("answer", "assistant")]},
    {"name": "nested dialog", "required": ["dialog.turns[].speaker.role", "dialog.turns[].utterance"], "optional": [], "list": ("dialog.turns", "speaker.role", "utterance"), "first": []},
    {"name": "text", "required": ["text"], "optional": [], "fields": [("text", "assistant")]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def paths(value: Any) -> set[str]:
    """Leaf paths of a record; list elements are [] and an empty list is a path of its own."""
    found, open_ = set(), [(value, "")]
    while open_:
        value, at = open_.pop()
        if isinstance(value, dict):
            open_ += [(v, f"{at}.{k}" if at else k) for k, v in value.items()]
        elif isinstance(value, list) and value:
            open_ += [(v, f"{at}[]") for v in value]
        else:
            found.add(f"{at}[]" if isinstance(value, list) else at)
    return found


def fingerprint(found: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry(mappings: list[dict[str, Any]]) -> tuple[dict[str, dict[str, Any]], set[str]]:
    """Fingerprint -> mapping for each set of required and some optional paths, and all paths that a mapping names."""
    known: dict[str, dict[str, Any]] = {}
    named: set[str] = set()
    for m in mappings:
        named |= {*m["required"], *m["optional"]}
        for n in range(len(m["optional"]) + 1):
            for some in itertools.combinations(m["optional"], n):
                known.setdefault(fingerprint([*m["required"], *some]), m)
        if "list" in m:
            named.add(m["list"][0] + "[]")
            known.setdefault(fingerprint([m["list"][0] + "[]"]), m)
    return known, named


def _get(value: Any, path: str) -> Any:
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: Any, m: dict[str, Any], roles: dict[str, str]) -> list[tuple[str, str]]:
    """The canonical (role, text) turns that a mapping reads from a record."""
    out = []
    for path, role in m.get("fields", m.get("first", [])):
        got = [_text(v) for v in (_get(record, p) for p in ((path,) if isinstance(path, str) else path)) if v is not None]
        if got:
            out.append((role, "\n\n".join(x for x in got if x)))
    if "list" in m:
        at, role, text = m["list"]
        for x in _get(record, at) or []:
            r = _text(_get(x, role))
            out.append((roles.get(r, r), _text(_get(x, text))))
    return out


def escape(text: str) -> str:
    """Text in which no control string can occur; see unescape."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the code-point spans of it that carry loss: the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|turn|>{escape(role)}<|text|>", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "<|end|>"]
        at += len(head) + len(body) + 7
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in formatted.split("<|end|>")[:-1]:
        role, _, text = part.removeprefix("<|turn|>").partition("<|text|>")
        out.append((unescape(role), unescape(text)))
    return out


def format_records(records: DataFrame, record: str = "record", mappings: list[dict[str, Any]] | None = None, roles: dict[str, str] | None = None) -> DataFrame:
    """records with _fingerprint, _layout, _formatted and _loss (spans of code points) for a column of JSON texts.

    Paths that no mapping names (ids, scores, extra fields) don't enter the fingerprint. A record whose
    fingerprint is unknown, that is null or no JSON, or nested too deep to be read, has layout null and an empty formatted text. Records
    are independent, so memory is bounded by a batch of them; a conversation is one record however long. An empty table gives no rows; an input column
    with one of the new names is replaced.
    """
    records = records.drop("_fingerprint", "_layout", "_formatted", "_loss")
    known, named = registry(MAPPINGS if mappings is None else mappings)
    alias = ROLES if roles is None else roles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b[record]:
                try:
                    value = json.loads(raw) if isinstance(raw, str) else None
                except (ValueError, RecursionError):
                    value = None
                print_ = fingerprint(paths(value) & named) if isinstance(value, dict) else None
                m = known.get(print_) if print_ else None
                try:
                    text, spans = render(turns_of(value, m, alias)) if m else ("", [])
                except RecursionError:
                    m, text, spans = None, "", []
                rows.append((print_, m and m["name"], text, [{"start": s, "end": e} for s, e in spans]))
            yield b.assign(**dict(zip(("_fingerprint", "_layout", "_formatted", "_loss"), map(list, zip(*rows)) if rows else ([], [], [], []))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", _fingerprint string, _layout string, _formatted string, _loss array<struct<start:int,end:int>>"
    return records.mapInPandas(run, schema)


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the turn rows of a conversation as one JSON record, by turn (nulls first), then role and text.

    A null text or role is empty; a null conv_id is a conversation; repeated rows are turns of their own.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select("conv_id", F.to_json(F.struct("turns")).alias("record"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what the formatted texts and their loss spans hold, parsed back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, loss in zip(b["_formatted"], b["_loss"]):
                turns = parse(text)
                masked = [unescape(text[x["start"] : x["end"]]) for x in loss]
                sha = lambda parts: hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, masked)), sha(masked), len(text)))
            names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            yield pd.DataFrame({key: b[key]} | dict(zip(names, map(list, zip(*rows)) if rows else [[] for _ in names])) | {"layout": b["_layout"]})

    kind = formatted.schema[key].dataType.simpleString()
    return formatted.mapInPandas(run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string")

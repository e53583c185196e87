"""Tokens, labels and names as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Four vocabularies of "nothing was recorded": each boundary has its own.
UNTYPED = frozenset("|nan|na|none|<na>|nat|null|n/a|__missing__".split("|"))
METADATA_MISSING = frozenset("|none|nan|null|n/a|na|<na>|nat".split("|"))
CELL_MISSING = frozenset("|.|-|–|nd|n.d|n.d.|na|n/a|nan|none|<na>|not tested|not determined".split("|"))
QC_UNTYPED = frozenset("|nan|na|none|<na>|n/a".split("|"))

#: Call vocabularies: canonical word -> the tokens read as it.
CALLS: dict[str, dict[str, str]] = {
    "clinical_sir": {"s": "s|susceptible", "r": "r|resistant", "i": "i|intermediate|susceptible increased exposure|susceptible, increased exposure"},
    "undeclared": {"s": "susceptible", "i": "intermediate", "r": "non-susceptible|nonsusceptible|resistant"},
    "wt_nwt": {"0": "wt|wild-type|wild type", "1": "nwt|non wild type|non-wild-type"},
    "binary": {"0": "0|0.0", "1": "1|1.0"},
}
POLICIES = ("non_susceptible", "drop", "susceptible")


def token(c: Column) -> Column:
    """Null as empty, else without outer blanks and in lower case."""
    return F.coalesce(F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def among(c: Column, words: frozenset[str]) -> Column:
    return token(c).isin(sorted(words))


def untyped(c: Column) -> Column:
    return among(c, UNTYPED)


def near_key(c: Column) -> Column:
    """Key under which identifiers count as near misses: blanks, case and leading zeros aside."""
    bare = F.lower(F.trim(c))
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), bare)


def canonical_call(c: Column, kind: str) -> Column:
    """The canonical word of a call, null if the vocabulary doesn't read it."""
    words = [(F.lit(t), F.lit(w)) for w, ts in CALLS[kind].items() for t in ts.split("|")]
    return F.element_at(F.create_map(*[x for pair in words for x in pair]), token(c))


def call_value(c: Column, kind: str, intermediate: str | None = None) -> Column:
    """0, 1 or null. The policy for intermediate calls defaults to non_susceptible for undeclared words, else susceptible."""
    word = canonical_call(c, kind)
    if kind in ("wt_nwt", "binary"):
        if intermediate is not None:
            raise ValueError("an intermediate policy applies to clinical_sir and undeclared calls only")
        return word.cast("double")
    policy = intermediate or {"undeclared": POLICIES[0]}.get(kind, POLICIES[2])
    if policy not in POLICIES:
        raise ValueError(f"unknown intermediate policy {policy!r}")
    middle = {"non_susceptible": F.lit(1.0), "susceptible": F.lit(0.0), "drop": F.lit(None).cast("double")}[policy]
    return F.when(word == "s", 0.0).when(word == "r", 1.0).when(word == "i", middle)


def call_meaning(c: Column, kind: str) -> Column:
    """What a call says, for telling repeated records apart: canonical word, unknown:token or missing."""
    return F.when(among(c, CELL_MISSING), "missing").otherwise(F.coalesce(canonical_call(c, kind), F.concat(F.lit("unknown:"), token(c))))


def fitting_kinds(tokens: list[str], declared: str | None = None) -> list[str]:
    """Vocabularies that read every one of the tokens."""
    read = {k: {t for ts in v.values() for t in ts.split("|")} for k, v in CALLS.items()}
    return [k for k, v in read.items() if k != declared and all(t in v for t in tokens)]


#: Codes of agents and the names they stand for; sorted, so that lookups and listings agree.
AGENTS = dict(
    pair.split("=")
    for pair in (
        "AMC=amoxicillin-clavulanate;AMK=amikacin;AMP=ampicillin;AMX=amoxicillin;AZM=azithromycin;CAZ=ceftazidime;CFX=cefoxitin;CHL=chloramphenicol;CIP=ciprofloxacin;CLI=clindamycin;COL=colistin;CRO=ceftriaxone;CTX=cefotaxime;DOX=doxycycline;"
        "ENR=enrofloxacin;ERY=erythromycin;FEP=cefepime;FFC=florfenicol;GEN=gentamicin;IPM=imipenem;KAN=kanamycin;LVX=levofloxacin;LZD=linezolid;MEM=meropenem;NAL=nalidixic acid;NEO=neomycin;OXA=oxacillin;PEN=penicillin;RIF=rifampicin;"
        "SMX=sulfamethoxazole;SPT=spectinomycin;STR=streptomycin;SXT=trimethoprim-sulfamethoxazole;TET=tetracycline;TGC=tigecycline;TIA=tiamulin;TIL=tilmicosin;TMP=trimethoprim;TOB=tobramycin;TUL=tulathromycin;VAN=vancomycin"
    ).split(";")
)


def unified_name(c: Column) -> Column:
    """A name without a method suffix in brackets, its spaces collapsed, read from its code where known; unknown names only lose outer blanks."""
    names = F.create_map(*[x for k, v in AGENTS.items() for x in (F.lit(k.lower()), F.lit(v))])
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*[\(\[][^\)\]]*[\)\]]\s*$", ""), r"\s+", " ")
    return F.coalesce(F.element_at(names, F.lower(bare)), F.element_at(names, F.lower(F.trim(c))), F.trim(c))


# dilution cells


def plain_signs(c: Column) -> Column:
    return F.translate(F.trim(c), "≤≥", "\u0001\u0002")


def cell_sign(c: Column) -> Column:
    s = F.replace(F.replace(F.trim(c), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    return F.regexp_extract(s, "^(<=|>=|<|>)", 1)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once however often f names it; as plain columns, each mention is computed anew, and nested ones multiply."""
    return F.element_at(F.transform(F.array(c), f), 1)


def cell_number(c: Column) -> Column:
    """The number of a cell without its sign: a sole decimal comma is a point, of a combination the first part counts; null if it isn't a number."""
    s = F.replace(F.replace(F.trim(c), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    s = F.trim(F.regexp_replace(s, "^(<=|>=|<|>)", ""))
    s = once(s, lambda s: F.when(s.rlike(r"^[0-9]+,[0-9]+$"), F.translate(s, ",", ".")).otherwise(s))
    s = once(s, lambda s: F.when(s.rlike(r"^[\deE.+-]+\s*/\s*[\deE.+-]+$"), F.trim(F.substring_index(s, "/", 1))).otherwise(s))
    return once(s, lambda s: F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double")))


MG_PER_L = frozenset("mg/l|mg/liter|mg/litre|mgl-1|ug/ml|µg/ml|μg/ml|mcg/ml".split("|"))


def unit_of(c: Column) -> Column:
    bare = F.regexp_replace(token(c), r"\s+", "")
    return F.when(among(c, METADATA_MISSING), "").when(bare.isin(sorted(MG_PER_L)), "mg/L").otherwise(F.trim(c))


def date_like(c: Column) -> Column:
    """Values that a spreadsheet has turned into a date (3-Mar for 3/3)."""
    mon = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    return F.lower(c).rlike(rf"^\s*(\d{{1,2}}[-/]{mon}|{mon}[-/]\d{{1,2}})\s*$")


def formula_safe(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula, behind an apostrophe; numbers stay."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & c.try_cast("double").isNull(), F.concat(F.lit("'"), c)).otherwise(c)

"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal them; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}+"
_ROWS = 500_000
_BLOCK = 256

# Possessive forms of the patterns, with the same matches: no class that is repeated holds what has to follow it, and a run that fails from its first
# character fails from every later one, so a match may start only at a run's edge or where the last match ended. They neither backtrack nor recurse.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}


def match_spans(text: Column, pattern: str) -> Column:
    """All leftmost matches as array<struct<start,end,value>>, in code points.

    Positions are running sums of the lengths of the pieces between matches and of the matches. Sums run inside blocks of 256 matches and then over
    blocks, as an accumulator that grows by a match a step is copied at each.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: F.struct(p.alias("gap"), v.alias("value")))
    kind = "array<struct<start:int,end:int,value:string>>"
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(_BLOCK)).cast("int")), lambda b: F.slice(pairs, b * F.lit(_BLOCK) + F.lit(1), F.lit(_BLOCK)))

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    summed = F.transform(blocks, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), one))
    ends = F.aggregate(summed, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
    moved = F.zip_with(summed, F.slice(ends, F.lit(1), F.size(summed)), lambda b, o: F.transform(b["out"], lambda m: F.struct((m["start"] + o).alias("start"), (m["end"] + o).alias("end"), m["value"].alias("value"))))
    return F.when(F.size(values) > 0, F.flatten(moved)).otherwise(F.array().cast(kind))


def _ip(v: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(999)) <= 255))


def _card(v: Column) -> Column:
    digits = F.translate(v, " -", "")
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % F.lit(2) == 0, d).when(d > 4, d * F.lit(2) - F.lit(9)).otherwise(d * F.lit(2))

    total = F.aggregate(F.sequence(F.lit(0), n - F.lit(1)), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(n.between(13, 19), total % F.lit(10) == 0).otherwise(F.lit(False))


def _phone(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """Of each kind array<struct<start,end,value>>: leftmost non-overlapping matches, without those that fail its test. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    digit = F.rlike(text, F.lit("[0-9]"))
    return {
        "email": F.when(F.contains(text, F.lit("@")), match_spans(text, PATTERNS["email"])).otherwise(none),
        "ip": F.when(digit, F.filter(match_spans(text, PATTERNS["ip"]), lambda m: _ip(m["value"]))).otherwise(none),
        "card": F.when(digit, F.filter(match_spans(text, PATTERNS["card"]), lambda m: _card(m["value"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(match_spans(text, PATTERNS["phone"]), lambda m: _phone(m["value"]))).otherwise(none),
    }


def _marked(spans: Column, mark: str, name: str, *more: str) -> Column:
    """Start, end, the mark under the name, and further fields of spans."""
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(mark).alias(name), *[m[x].alias(x) for x in more]))


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\P{L}+")), lambda t: t != "")


def disclosing_terms(docs: DataFrame, key: str, text: str, reach: int, least: int, generalise: float) -> DataFrame:
    """(_id, _same, _told): the terms that reveal a protected entity of a document and the share they tell, array<struct<t,share>>, of documents that have any.

    An entity is a base match (kind and text in lower case), a context the `reach` code points on either side of a place of it. With N documents, n_e of them with the entity, n_t
    with the term and n_et with the term in a context of the entity, the term tells PMI = log2(N n_et / (n_e n_t)) of the entity's information IC = log2(N / n_e). A term
    with PMI / IC >= `generalise` is told in all documents with the entity, if at least `least` documents and as many different contexts show it: a single
    place says nothing about the corpus, and copies of one context are one. All counts are over all documents; rows of one id and text are one document in each of them.
    """
    source = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = source.withColumns({f"_{k}": v for k, v in base_spans(F.col("_text")).items()})
    every = F.concat(*[_marked(F.col(f"_{k}"), k, "kind", "value") for k in KINDS])
    found = found.select("_id", "_text", every.alias("_all")).filter(F.size("_all") > 0)
    one = found.withColumn("_same", F.xxhash64("_text")).withColumn("_m", F.explode("_all"))
    lo = F.greatest(F.lit(0), F.col("_m.start") - F.lit(reach))
    left, right = F.col("_text").substr(lo + 1, F.col("_m.start") - lo), F.col("_text").substr(F.col("_m.end") + 1, F.lit(reach))
    one = one.withColumns({"_lo": lo, "_left": left, "_right": right, "_n": F.length("_text")})
    # words cut by the edge of a context are left out
    head = F.filter(match_spans(F.col("_left"), TERM), lambda m: (m["start"] > 0) | (F.col("_lo") == 0))
    tail = F.filter(match_spans(F.col("_right"), TERM), lambda m: (m["end"] < F.length("_right")) | (F.col("_m.end") + F.lit(reach) >= F.col("_n")))
    moved = lambda spans, by: F.transform(spans, lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), F.lower(m["value"]).alias("term")))
    near = F.concat(moved(head, F.col("_lo")), moved(tail, F.col("_m.end")))
    near = F.array_distinct(F.transform(F.filter(near, lambda t: ~_hit(t, F.col("_all"))), lambda t: t["term"]))
    entity = F.concat(F.col("_m.kind"), F.lit(":"), F.lower(F.col("_m.value")))
    context = F.xxhash64("_left", "_right")
    places = staged(one.select("_id", "_same", entity.alias("e"), context.alias("c"), near.alias("near")), "places")
    seen = places.select("_id", "_same", "e", "c", F.explode("near").alias("t"))
    doc = F.struct("_id", "_same")
    # distinct documents and contexts by two levels of grouping, so that no hot pair needs a set in one task
    docs_et = seen.select("e", "t", doc.alias("d")).distinct().groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= least)
    shown = seen.select("e", "t", "c").distinct().groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_c")).filter(F.col("n_c") >= least)
    pairs = staged(docs_et.join(shown, ["e", "t"]), "pairs")
    entities = places.select("_id", "_same", "e").distinct()
    n_e = entities.groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    wanted = pairs.select("t").distinct()
    small = wanted.count() <= _ROWS
    # a row that is there c times counts 1 / c, so that no text has to be sent to its copies
    rows = staged(source.groupBy("_id", F.xxhash64("_text").alias("_same")).agg(F.count(F.lit(1)).alias("_c")), "rows")
    total = float(rows.count())
    again = rows.filter("_c > 1").withColumnsRenamed({"_id": "_again", "_same": "_as"})
    repeats = again.count()
    weighed = source.withColumn("_w", F.lit(1.0))
    if repeats:
        side = F.broadcast(again) if repeats <= _ROWS else again
        weighed = source.withColumn("_h", F.xxhash64("_text")).join(side, F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_h") == F.col("_as")), "left").withColumn("_w", F.coalesce(F.lit(1.0) / F.col("_c"), F.lit(1.0)))
    words = weighed.select("_w", F.explode(terms(F.col("_text"))).alias("t")).join(F.broadcast(wanted) if small else wanted, "t", "left_semi")
    n_t = words.groupBy("t").agg(F.round(F.sum("_w")).alias("n_t"))
    share = F.log2(F.lit(total) * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t"))) / F.log2(F.lit(total) / F.col("n_e"))
    judged = pairs.join(n_e, "e").join(n_t, "t").filter(F.col("n_e") < F.lit(total)).withColumn("share", share).filter(F.col("share") >= generalise).select("e", "t", "share")
    judged = staged(judged, "judged")
    told = F.broadcast(judged) if judged.count() <= _ROWS else judged
    hits = entities.join(told, "e").groupBy("_id", "_same", "t").agg(F.max("share").alias("share"))
    return hits.groupBy("_id", "_same").agg(F.sort_array(F.collect_list(F.struct("t", "share"))).alias("_told"))


def _hit(m: Column, spans: Column) -> Column:
    return F.exists(spans, lambda o: (o["start"] < m["end"]) & (o["end"] > m["start"]))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 80, least: int = 2, generalise: float = 0.6, remove: float = 0.9) -> DataFrame:
    """docs with email, ip, card and phone (array<struct<start,end,value>>), terms (array<struct<start,end,share>>) and sanitised, the text with them taken out.

    Base matches become their tag. Terms that tell a share >= `generalise` of the information of an entity of the document (see disclosing_terms; they are learned near its places)
    become [TERM] wherever they stand in it, those of a share >= `remove` go. Overlapping places are taken out once, as the first of them. Positions are code points, ends exclusive.
    The terms join the texts by a broadcast while they are of at most 500,000 documents, else by a shuffle.
    A null text is empty with no places (sanitised stays null); repeated rows get one result each; null ids are an id like others; an empty table gives no rows; an input column with one
    of the new names, or one of them after an underscore, is replaced.
    """
    new = (*KINDS, "terms", "sanitised", "h", "id", "same", "told")
    docs = docs.drop(*new[:6], *[f"_{n}" for n in new])
    shown = staged(disclosing_terms(docs, key, text, reach, least, generalise), "terms")
    side = F.broadcast(shown) if shown.count() <= _ROWS else shown
    same = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    out = docs.withColumns({f"_{k}": v for k, v in base_spans(F.col(text)).items()}).withColumn("_h", same)
    out = out.join(side, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_same")), "left").drop("_id", "_same", "_h")
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    share = lambda v: F.get(F.filter(F.col("_told"), lambda x: x["t"] == F.lower(v)), F.lit(0))["share"]
    placed = F.transform(match_spans(F.coalesce(F.col(text), F.lit("")), TERM), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), share(m["value"]).alias("share")))
    placed = F.filter(placed, lambda m: m["share"].isNotNull() & ~F.exists(F.array(*[F.col(f"_{k}") for k in KINDS]), lambda spans: _hit(m, spans)))
    out = out.withColumn("_terms", F.when(F.col("_told").isNotNull(), placed).otherwise(none)).drop("_told")
    tagged = [_marked(F.col(f"_{k}"), TAGS[k], "tag") for k in KINDS]
    words = F.transform(F.col("_terms"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(m["share"] >= remove, F.lit("")).otherwise(F.lit(TAGS["term"])).alias("tag")))
    spans = F.array_sort(F.concat(*tagged, words))

    def put(acc: Column, m: Column) -> Column:
        added = F.struct(F.concat(acc["out"], F.col(text).substr(acc["at"] + 1, F.greatest(F.lit(0), m["start"] - acc["at"])), m["tag"]).alias("out"), m["end"].alias("at"))
        return F.when(m["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], m["end"]).alias("at"))).otherwise(added)

    cut = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put, lambda acc: F.concat(acc["out"], F.col(text).substr(acc["at"] + 1, F.length(text))))
    out = out.withColumn("sanitised", F.when(F.size(spans) == 0, F.col(text)).otherwise(cut))
    return out.withColumnsRenamed({f"_{k}": k for k in KINDS} | {"_terms": "terms"})


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))

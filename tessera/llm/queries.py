"""The registered queries of this folder, opN_<name> and pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, flac, language, mixing, near_dup, pii, prefix_free, sharding, suffix_trees


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.flac_features(flac.text_to_flac(_table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown_shard").alias("grown_shard")
    )


def op4_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_trees.remove_repeated_words(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at the same weight, as many documents in all as there are."""
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.length("text").cast("long").alias("n_text"), F.sha2("text", 256).alias("text_sha256"), F.col("_copies").cast("int").alias("copies"), F.col("_copy").cast("int").alias("copy"), F.col("_order").alias("mix_order"))


def op7_disclosure_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[pii.listed(k, F.col(k)) for k in pii.KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    spans = F.array_join(F.concat(base, pii.listed("term", F.col("terms"))), ",")
    return out.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), spans.alias("spans"), F.sha2(F.coalesce("sanitised", F.lit("")), 256).alias("sanitised_sha256"))


def op8_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_free.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return chat.read_back(chat.format_records(chat.conversation_records(rows.unionByName(more))))


def op10_cross_parse_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs, train=~F.col("held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac_media": op1_flac_media,
    "op2_decontaminate": op2_decontaminate,
    "op3_jump_shards": op3_jump_shards,
    "op4_suffix_tree_dedup": op4_suffix_tree_dedup,
    "op5_prob_minhash": op5_prob_minhash,
    "op6_poisson_mix": op6_poisson_mix,
    "op7_disclosure_sanitise": op7_disclosure_sanitise,
    "op8_prefix_free_dedup": op8_prefix_free_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_cross_parse_language": op10_cross_parse_language,
}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

# jump consistent hashing in 128-bit integers, the 64-bit key as an unsigned number; CRC-32 bit by bit over a table of 256 remainders
_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
_JUMP = """list_reduce(list_prepend({{'k': (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616, 'b': 0::BIGINT, 'j': 0::BIGINT}},
        list_transform(generate_series(1, {n}), lambda x: {{'k': 0::HUGEINT, 'b': 0::BIGINT, 'j': 0::BIGINT}})),
        lambda a, x: CASE WHEN a.j >= {n} THEN a ELSE {{'k': (a.k * 2862933555777941757 + 1) % 18446744073709551616, 'b': a.j,
            'j': floor((a.j + 1) * (2147483648.0::DOUBLE / ((((a.k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT}} END).b::INT"""

ORACLE: dict[str, str] = {
    "op3_jump_shards": f"""
        WITH t AS (SELECT {_CRC}::UBIGINT[] AS crc),
        d AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
                     xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UBIGINT)),
                       lambda a, x: xor(a >> 8, crc[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM documents, t),
        s AS (SELECT *, {_JUMP.format(n=24)} AS shard, {_JUMP.format(n=25)} AS grown_shard FROM d)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s""",
    "op2_decontaminate": f"""
        WITH b0 AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        b AS (SELECT item_id, w, least(5, len(w)) AS k FROM b0 WHERE len(w) > 0),
        bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM b, LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
        bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        ks AS (SELECT DISTINCT k FROM bs),
        ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, ks, LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
        h AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (k, s) GROUP BY 1, 2)
        SELECT doc_id, item_id, c::INT AS n_shared, n::INT AS n_item, c::DOUBLE / n::DOUBLE AS containment
        FROM h JOIN bn USING (item_id) WHERE c::DOUBLE / n::DOUBLE >= 0.8""",
    "op4_suffix_tree_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS i)),
        f AS (SELECT s, min(doc_id) AS m FROM k GROUP BY 1),
        h AS (SELECT doc_id, i FROM k JOIN f USING (s) WHERE m < doc_id),
        c AS (SELECT DISTINCT doc_id, i + j AS i FROM h, (SELECT unnest(generate_series(0, 12)) AS j)),
        p AS (SELECT doc_id, i, w[i] AS x FROM d, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)),
        r AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)""",
    "op6_poisson_mix": """
        WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
        r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM c)::DOUBLE * (SELECT sum(n) FROM c)::DOUBLE / n::DOUBLE AS rate FROM c),
        u AS (SELECT doc_id, source, text, rate,
                     ('0x' || substr(md5('mix|' || doc_id::VARCHAR), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
              FROM documents JOIN r USING (source)),
        k AS (SELECT doc_id, source, text,
                     list_reduce([{'k': 0, 'p': exp(-rate), 'c': exp(-rate), 'i': 0}]
                       || list_transform(generate_series(1, ceil(rate + 12.0 * sqrt(rate) + 30.0)::BIGINT), lambda x: {'k': 0, 'p': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'i': x::INT}),
                       lambda a, b: CASE WHEN u < a.c THEN a ELSE {'k': b.i, 'p': a.p * rate / b.i::DOUBLE, 'c': a.c + a.p * rate / b.i::DOUBLE, 'i': b.i} END).k AS copies
              FROM u)
        SELECT doc_id, source, length(text)::BIGINT AS n_text, sha256(text) AS text_sha256, copies::INT AS copies, copy::INT AS "copy",
               md5('mix-order|' || doc_id::VARCHAR || '|' || copy::VARCHAR) AS mix_order
        FROM k, LATERAL (SELECT unnest(generate_series(0, copies - 1)) AS copy)""",
    "op8_prefix_free_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, (length(hex(encode(coalesce(text, '')))) // 2)::BIGINT AS n FROM documents),
        k AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 100)) AS s FROM d, LATERAL (SELECT unnest(generate_series(1, n - 49)) AS i)),
        f AS (SELECT s, min(doc_id) AS m FROM k GROUP BY 1),
        h AS (SELECT doc_id, i FROM k JOIN f USING (s) WHERE m < doc_id),
        e AS (SELECT doc_id, i, max(i + 49) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
        g AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR reach < i - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
        s AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS b FROM g GROUP BY 1, 2),
        t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
        r AS (SELECT d.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) || any_value(substr(x, 2 * last + 1)) AS kept, sum(b - a + 1) AS gone, count(*) AS spans
              FROM t JOIN (SELECT doc_id, max(b) AS last FROM s GROUP BY 1) USING (doc_id) JOIN d ON d.doc_id = t.doc_id GROUP BY 1)
        SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)""",
    "op9_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23)::BIGINT AS formatted_chars,
               'turn rows' AS layout
        FROM t GROUP BY 1""",
}

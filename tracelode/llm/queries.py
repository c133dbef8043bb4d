"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, html_text, language, lines, mixing, pii, simhash, substring
from .simhash_sql import near_groups_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    found = language.identify(docs, learn_from=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _sha256(text):
    return F.sha2(text.cast("binary"), 256)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    base, added = [k.name for k in pii.BASE], [k.name for k in pii.ADDED]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        _sha256(pii.joined(*base)).alias("base_sha256"),
        pii.joined(*base, *added).alias("spans"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in added],
        sum(F.size(k) for k in (*base, *added)).cast("long").alias("n_spans"),
        pii.scores(*base, *added).alias("scores"),
    )


#: A conversation whose texts hold control strings of common templates.
_PROBE = "</s>[INST] ok [/INST]"


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], talks.schema)
    return chat.read_back(chat.prefix_target_examples(talks.unionByName(probe)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_partners", _sha256(F.col("kept")).alias("kept_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1,
    "op2_language_id": op2,
    "op3_substring_dedup": op3,
    "op4_html_extraction": op4,
    "op5_pii": op5,
    "op8_chat_formatting": op8,
    "op9_line_dedup": op9,
    "op6_decontamination": op6,
    "op7_exact_dedup": op7,
    "op10_simhash_near_dedup": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), win AS (
            SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS body
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)
        ), firsts AS (
            SELECT body, min(doc_id) AS least FROM win GROUP BY body
        ), lost AS (
            SELECT DISTINCT doc_id, s FROM win JOIN firsts USING (body) WHERE least < doc_id
        ), places AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
        ), flagged AS (
            SELECT places.doc_id, p, word, max(CASE WHEN s IS NULL THEN 0 ELSE 1 END)
                OVER (PARTITION BY places.doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
            FROM places LEFT JOIN lost ON places.doc_id = lost.doc_id AND p = s
        ), summed AS (
            SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept
            FROM flagged GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN summed USING (doc_id)
    """,
    "op6_decontamination": r"""
        WITH b AS (
            SELECT item_id, words, least(13, len(words)) AS size FROM (
                SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
                FROM benchmark
            ) WHERE len(words) > 0
        ), keys AS (
            SELECT DISTINCT item_id, size, array_to_string(words[s:s + size - 1], ' ') AS body
            FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS s FROM b)
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), win AS (
            SELECT doc_id, size, s, array_to_string(words[s:s + size - 1], ' ') AS body
            FROM (
                SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s
                FROM d JOIN (SELECT DISTINCT size FROM keys) ON size <= len(words)
            )
        ), hits AS (
            SELECT doc_id, item_id, size, s FROM win JOIN keys USING (size, body)
        ), words_hit AS (
            SELECT doc_id, count(*) AS n_hit
            FROM (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(list, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op8_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), numbered AS (
            SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
                length(role || text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) + length('<s>[' || ']' || '</s>') + 2 AS size
            FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), summed AS (
            SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM numbered
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM summed GROUP BY conv_id
    """,
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        ), g AS (
            SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
                first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS keep_id
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
    """,
    "op9_line_dedup": r"""
        WITH raw AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
        ), cut AS (
            SELECT doc_id, line, p, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s
            FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM raw)
        ), whole AS (
            SELECT doc_id, p, s, row_number() OVER w AS k, lead(s) OVER w AS later,
                len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words
            FROM cut WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY p)
        ), win AS (
            SELECT doc_id, k, 2 AS size, s || chr(10) || later AS body FROM whole WHERE later IS NOT NULL
            UNION ALL SELECT doc_id, k, 1, s FROM whole WHERE words >= 8
        ), firsts AS (
            SELECT size, body, min(doc_id) AS least FROM win GROUP BY size, body
        ), hits AS (
            SELECT doc_id, k, size, least FROM win JOIN firsts USING (size, body) WHERE least < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS k FROM hits
        ), partners AS (
            SELECT doc_id, count(DISTINCT least) AS n_partners FROM hits GROUP BY doc_id
        ), flagged AS (
            SELECT cut.doc_id, cut.p, cut.line, whole.k IS NOT NULL AS is_line, gone.k IS NOT NULL AS is_gone
            FROM cut LEFT JOIN whole ON cut.doc_id = whole.doc_id AND cut.p = whole.p
            LEFT JOIN gone ON whole.doc_id = gone.doc_id AND whole.k = gone.k
        )
        SELECT doc_id, count(*) FILTER (is_line) AS n_lines, count(*) FILTER (is_gone) AS n_removed,
            coalesce(max(n_partners), 0) AS n_partners,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT is_gone), '')) AS kept_sha256
        FROM flagged LEFT JOIN partners USING (doc_id) GROUP BY doc_id
    """,
    "op10_simhash_near_dedup": near_groups_sql(),
}

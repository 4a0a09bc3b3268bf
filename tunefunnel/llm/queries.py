"""The registered corpus queries, one for each operator, over whole tables, and
their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, byte_pairs, exact_dedup, language_id, lexical_search, nearest, packing, sentence_pieces,
               simhash, substring_dedup, token_counts, url_rules, warc)
from .common import table

#: Tokenizer files of the queries.
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups of all documents."""
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return nearest.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.train(docs.filter(~language_id.held_out()))
    return language_id.predict(
        docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by explicit and mined rules."""
    return url_rules.judge(table(spark, sf_dir, "pages", "page_id", "url"),
                           table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a merge-type vocabulary."""
    out = sentence_pieces.encoded(table(spark, sf_dir, "documents", "doc_id", "text"), PIECES)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), "checked")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), WORDS)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated passages of 35 words cover."""
    out = substring_dedup.cut(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the index."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.round_trip(spark, pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens along the curve."""
    return packed_digest(packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), WORDS))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.ranked(table(spark, sf_dir, "documents", "doc_id", "text"),
                                 table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a byte-level vocabulary."""
    out = byte_pairs.encoded(table(spark, sf_dir, "documents", "doc_id", "text"), BYTES)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two vocabularies in groups, with the corpus
    counts of the id pairs that they link."""
    out = alignment.Alignment(table(spark, sf_dir, "documents", "doc_id", "text"), BYTES, PIECES).scored()
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_nearest, op3_language_id, op4_url_filter, op5_sentencepiece, op6_token_counts, op7_simhash,
    op8_substring_dedup, op9_warc, op10_packing, op11_lexical_search, op12_byte_bpe, op13_token_alignment)}

ORACLE = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS sha
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id,
               count(*) OVER (PARTITION BY sha) AS group_size,
               doc_id = first_value(doc_id) OVER g AS kept, sha AS text_sha256
        FROM t WINDOW g AS (PARTITION BY sha ORDER BY n DESC, doc_id)
    """,
    "op8_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        windows AS (
            SELECT r, s, array_to_string(w[s:s + 34], ' ') AS k
            FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
        repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
        covered AS (
            SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM windows WHERE k IN (SELECT k FROM repeated)),
        words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
            FROM words ANTI JOIN covered USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op9_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n,
                   sha1(coalesce(html, '')) AS h
            FROM pages),
        best AS (SELECT t, max(page_id) AS id FROM p GROUP BY t)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> id THEN id END AS refers_to
        FROM p JOIN best USING (t)
    """,
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents),
        i AS (
            SELECT item_id, row_number() OVER () AS q, list_distinct(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark),
        asked AS (SELECT q, item_id, unnest(t) AS term FROM i),
        total AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
        tf AS (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
            WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
        lengths AS (
            SELECT r, doc_id, 100 - 90 + ((90 * CAST(len(t) AS BIGINT) * n) // l) AS m FROM d, total WHERE len(t) > 0),
        scores AS (
            SELECT q, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (r)
            GROUP BY q, item_id, r, doc_id),
        places AS (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM places WHERE rank <= 10
    """,
}

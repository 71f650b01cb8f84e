"""The operators over the whole sample tables, as the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afluente.llm.chat import format_conversations, read_conversations
from afluente.llm.crosstokens import score_links
from afluente.llm.decontaminate import contaminated
from afluente.llm.digest import fingerprint_documents
from afluente.llm.interactions import audit_filters
from afluente.llm.ledger import BASE, STANDARD, apply_policies, ledger
from afluente.llm.lines import drop_repeated_lines
from afluente.llm.pii import KINDS, find_pii, spans_as_text
from afluente.llm.pii import train as train_pii
from afluente.llm.pieces import summarise_encoding
from afluente.llm.quality import score_quality, train
from afluente.llm.simhash import near_duplicates
from afluente.llm.suffixes import remove_repeats
from afluente.llm.tokenfiles import token_checksums, write_token_files
from afluente.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op10_document_digest(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(table(spark, folder, "documents"))


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return summarise_encoding(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = """
WITH cut AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), line AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM cut
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM line
), shared AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.*, coalesce(k.doc_id < s.last, false) AS dropped FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = write_token_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_checksums(files)


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return score_quality(documents, train(documents, table(spark, folder, "labels")))


@query
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    tricky = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_conversations(format_conversations(conversations.unionByName(more)))


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = find_pii(documents, train_pii(documents))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_as_text("base"), 256).alias("base_sha256"), spans_as_text("spans").alias("spans"))


@query
def op11_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    judged = apply_policies(written(ledger(table(spark, folder, "documents"))), (BASE, STANDARD))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base_kept, kept = F.col("kept_base"), F.col(f"`kept_{STANDARD.version}`")
    return judged.select("doc_id", *measures, (~base_kept).alias("base_failed"), (base_kept & kept).alias("kept"))


ORACLES["op11_rule_ledger"] = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
), place AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS spot FROM cut
), passage AS (
    SELECT doc_id, spot, count(*) OVER (
        PARTITION BY doc_id, words[spot], words[spot + 1], words[spot + 2], words[spot + 3], words[spot + 4]) AS times
    FROM place
), repeated AS (
    SELECT doc_id, count(DISTINCT spot + k) AS n FROM passage, range(5) r(k) WHERE times > 1 GROUP BY doc_id
), measured AS (
    SELECT c.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct,
        len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
    FROM cut c LEFT JOIN repeated r ON r.doc_id = c.doc_id
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_capitals > 40 * word_chars OR word_chars < 2 * n_words
        OR word_chars > 20 * n_words OR (n_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines)
        OR (n_words >= 50 AND 100 * n_distinct < 15 * n_words)) AS kept
FROM judged
"""


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    vocabularies = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return score_links(table(spark, folder, "documents"), *vocabularies)


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLES["op13_filter_audit"] = """
WITH letter AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), filter_orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), cut AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), label AS (
    SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
        CASE WHEN len(words) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
        CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
        CASE WHEN cut.doc_id > min(cut.doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails
    FROM cut LEFT JOIN label ON label.doc_id = cut.doc_id
), kind AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
    FROM judged GROUP BY part, fails
), step AS (
    SELECT kind.*, filter_order, step, contains(fails, filter_order[step]) AS hit,
        regexp_matches(fails, '[' || filter_order[:step - 1] || '-]') AS gone, filter_order[step] AS own
    FROM kind, filter_orders, range(1, 6) s(step)
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * 120 // nullif(length(fails), 0)) FILTER (WHERE hit), 0)::BIGINT AS shapley
FROM step GROUP BY part, filter_order, step
"""

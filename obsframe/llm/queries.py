"""Registered queries of the operators over the given tables, and their SQL text."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm.bpe import encode_documents, ids_sha256
from obsframe.llm.filter_audit import MEASURES, audit_filters
from obsframe.llm.host_rules import COUNTS, judge_documents
from obsframe.llm.line_dedup import dedup_lines
from obsframe.llm.neighbours import nearest_rows
from obsframe.llm.ngram_join import join_documents
from obsframe.llm.packing import pack_documents
from obsframe.llm.passages import quality_scorer
from obsframe.llm.pseudo_likelihood import score_documents
from obsframe.llm.samples import held_out
from obsframe.llm.search import search_documents
from obsframe.llm.sentence_pieces import decimal_sha256, encode_pieces
from obsframe.llm.tables import shared_folder
from obsframe.llm.token_files import ids_crc32, read_tokens, with_starts, write_tokens
from obsframe.llm.toxicity import toxicity_scorer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))


def op2_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_documents(table(spark, folder, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_folder(spark)
    write_tokens(table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return with_starts(read_tokens(spark, files), ids_crc32("tokens").alias("ids_crc32"))


def scored(docs: DataFrame, score: Callable[[Column], Column], least: float) -> DataFrame:
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scored(docs, toxicity_scorer(docs, table(spark, folder, "labels")), 0.5)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs, added = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", f"{added}.n_lines", f"{added}.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    hashes = ids_sha256("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *hashes)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scored(docs, quality_scorer(docs, table(spark, folder, "labels")), 0.3)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_rows(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return join_documents(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels")).select("part", "filter_order", "step", *MEASURES)


def op12_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_pieces(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    hashes = decimal_sha256("ids").alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *hashes)


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op2_host_rules"] = f"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words) WHERE length(trim(line, {BLANK})) > 0 GROUP BY doc_id),
counts AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
rules AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
failures AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 20 * n_dup_lines > n_words AS failed FROM rules),
hosts AS (SELECT source, count(*) AS n, sum(failed::INT) AS f FROM failures GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
strength AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1000.0) ELSE 1000.0 END AS s FROM prior),
verdicts AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS bad FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM failures JOIN verdicts ON failures.source IS NOT DISTINCT FROM verdicts.source
"""

LINES = f"""
lines AS (SELECT doc_id, pos, line, translate(trim(line, {BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, l AS line, p AS pos FROM (SELECT doc_id, unnest(s) AS l, unnest(range(len(s))) AS p
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
repeated AS (SELECT key, max(doc_id) AS kept_in FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, pos, line, kept_in IS NOT NULL AND doc_id <> kept_in AS gone FROM lines LEFT JOIN repeated USING (key))"""
ORACLES["op5_line_dedup"] = f"""
WITH {LINES}
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLES["op11_filter_audit"] = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
fails AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
  100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM texts),
marks AS (SELECT part, [a, b, c, d, e] AS f, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM fails LEFT JOIN labels USING (doc_id)),
patterns AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM marks GROUP BY part, f),
letters AS (SELECT range AS i FROM range(1, 6)),
orders AS (SELECT [v.i, w.i, x.i, y.i, z.i] AS o FROM letters v, letters w, letters x, letters y, letters z WHERE len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5),
steps AS (SELECT o, i AS step, o[i] AS k, list_aggregate([chr((64 + j)::INT) FOR j IN o], 'string_agg', '') AS filter_order FROM orders, letters),
counts AS (SELECT part, filter_order, step, k,
  sum(n) FILTER (NOT gone AND NOT f[k]) AS kept, sum(n) FILTER (NOT gone AND f[k]) AS removed, sum(n) FILTER (gone AND f[k]) AS redundant,
  sum(n) FILTER (f[k] AND len([x FOR x IN f IF x]) = 1) AS unique_fails, sum(good) FILTER (NOT gone AND f[k]) AS good_lost, sum(bad) FILTER (NOT gone AND f[k]) AS toxic_lost
  FROM (SELECT *, coalesce(list_bool_or([f[j] FOR j IN o[:step - 1]]), false) AS gone FROM patterns, steps) GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley FROM counts
"""

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES["op13_lexical_search"] = f"""
WITH terms AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{TERM}')), {LOWER}) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, translate(unnest(regexp_extract_all(text, '{TERM}')), {LOWER}) AS term FROM benchmark) GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY term, all_docs),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * all_docs) // all_terms))) AS impact
  FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(often * impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""

for _query in (op1_pseudo_likelihood, op2_host_rules, op3_token_files, op4_toxicity, op5_line_dedup, op6_byte_bpe, op7_quality, op8_packing, op9_neighbours, op10_ngram_join, op11_filter_audit, op12_sentence_pieces, op13_lexical_search):
    QUERIES[_query.__name__] = _query

QUERIES["pipeline"] = corpus_pipeline.run

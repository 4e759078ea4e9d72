"""The registered queries of the corpus operators: thin calls with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, collocations, contentsort, decontaminate, licenses, mixing, pii, repetition, secrets, simhash, tokens, toxicity, whitening
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.findings(table(spark, sf_dir, "documents"))
    counts = [pii.how_many(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, lanes=1, radius=3)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_turns(rows))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, _ = mixing.mixed_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rates


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.contamination(docs, decontaminate.searchers(docs, table(spark, sf_dir, "benchmark")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_pii": op1_pii, "op2_simhash": op2_simhash, "op3_tokens": op3_tokens, "op4_secrets": op4_secrets, "op5_chat": op5_chat, "op6_quality": op6_quality, "op7_mixing": op7_mixing, "op8_toxicity": op8_toxicity, "op9_decontamination": op9_decontamination, "op10_licenses": op10_licenses, "op11_collocations": op11_collocations, "op12_content_sort": op12_content_sort, "op13_whitening": op13_whitening}
_SPACE = r"[\x20\x09-\x0D]"
#: For those that SQL can say.
SQL: dict[str, str] = {
    "op11_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM starts, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w)
), f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY lang, phrase, k
), total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS tail
  FROM (SELECT lang, phrase, a, k, unnest(range(1, k)) AS c FROM cand)
), scores AS (
  SELECT u.lang, u.phrase, u.a, u.c, x.a AS l, y.a AS r, (1000000::HUGEINT * u.a * u.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.head JOIN f y ON y.lang = u.lang AND y.phrase = u.tail
), weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (
  SELECT lang, max(a) AS longer, part FROM (
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS part FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(string_split(phrase, ' ')[2:3], ' ') FROM cand WHERE k = 3
  ) GROUP BY lang, part
), ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, w.l, w.r, w.score
  FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.part = w.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * w.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_content_sort": rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256 FROM t""",
}

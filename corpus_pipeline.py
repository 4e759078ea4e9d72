"""A training corpus from ``documents``: toxic texts out, one of each near-duplicate group, no benchmark leaks, mixed, as token ids.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever they are called, and their rows unchanged.

Defined results: null and empty texts are not toxic and hold no leak; all texts without words are one group, of which the smallest id stays; rows with a null
``doc_id`` are kept like others and come last in their group; of repeated rows one stays; very long texts are read whole by every stage; an
empty table stays empty. Mixing repeats rows and drops none. The last stage returns doc_id, start, n_tokens, ids_crc32, part and seq of every row that is left.
"""

from __future__ import annotations

import uuid
import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm import decontaminate, mixing, simhash, tokens, toxicity
from cairn.llm.common import shared_dir, table, written

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts linked by sets of five-word shingles with a Jaccard similarity of 0.8 or more, found by fingerprints of 256 bits; the smallest id of a group stays."""
    return simhash.one_of_each(docs, **simhash.SIMILAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, decontaminate.searchers(docs, table(spark, sf_dir, "benchmark")))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smoothed shares of the domains; no document is dropped, those of small domains stand up to four times; missed targets are a warning."""
    domains = mixing.fit_domains(docs, table(spark, sf_dir, "labels"))
    narrow = written(mixing.posteriors(docs, domains), "posteriors")
    mix = mixing.fit_mix(narrow, domains, grow=True, min_rate=1.0, max_rate=4.0)
    if missed := mix.missed():
        warnings.warn(f"domains off their target by this share of it: {missed}", stacklevel=2)
    return mixing.resampled(docs, mix)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_output(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each_group), ("decontamination", drop_leaks), ("mixing", mix_domains), ("tokens", token_ids)]

#: SQL has no classifiers, fingerprints or tokenizers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of training-data operators (part of crossgrain.llm).

Quality rules, language ID, near-duplicates, mixing and BPE, in this order. Every stage works on all
rows that the stage before it kept and is written as Parquet before the next one starts, so a lost
executor never repeats a stage. What a stage wrote goes once the next one is written; the last is left.
The first three only drop documents; mixing draws every document once at least and small sources more
often; the last returns token ids and digests.

Edge cases: a null or empty text fails the quality rules and goes; a text without a letter goes at
language ID, as does one of which the language that it declares makes up under `DECLARED`; without a
declared language that was learned, one in several learned languages stays; rows without doc_id are never near-duplicates
and stay; of rows that share a doc_id the least stays, of a near-duplicate class the least doc_id;
ties in hashes go together; a null source counts as the source ''; very long texts pass every stage
whole; extra columns come along up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossgrain.llm import bpe, dedup, language_id, mixing, quality_rules
from crossgrain.llm.common import Temporary, materialize, table

#: Entropy of the mix, as a share of the most possible, and passes over a source at most.
EVENNESS, REPETITIONS = 0.98, 2.0
#: Least share of a text that the language in its `lang` makes up: with less, the label doesn't say what the text is.
DECLARED = 0.65


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit(docs), least=DECLARED, declared="lang")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, EVENNESS, REPETITIONS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, *bpe.default_vocabulary(), with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("minhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: SQL can express neither the hashes of the mix nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Temporary(spark) as written:
        for name, stage in STAGES:
            with Temporary(spark) as inside:
                after = materialize(stage(spark, docs, sf_dir), name)
                inside.keep(after)
            written.drop(docs)  # the stage before; nothing reads it any more
            docs = after
        written.keep(docs)
    return docs

"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm import bpe, chat, dedup, language_id, mixing, periodic, pu_quality, quality_rules, sharding, topk, toxicity, url_filter, whitening
from crossgrain.llm.common import held_out, pick, table


#: Fixed by the contract of the query: a conversation whose texts hold control strings.
CONTROL_TALK = (-7, "</s>[INST] ok [/INST]")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    conv, said = CONTROL_TALK
    extra = spark.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = talks.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digests(chat.format_conversations(turns))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *bpe.default_vocabulary())


#: Fixed by the contracts of the queries: scores from which a text counts as good, or as toxic.
GOOD_FROM, TOXIC_FROM = 0.7, 0.3


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).alias("predicted"))


#: The mix in production: entropy wanted, as a share of the most possible, and passes over a source at most.
EVENNESS, REPETITIONS = 0.98, 4.0


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.counted(table(spark, sf_dir, "documents"))
    budget = rows.agg(F.sum("tokens")).first()[0] or 0  # as many tokens as there are
    plan = mixing.planned(rows, EVENNESS, REPETITIONS, float(budget), seed=11)
    return mixing.draw(rows, plan, seed=11).select("doc_id", "source", "tokens", "epoch", "block", "draw_at")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumn("representative", F.col("doc_id") == F.col("class_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"), "clauses")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "languages", "proportions")


#: Shards of the production layout, all of one weight.
SHARD_WEIGHTS = (1.0,) * 24


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_records(table(spark, sf_dir, "documents"), "doc_id", "text", SHARD_WEIGHTS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


#: Fixed by the contract of the query: verdict, host and path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), [url_filter.rule(*r) for r in URL_RULES])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.planted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_bpe, op3_quality_classifier, op4_mixing, op5_minhash_near_dedup, op6_toxicity, op7_quality_rules, op8_exact_top_k, op9_language_id, op10_sharding, op11_embedding_whitening, op12_url_filters, op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": chat.SQL, "op7_quality_rules": quality_rules.SQL, "op8_exact_top_k": topk.SQL}

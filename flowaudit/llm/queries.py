"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowaudit.llm import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op2_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import token_store

    path = common.Workspace(spark, "token-ids").path("orc")
    token_store.write_token_ids(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_store.token_positions(spark, path)


@query
def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import ngram_join

    return ngram_join.jaccard_components(table(spark, folder, "documents"), words=4, percent=85)


@query
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import packing

    return packing.best_fit_packing(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import substring

    return substring.remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import decontamination

    return decontamination.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import vector_dedup

    return vector_dedup.near_duplicates(table(spark, folder, "embeddings"))


def remainder(n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import toxicity

    common.ship_package(spark)
    held = remainder(5) == 0
    scored = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import language

    common.ship_package(spark)
    held = remainder(3) == 1
    out = language.identify(table(spark, folder, "documents").select("doc_id", "text", "lang"), ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import pii

    return pii.span_digest(pii.find_personal_data(table(spark, folder, "documents")))


@query
def op3_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import fixity

    records = fixity.warc_records(table(spark, folder, "pages"))
    record = F.col("record")
    placed = fixity.placed(records, first=record, second=fixity.damaged(record, F.col("page_id")))
    placed = common.Workspace(spark, "fixity-leaves").table(placed, "leaves")
    sides = [placed.select("archive", "offset", F.col(n).alias("hash")) for n in ("first", "second")]
    return fixity.audit(*sides)


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import runs

    return runs.run_digest(runs.find_runs(runs.planted(table(spark, folder, "documents"))))


@query
def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import secrets

    return secrets.span_digest(secrets.find_secrets(table(spark, folder, "documents")))


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from flowaudit.llm import conversations

    original = table(spark, folder, "conversations")
    return conversations.repair_digest(original, conversations.repair(conversations.damaged(original)))

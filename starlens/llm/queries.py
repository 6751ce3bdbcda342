"""The operators over the test tables, as registered queries, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.llm import conversations, decontaminate, language, mixing, orderhash, packing, quality, repeats, sharding, simhash, suffixes, tokenfiles, toxicity
from starlens.llm.common import documents
from starlens.session import configure, work_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.removed(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predicted(docs, language.train(docs)).select("doc_id", "held_out", "lang_pred", "score", "spans")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = work_path(spark, "tokens")
    tokenfiles.write_tokens(documents(spark, sf_dir), target)
    return tokenfiles.read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.against_next(documents(spark, sf_dir))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("rate")


def damaged(conversations_: DataFrame) -> DataFrame:
    """Rows with planted faults, by a hash of their place: ``dropped`` ones, empty texts, texts without full stops, repeated rows, wrong roles."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.pmod(F.crc32(place.cast("binary")), F.lit(20))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations_.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = configure(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair(damaged(rows), dropped="dropped")


def op12_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.runs(documents(spark, sf_dir), planted=True)
    best = F.col("longest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_simhash_near_duplicates, op3_quality_rules, op4_suffix_array_dedup, op5_language_id,
    op6_token_files, op7_ordinal_toxicity, op8_extendible_sharding, op9_order_minhash, op10_poisson_mixing,
    op11_conversation_repair, op12_repeated_runs, op13_benchmark_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.rules_sql(), "op4_suffix_array_dedup": suffixes.removed_sql(),
            "op8_extendible_sharding": sharding.shards_sql(), "op10_poisson_mixing": mixing.mix_sql(),
            "op13_benchmark_decontamination": decontaminate.hits_sql()}

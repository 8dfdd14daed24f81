"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcube.llm import bpe, chat, filter_audit, kneser_ney, language_id, lexical, mixing, secrets, sharding, simhash, token_counts, topk, winnowing
from driftcube.llm.common import prepare, text_of
from driftcube.llm.oracle import oracle_sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def _is(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda s: s["kind"] != secrets.OWNED))
    kinds = F.transform("base", lambda s: s["kind"])
    of_kind = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select(
        "doc_id", *of_kind, F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"), live
    )


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.with_next_document(documents(spark, sf_dir), keep_text=False)
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(documents(spark, sf_dir))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", *bpe.digests())


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op6_capped_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}')")
    back = chat.read_back(chat.expanded(rows.union(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
        F.size("losses").cast("long").alias("n_examples"),
    )


def op8_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, "vec_id % 50 = 0")


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    model = kneser_ney.Classifier(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.judged(docs, pooled=True).select("doc_id", "lang", "length", "perplexity", "lowest", "highest", "keep")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir).select("doc_id", text_of().alias("text"))
    counted = token_counts.count_tokens(texts, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )


def op11_sparse_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_audit.audit(rows).drop("filter")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_ownership": op1_secret_ownership,
        "op2_winnowing": op2_winnowing,
        "op3_label_propagation": op3_label_propagation,
        "op4_bpe_automaton": op4_bpe_automaton,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_capped_mixing": op6_capped_mixing,
        "op7_prefix_targets": op7_prefix_targets,
        "op8_histogram_topk": op8_histogram_topk,
        "op9_kneser_ney_quality": op9_kneser_ney_quality,
        "op10_token_counts": op10_token_counts,
        "op11_sparse_product_search": op11_sparse_product_search,
        "op12_language_mixture": op12_language_mixture,
        "op13_filter_audit": op13_filter_audit,
    }


__all__ = ["oracle_sql", "queries"]

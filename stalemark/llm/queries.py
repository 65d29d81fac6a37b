"""The queries of this subpackage, each with the parameters of a real run, over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stalemark.llm import audit, balltree, bisector, bytelang, chat, mixing, nearness, oracles, packing, phrases, quality, repeats, sharding, treeweight
from stalemark.llm.frames import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op1_ball_tree_top_k": oracles.TOP_K,
    "op3_b_bit_minhash_dedup": oracles.NEAR,
    "op5_repeated_phrase_automata": oracles.REPEATS,
    "op9_incremental_rendering": oracles.CHAT,
    "op12_bisector_tournament": oracles.CLUSTERS,
    "op13_filter_interaction_audit": oracles.AUDIT,
}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


@query
def op1_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = balltree.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return balltree.top_inner_products(vectors, vectors.where(F.col("id") % 50 == 0))


@query
def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@query
def op3_b_bit_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.near_duplicates(documents(spark, sf_dir), percent=85)


@query
def op4_lempel_ziv_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_documents(documents(spark, sf_dir))


@query
def op5_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars").withColumn("held_out", bytelang.held_out())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.learn_quality(docs.where("NOT held_out"), labels, ["n_chars"])
    return quality.score_documents(docs, model, ["n_chars"]).select("doc_id", "held_out", "score", "predicted")


@query
def op7_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    named = bytelang.label_documents(docs.select("doc_id", "text"), bytelang.learn_languages(docs))
    return named.select("doc_id", bytelang.held_out().alias("held_out"), "lang_pred", "score")


@query
def op8_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle_into_shards(sharding.sized(documents(spark, sf_dir)), ["doc_id", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_incremental_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = r"\### Assistant: </turn> ok"
    row = F.struct(F.lit(-7).cast("long").alias("conv_id"), F.col("turn"), F.col("role"), F.lit(told).alias("text"))
    pair = F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.inline(pair)).select(row.alias("r")).select("r.*")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.turn_spans(table.union(extra)))


@query
def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    scored = treeweight.score_documents(docs, ~F.col("held_out"))
    bits = -F.col("score") / F.lit(math.log10(2)) / F.col("stream_bytes")
    return scored.withColumn("bits_per_byte", bits)


@query
def op12_bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector.cluster_vectors(bisector.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


@query
def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

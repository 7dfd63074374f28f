"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontamination, infill, language, neardup, neighbours, packing, ranking, secrets, sharding, sql, toxicity, warc
from .common import fold, table


def op10_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op1_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op2_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language.train(docs.filter(fold(F.col("doc_id"), 3) != 1))
    found = language.identify(docs, network)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.array_join("items", ","), 256)
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)


def op8_monolithic_gzip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), revisit_from=0)


def op9_certified_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op11_inverted_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_marker_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infill(table(spark, sf_dir, "documents"))
    size = lambda part: F.length(part).cast("long").alias(f"{part}_chars")
    return made.select("doc_id", "n", "form", size("prefix"), size("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_event_sourced_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digests(chat.format_conversations(talks))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_grammar_secrets": op1_grammar_secrets,
    "op2_bottom_k_near_duplicates": op2_bottom_k_near_duplicates,
    "op3_byte_cnn_language": op3_byte_cnn_language,
    "op4_gru_toxicity": op4_gru_toxicity,
    "op5_cross_polytope_neighbours": op5_cross_polytope_neighbours,
    "op6_winnowing_decontamination": op6_winnowing_decontamination,
    "op7_context_tree_weighting": op7_context_tree_weighting,
    "op8_monolithic_gzip_warc": op8_monolithic_gzip_warc,
    "op9_certified_best_fit": op9_certified_best_fit,
    "op10_kd_tree_sharding": op10_kd_tree_sharding,
    "op11_inverted_treap_search": op11_inverted_treap_search,
    "op12_marker_infill": op12_marker_infill,
    "op13_event_sourced_chats": op13_event_sourced_chats,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op11_inverted_treap_search": sql.RANKED,
    "op12_marker_infill": sql.INFILL,
    "op13_event_sourced_chats": sql.CHATS,
}

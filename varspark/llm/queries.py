"""The registered query of each operator: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varspark.llm import centroids, decontaminate, forest, jaccard, lm, middle, mixing, oracles, pieces, quality, secrets, sharding, suffixes, toxicity
from varspark.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels_outside(spark: SparkSession, sf_dir: str, column: str, n: int, fold: int) -> DataFrame:
    """(doc_id, label) of the rows of labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(crc_mod("doc_id", n) != fold).select("doc_id", F.col(column).cast("int").alias("label"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, labels_outside(spark, sf_dir, "quality", 4, 2))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.decode(pieces.encode(docs))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    scores = lm.score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, labels_outside(spark, sf_dir, "toxic", 5, 0))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = {f"n_{name}": secrets.count_of(F.col("base"), k) for k, name in enumerate(secrets.KINDS)}
    return scanned.select("doc_id", *(c.alias(name) for name, c in counts.items() if name != "n_random"), F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_sharding, op3_decontamination, op4_pieces, op5_lm_scores, op6_jaccard, op7_toxicity, op8_suffixes, op9_forest, op10_secrets, op11_centroids, op12_mixing, op13_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": oracles.sharding(), "op6_jaccard": oracles.jaccard(), "op8_suffixes": oracles.repeats(), "op9_forest": oracles.near_vectors(), "op11_centroids": oracles.clusters(), "op12_mixing": oracles.mix(), "op13_middle": oracles.middles()}

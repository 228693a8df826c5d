"""A corpus through five of the operators, each stage a table that the next one reads.

Every stage but the last returns the columns of documents, of all rows that it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, decontaminate, pii, simhash, toxicity
from scanloom.llm.queries import vocabulary_path
from scanloom.llm.shared import cut, free_name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.5 or more) go. Without labels of both classes
    there is no classifier, and all stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.constant is not None:
        return docs
    score = free_name(docs, "score")
    return toxicity.with_score(docs, model, out=score).where(F.col(score) < 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word Jaccard of 0.8 or more) stays: that with the
    smallest doc_id. Links come from op1's trie of fingerprints and an exact check, and from MinHash bands
    for the pairs that differ in more bits than a trie can look for."""
    return simhash.keep_one_similar(docs, width=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover to a twentieth of their words or more go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; n_chars follows the text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, four little-endian bytes each) and what they decode to, by its digest."""
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary_path(), out="token_ids")
    return both.select("doc_id", "lang", "source", "token_ids", bpe.n_tokens("token_ids").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", drop_benchmark), ("pii", mask_pii), ("bpe", encode)]

#: The stages are no SQL (a trained network, XXH64 fingerprints, merges); each is tested by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

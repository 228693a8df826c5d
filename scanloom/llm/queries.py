"""The operators of this subpackage as registered queries: each reads its whole table and returns
the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, exact_top_k, kd_shards, lexical, licenses, multi_index, pii, simhash, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The published byte-level vocabulary that op10 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [pii.count("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = warc.round_trip(pages.select("page_id", "url", "html"))
    return back.select(F.nullif("record_id", F.lit("")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op4_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words, spans, items = decontaminate.columns_of(docs)
    found = decontaminate.overlaps(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col(words).alias("n_words"), decontaminate.n_hit(spans).alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), decontaminate.contaminated(words, spans).alias("contaminated"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the contract's columns: the bytes left, and the words in repeated passages of over 50 words
    (which may be shorter than the bytes that are removed)."""
    made = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), passage_words=51)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s.end - s.start)
    return made.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", (F.col("n_bytes") - removed).alias("n_kept"), F.col("passage_words").alias("n_passage_words"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every fourth in source/lang, others one or two directories below."""
    below = F.expr("CASE WHEN doc_id % 4 = 1 THEN concat('/', doc_id div 256) WHEN doc_id % 4 = 0 THEN '' ELSE concat('/', doc_id div 256, '/', doc_id div 32) END")
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.coalesce(below, F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    made = licenses.scan(_table(spark, sf_dir, "documents"), path)
    return made.select("doc_id", "license", F.round("cosine", 6).alias("cosine"), "origin", "inherited_from")


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = kd_shards.shard(_table(spark, sf_dir, "documents"), 8)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, path)
    return both.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
held AS (SELECT row, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS words FROM held),
tf AS (SELECT row, term, count(*)::bigint AS tf FROM (SELECT row, unnest(terms) AS term FROM held) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), totals),
asked AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL)),
scored AS (
  SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words)))))::bigint AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN held USING (row), totals GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::int AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k.search(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with the faults that op13's contract plants, by a checksum of each row's key."""
    said = rows.select("conv_id", "turn", *(conversations.with_blanks(c).alias(c) for c in ("role", "text")), F.concat(conversations.with_blanks("conv_id"), F.lit(":"), conversations.with_blanks("turn")).alias("key"))
    kind = F.crc32("key") % 20
    hurt = said.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.report(damaged(rows), rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Those that DuckDB can say over whole tables; the others are tested by brute force."""
    return {"op7_license_scan": licenses.oracle_sql(), "op11_ranked_search": OP11_SQL, "op12_exact_top_k": OP12_SQL}

"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import alignment, blocknames, crosspoly, langid, licences, mixing, neardup, packing, quality, records, search, tokencount, windows
from pagelens.llm.common import spread, table, tokenizer_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id", "text")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality.held_out(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull() & ~held).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score_quality(_documents(spark, sf_dir), labels)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.count_tokens(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocknames.exact_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_documents(spark, sf_dir))


def op8_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs, langid.training_rows(docs), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_inverted_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build_index(_documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"), k=10)


def op12_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = windows.pack(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")


def op13_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP6_SQL = """
    WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM texts WINDOW w AS (PARTITION BY norm)
"""


def queries() -> dict:
    return {
        "op1_token_records": op1_token_records,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_mix_sources": op4_mix_sources,
        "op5_token_counts": op5_token_counts,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_license_scan": op7_license_scan,
        "op8_cross_polytope_neighbours": op8_cross_polytope_neighbours,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_language_id": op10_language_id,
        "op11_inverted_treap_search": op11_inverted_treap_search,
        "op12_least_squares_packing": op12_least_squares_packing,
        "op13_interval_alignment": op13_interval_alignment,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op7_license_scan": licences.scan_sql(), "op11_inverted_treap_search": search.SQL}

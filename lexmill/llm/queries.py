"""One thin query per operator over the synthetic tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import line_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.decontaminate import contaminated

    return contaminated(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.token_counts import token_counts

    return token_counts(spark, _read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source, language and id."""
    from lexmill.llm.licences import scan

    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = scan(spark, docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")
    return found.withColumnRenamed("id", "doc_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.packing import pack_documents

    return pack_documents(spark, _read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.line_dedup import PASSAGE_WORDS, dedup_lines

    out = dedup_lines(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=PASSAGE_WORDS)
    return out.select("doc_id", "text", F.col("__lines_removed").cast("long").alias("lines_removed"), F.col("__chunks_removed").cast("long").alias("chunks_removed"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import lang_id

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(lang_id.fold("doc_id", 4) == 2, F.lit(False))
    net = lang_id.fit(docs.where(lang_id.fold("doc_id", 4) != 2))
    out = lang_id.predict(spark, docs.select("doc_id", "text"), net)
    return out.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.vector_join import cosine_groups

    return cosine_groups(spark, _read(spark, sf_dir, "embeddings"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.ngram_join import jaccard_groups

    return jaccard_groups(spark, _read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import toxicity
    from lexmill.llm.lang_id import fold

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(fold("doc_id", 3) != 1)
    model = toxicity.fit(docs, labels)
    out = toxicity.scores(spark, docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by source to 24 of near equal bytes; affected shards are written and read back."""
    from lexmill.llm.resharding import reshard_and_rewrite
    from lexmill.llm.scratch import Scratch

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.coalesce(F.crc32(F.col("source").cast("binary")) % 16, F.lit(0))
    return reshard_and_rewrite(spark, docs, old, 24, f"{Scratch(spark, 'shards').root}/files")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_licence_scan": op3_licence_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_vector_near_dup": op7_vector_near_dup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_resharding": op10_resharding,
}
ORACLE_SQL: dict[str, str] = {"op5_line_dedup": line_dedup.ORACLE_SQL}

"""The registered queries of the corpus operators: each applies its operator,
with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import iblt, langid, mixing, ngramjoin, pieces, pii, suffix, urlfilter, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed, and the text that stays (null where a character is cut in two)."""
    out = suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=True)
    return out.select("doc_id", "n_removed", "n_spans", "n_bytes", "kept_sha256", F.try_validate_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.withColumn("held_out", langid.held_out(F.col("doc_id")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether decoding them gives its text again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = pieces.Pieces.load()
    both = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    return both.select("doc_id", "n_tokens", "n_chunks", "n_states", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "token_ids")


def op7_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_components(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("set_id")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, urlfilter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.pseudonymise(docs.select("doc_id", "text")).select("doc_id", "n_entities", "text")


QUERIES = {
    "op1_suffix": op1_suffix,
    "op2_langid": op2_langid,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_fingerprint": op5_fingerprint,
    "op6_pieces": op6_pieces,
    "op7_ngramjoin": op7_ngramjoin,
    "op8_urlfilter": op8_urlfilter,
    "op9_vectors": op9_vectors,
    "op10_pii": op10_pii,
}

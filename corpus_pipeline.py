"""Corpus pipeline: documents through quality rules, near-duplicate removal, removal of repeated
passages, mixing to source weights and SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet into the shared folder and reads it back as the next stage's documents.  All stages but
the last return the columns of documents; rows are whole (all columns carried along).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.llm import minhash, mixing, pieces, quality, repeats
from fleetbook.llm.common import bound_batches, stored

#: Shingles of five words, similarity 0.8 or more; a pair of 0.8 meets in a table with probability 0.9996.
NEAR = minhash.Rule(shingle=5, similarity=(80, 100), halves=12)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    The fit is over the statistics of all documents; a second pass over the texts applies it, so
    no text is shuffled.
    """
    bound_batches(spark)
    stats = stored(quality.with_stats(docs, ["lang", "source"]), "stats")
    rows = docs.select(F.struct(*_columns(docs)).alias("doc"), "text", "lang", "source")
    judged = quality.judge(quality.with_stats(rows, ["doc", "lang", "source"]), quality.fit_mcd(stats))
    return judged.filter("qs_kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.

    A document is an id and its text: rows that repeat both are one document (the smallest row in
    the order of the other columns stays), rows that share an id but not the text are judged each by its
    own.  Documents without an id stay.
    """
    bound_batches(spark)
    found = minhash.near_duplicates(docs, NEAR)
    kept = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("nd_id"), F.col("digest").alias("nd_digest")).agg(
        F.count("*").alias("nd_rows"))
    rows = docs.select(F.struct(*_columns(docs)).alias("doc"), "doc_id", minhash.text_digest().alias("digest"))
    left = rows.filter("doc_id is not null").join(kept, (F.col("doc_id") == F.col("nd_id")) & (F.col("digest") == F.col("nd_digest")))
    once = left.filter("nd_rows > 1").groupBy("doc_id", "digest").agg(F.min("doc").alias("doc"))
    whole = left.filter("nd_rows = 1").select("doc").unionByName(once.select("doc"))
    return whole.unionByName(rows.filter("doc_id is null").select("doc")).select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller id holds; a character
    that lost a byte goes whole.  ``n_chars`` is that of the remaining text."""
    bound_batches(spark)
    out = repeats.remove_repeats(docs, docs.columns, texts=True)
    new = {"text": F.col("rp_text"), "n_chars": F.char_length("rp_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times)."""
    bound_batches(spark)
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, in chunks."""
    bound_batches(spark)
    return pieces.encode_documents(docs).select("rec_id", "doc_id", "chunk_no", "n_chunks", "n_pieces", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL cannot express the fits and the tokeniser; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

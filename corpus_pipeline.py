"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of documents.  Each stage works on all rows its predecessor
kept.  Null and empty texts fail the first stage; of documents with one id each goes its own way; of near-duplicates the first by
id stays, ties in mixing are drawn by id; texts of any length are read whole; columns other than those of documents are not passed on; an empty
table gives an empty result.  SQL cannot express the near-duplicate join and the encoding, so there is
no SQL twin; ``tests/llm`` compares the pipeline with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallworks.llm import line_dedup, mixing, ngram_join, quality_rules as quality, sentencepiece
from stallworks.llm.tables import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality.judged(docs, "text", {c: F.col(c) for c in COLUMNS})
    return judged.filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go from the texts; every document stays.

    Copies are still there and count as one page: the next stage keeps one of them, with its text.
    """
    carry = {c: F.col(c) for c in COLUMNS if c not in ("text", "n_chars")}
    done = line_dedup.drop_boilerplate(docs, F.col("text"), F.col("source"), carry, copies_once=True)
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return ngram_join.ngram_classes(docs, carry=COLUMNS).filter("kept").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares by source, language and topic are the target shares."""
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic()}
    done = mixing.mixed(docs, dimensions, mixing.token_count(F.coalesce("text", F.lit(""))), F.col("doc_id"),
                        {f"own_{c}": F.col(c) for c in COLUMNS})
    return done.filter("kept").select(*(F.col(f"own_{c}").alias(c) for c in COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_sha256, score, round_trip of every document that is left."""
    return sentencepiece.encoding_digest(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", join_stage),
          ("mixing sources", mixing_stage), ("SentencePiece encoding", encoding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

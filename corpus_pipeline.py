"""A training corpus from documents: quality, lines, near-duplicates, mixture,
sequences. Every stage works on all rows that the one before it kept.

Null and empty texts are scored like texts without features, become empty
texts in the line stage, link with each other as near-duplicates, have size 0
in the mixture and are one end id as a sequence. Null ids and sources are
values like others, repeated rows are near-duplicates of each other, equal
inputs give equal results, and an empty table gives empty results at every
stage. Columns beyond those of ``documents`` are dropped by the first stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.llm import line_dedup, mixing, packing, pu_classifier, simhash
from ordertide.llm.queries import tokenizer_path
from ordertide.llm.tables import read_corpus, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    labels = read_corpus(spark, sf_dir, "labels")
    scored = pu_classifier.classify(docs, labels, carry=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that 5 or more of them share (each stays in
    the one with the largest doc_id); n_chars is counted anew."""
    out = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5, keep="last", carry=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, max_bits=2).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its source's target takes it."""
    mixed = mixing.mix(docs, source_weights=(5, 2, 1), budget=1.5, max_epochs=2.0)
    return mixing.take(docs, mixed).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 4096 tokens."""
    pieces = packing.tokenize(docs, tokenizer_path(), capacity=4096, end_id=1)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, capacity=4096)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates),
          ("mixing to target weights", mixture), ("best-fit packing", sequences)]

#: Fingerprints, a trained model and a tokenizer are not SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = read_corpus(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}-{name.replace(' ', '-')}")
    return docs

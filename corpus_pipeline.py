"""The corpus pipeline: documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir). It works on all rows that its predecessor kept and returns a DataFrame, which
is written and read again before the next one. All but the last return the columns of documents.

Defined cases: null and empty texts are scored as empty texts, hold no benchmark words and no personal data, and have no ids; rows with a null id
are kept by the second stage, as are rows without shingles; repeated rows have one id and stay or go together; texts of any
length pass whole; empty tables give no rows; further columns of documents, of any name, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontam, jaccard, pii, quality
from ledgerloom.llm import common as C
from ledgerloom.llm.catalog import vocabulary

#: A document of lower score is rejected.
LEAST_SCORE = 0.7


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the positive-unlabelled classifier rejects."""
    labels = C.table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels, C.fold("doc_id") != 2)
    return docs.filter(quality.score(model, F.col("text")) >= LEAST_SCORE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, keep the one with the smallest id."""
    return jaccard.keep_one(docs, k=5, pct=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; a document that is mostly benchmark goes."""
    return decontam.remove(docs, C.table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in the place of personal data."""
    return pii.replace(docs, key="corpus 1")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    coded = docs.select("doc_id", "lang", "source", bpe.encode(F.col("text"), vocabulary()).alias("c"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens"), F.col("c.ids").alias("ids"))


STAGES: list[tuple[str, Callable]] = [
    ("quality classifier", reject_poor),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("PII", replace_personal_data),
    ("BPE encoding", encode),
]

#: A trained classifier and a tokenizer are no SQL; tests/llm/test_pipeline.py compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet to the shared folder and read again, and goes when the next one is there."""
    scratch = C.Scratch(spark, "pipeline")
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch.path(name.replace(" ", "-"))
        made = stage(spark, docs, sf_dir)
        made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        scratch.drop_all(but=path)
    return docs

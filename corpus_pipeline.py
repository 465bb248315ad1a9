"""A corpus pipeline of operators of the language-model subpackage, one Parquet table after another.

Every stage but the last takes and gives the columns of ``documents``; labels for training come from the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminara.llm.common import Stored, read_table
from laminara.llm.mixing import mixed_rows
from laminara.llm.pii import DEMO_KEY, replace_pii
from laminara.llm.quality_crf import keep_documents, train
from laminara.llm.simhash import keep_one
from laminara.llm.sp_bpe import default_model, encode_decode, load_vocabulary

#: Shares of each domain's expected tokens that mixing keeps; no document comes more than once.
KEPT = {"low": 1.0, "high": 1.0, "low_toxic": 0.5, "high_toxic": 0.5}


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprints and by similarity of five-word shingles."""
    return keep_one(docs)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and their new length."""
    return replace_pii(docs, DEMO_KEY).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which toxic domains keep half of their expected tokens."""
    return mixed_rows(docs, read_table(spark, sf_dir, "labels"), kept=KEPT, max_rate=1.0)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document and what they decode to, as digests."""
    return encode_decode(docs, load_vocabulary(default_model()), digests=True)


STAGES = [
    ("quality rules", stage_quality),
    ("SimHash near-dedup", stage_near_dedup),
    ("PII surrogates", stage_pii),
    ("mixing to target weights", stage_mixing),
    ("SentencePiece encoding and decoding", stage_encode),
]
#: Training, surrogates and encoding have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written to shared storage and read again."""
    docs = read_table(spark, sf_dir, "documents")
    before = list(Stored.there)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            done = Stored(docs)
            for table in [t for t in Stored.there if t is not done and t not in before]:
                table.drop()
            docs = done.df
    return docs

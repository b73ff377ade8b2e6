"""A corpus pipeline: keep good documents, keep one of each group of copies, mask personal data, mix, encode.

``STAGES`` in order; each takes and returns documents, the last returns piece ids. Stages are held
together by written tables in the folder all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from outlay.llm.mixing import mixed_texts
from outlay.llm.ngram_join import keep_one_of_each
from outlay.llm.personal import mask_personal
from outlay.llm.pieces import encode_pieces
from outlay.llm.quality import keep_quality
from outlay.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by ``labels``, does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document."""
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind."""
    return mask_personal(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, as documents with the words that it takes from them."""
    return mixed_texts(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_ids, ids)`` of every document of the mix."""
    return encode_pieces(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixing),
    ("SentencePiece", sentencepiece),
]

#: Trained models and piece ids are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of the mixed documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

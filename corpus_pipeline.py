"""The corpus pipeline: five stages from raw documents to verified token ids.

Each stage reads what the one before it kept, written as Parquet, and decides
on that input alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewright.llm.common import load
from pricewright.llm.decontamination import decontaminate
from pricewright.llm.exact_dedup import exact_dedup
from pricewright.llm.language_id import identify_documents
from pricewright.llm.near_dedup import near_dedup
from pricewright.llm.sentencepiece_codec import encode_decode
from pricewright.session import materialize


#: Rows in one Arrow batch; whole texts pass through it, so fewer rows than Spark's default bound a task's memory.
BATCH_ROWS = 500


def _spare_memory(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """``docs`` less the rows with a dropped doc_id.

    The ids are written first, so the planner knows their size: a small set is
    broadcast, a large one joined by shuffle. Rows without a doc_id stay; rows
    that share one are decided alike, and go when one of them goes.
    """
    return docs.join(materialize(dropped.select("doc_id").distinct(), name), "doc_id", "left_anti").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _spare_memory(spark)
    return _without(docs, identify_documents(docs).where("not accepted"), "other-languages")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _spare_memory(spark)
    return _without(docs, exact_dedup(docs).where("not kept"), "exact-copies")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _spare_memory(spark)
    return _without(docs, near_dedup(docs).where("not kept"), "near-copies")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _spare_memory(spark)
    items = load(spark, sf_dir, "benchmark", "item_id", "text")
    return _without(docs, decontaminate(docs, items).where("contaminated"), "contaminated")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _spare_memory(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: Sampling and tokenizing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, token ids and how they were verified. The session's batch size is restored."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        docs = load(spark, sf_dir, "documents")
        for number, (_, stage) in enumerate(STAGES):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    finally:
        spark.conf.set(size, before)
    return docs

"""Training-data pipeline over ``documents``: five stages, each written and read again.

Every stage works on all that the one before kept.  The first three drop rows
(low quality, no recognisable language, near copies), the fourth cuts repeated
passages out of the texts, the last packs what remains into sequences.

Defined results of all stages: columns other than ``doc_id`` and ``text`` (and
``n_chars``, counted anew where passages were cut) stay as they are, whatever
their names; repeated rows stay or go together; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import langid, neardup, packing, quality, suffixes
from ledgerloom.llm.common import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go; null, empty and blank texts are rejected."""
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; texts without a letter have none."""
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that with the smallest id; rows with a null id stay."""
    return neardup.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that start anywhere else too are cut; a text that repeats whole becomes empty."""
    return suffixes.cut_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; an empty text is one piece, the end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("suffix dedup", suffix_stage),
    ("packing", packing_stage),
]

#: No stage can be expressed in SQL: learned models, byte-level matching and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs

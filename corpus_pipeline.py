"""A training-corpus pipeline: quality, exact and near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs. All but the last return the columns of ``documents``; the last
returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.exact_dedup import exact_dedup
from strataforge.llm.jaccard import jaccard_components
from strataforge.llm.packing import TOKENIZER, pack
from strataforge.llm.quality import fit_quality, quality_scores, quality_statistics
from strataforge.llm.store import RID, P, drop_since, is_scan, kept_rows, mark, materialize, quoted
from strataforge.llm.substrings import RESULT, substring_dedup


def _scanned(docs: DataFrame) -> DataFrame:
    return docs if is_scan(docs) else materialize(docs, "docs")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learned from the labels of the training folds, is 0.5 or more.

    Each row is judged by its own text: a null text as an empty one, rows with null or repeated ids
    like any other. Without labels of both kinds every score is one half and all rows stay.
    """
    docs = _scanned(docs)
    statistics = quality_statistics(docs)
    scores = quality_scores(statistics, fit_quality(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return kept_rows(docs, scores.where("score >= 0.5"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (a null one counts as empty), the row with the largest doc_id; a null doc_id loses, the last row of equals stays."""
    docs = _scanned(docs)
    return kept_rows(docs, exact_dedup(docs).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word-shingle Jaccard similarity 0.8 or more, the row with the smallest doc_id.

    Documents without words link with nothing and stay; a null doc_id comes after every other.
    """
    docs = _scanned(docs)
    found = materialize(jaccard_components(docs, 5, 80), "near")
    grouped = found.where("component_size > 1")
    first = grouped.groupBy(f"{P}class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), *RID)).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in RID))
    return kept_rows(docs, found.where("component_size = 1").select(*RID).union(first))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that start in a document with a smaller doc_id.

    A text that loses nothing stays as it is (a null one too); another one is its kept words joined
    by one space. A null doc_id comes after every other; rows of one doc_id keep each other's words.
    """
    columns = docs.columns
    carry = [c for c in columns if c not in ("doc_id", "text")]
    out = substring_dedup(docs, carry=carry)
    changed = F.col(RESULT[1]) > 0
    text = F.when(changed, F.col(RESULT[2])).otherwise(F.col(f"{P}text"))
    made = {"doc_id": F.col(f"{P}id"), "text": text}
    if "n_chars" in carry:
        made["n_chars"] = F.when(changed, F.length(RESULT[2]).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(made.get(c, F.col(quoted(c))).alias(c) for c in columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed along the Hilbert curve into sequences of 1024 tokens (pieces with their ids).

    Row by row: a null text is a single end token, null and repeated doc_ids are packed like others.
    """
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread; what a stage wrote on its way goes once it is done."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        drop_since(spark, start, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)

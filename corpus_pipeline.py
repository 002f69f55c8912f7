"""The corpus pipeline: five stages over ``documents``, each an operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.llm import decontaminate, line_dedup, minhash_forest, packing, quality
from skillgrid.llm.common import Scratch, fresh, table
from skillgrid.llm.queries import fitted_quality, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5 go.

    Null and empty texts are scored as an empty text; rows that repeat are judged alike. An empty
    table gives no row; all columns stay, whatever their names.
    """
    model = fitted_quality(spark, sf_dir)
    (score,) = fresh(docs, "score")
    return quality.score(docs, model, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated runs go but for their first copy; a document of which nothing is left goes too.

    Null and empty texts stay, and so do rows with a null doc_id; ``n_chars`` follows the text where
    lines went. An empty table gives no row.
    """
    names = fresh(docs, "n_lines", "n_removed", "n_runs", "longest_run")
    out = line_dedup.dedup_lines(docs, names=tuple(names))
    lines, removed = (F.col(n) for n in names[:2])
    out = out.where((removed == 0) | (removed < lines))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id.

    Documents are told apart by id and text. Null ids and texts without words stay; an empty table gives no row.
    """
    return minhash_forest.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, whatever else has their id.

    Null ids and null or empty texts stay; an empty table, or one of items, changes nothing.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed; a null or empty text is the end id alone, rows that repeat are packed as often."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Fitting, MinHash and tokenising are not SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to ``documents``; each result is written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs

"""The corpus pipeline: each stage gets all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.llm import language_id, line_dedup, mixing, packing, rows
from phonoweave.llm.common import Stored, table
from phonoweave.llm.queries import MIN_KNOWN, TARGETS, TOKEN_BUDGET, domain, tokenizer


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with text in a learned language. Those without a letter, or with fewer known letters than MIN_KNOWN, go.

    All columns stay as they were, whatever their names.
    """
    found = language_id.identify(rows.held(docs, "text"), language_id.fit(docs), known=True)
    kept = found.where((F.col("lang_pred") != language_id.UND) & (F.col("known") >= MIN_KNOWN))
    return rows.given_back(kept, docs, text=F.col("text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each line that ten documents or more have left once, in the least doc_id; n_chars follows the text.

    All documents stay, those without a line left as empty ones, and so do all other columns.
    """
    kept = line_dedup.dedup_lines(rows.held(docs, "doc_id", "text"), min_docs=10, keep="first", min_chars=1)
    follows = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return rows.given_back(kept, docs, doc_id=F.col("doc_id"), text=F.col("text"), **follows)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of least doc_id, one without an id only if none has one.

    Rows equal in id and text are one document; differing texts of one id and texts without an id are compared like any others.
    """
    return rows.one_of_each(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, whole rows, so that the expected token totals of the domains match TARGETS."""
    model = mixing.fit(docs, table(spark, sf_dir, "labels"), domain())
    return mixing.resample(docs, model, TARGETS, TOKEN_BUDGET, tokenizer())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of each row. text_md5 tells which of the texts of an id it is; rows equal in both are alike."""
    return packing.pack_documents(docs, tokenizer(), key="text_md5")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The first stage is a trained model, which SQL cannot express; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each result written to the shared folder and read by the next stage.

    What a stage has read is deleted when its own result is written, but for the table of documents itself.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            last.drop()
        docs, last = now.df, now
    return docs

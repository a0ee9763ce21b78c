"""A corpus pipeline in stages: language, near copies, repeated passages, benchmark passages, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All stages but the last return the columns of documents.  Every stage defines its result for odd rows: rows without a
doc_id are documents like others, repeated rows are documents of their own until near_copies leaves one, an empty table gives an empty
one, texts of any length are read whole, and columns of any other name, whatever operators call theirs, go through unchanged.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontamination, jaccard_join, language_id, packing, substring_dedup
from tidemark.llm.session import stored, table

#: A text whose best language has a lower pooled probability than this is in none of the languages.
LEAST_SCORE = 0.4


#: Columns of documents that stages read or change.  Others go through under names of their own.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """A stage that keeps all columns as they are called, whatever names its operator uses."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"_other_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), sf_dir)
        return out.select(*(F.col(n).alias(c) for c, n in names.items()))

    return run


@apart
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents go that have no letter, or that no language is likely for.

    Null and empty texts have no letter, so they go; so do texts without any language if no row has a label.  Repeated rows
    share their fate.
    """
    found = language_id.predicted(docs, language_id.fitted(docs))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


@apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near copies, the document with the smallest doc_id stays.

    Of repeated rows one stays; rows without a doc_id stay only where their class has no doc_id at all (one of them).
    Null texts and texts without words are in no class and stay.
    """
    return jaccard_join.one_of_each(docs).select(*docs.columns)


@apart
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that an earlier document has are cut; a document that loses all its words goes.

    Null and empty texts lose nothing and stay, so do rows without a doc_id; rows that share a doc_id take nothing from each
    other.  n_chars, where there is such a column, follows the text.
    """
    found = substring_dedup.cut(docs)
    cut = F.col("n_removed") > 0
    found = found.where(~cut | (F.col("kept") != ""))
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return found.withColumns(changed).select(*docs.columns)


@apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents go of whose words at least one in twenty stands in benchmark windows.

    Null and empty texts have no words and stay.  Repeated rows share their fate; an empty benchmark lets all stay.
    """
    hits = decontamination.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), name="hits_")
    n_hit = F.aggregate("hits_.ranges", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))
    return hits.where(~((n_hit > 0) & (20 * n_hit >= F.col("hits_.n_words")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents that are left.

    A null or empty text is its end id alone; rows that share a doc_id, or have none, are documents of their own.
    """
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_passages", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express a trained network, nor a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus in five stages: language ID, exact dedup, near-duplicate removal, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents. Stages name rows by file and place
in it, so rows with equal or null ids are documents of their own and no copy of the corpus is made to number them; extra columns pass
through. A stage leaves no table behind but the numbers of the rows that it keeps. Texts meet these numbers in a merge join at every size, so that a
stage is planned alike on small and large tables: its numbers grow with the rows, and are never broadcast. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, exact, langid, mixing, simhash
from tidewell.llm.common import discard, documents, numbered, scratch, staged
from tidewell.llm.queries import tokenizer_path

ROW = "__row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts, texts without a letter, and texts that look like none of the languages learned."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest doc_id stays."""
    rows = numbered(docs, ROW)
    with scratch() as own:
        found = exact.deduplicate(rows.select(F.struct("doc_id", ROW).alias("key"), "text"), id_col="key")
        kept = own.keep(staged(found.where("kept").select(F.col(f"key.{ROW}").alias(ROW)), "exact-kept"))
    return rows.join(kept.hint("merge"), ROW, "left_semi").drop(ROW)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles have a similarity of 0.8 or more the row with the smallest doc_id stays; null ids count as greatest."""
    rows = numbered(docs, ROW)
    with scratch() as own:
        found = simhash.near_copies(rows, row_col=ROW).join(rows.select(ROW, "doc_id"), ROW)
        first = found.groupBy("root").agg(F.min_by(ROW, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias(ROW))
        kept = own.keep(staged(first.select(ROW), "near-kept"))
    return rows.join(kept.hint("merge"), ROW, "left_semi").drop(ROW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = numbered(docs, ROW)
    with scratch() as own:
        taken = own.keep(staged(mixing.mix(rows, carry=(ROW,)).where("copies > 0").select(ROW, F.col("copies").cast("int").alias("__copies")), "mix-taken"))
    out = rows.join(taken.hint("merge"), ROW).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.drop(ROW, "__copies", "__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL can't express the language model, similarity groups and the cube method.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scratch() as own:
            after = own.keep(staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = after
    return docs

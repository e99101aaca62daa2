"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

Every stage works on all rows its predecessor kept.  All but the last return the columns
of ``documents``; the last drops and repeats documents as the mix decides and adds its figures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import chunk_dedup, decontaminate, language, mixing, near_dedup
from relweave.llm.store import small, stored, unused

LEAST_SCORE = 0.5  # a language that is no more likely than all others together is no answer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or a clear language go."""
    guess, = unused(docs, "guess")
    known = language.identify(docs, language.learn_from_documents(docs), guess=guess)
    told = (F.col(guess)["lang"] != language.UNKNOWN) & (F.col(guess)["score"] >= LEAST_SCORE)
    return known.where(told).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; rows without id stay.

    Repeated rows of one id are one document, of which the row with the least digest of all its columns stays.
    Rows of ids that stand once, nearly all, are not shuffled for it.
    """
    own, = unused(docs, "id")
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    left = docs.join(small(stored(gone, "gone"), 8), F.col("doc_id") == F.col(own), "left_anti")
    again = left.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(own)).count().where("count > 1").select(own)
    again = stored(again, "again")
    if again.isEmpty():
        return left
    again = small(again, 8)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = left.join(again, F.col("doc_id") == F.col(own), "left_semi")
    one = several.groupBy(F.col("doc_id").alias(own)).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("r")).select("r.*")
    return left.join(again, F.col("doc_id") == F.col(own), "left_anti").unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages an earlier one holds; ``n_chars`` follows the text."""
    spans, = unused(docs, "cut")
    cut = chunk_dedup.remove_repeats(docs, spans=spans)
    changed = F.col(spans).isNotNull()
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy it takes of a document, none for one left out; with the document's size, its source's
    size and target, and the words of all its copies together (``taken``)."""
    mix_, copy = unused(docs, "mix", "copy")
    mixed, mix = mixing.with_copies(docs, mix=mix_), F.col(mix_)
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), mix["copies"].cast("int")))).select(
        *docs.columns, mix["size"].alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"),
        (mix["copies"] * mix["size"]).alias("taken"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # a trained language model and rolling hashes are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

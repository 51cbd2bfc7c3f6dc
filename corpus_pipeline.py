"""The corpus pipeline: language, toxicity, near duplicates, packing. Each stage works on what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps, the last one the
pieces with their places. Null and empty texts are `und` and go in the first stage; equal rows of one document are near duplicates
of each other; empty tables pass through every stage; extra columns pass through, whatever their names, up to the last stage. Very long
texts are handed to Python in batches of one row and cut into slices there, so a worker holds one text and its slices at a time. A stage
that fits a model sets the session's bound of Arrow batches to 4 MB for good, if it is larger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.common import columns_of, staged, unused
from lintel.llm.jaccard import similar_components
from lintel.llm.language_id import identify
from lintel.llm.packing import pack_documents
from lintel.llm.toxicity import classify


def _prefix(docs: DataFrame, *names: str) -> str:
    """Underscores that make all names unlike every column."""
    return max((unused(docs.columns, f"_{n}").removesuffix(n) for n in names), key=len)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learnt from those that name theirs."""
    prefix = _prefix(docs, "lang_pred", "score", "rejected", "entropy")
    return identify(docs, train=docs, prefix=prefix).where(~F.col(f"{prefix}rejected")).select(*columns_of(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; learnt from the labelled ones among them."""
    prefix = _prefix(docs, "toxicity", "toxic")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return classify(docs, docs.select("doc_id", "text", "lang"), labels, prefix=prefix).where(F.col(f"{prefix}toxic") == 0).select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id (of equal ids that with the smallest hash of its text)."""
    first_id, first_text, text = unused(docs.columns, "_id"), unused(docs.columns, "_first"), unused(docs.columns, "_text")
    rows = similar_components(docs.select("doc_id", "text"))
    # rows without shingles are linked with nothing: each is its own group
    group = F.when(F.col("component").isNull(), F.struct("doc_id", "text_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias(first_id), F.col("text_hash").alias(first_text)))
    firsts = rows.groupBy("component", group.alias("alone")).agg(first.alias("first")).select(f"first.{first_id}", f"first.{first_text}").distinct()
    hashed = docs.withColumn(text, F.xxhash64("text"))
    kept = hashed.join(firsts, F.col("doc_id").eqNullSafe(F.col(first_id)) & (F.col(text) == F.col(first_text)), "left_semi")
    return kept.dropDuplicates(["doc_id", text]).select(*columns_of(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Learnt models and bin packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

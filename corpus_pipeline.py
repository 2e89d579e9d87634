"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of documents.
``run`` writes every stage as Parquet in the shared scratch folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convsift.llm import language_id, line_dedup, minhash, mixing, packing
from convsift.llm.common import documents, materialise, n_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Resemblance of near-duplicates; op1's own query has another.
NEAR_PERCENT = 80


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the operator's rejects go.

    Learns from the documents' own labels.
    """
    model = language_id.fit(docs)
    return language_id.identify(docs.select(*COLUMNS), model).where("NOT rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier document has; those left without words go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    out = out.where((F.col("removed_chunks") == 0) | (n_words(F.col("text")) > 0))
    changed = F.col("removed_chunks") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (a null one is last), of every group of near-duplicates.

    Every row is judged by its own text, whatever its id; equal rows are one.
    """
    # Rows are known by a hash of all their columns, and of which are null; different rows
    # under one hash are judged as one document but all stay or go together.
    nulls = [F.col(c).isNull() for c in COLUMNS]
    key = F.pmod(F.xxhash64(*COLUMNS, *nulls), F.lit(minhash.NO_ID)).alias("_key")
    rows = docs.select(*COLUMNS, key)
    found = minhash.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"), NEAR_PERCENT)
    found = found.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("_group"))
    ids = rows.groupBy("_key").agg(F.min("doc_id").alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_key"))).getField("_key")
    kept = ids.join(found, "_key").groupBy("_group").agg(first.alias("_key"))
    # Equal rows meet as partial aggregates, at most one a task.
    return rows.join(kept, "_key", "left_semi").select(*COLUMNS).dropDuplicates(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    out = mixing.mix_sources(docs.select(*COLUMNS), n_words(F.col("text")), F.array("source"))
    copies = F.array_repeat(F.lit(0), F.col("copies"))
    return out.withColumn("_copy", F.explode(copies)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

# The language model, the shifted cuts and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs

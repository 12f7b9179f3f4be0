"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal
data is masked, and what is left is packed into training sequences.

Every stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as Parquet into the
shared folder and reads it back as the next one's docs.  All stages but the last return the columns
of documents, in their order; columns beyond those of the contract pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import near_dedup, packing, pii, toxicity
from granary.llm.queries import table, vocabulary
from granary.llm.shared import drop_written, free_name, written

#: Percent of shared five-word shingles from which two documents count as copies.
SIMILAR = 80
#: Chunks of text whose ids a worker of the last stage remembers: executors still hold the heap of the stages before.
REMEMBERED = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity model, learned from `labels`, scores below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_toxicity")
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of SIMILAR documents the row of least doc_id; of rows that share it one text's,
    once.  Rows without an id or without words are all kept."""
    rows = near_dedup.components(docs, SIMILAR).filter("doc_id is not null and label is not null")
    mark = free_name(docs, "_mark")
    kept = rows.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("head")).select("head.doc_id", F.col("head.mark").alias(mark))
    lone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.filter(~lone).withColumn(mark, F.xxhash64("text")).join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.filter(lone))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every identifier by its mask and counts n_chars anew."""
    return pii.mask_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=1, capacity=2048, keep=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The stages hold a learned model, signatures and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(docs)
        docs = done
    return docs

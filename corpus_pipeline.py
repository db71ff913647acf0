"""A training corpus from documents: rated, deduplicated, decontaminated, scanned, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwell.llm import decontam, neardup, packing, quality, secrets
from gridwell.llm.queries import vocabulary_path
from gridwell.session import CHAIN_BATCH_BYTES, scratch_path, ship, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability is high enough."""
    ship(spark, CHAIN_BATCH_BYTES)
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id.

    Where a doc_id repeats or is null, each row is a document of its own; a null doc_id
    comes last. Rows without words are in no group and all stay.
    """
    ship(spark, CHAIN_BATCH_BYTES)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        kept = neardup.near_duplicates(docs).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    rows = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(own["text"]).alias("text")))
    named = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", F.col(own["doc_id"]).alias("id")), "row")
    first = F.min(F.struct(F.isnull("id").alias("last"), "id", "row"))["row"]
    kept = named.groupBy("component_id").agg(first.alias("row"))
    return rows.join(kept, "row", "left_semi").select(*(F.col(n).alias(c) for c, n in own.items()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    ship(spark, CHAIN_BATCH_BYTES)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds."""
    ship(spark, CHAIN_BATCH_BYTES)
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 2048."""
    ship(spark, CHAIN_BATCH_BYTES)
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: No stage but the scans' base could be put in SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Points from files and from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwell.session import table

#: Point views over the driver's tables: id, x, y.
VIEWS = {
    "emb2d": ("embeddings", "vec_id", "CAST(embedding[0] AS DOUBLE)", "CAST(embedding[1] AS DOUBLE)"),
    "part2d": ("part", "p_partkey", "CAST(p_size AS DOUBLE)", "p_retailprice"),
    "cust2d": ("customer", "c_custkey", "CAST(c_nationkey AS DOUBLE)", "c_acctbal / 1000D"),
    "supp2d": ("supplier", "s_suppkey", "CAST(s_nationkey AS DOUBLE)", "s_acctbal / 1000D"),
    "events2d": ("events", "event_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 3.6e9D", "value"),
}


def points(spark: SparkSession, sf_dir: str, view: str, *payload: str) -> DataFrame:
    """A point view: id, x, y and the named payload columns; only those are read."""
    name, key, x, y = VIEWS[view]
    return table(spark, sf_dir, name).select(F.expr(key).alias("id"), F.expr(x).alias("x"), F.expr(y).alias("y"), *payload)


def labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points of a header-less ``x,y,label`` file or folder: id (line number from 0, files
    by name), x, y, label. A line that can't be read is an error.

    Lines are numbered by their place: their number within a split, and the lines of the
    splits before, of which there is one count each.
    """
    rows = spark.read.schema("x double, y double, label double").csv(path, mode="FAILFAST")
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    sizes = placed.groupBy("file", "block").agg(F.count("*").alias("size"), F.min("n").alias("first")).orderBy("file", "block").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["file"], r["block"], at - r["first"]))
        at += r["size"]
    offset = F.broadcast(spark.createDataFrame(starts, "file string, block long, shift long"))
    return placed.join(offset, ["file", "block"]).select((F.col("n") + F.col("shift")).alias("id"), "x", "y", F.col("label").cast("long").alias("label"))


def in_memory(spark: SparkSession, rows: list[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "id long, x double, y double")

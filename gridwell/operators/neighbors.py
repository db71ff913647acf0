"""Range joins within eps, through an equi-join of grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwell.functions import cell, dist2
from gridwell.session import written

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def with_cells(points: DataFrame, side: float) -> DataFrame:
    return points.withColumn("cx", cell(F.col("x"), side)).withColumn("cy", cell(F.col("y"), side))


def histogram(points: DataFrame, side: float) -> DataFrame:
    """Points in each cell that has some: cx, cy, n. Sums are taken map-side first."""
    return with_cells(points, side).groupBy("cx", "cy").agg(F.count("*").alias("n"))


def neighbor_pairs(left: DataFrame, right: DataFrame, eps: float, heavy: int | None = None) -> DataFrame:
    """All (i, j, d2) with right's j within eps of left's i, both ends included.

    The cells are slightly wider than eps, so that rounding at their edges loses no
    pair; the distance itself is compared exactly. With ``heavy``, a cell that holds more
    of left's points than that is dealt in parts of about so many, and right's points
    near it go to each part.
    """
    a, b = _sides(left, right, eps)
    keys = ["cx", "cy"]
    if heavy:
        a, b = _salted(a, b, heavy)
        keys.append("salt")
    d2 = dist2(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    return a.join(b, keys).withColumn("d2", d2).where(F.col("d2") <= F.lit(eps * eps)).select("i", "j", "d2")


def _sides(left: DataFrame, right: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Left's points in their cells, right's in all cells around theirs."""
    side = eps * (1 + 1e-9)
    a = with_cells(left.select(F.col("id").alias("i"), "x", "y"), side)
    b = with_cells(right.select(F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by")).withColumnsRenamed({"bx": "x", "by": "y"}), side)
    near = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in AROUND)))
    b = b.withColumn("c", near).select("j", F.col("x").alias("bx"), F.col("y").alias("by"), "c.cx", "c.cy")
    return a, b


def _salted(a: DataFrame, b: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: one of as many as the cell has parts on the left, all of them on the right."""
    parts = a.groupBy("cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > heavy)
    parts = written(parts.select("cx", "cy", F.ceil(F.col("n") / heavy).cast("int").alias("parts")), "heavy")
    k = F.coalesce("parts", F.lit(1))
    one = a.join(parts, ["cx", "cy"], "left").withColumn("salt", F.pmod(F.xxhash64("i"), k).cast("int")).drop("parts")
    every = b.join(parts, ["cx", "cy"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), k - 1))).drop("parts")
    return one, every


def neighbor_counts(points: DataFrame, eps: float) -> DataFrame:
    """(id, n): neighbours of each point, itself included."""
    return neighbor_pairs(points, points, eps).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"))


def core_points(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    return neighbor_counts(points, eps).where(F.col("n") >= min_points).select("id")

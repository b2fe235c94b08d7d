"""Joins that state how many partners a row must have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, written
from kinetra.operators.ordered_windows import indexed


def exactly_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each left row with ``matches`` (right rows of its keys) and ``status``: matched, missing or ambiguous.

    The right side is counted per key before the join, so that many partners never multiply. Null keys match nothing.
    """
    counts = written(right.groupBy(*on).agg(F.count("*").alias("matches")))
    n = F.coalesce("matches", F.lit(0))
    return lookup_join(left, counts, on, F.hash(*left.columns)).withColumn("matches", n).withColumn("status", F.when(n == 1, "matched").when(n == 0, "missing").otherwise("ambiguous"))


def same_sets(left: DataFrame, right: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """Per group: n_left, n_right, only_left, only_right (distinct members), and whether both sets are equal."""
    sides = left.select(*group, member, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*group, member, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    members = sides.groupBy(*group, member).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    out = members.groupBy(*group).agg(
        F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"),
        F.sum(F.col("_l") * (1 - F.col("_r"))).alias("only_left"), F.sum(F.col("_r") * (1 - F.col("_l"))).alias("only_right"),
    )
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def zipped(left: DataFrame, right: DataFrame, group: Sequence[str], left_order: str, right_order: str, step: float = 4_096) -> DataFrame:
    """Rows of both sides of a group paired by their places in its order (full outer): the group, place, left and right order values.

    Orders are numbers; a group is ordered in parts of ``step`` of them. A group that one side lacks, or has fewer of, leaves nulls.
    """
    sides = [indexed(df.select(*group, F.col(order).alias(f"{side}_value")), group, [f"{side}_value"], F.floor(F.col(f"{side}_value") / step)) for df, order, side in ((left, left_order, "left"), (right, right_order, "right"))]
    return sides[0].join(sides[1], [*group, "_at"], "full").withColumnRenamed("_at", "place")

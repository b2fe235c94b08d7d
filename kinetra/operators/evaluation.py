"""Plans, rankings and summaries of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.functions.stats import hazen_quantiles
from kinetra.operators.ordered_windows import indexed

#: Parts in which a whole table is ranked.
PARTS = 64


def experiment_plan(lists: dict[str, DataFrame], seeds: DataFrame) -> DataFrame:
    """All combinations of the lists' values (each a one-column DataFrame of distinct candidates), each with every seed.

    Result: combination_id, combination_number, run_number, one column per list, seed. The first list varies fastest. The lists
    are what an experiment states; their product is the result itself. Duplicates and nulls in a list are dropped.
    """
    def numbered(values: DataFrame, name: str) -> DataFrame:
        """The list's values, their places from 0 and how many there are."""
        sorted_ = values.toDF(name).dropna().agg(F.array_sort(F.collect_set(name)).alias("_l"))
        return sorted_.select(F.size("_l").alias(f"_n_{name}"), F.posexplode("_l").alias(f"_i_{name}", name))

    names, plan = list(lists), None
    for name in names:
        values = numbered(lists[name], name)
        plan = values if plan is None else plan.crossJoin(F.broadcast(values))
    runs = plan.crossJoin(F.broadcast(numbered(seeds, "seed")))
    number = F.lit(0).cast("bigint")
    for name in reversed(names):
        number = number * F.col(f"_n_{name}") + F.col(f"_i_{name}")
    runs = runs.withColumn("combination_number", number + 1).withColumn("run_number", number * F.col("_n_seed") + F.col("_i_seed") + 1)
    return runs.select(*names, "combination_number", F.format_string("combination_%04d", "combination_number").alias("combination_id"), "seed", "run_number")


def ranked(df: DataFrame, metric: str, tie: str, name: str = "rank") -> DataFrame:
    """The rows with their rank by ``metric``, ties by ``tie``; rows without a finite metric have none.

    Ranks over the whole table come from the counts of parts between PARTS quantiles (of a sketch), so that no task orders all rows,
    however the metric is spread.
    """
    finite = F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")) & (F.abs(F.col(metric)) < float("inf"))
    cuts = df.where(finite).agg(F.percentile_approx(metric, [k / PARTS for k in range(1, PARTS)], 10_000)).first()[0] or []
    part = sum(((F.col(metric) > F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    placed = indexed(df.where(finite).withColumn("_all", F.lit(0)), ["_all"], [metric, tie], part)
    return placed.withColumn(name, (F.col("_at") + 1).cast("bigint")).drop("_at", "_all").unionByName(df.where(~finite).withColumn(name, F.lit(None).cast("bigint")))


def combination_summary(runs: DataFrame, keys: Sequence[str], completed: str, evaluated: str, metric: str) -> DataFrame:
    """Per combination: planned, completed, failed, evaluated, rate, and median, q25, q75, iqr of the metric over evaluated finite runs."""
    counts = runs.groupBy(*keys).agg(
        F.count("*").alias("planned"), F.count_if(F.col(completed)).alias("completed"), F.count_if(~F.col(completed)).alias("failed"),
        F.count_if(F.col(evaluated)).alias("evaluated"), (F.count_if(F.col(evaluated)) / F.count("*")).alias("rate"),
    )
    q = hazen_quantiles(runs.where(F.col(evaluated)), keys, F.col(metric), {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n")
    return counts.join(q, list(keys), "left").withColumn("iqr", F.col("q75") - F.col("q25"))


def densified(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """Every combination of the values that the dimensions have, with the mean of ``value`` or null."""
    got = df.groupBy(*dims).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    grid = None
    for d in dims:
        values = got.select(d).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    return grid.join(got, list(dims), "left").fillna(0, ["n"])


def surface_rmse(points: DataFrame, other: DataFrame, mesh: str, vertex: str) -> DataFrame:
    """Per mesh: n vertices, missing (in one only) and rmse of the distances of equal vertices (x, y, z)."""
    both = points.select(mesh, vertex, "x", "y", "z").join(other.select(mesh, vertex, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2")), [mesh, vertex], "full")
    d2 = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("z") - F.col("z2"), 2)
    return both.groupBy(mesh).agg(F.count(d2).alias("n"), F.count_if(F.col("x").isNull() | F.col("x2").isNull()).alias("missing"), F.sqrt(F.avg(d2)).alias("rmse"))

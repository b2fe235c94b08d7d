"""Quantiles and moving windows with the definitions of numerical toolboxes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, merged, written

#: How far, as a share of a key's rows, the cuts lie from a wanted quantile.
NEAR = 0.002
#: Rows of a key above which its join with its cuts is spread.
HOT = 65_536


def hazen(values: Column, p: float) -> Column:
    """The quantile p of a sorted array without nulls by midpoint interpolation (rank n p + 1/2); null if empty."""
    n = F.size(values)
    h = F.greatest(F.least(n * F.lit(float(p)) + 0.5, n.cast("double")), F.lit(1.0))
    low = F.floor(h).cast("int")
    a, b = F.get(values, low - 1), F.get(values, F.least(low, n - 1))
    return F.when(n > 0, a + (h - low) * (b - a))


def hazen_quantiles(df: DataFrame, keys: Sequence[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """Exact midpoint quantiles of each key's values, and their number n; null, NaN and infinite values are left out.

    A sketch per key gives cuts a little below and above each wanted quantile. Counts between the cuts tell exactly which parts hold
    the wanted ranks; only the rows of those parts, some NEAR of a key each way, are shuffled and ranked. So a hot key shuffles
    little, however its values are spread. Keys may be null.
    """
    keys = list(keys)
    v = value.cast("double")
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    rows = written(df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(key.alias("_k"), v.alias("_v")))
    near = sorted({min(max(p + d, 0.0), 1.0) for p in quantiles.values() for d in (-NEAR, NEAR)})
    cuts = written(rows.groupBy("_k").agg(F.percentile_approx("_v", near, 10_000).alias("_cuts"), F.count("*").alias("_rows")))
    part = sum(((F.col("_v") > F.get("_cuts", F.lit(i))).cast("int") for i in range(len(near))), F.lit(0))
    hot = (cuts.agg(F.max("_rows")).first()[0] or 0) > HOT
    cut = lookup_join(rows, cuts.drop("_rows"), ["_k"], F.col("_v"), "inner", hot=hot).select("_k", "_v", part.alias("_part"))
    parts = cut.groupBy("_k", "_part").agg(F.count("*").alias("_c"))
    along = Window.partitionBy("_k").orderBy("_part")
    parts = parts.withColumns({"_to": F.sum("_c").over(along), "_n": F.sum("_c").over(Window.partitionBy("_k"))}).withColumn("_from", F.col("_to") - F.col("_c"))
    rank = {name: F.greatest(F.least(F.col("_n") * F.lit(float(p)) + 0.5, F.col("_n").cast("double")), F.lit(1.0)) for name, p in quantiles.items()}
    holds = reduce(lambda a, b: a | b, [(F.col("_from") < f(h)) & (F.col("_to") >= f(h)) for h in rank.values() for f in (F.floor, F.ceil)])
    wanted = written(parts.where(holds).select("_k", "_part", "_from", "_n"))
    counted = lookup_join(cut, wanted.select("_k", "_part"), ["_k", "_part"], F.col("_v"), "left_semi", hot=hot).groupBy("_k", "_part", "_v").count()
    inside = Window.partitionBy("_k", "_part").orderBy("_v")
    ranked = counted.withColumn("_in", F.sum("count").over(inside)).join(merged(wanted), ["_k", "_part"]).withColumn("_to", F.col("_from") + F.col("_in"))
    first, out = F.col("_to") - F.col("count"), []
    for name, h in rank.items():
        at = lambda k: F.max(F.when((first < k) & (F.col("_to") >= k), F.col("_v")))
        low, high = F.floor(h), F.ceil(h)
        out.append((at(low) + F.max(h - low) * (at(high) - at(low))).alias(name))
    return ranked.groupBy("_k").agg(F.max("_n").alias("n"), *out).select(*[F.col("_k")[k].alias(k) for k in keys], "n", *quantiles)


def moving_frame(window: WindowSpec, k: int) -> WindowSpec:
    """The rows of a centred moving window of k rows: odd k, as many before as after; even k, one more before."""
    return window.rowsBetween(-(k // 2), (k - 1) // 2)


def robust_unit(value: Column, low: Column, high: Column) -> Column:
    """value between its low and high percentiles as 0 to 1, cut off at both; 0.5 where they are equal."""
    return F.when(high > low, F.greatest(F.least((value - low) / (high - low), F.lit(1.0)), F.lit(0.0))).otherwise(0.5)

"""Windows and running sums over the ordered rows of a key, however many rows the key has."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinetra.operators.common import merged

#: Rows of a block of a key's order.
BLOCK = 65_536


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: Column, once: bool = False, extra: Callable[[WindowSpec], dict[str, Column]] | None = None) -> DataFrame:
    """``df`` with ``_part`` and ``_n``, the place in the part, from 0; see indexed. ``extra`` gives further columns over the window of a part."""
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    cut = df.withColumn("_part", part)
    if once:
        before = F.lag(order[-1]).over(w)
        cut = cut.withColumn("_prev", before).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(order[-1]))).drop("_prev")
    return cut.withColumns({"_n": F.row_number().over(w) - 1} | (extra(w) if extra else {}))


def placed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numbered rows with ``_at``, the place, from 0, in the key's order: the counts of the parts before, and the place in the part."""
    counts = rows.groupBy(*keys, "_part").count()
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*keys, "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_first"))
    return rows.join(firsts, [*keys, "_part"]).withColumn("_at", F.col("_first") + F.col("_n")).drop("_first", "_n", "_part")


def indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: Column, once: bool = False) -> DataFrame:
    """``df`` with ``_at``: the place, from 0, in the key's order.

    ``part`` never falls along the order; it cuts a key into parts, each ordered in one task, whose counts give the
    places of their first rows; only those counts are ordered per key. ``once``: of rows with the same last column of
    the order, which follow each other, one is kept. Rows with a null key are left out.
    """
    return placed(numbered(df, keys, order, part, once), keys)


def with_neighbours(df: DataFrame, keys: Sequence[str], before: int, after: int, block: int = BLOCK) -> tuple[DataFrame, WindowSpec]:
    """The indexed rows cut into blocks that also hold ``before`` and ``after`` rows of their neighbours, and a window over a block.

    Evaluate what needs no more than those neighbours over the window, then keep the rows where ``_own`` is true.
    """
    if max(before, after) >= block:
        raise ValueError("more neighbours than a block has")
    b, m = F.floor(F.col("_at") / block), F.pmod("_at", F.lit(block))
    copies = F.array_compact(F.array(b, F.when((m < after) & (b > 0), b - 1), F.when(m >= block - before, b + 1)))
    rows = df.withColumn("_home", b).withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")
    return rows, Window.partitionBy(*keys, "_block").orderBy("_at")


def own(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_block")


def running_sum(df: DataFrame, keys: Sequence[str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The indexed rows with the sum of ``value`` up to and with each row: sums of blocks, then sums inside each."""
    cut = df.withColumn("_b", F.floor(F.col("_at") / block)).withColumn("_v", value)
    sums = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_in", F.sum("_v").over(inside)).join(offsets, [*keys, "_b"]).withColumn(name, F.col("_off") + F.col("_in")).drop("_b", "_v", "_in", "_off")


def carried(df: DataFrame, keys: Sequence[str], place: str, values: dict[str, Column], before: bool = False, block: int = BLOCK) -> DataFrame:
    """``df`` with a column per entry of ``values``: its last known value up to and with each row (``before``: without the row itself).

    ``place`` is a number along which a key's rows are ordered, without ties; rows are cut into blocks by it. Inside a block a window
    carries values on; what a block begins with comes from the last values of the blocks before, of which there is one row
    each. Keys may be null.
    """
    cut = df.withColumn("_b", F.floor(F.col(place) / block)).withColumns({f"_v_{n}": v for n, v in values.items()})
    lasts = cut.groupBy(*keys, "_b").agg(*[F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(place, f"_v_{n}")))[f"_v_{n}"].alias(f"_l_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    begins = lasts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_b").orderBy(place).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    # a block's rows take what it begins with as a row ahead of the first one's
    within = cut.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    out = within.join(merged(begins), same).withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in values})
    return out.drop("_b", "_kb", *[f"_k{i}" for i in range(len(keys))], *[f"_{p}_{n}" for n in values for p in "vic"])

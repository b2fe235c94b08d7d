"""Irregular readings onto a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots of one block of a key's time; the unit that is sorted in one task.
BLOCK_SLOTS = 16_384
#: Most elements of an array that is exploded, up to CHUNK ** 3 slots between two readings.
CHUNK = 4_096


def _slots_between(df: DataFrame, first, last, step) -> DataFrame:
    """Each row once for every ``_slot`` in first, first + step ... last; none where first > last. Arrays stay short."""
    df = df.withColumn("_n", F.floor((last - first) / step)).where("_n >= 0")
    for name, size, above in (("_c2", CHUNK**2, None), ("_c1", CHUNK, "_c2"), ("_i", 1, "_c1")):
        begin = f"{above} * {CHUNK}L" if above else "0L"
        end = f"least(_n div {size}L, {above} * {CHUNK}L + {CHUNK - 1})" if above else f"_n div {size}L"
        df = df.withColumn(name, F.explode(F.expr(f"sequence({begin}, {end})")))
    return df.withColumn("_slot", first + F.col("_i") * step).drop("_n", "_c2", "_c1", "_i")


def regular_grid(
    readings: DataFrame,
    keys: Sequence[str],
    time_col: str,
    value_col: str,
    step_col: str,
    max_gap_steps: int = 5,
    bounds: DataFrame | None = None,
    block_slots: int = BLOCK_SLOTS,
) -> DataFrame:
    """One row per key and grid step between the key's first and last finite reading.

    Result: the keys, ``slot_ms``, ``value`` and ``state``. The slot of a reading is floor(time / step) * step. State
    is ``observed`` (value: that of the slot's latest reading, the larger at equal times), ``interpolated`` (linear
    between the neighbouring slots, where at most ``max_gap_steps`` slots lack readings), ``gap`` (value null, longer
    gaps) or ``outside`` (value null; slots that ``bounds`` adds before the first or after the last reading).
    ``bounds`` has the keys, ``from_ms`` and ``to_ms``; a null leaves its side as it is.

    Each key's time is cut into blocks. Readings are reduced to slots before the shuffle; lead pairs each slot with the
    next one of its block; the last slot of a block takes its partner from a summary with one row per block. A hot key
    is therefore many tasks, and only the summary of its blocks is ordered in one.

    Nulls: readings whose key, time, step or value is null, whose value is NaN or infinite, or whose step is not
    positive belong to no grid. Repeated rows change nothing. Empty input gives no rows. Other columns are ignored.
    """
    keys = list(keys)
    t, step = F.col(time_col).cast("bigint"), F.col(step_col).cast("bigint")
    value = F.col(value_col).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & t.isNotNull() & (step > 0)
    for k in keys:
        finite &= F.col(k).isNotNull()
    # expressions of the source's columns come first, so that a key named like an inner column can't clash
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = readings.where(finite).select(*named, t.alias("_t"), step.alias("_step"), value.alias("_v"))
    slot = F.expr("_t - pmod(_t, _step)")
    slots = (
        rows.withColumn("_s", slot)
        .groupBy(*ks, "_step", F.expr(f"floor(_s / (_step * {block_slots}))").alias("_block"), "_s")
        .agg(F.max(F.struct("_t", "_v"))["_v"].alias("_v"))
    )
    by_block = slots.groupBy(*ks, "_step", "_block").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"), F.min_by("_v", "_s").alias("_first_v"))
    per_key = Window.partitionBy(*ks, "_step").orderBy("_block")
    following = by_block.select(*ks, "_step", "_block", F.lead("_first").over(per_key).alias("_next_block_s"), F.lead("_first_v").over(per_key).alias("_next_block_v"))
    w = Window.partitionBy(*ks, "_step", "_block").orderBy("_s")
    paired = (
        slots.withColumn("_ns", F.lead("_s").over(w))
        .withColumn("_nv", F.lead("_v").over(w))
        .join(following, [*ks, "_step", "_block"], "left")
        .withColumn("_nv", F.when(F.col("_ns").isNull(), F.col("_next_block_v")).otherwise(F.col("_nv")))
        .withColumn("_ns", F.coalesce("_ns", "_next_block_s"))
    )
    missing = _slots_between(paired.where("_ns > _s + _step"), F.col("_s") + F.col("_step"), F.col("_ns") - F.col("_step"), F.col("_step"))
    short = F.expr(f"(_ns - _s) div _step - 1 <= {int(max_gap_steps)}")
    out = [F.col(k).alias(name) for k, name in zip(ks, keys)]
    inside = missing.select(
        *out,
        F.col("_slot").alias("slot_ms"),
        F.when(short, F.expr("_v + (_nv - _v) * ((_slot - _s) / (_ns - _s))")).alias("value"),
        F.when(short, "interpolated").otherwise("gap").alias("state"),
    )
    observed = slots.select(*out, F.col("_s").alias("slot_ms"), F.col("_v").alias("value"), F.lit("observed").alias("state"))
    grid = observed.unionByName(inside)
    if bounds is None:
        return grid
    limits = bounds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("from_ms").cast("bigint").alias("_from"), F.col("to_ms").cast("bigint").alias("_to")).groupBy(*ks).agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    ends = by_block.groupBy(*ks, "_step").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")).join(limits, ks)
    before = _slots_between(ends.where("_from is not null"), F.expr("_from - pmod(_from, _step)"), F.col("_first") - F.col("_step"), F.col("_step"))
    after = _slots_between(ends.where("_to is not null"), F.col("_last") + F.col("_step"), F.expr("_to - pmod(_to, _step)"), F.col("_step"))
    outside = [x.select(*out, F.col("_slot").alias("slot_ms"), F.lit(None).cast("double").alias("value"), F.lit("outside").alias("state")) for x in (before, after)]
    return grid.unionByName(outside[0]).unionByName(outside[1])

"""Mixing sources to target weights."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, written

#: Tokens of a block, by less than which a source is ahead or behind; it is scheduled as two units.
BLOCK_TOKENS = 2_048
#: Units of a segment of the schedule, which is one small step of Python inside a Spark task.
SEGMENT = 16_384
#: Documents of a bucket of a source's stream, about; a bucket is what is ordered in one task.
BUCKET_DOCS = 50_000


def quotas(total: float, shares: list[float], capacity: list[float]) -> list[float]:
    """Tokens of each source: in proportion to the shares, none above its capacity, together ``total`` where they suffice.

    What a source cannot give is spread over the others in proportion to their shares. A source of share 0 gives none.
    """
    got, open_ = [0.0] * len(shares), [i for i, s in enumerate(shares) if s > 0 and capacity[i] > 0]
    left = total
    while open_ and left > 1e-9:
        weight = sum(shares[i] for i in open_)
        full = [i for i in open_ if left * shares[i] / weight >= capacity[i]]
        if not full:
            for i in open_:
                got[i] = left * shares[i] / weight
            break
        for i in full:
            got[i] = capacity[i]
        left -= sum(capacity[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return got


def segment_units(units: list[int], length: int = SEGMENT) -> Iterator[list[int]]:
    """How many units each source has in each segment of ``length`` slots, together ``length`` (the last segment: what is left).

    Unit i of a source with u of all n units is released at i n / u and due at (i + 1) n / u. A segment holds all units
    that fall due in it, and then those released before its end that are due first (the source listed first at equal
    deadlines). As units wait for their release and none is late, each source has floor or ceil of its share of the slots
    at every end of a segment.
    """
    n, done = sum(units), [0] * len(units)
    for start in range(0, n, length):
        end = min(start + length, n)
        now = [max(d, u * end // n) for u, d in zip(units, done)]
        open_ = sorted((-(-(k + 1) * n // u), s) for s, (u, k) in enumerate(zip(units, now)) if u and k < -(-u * end // n))
        for _, s in open_[: end - sum(now)]:
            now[s] += 1
        yield [a - b for a, b in zip(now, done)]
        done = now


def pfair_slots(units: list[int]) -> list[tuple[int, int]]:
    """(source, unit of the source) for each slot, of which there are as many as units.

    Unit i of a source with u of all n units is released at floor(i n / u) and due at ceil((i + 1) n / u); each slot goes to
    the released unit that is due first, at equal deadlines to the source listed first. No source is ever a whole unit
    ahead of or behind its share of the slots.
    """
    n, out = sum(units), []
    waiting = [(0, s, 0) for s, u in enumerate(units) if u]  # release, source, unit
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, unit
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * n // units[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i))
        if i + 1 < units[s]:
            heapq.heappush(waiting, ((i + 1) * n // units[s], s, i + 1))
    return out


_QUOTAS = "mix_name string, source string, quota double, units bigint, unit_tokens double, target_share double, max_repeats int, source_tokens double"


def mix_quotas(targets: DataFrame, stock: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per mix and listed source: quota in tokens and in units of half a block, and its share of the mix's target shares.

    ``targets``: mix_name, source, target_share, max_repeats, size_ratio. ``stock``: source, tokens, all_tokens. A group is a
    mix's listed sources; nothing here grows with the documents.
    """

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", kind="stable").reset_index(drop=True)
        capacity = pdf.tokens * pdf.max_repeats
        got = quotas(float(pdf.size_ratio.max()) * float(pdf.all_tokens.max()), [float(x) for x in pdf.target_share], [float(x) for x in capacity])
        unit, weight = block_tokens / 2, float(pdf.target_share.sum())
        return pdf.assign(quota=got, units=[-int(-g // unit) for g in got], unit_tokens=unit, target_share=pdf.target_share / weight if weight else 0.0, source_tokens=pdf.tokens.astype(float))[names]

    names = [x.split()[0] for x in _QUOTAS.split(", ")]
    listed = (
        targets.where(F.col("mix_name").isNotNull() & F.col("source").isNotNull())
        .groupBy("mix_name", F.lower(F.trim("source")).alias("source"))
        .agg(
            F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("target_share"),
            F.coalesce(F.min(F.greatest("max_repeats", F.lit(0))), F.lit(1)).alias("max_repeats"),
            F.coalesce(F.max(F.greatest("size_ratio", F.lit(0.0))), F.lit(0.0)).alias("size_ratio"),
        )
    )
    full = listed.join(F.broadcast(stock.agg(F.max("all_tokens").alias("all_tokens"))), how="cross").join(stock.select("source", "tokens"), "source", "left").fillna(0, ["tokens", "all_tokens"])
    return full.groupBy("mix_name").applyInPandas(plan, _QUOTAS)


def mix_slots(quotas: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """mix_name, source, unit, slot of every unit of every mix.

    Two levels: how many units each source has in each segment (a step a segment, see segment_units), then the order inside
    a segment, each a row of its own that Spark spreads over all tasks. In a segment units are scheduled by their share of
    the segment. Either level is less than a unit off, so that a source is always less than a block, which is two units, ahead or behind.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", kind="stable")
        mix, sources, done, rows = pdf.mix_name.iloc[0], list(pdf.source), [0] * len(pdf), []
        for k, units in enumerate(segment_units([int(u) for u in pdf.units], segment)):
            rows.append((mix, k * segment, sources, list(done), units))
            done = [a + b for a, b in zip(done, units)]
        return pd.DataFrame(rows, columns=["mix_name", "at", "sources", "done", "units"])

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for mix, at, sources, done, units in zip(pdf.mix_name, pdf["at"], pdf.sources, pdf.done, pdf.units):
                slots = pfair_slots([int(u) for u in units])
                yield pd.DataFrame({"mix_name": mix, "source": [sources[s] for s, _ in slots], "unit": [int(done[s]) + i for s, i in slots], "slot": range(int(at), int(at) + len(slots))})

    segments = quotas.where("units > 0").groupBy("mix_name").applyInPandas(split, "mix_name string, at bigint, sources array<string>, done array<bigint>, units array<bigint>")
    n = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(n, "mix_name", "at").mapInPandas(order, "mix_name string, source string, unit bigint, slot bigint")


def stock_of(sized: DataFrame) -> DataFrame:
    """source, tokens and all_tokens (of all rows, those without source too); one row per source."""
    by = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    return by.crossJoin(F.broadcast(sized.agg(F.sum("n_tokens").alias("all_tokens")))).where("source is not null")


def mixed(sized: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, segment: int = SEGMENT) -> DataFrame:
    """The documents of each mix, each as often as it is used: mix_name, source, doc_id, copy_no (from 1), n_tokens, slot, start_token.

    ``sized``: doc_id, source (lower case, trimmed, null: in no mix), n_tokens; one row per document. Read in the order of
    (slot, start_token), a mix's sources interleave evenly: slots are units of half a block, and of each source less than
    a block is ahead of or behind its share (see mix_slots), at any size of the data. A source's
    documents form a stream in an order given by the hash of their ids, repeated up to max_repeats times; start_token is
    a document's place in it. A document is used if more than half of it lies within the source's quota (see quotas), so
    a source misses its quota by at most half a document. Sources that compare equal in a mix add up their shares; the
    smallest max_repeats counts, null as 1. Documents without tokens have no text to add and are left out.

    Place in a stream: sums per bucket of hash values, then the running sum inside each bucket; a source that holds most
    documents is as many tasks as it has buckets. Documents find their unit by arithmetic and join its slot.
    """
    stock = written(stock_of(sized))
    have = sized.select("doc_id", "source", "n_tokens").where("source is not null and n_tokens > 0")
    n = max(1, -(-sized.count() // BUCKET_DOCS))
    have = have.withColumn("_h", F.xxhash64("doc_id")).withColumn("_b", F.pmod("_h", F.lit(n)))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = have.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_sum")).select("source", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    stream = have.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, ["source", "_b"]).withColumn("_at", F.col("_from") + F.col("_in"))
    quotas = written(mix_quotas(targets, stock, block_tokens))
    uses = F.expr("least(max_repeats, greatest(0, ceil((quota - _at - n_tokens / 2) / source_tokens)))").cast("int")
    placed = (
        lookup_join(stream, quotas.where("quota > 0"), ["source"], F.col("doc_id"), "inner")
        .withColumn("_uses", uses)
        .where("_uses > 0")
        .withColumn("copy_no", F.explode(F.expr("sequence(1, _uses)")))
        .withColumn("start_token", F.expr("cast((copy_no - 1) * source_tokens + _at as bigint)"))
        .withColumn("unit", F.expr("least(units - 1, cast(floor(start_token / unit_tokens) as bigint))"))
    )
    return placed.join(mix_slots(quotas, segment), ["mix_name", "source", "unit"]).select("mix_name", "source", "doc_id", "copy_no", "n_tokens", "slot", "start_token")


def reached_shares(mix: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and listed source: target_share (of their sum), quota, tokens and share reached, documents and uses, most uses of one."""
    got = mix.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.sum(F.when(F.col("copy_no") == 1, 1).otherwise(0)).alias("documents"), F.max("copy_no").alias("most_uses"))
    planned = mix_quotas(targets, stock_of(sized)).select("mix_name", "source", "target_share", "quota")
    both = planned.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "uses", "documents", "most_uses"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return both.withColumn("share", F.when(total > 0, F.col("tokens") / total))

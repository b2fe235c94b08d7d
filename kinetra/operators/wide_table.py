"""Attribute-value rows into wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, shuffle_partitions

#: Attributes that are pivoted together.
BLOCK = 64
_BLANK = r"[\s\u00a0\u2000-\u200b\u3000\ufeff]"
_NUMBER = r"[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?"
#: Types by attribute of the sequence headers (fixed values of the data).
HEADER_ATTRIBUTES = {
    "Timestamp": "double",
    "DepthMm": "double",
    "GainPercent": "double",
    "FocusZone": "int",
    "ProbeToTrackerDeviceTransform": "matrix",
    "ReferenceToTrackerDeviceTransform": "matrix",
    "ProbeToTrackerDeviceTransformStatus": "flag",
    "ReferenceToTrackerDeviceTransformStatus": "flag",
    "ImageStatus": "flag",
    "FreezeOn": "flag",
    "OperatorNote": "string",
}


def folded(name: Column) -> Column:
    """A name as it compares: lower case without blanks, _ and -."""
    return F.lower(F.regexp_replace(name, rf"({_BLANK}|[_-])+", ""))


def _bare(value: Column) -> Column:
    """Without outer blanks and quotes."""
    return F.regexp_replace(value, rf"^({_BLANK}|[\"'])+|({_BLANK}|[\"'])+$", "")


def _finite(text: Column) -> Column:
    number = F.when(text.rlike(f"^{_NUMBER}$"), F.translate(text, ",", ".").try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def typed(value: Column, kind: str) -> Column:
    """``value`` as double, int, flag (boolean), matrix (16 doubles) or string; null if blank or not readable so."""
    bare = _bare(value)
    blank = F.regexp_replace(value, rf"{_BLANK}+", "") == ""
    if kind == "double":
        return _finite(bare)
    if kind == "int":
        return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int"))
    if kind == "flag":
        return F.when(~blank & value.isNotNull(), F.upper(bare).isin("OK", "TRUE", "1"))
    if kind == "matrix":
        cells = F.transform(F.split(bare, rf"{_BLANK}+"), _finite)
        return F.when((F.size(cells) == 16) & F.forall(cells, lambda x: x.isNotNull()), cells)
    if kind == "string":
        return F.when(~blank, value)
    raise ValueError(f"no such type: {kind}")


def wide_table(
    rows: DataFrame,
    entity: Sequence[str],
    attribute: Column,
    value: Column,
    order: Column,
    attributes: dict[str, str],
    block: int = BLOCK,
    partitions: int | None = None,
) -> DataFrame:
    """One row per entity with one typed column per attribute.

    ``attributes`` gives each column's type (see typed) by its name; names compare folded. Of several values of an
    attribute the one of the highest ``order`` stands, the largest at equal orders, whether readable or not. Attributes
    not listed are ignored, but an entity that has only such still gets a row. Rows with a null in the entity are left
    out; a null attribute is ignored; a null value counts (as null) and a null order comes before all others.

    The rows are reduced to one value per entity and attribute before the shuffle by entity. The attributes are
    divided into blocks, each block is pivoted over that same partitioning, and the blocks are joined on it:
    however many attributes there are, nothing is shuffled again.
    """
    entity = list(entity)
    es = [f"_e{i}" for i in range(len(entity))]
    n = partitions or shuffle_partitions(rows)
    names = {a.lower().replace("_", "").replace("-", "").replace(" ", ""): a for a in attributes}
    if len(names) < len(attributes):
        raise ValueError("attributes that compare equal")
    have = rows.select(*[F.col(e).alias(x) for e, x in zip(entity, es)], folded(attribute).alias("_a"), F.struct(order.alias("o"), value.cast("string").alias("v")).alias("_ov"))
    for e in es:
        have = have.where(F.col(e).isNotNull())
    # entities without listed attributes keep one row under the empty name
    have = have.withColumn("_a", F.when(F.col("_a").isin(*names), F.col("_a")).otherwise(""))
    standing = have.groupBy(*es, "_a").agg(F.max("_ov")["v"].alias("_v")).repartition(n, *es)
    listed = list(names.items())
    blocks = []
    for at in range(0, len(listed), block):
        part = listed[at : at + block]
        raw = standing.groupBy(*es).agg(*[F.max(F.when(F.col("_a") == folded_name, F.col("_v"))).alias(f"_c{at + i}") for i, (folded_name, _) in enumerate(part)])
        blocks.append(raw.select(*es, *[typed(F.col(f"_c{at + i}"), attributes[name]).alias(name) for i, (_, name) in enumerate(part)]))
    wide = blocks[0]
    for other in blocks[1:]:
        wide = wide.join(other.hint("merge"), es)
    return wide.select(*[F.col(x).alias(e) for x, e in zip(es, entity)], *attributes)


def attribute_kinds(rows: DataFrame, attribute: Column, value: Column, share: float = 0.9) -> DataFrame:
    """What attributes there are: attribute (folded), kind and n, its non-blank values. One aggregation; one row an attribute.

    The kind is the first of int, double and matrix as which at least ``share`` of the values can be read, else string. What wide_table
    is given can be taken from here, and what it isn't given is seen here.
    """
    v = value.cast("string")
    said = rows.select(folded(attribute).alias("attribute"), v.alias("_v")).where(F.col("attribute").isNotNull() & (F.regexp_replace("_v", rf"{_BLANK}+", "") != ""))
    kinds = ("int", "double", "matrix")
    got = said.groupBy("attribute").agg(F.count("*").alias("n"), *[F.count_if(typed(F.col("_v"), k).isNotNull()).alias(f"_{k}") for k in kinds])
    kind = F.lit("string")
    for k in reversed(kinds):
        kind = F.when(F.col(f"_{k}") >= share * F.col("n"), k).otherwise(kind)
    return got.select("attribute", kind.alias("kind"), "n")


def frame_table(fields: DataFrame, attributes: dict[str, str] = HEADER_ATTRIBUTES, block: int = BLOCK) -> DataFrame:
    """The wide table of the frames of recorded sequences, from (sequence_id, line_no, entity, attribute, attr_value).

    Entities other than Seq_Frame with a number are no frames. Frames with a number not below the third number of the
    sequence's DimSize (header entity) are left out; a sequence without a readable DimSize keeps all its frames.
    """
    fields = fields.select("sequence_id", "line_no", folded(F.col("entity")).alias("entity"), "attribute", "attr_value")
    frame = F.regexp_extract("entity", r"^seqframe0*([0-9]{1,9})$", 1)
    frames = fields.where(frame != "").withColumn("frame_id", frame.cast("int"))
    dims = fields.where((F.col("entity") == "header") & (folded(F.col("attribute")) == "dimsize") & F.col("sequence_id").isNotNull())
    third = _bare(F.max(F.struct("line_no", "attr_value"))["attr_value"])
    dims = dims.groupBy("sequence_id").agg(F.get(F.split(third, rf"{_BLANK}+"), F.lit(2)).try_cast("int").alias("_frames"))
    wide = wide_table(frames, ["sequence_id", "frame_id"], F.col("attribute"), F.col("attr_value"), F.col("line_no"), attributes, block)
    return lookup_join(wide, dims, ["sequence_id"], F.col("frame_id")).where("_frames is null or frame_id < _frames").drop("_frames")


def cells(wide: DataFrame, entity: Sequence[str]) -> DataFrame:
    """The non-null cells as (entity..., attribute) rows."""
    names = [c for c in wide.columns if c not in entity]
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names]))
    return wide.select(*entity, F.explode(present).alias("attribute"))

"""Building blocks that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows and bytes of a side that is broadcast; the side is measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: How much larger rows in memory may be than in the files of a written table.
UNPACKED = 16
#: Copies of a lookup row, over which the rows of a hot key spread.
SALTS = 16


def row_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return 16 + F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda n, x: n + row_bytes(x, kind.elementType)), F.lit(0))
    if isinstance(kind, T.MapType):
        return row_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + row_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((row_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("bigint"))
    return F.lit(8).cast("bigint")


def size_of_row(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes in memory."""
    return sum((row_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and so many bytes.

    A table just written tells by its files: UNPACKED times their size is within ``bytes_``. Else a job measures, which stops
    once there are too many rows.
    """
    if UNPACKED * getattr(df, "_file_bytes", bytes_) <= bytes_:
        return True
    n, total = df.select(size_of_row(df).alias("_size")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    return n <= rows and total <= bytes_


def made(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated here, once a row: what follows refers to its result and doesn't repeat its making."""
    return df.withColumn(name, F.explode(F.array(value)))


def merged(df: DataFrame) -> DataFrame:
    """``df`` so that a join with it sorts and merges: for a side of any size.

    Else Spark broadcasts a side whose files are small, and repeated texts or copies of rows may take a hundred times as much in memory.
    """
    return df.hint("merge")


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread: Column, how: str = "left", fits: bool | None = None, hot: bool = True) -> DataFrame:
    """Join many rows with a lookup that has few rows a key.

    A lookup whose measured rows and bytes are within bounds is broadcast. A larger one is salted and merged: each lookup row is
    copied SALTS times and the rows of a key spread over the copies by the hash of ``spread``, so that a hot key
    is no single task. ``how`` is "left", "inner", "left_semi" or "left_anti". Null keys match nothing. The lookup is
    evaluated twice (measured, joined): pass one that is cheap or written, or say whether it ``fits`` if it was measured before.
    Not ``hot``: no key has many rows, so that copies aren't needed.
    """
    on = list(on)
    if small(lookup) if fits is None else fits:
        return rows.join(F.broadcast(lookup), on, how)
    if not hot:
        return rows.join(merged(lookup), on, how)
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(merged(salted), [*on, "_salt"], how).drop("_salt")


def once_per_id(df: DataFrame, key: str) -> DataFrame:
    """``df`` without rows delivered again: those that have the same ``key`` and the same content as another.

    Rows that share a key, or have none, but differ in another column all stay. Only the keys are shuffled to find those
    that repeat. Where these are few (measured), the other rows pass without a shuffle of their wide columns; else all rows are shuffled.
    """
    repeated = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("_repeated"))
    n = repeated.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return df
    if n > BROADCAST_ROWS or not small(repeated):
        return df.dropDuplicates()
    same = F.col(key).eqNullSafe(F.col("_repeated"))
    return df.join(F.broadcast(repeated), same, "left_anti").unionByName(df.join(F.broadcast(repeated), same, "left_semi").dropDuplicates())


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where it names none and all runs on this machine (tests) one is made."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again, so that later steps neither recompute nor lose it.

    Unlike a checkpoint, the table is computed once, only the columns in use are read, and it doesn't keep the estimates of
    the plan that made it, which multiply when each round of a loop joins the one before.
    """
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark = df.sparkSession
    out = spark.read.schema(df.schema).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out._file_bytes = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return out


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

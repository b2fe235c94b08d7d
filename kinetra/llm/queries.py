"""Registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm.encode import token_count, token_ids
from kinetra.llm.mixing import mixed, reached_shares
from kinetra.llm.nearest_time import nearest_in_time
from kinetra.llm.personal_info import personal_spans, redacted
from kinetra.operators.common import lookup_join, once_per_id, written


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    starts = _table(spark, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max("started_epoch_ms").alias("started"), F.max("clock_offset_ms").alias("offset"))
    packets = _table(spark, d, "packets").where("ts is not null and not isnan(ts)").select("packet_id", "session_id", "ts")
    timed = lookup_join(packets, starts, ["session_id"], F.col("packet_id"), "inner").withColumn("at_ms", F.expr("started + 1000 * ts + coalesce(offset, 0)"))
    readings = _table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms")
    return nearest_in_time(timed, readings, ["session_id"], "packet_id", "at_ms", "reading_id", "utc_epoch_ms", 100.0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each packet with a ts, and the nearest reading of its session within 100 ms."""
    return _frame_pairs(spark, d).select("packet_id", "reading_id")


def p4_distance(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their distance in ms."""
    return _frame_pairs(spark, d).select("packet_id", "reading_id", F.round("away", 3).alias("away_ms"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of each document's text."""
    documents = once_per_id(_table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", token_ids(F.col("text")).alias("ids"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    documents = once_per_id(_table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    source = F.lower(F.trim("source"))
    return written(documents.select("doc_id", F.when(source != "", source).alias("source"), token_count(F.col("text")).alias("n_tokens")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix, as often as each is used, with their places in the interleaved order."""
    return mixed(_sized(spark, d), _table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that each mix reaches."""
    sized, targets = _sized(spark, d), _table(spark, d, "mix_targets")
    return reached_shares(mixed(sized, targets), sized, targets)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return once_per_id(_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's text has an email, phone or id number, address or name."""
    spans = personal_spans(_texts(spark, d)).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", F.col("s.kind").alias("pii_kind"), F.col("s.start").alias("start_at"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    texts = _texts(spark, d)
    return redacted(texts, personal_spans(texts))


QUERIES = {f.__name__: f for f in (p4_found, p4_distance, p6_ids, p7_mix, p7_shares, p8_found, p8_texts)}

_PAIRS = """
WITH s AS (SELECT session_id, max(started_epoch_ms) AS started, max(clock_offset_ms) AS off FROM sessions GROUP BY 1),
p AS (SELECT DISTINCT packet_id, session_id, started + 1000 * ts + coalesce(off, 0) AS at_ms FROM packets JOIN s USING (session_id) WHERE ts IS NOT NULL),
r AS (SELECT DISTINCT reading_id, session_id, utc_epoch_ms FROM tracking),
n AS (SELECT packet_id, reading_id, abs(at_ms - utc_epoch_ms) AS away,
  row_number() OVER (PARTITION BY packet_id ORDER BY abs(at_ms - utc_epoch_ms), utc_epoch_ms, reading_id) AS rn
  FROM p JOIN r USING (session_id) WHERE utc_epoch_ms BETWEEN at_ms - 100 AND at_ms + 100)
"""
SQL = {
    "p4_found": _PAIRS + "SELECT packet_id, reading_id FROM n WHERE rn = 1",
    "p4_distance": _PAIRS + "SELECT packet_id, reading_id, round(away, 3) AS away_ms FROM n WHERE rn = 1",
}

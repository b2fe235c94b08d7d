"""Queries of plans, rankings and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.functions.stats import hazen_quantiles
from kinetra.operators.common import written
from kinetra.operators.evaluation import combination_summary, densified, experiment_plan, ranked, surface_rmse
from kinetra.operators.images import grey_sums
from kinetra.operators.scoring import plane_totals, pose_cost
from kinetra.plans.tables import table


def plan_of_experiments(spark, d):
    """Every combination of what stations and sessions offer, with every region's number as seed."""
    stations, sessions = table(spark, d, "stations"), table(spark, d, "sessions")
    lists = {"range_mm": stations.select("range_mm"), "rate_hz": stations.select("nominal_rate_hz"), "grid_ms": sessions.select("grid_ms")}
    return experiment_plan(lists, table(spark, d, "region").select("r_regionkey"))


def combination_quantiles(spark, d):
    """Midpoint quartiles of prices by brand."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q = hazen_quantiles(rows, ["p_brand"], F.col("l_extendedprice"), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return q.select("p_brand", "n", *[F.round(c, 4).alias(c) for c in ("q25", "median", "q75")])


def summary_of_combinations(spark, d):
    """Per order priority: planned, completed, failed and evaluated runs, and quartiles of the evaluated ones."""
    orders = table(spark, d, "orders").withColumn("completed", F.col("o_orderstatus") != "P").withColumn("evaluated", F.col("o_orderstatus") == "F")
    got = combination_summary(orders, ["o_orderpriority"], "completed", "evaluated", "o_totalprice")
    return got.select("o_orderpriority", "planned", "completed", "failed", "evaluated", *[F.round(c, 4).alias(c) for c in ("rate", "q25", "median", "q75", "iqr")])


def run_rank(spark, d):
    """Orders ranked by price; open ones have no rank."""
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("metric"))
    return ranked(orders, "metric", "o_orderkey").select("o_orderkey", "rank")


def combination_rank(spark, d):
    """Customers ranked by the median of their orders' prices."""
    q = hazen_quantiles(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice"), {"median": 0.5})
    medians = written(q.select("o_custkey", F.round("median", 4).alias("median")))  # ranked reads them several times
    return ranked(medians, "median", "o_custkey").select("o_custkey", "median", "rank")


def hyperparameter_grid(spark, d):
    """Mean price for every pair of status and priority, also those without orders."""
    return densified(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("mean", F.round("mean", 3))


def top_k_groups_detail(spark, d):
    """Orders of the twenty customers that spent most."""
    orders = table(spark, d, "orders")
    top = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent")).orderBy(F.desc("spent"), "o_custkey").limit(20)
    return orders.join(F.broadcast(top.select("o_custkey")), "o_custkey", "left_semi").select("o_custkey", "o_orderkey", "o_totalprice")


def surface_rmse_by_label(spark, d):
    """Per label the distance between two triples of each embedding, as if they were vertices of two surfaces."""
    e = table(spark, d, "embeddings")
    at = lambda i: e.select("label", "vec_id", *[F.get("embedding", F.lit(i + k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    return surface_rmse(at(0), at(3), "label", "vec_id").withColumn("rmse", F.round("rmse", 6))


def _scores(spark, d):
    """Packets as planes, the pixels of their images above 40 as hits, the size of the image as initial count."""
    packets = table(spark, d, "packets").dropDuplicates(["packet_id"]).where("image is not null")
    planes = packets.select(F.col("packet_id").alias("plane_id"), (F.col("width") * F.col("height")).alias("n_initial"))
    got = grey_sums(packets.select(F.col("packet_id").alias("plane_id"), "image"), "plane_id", 41)
    return plane_totals(planes, got, ["plane_id"], 255.0, 8.0, 6.0)


def cost_terms(spark, d):
    """Per packet: pixels, coverage and score of its image."""
    return _scores(spark, d).select("plane_id", "n_pixels", "active", "missing", *[F.round(c, 6).alias(c) for c in ("mean_intensity", "coverage", "score")])


def cost_of_pose(spark, d):
    """One cost over all packets."""
    got = pose_cost(_scores(spark, d), 0.5)
    return got.select(F.round("cost", 6).alias("cost"), F.round("mean_intensity", 4).alias("mean_intensity"), "n_active", "n_missing")


def json_props(spark, d):
    """Values out of the events' JSON, counted."""
    parsed = table(spark, d, "events").select("event_type", F.expr("try_parse_json(props)").alias("v"))
    keys = parsed.select("event_type", F.explode(F.map_keys(F.expr("cast(v as map<string, string>)"))).alias("key"))
    return keys.groupBy("event_type", "key").agg(F.count("*").alias("n"))


_MODULE = (plan_of_experiments, combination_quantiles, summary_of_combinations, run_rank, combination_rank, hyperparameter_grid, top_k_groups_detail, surface_rmse_by_label, cost_terms, cost_of_pose, json_props)
QUERIES = {f.__name__: f for f in _MODULE}


def _q(p: float) -> str:
    h = f"greatest(least(n * {p} + 0.5, n), 1)"
    return f"(l[CAST(floor({h}) AS BIGINT)] + ({h} - floor({h})) * (l[CAST(ceil({h}) AS BIGINT)] - l[CAST(floor({h}) AS BIGINT)]))"


_SCORES = """
p AS (SELECT DISTINCT ON (packet_id) * FROM packets WHERE image IS NOT NULL ORDER BY packet_id),
h AS (SELECT packet_id, unnest(list_transform(range(octet_length(image)), lambda i: CAST('0x' || substr(hex(image), i * 2 + 1, 2) AS INT))) AS v FROM p),
g AS (SELECT packet_id, count(*) AS n, avg(v) AS m FROM h WHERE v > 40 GROUP BY 1),
s AS (SELECT packet_id AS plane_id, coalesce(n, 0) AS n_pixels, coalesce(m, 0) AS mean_intensity, least(1, coalesce(n, 0) / greatest(width * height, 8)) AS coverage,
  coalesce(m, 0) / 255 * least(1, coalesce(n, 0) / greatest(width * height, 8)) AS score, width * height >= 8 AS active, coalesce(n, 0) < 6 AS missing FROM p LEFT JOIN g USING (packet_id))
"""
SQL = {
    "plan_of_experiments": """WITH c AS (SELECT range_mm, rate_hz, grid_ms, row_number() OVER (ORDER BY grid_ms, rate_hz, range_mm) AS combination_number
FROM (SELECT DISTINCT range_mm FROM stations WHERE range_mm IS NOT NULL), (SELECT DISTINCT nominal_rate_hz AS rate_hz FROM stations WHERE nominal_rate_hz IS NOT NULL), (SELECT DISTINCT grid_ms FROM sessions WHERE grid_ms IS NOT NULL))
SELECT c.*, printf('combination_%04d', combination_number) AS combination_id, r_regionkey AS seed, row_number() OVER (ORDER BY combination_number, r_regionkey) AS run_number FROM c, region""",
    "combination_quantiles": f"WITH g AS (SELECT p_brand, list_sort(list(l_extendedprice)) AS l, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, n, round({_q(0.25)}, 4) AS q25, round({_q(0.5)}, 4) AS median, round({_q(0.75)}, 4) AS q75 FROM g",
    "summary_of_combinations": f"""WITH c AS (SELECT o_orderpriority, count(*) AS planned, count(*) FILTER (o_orderstatus <> 'P') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'F') AS evaluated FROM orders GROUP BY 1),
g AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c.*, round(evaluated / planned, 4) AS rate, round({_q(0.25)}, 4) AS q25, round({_q(0.5)}, 4) AS median, round({_q(0.75)}, 4) AS q75, round({_q(0.75)} - {_q(0.25)}, 4) AS iqr FROM c LEFT JOIN g USING (o_orderpriority)""",
    "run_rank": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN row_number() OVER (PARTITION BY o_orderstatus <> 'O' ORDER BY o_totalprice, o_orderkey) END AS rank FROM orders",
    "combination_rank": f"WITH g AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT o_custkey, round({_q(0.5)}, 4) AS median FROM g) SELECT o_custkey, median, row_number() OVER (ORDER BY median, o_custkey) AS rank FROM m",
    "hyperparameter_grid": "WITH g AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.o_orderstatus, b.o_orderpriority, round(mean, 3) AS mean, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b LEFT JOIN g USING (o_orderstatus, o_orderpriority)",
    "top_k_groups_detail": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(CAST(o_totalprice AS DECIMAL(18, 2))) DESC, o_custkey LIMIT 20)",
    "surface_rmse_by_label": "SELECT label, count(*) AS n, 0 AS missing, round(sqrt(avg((embedding[1]::DOUBLE - embedding[4]::DOUBLE) ** 2 + (embedding[2]::DOUBLE - embedding[5]::DOUBLE) ** 2 + (embedding[3]::DOUBLE - embedding[6]::DOUBLE) ** 2)), 6) AS rmse FROM embeddings GROUP BY 1",
    "cost_terms": f"WITH {_SCORES} SELECT plane_id, n_pixels, active, missing, round(mean_intensity, 6) AS mean_intensity, round(coverage, 6) AS coverage, round(score, 6) AS score FROM s",
    "cost_of_pose": f"WITH {_SCORES} SELECT round(-avg(score) FILTER (active) + 0.5 * avg(CAST(missing AS INT)) FILTER (active), 6) AS cost, round(sum(mean_intensity * n_pixels) / sum(n_pixels), 4) AS mean_intensity, count(*) FILTER (active) AS n_active, count(*) FILTER (active AND missing) AS n_missing FROM s",
    "json_props": "SELECT event_type, unnest(json_keys(props)) AS key, count(*) AS n FROM events GROUP BY 1, 2",
}

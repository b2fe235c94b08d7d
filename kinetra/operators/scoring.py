"""Scores of poses from the pixels they hit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The cost where no plane is active or a score isn't finite.
WORST = 1e6


def hit_intensities(pixels: DataFrame, images: DataFrame, keys: Sequence[str], image_key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per group of ``keys`` (which hold image_key): n and total of the grey values under its pixels (row, col from 1).

    ``images``: image_key, width, height, image (a byte a pixel, row by row). A group's pixels are a list, at most as long as an image has
    pixels, and meet their image once; pixels of a null or short image don't count. Several images may have one key: they are told apart by the
    columns ``keep``, which come with the result.
    """
    at = F.collect_set((F.col("row") - 1) * F.lit(1 << 20) + F.col("col"))
    lists = pixels.groupBy(*keys).agg(at.alias("_at"))
    joined = lists.join(images.select(image_key, *keep, "width", "height", "image"), image_key).where(F.octet_length("image") == F.col("width") * F.col("height"))
    place = lambda x: (F.floor(x / F.lit(1 << 20)) * F.col("width") + x % F.lit(1 << 20)).cast("int")
    grey = lambda x: F.conv(F.hex(F.substring("image", place(x), F.lit(1))), 16, 10).cast("bigint")
    total = F.aggregate("_at", F.lit(0).cast("bigint"), lambda s, x: s + grey(x))
    return joined.select(*keys, *keep, F.size("_at").cast("bigint").alias("n"), total.alias("total"))


def plane_scores(planes: DataFrame, hits: DataFrame, intensity_max: float, min_reference: float, min_pixels: float) -> DataFrame:
    """plane_totals of single pixels. ``hits``: plane_id, intensity."""
    return plane_totals(planes, hits.groupBy("plane_id").agg(F.count("intensity").alias("n"), F.sum("intensity").alias("total")), ["plane_id"], intensity_max, min_reference, min_pixels)


def plane_totals(planes: DataFrame, got: DataFrame, keys: Sequence[str], intensity_max: float, min_reference: float, min_pixels: float) -> DataFrame:
    """Per plane (``keys``): n_pixels, mean_intensity, coverage, score, active, missing.

    ``planes``: plane_id, n_initial (pixels of the initial pose). ``got``: n and total of the pixels hit. Coverage is n over the larger of
    n_initial and min_reference, at most 1; the score is normalised mean times coverage. A plane is active if n_initial
    reaches min_reference, and missing if it has fewer than min_pixels pixels. Planes without pixels stay, with zeros.
    """
    n = F.coalesce("n", F.lit(0))
    mean = F.coalesce(F.when(F.col("n") > 0, F.col("total") / F.col("n")), F.lit(0.0))
    coverage = F.least(F.lit(1.0), n / F.greatest(F.col("n_initial").cast("double"), F.lit(float(min_reference))))
    score = mean / intensity_max * coverage
    return planes.join(got, list(keys), "left").select(
        *keys, n.alias("n_pixels"), mean.alias("mean_intensity"), coverage.alias("coverage"),
        F.when(F.isnan(score) | score.isNull(), 0.0).otherwise(score).alias("score"),
        (F.col("n_initial") >= min_reference).alias("active"), (n < min_pixels).alias("missing"),
    )


def pose_cost(scores: DataFrame, lambda_missing: float, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per ``keys``, as the pose): cost, mean_intensity over all pixels, n_active, n_missing. The cost is minus the mean score plus lambda times the missing share, over active planes."""
    active, missing = F.col("active"), F.col("active") & F.col("missing")
    cost = -F.avg(F.when(active, F.col("score"))) + lambda_missing * F.avg(F.when(active, F.col("missing").cast("int")))
    total = F.sum("n_pixels")
    return scores.groupBy(*keys).agg(
        F.coalesce(F.when(F.isnan(cost), WORST).otherwise(cost), F.lit(WORST)).alias("cost"),
        F.when(total > 0, F.sum(F.col("mean_intensity") * F.col("n_pixels")) / total).otherwise(0.0).alias("mean_intensity"),
        F.count_if(active).alias("n_active"), F.count_if(missing).alias("n_missing"),
    )

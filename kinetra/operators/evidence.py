"""Bone surfaces in grey images: where each pixel looks like one, and the way through it.

A frame is the largest group; Spark spreads frames over tasks and numpy works on whole images. Depth runs along rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators.images import Segmentation, _each, best_path, huber_smooth, segment


@dataclass(frozen=True)
class Evidence:
    """Lengths in mm. ``weights`` are those of position, reflection and shadow; gaps up to ``gap`` are filled; a group of columns counts
    from ``least_length`` and ``least_confidence`` on; a confidence below ``threshold`` is scaled by ``fallback`` squared; smoothing moves
    a depth by at most ``most_move``.
    """

    blur: float = 0.2
    ridge_blur: float = 0.3
    percentiles: tuple[float, float] = (5.0, 95.0)
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    margin: float = 1.0
    shadow: tuple[float, float] = (0.5, 5.0)
    fallback: float = 0.5
    threshold: float = 0.1
    least_length: float = 2.0
    least_confidence: float = 0.1
    gap: float = 2.0
    smoothness: float = 2.0
    most_move: float = 0.75


def blurred(image: np.ndarray, rows: float, columns: float) -> np.ndarray:
    """A Gaussian over each axis, cut at two standard deviations (in pixels); the border goes on outside."""
    for axis, sigma in ((0, rows), (1, columns)):
        r = int(np.ceil(2 * sigma))
        kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-12)) ** 2)
        kernel /= kernel.sum()
        padded = np.pad(image, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = sum(w * np.take(padded, range(k, k + image.shape[axis]), axis) for k, w in enumerate(kernel))
    return image


def ridge(image: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Minus the Laplacian where it is positive; the border goes on outside."""
    p = np.pad(image, 1, mode="edge")
    down = (p[2:, 1:-1] - 2 * image + p[:-2, 1:-1]) / dy**2
    across = (p[1:-1, 2:] - 2 * image + p[1:-1, :-2]) / dx**2
    return np.maximum(0.0, -(down + across))


def between_percentiles(values: np.ndarray, mask: np.ndarray, percentiles: tuple[float, float]) -> np.ndarray:
    """``values`` between their midpoint percentiles over the mask as 0 to 1; 0.5 if these are equal, 0 outside the mask."""
    if not mask.any():
        return np.zeros(values.shape)
    low, high = np.percentile(values[mask], percentiles, method="hazen")
    if high <= low + np.spacing(max(abs(low), abs(high), 1.0)):
        return np.where(mask, 0.5, 0.0)
    return np.where(mask, np.clip((values - low) / (high - low), 0, 1), 0.0)


def shadow(image: np.ndarray, dy: float, start: float, length: float) -> np.ndarray:
    """How dark it is below each pixel: 1 minus the Gaussian-weighted mean of the rows from start to length below; what lies outside counts as 0.5."""
    first = max(1, int(np.ceil(start / dy)))
    offsets = np.arange(first, max(first, int(np.floor(length / dy))) + 1)
    weights = np.exp(-0.5 * (offsets * dy / max(length / 2, dy)) ** 2)
    total, there = np.zeros(image.shape), np.zeros((len(image), 1))
    for k, w in zip(offsets, weights):
        if k < len(image):
            total[:-k] += w * image[k:]
            there[:-k] += w
    mean = np.where(there > 0, total / np.where(there > 0, there, 1), 0.5)
    covered = np.minimum(there / weights.sum(), 1)
    return covered * (1 - mean) + (1 - covered) * 0.5


def first_peak(values: np.ndarray) -> int:
    """The place of the first value that is no smaller than the one before and larger than the one after; of a rising rest its end."""
    if len(values) == 1 or values[0] >= values[1]:
        return 0
    inner = np.flatnonzero((values[1:-1] >= values[:-2]) & (values[1:-1] > values[2:]))
    if len(inner):
        return int(inner[0]) + 1
    return len(values) - 1 if values[-1] > values[-2] else int(values.argmax())


def position(image: np.ndarray, mask: np.ndarray, dy: float, e: Evidence) -> np.ndarray:
    """How well each pixel of the mask lies between the steepest rise above it and the first peak after that, times how steep it is in its column."""
    p = np.pad(image, ((1, 1), (0, 0)), mode="edge")
    slope, out = (p[2:] - p[:-2]) / (2 * dy), np.zeros(image.shape)
    margin = max(1, int(np.floor(e.margin / dy + 0.5)))
    for c in np.flatnonzero(mask.any(0)):
        rows = np.flatnonzero(mask[:, c])
        steep, near = np.zeros(len(rows)), np.ones(len(rows))
        for k, r in enumerate(rows):
            begin = max(0, r - margin)
            at = begin + int(slope[begin : r + 1, c].argmax())
            if slope[at, c] > 0:
                peak = at + first_peak(image[at : r + margin + 1, c])
                sigma = max(e.ridge_blur / dy, 1.0, 0.5 * abs(peak - at))
                steep[k], near[k] = slope[at, c], np.exp(-0.5 * ((r - 0.5 * (at + peak)) / sigma) ** 2)
        out[rows, c] = steep / steep.max() * near if steep.max() > 0 else e.fallback
    return out


def fused(parts: list[np.ndarray], weights: tuple[float, ...]) -> np.ndarray:
    """The weighted geometric mean, each part at least a millionth, cut to 0 to 1."""
    logs = sum(w * np.log(np.maximum(p, 1e-6)) for w, p in zip(weights, parts))
    return np.clip(np.exp(logs / sum(weights)), 0, 1)


def confidence(image: np.ndarray, mask: np.ndarray, dx: float, dy: float, e: Evidence) -> np.ndarray:
    """The evidence of a surface at each pixel of the mask: its position, its reflection (brightness and ridge) and the shadow below; 0 outside."""
    smooth = blurred(image, e.blur / dy, e.blur / dx)
    lines = ridge(blurred(image, e.ridge_blur / dy, e.ridge_blur / dx), dx, dy)
    unit = lambda v: between_percentiles(v, mask, e.percentiles)
    parts = [position(smooth, mask, dy, e), 0.5 * (unit(smooth) + unit(lines)), unit(shadow(smooth, dy, *e.shadow))]
    return np.where(mask, fused(parts, e.weights), 0.0)


def monotone_fill(at: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values between knots by monotone cubic pieces; a straight line between two knots."""
    h, d = np.diff(at), np.diff(values) / np.diff(at)
    if len(at) == 2:
        return values[0] + d[0] * (wanted - at[0])
    slope = np.zeros(len(at))
    same = d[1:] * d[:-1] > 0
    w0, w1 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope[1:-1] = np.where(same, (w0 + w1) / (w0 / d[:-1] + w1 / d[1:]), 0)
    for k, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        slope[k] = 0 if np.sign(s) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s
    i = np.clip(np.searchsorted(at, wanted, "right") - 1, 0, len(h) - 1)
    x = (wanted - at[i]) / h[i]
    return values[i] * (1 + 2 * x) * (1 - x) ** 2 + h[i] * slope[i] * x * (1 - x) ** 2 + values[i + 1] * x * x * (3 - 2 * x) - h[i] * slope[i + 1] * x * x * (1 - x)


def traced(image: np.ndarray, mask: np.ndarray, dx: float, dy: float, e: Evidence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column the depth in rows (NaN: none), whether it was observed (not filled), and its confidence.

    Columns with candidates form groups between gaps wider than ``gap``; each has its own way, and stays if it is long and
    sure enough. Gaps inside a group are filled by monotone pieces. Each group is smoothed; a moved depth loses
    confidence, and a filled one has the lesser of its ends', less the wider the gap.
    """
    sure = confidence(image, mask, dx, dy, e)
    sure = np.where(sure < e.threshold, e.fallback**2 * sure, sure)
    n = mask.shape[1]
    depth, observed, conf = np.full(n, np.nan), np.zeros(n, bool), np.full(n, np.nan)
    active = np.flatnonzero(mask.any(0))
    for group in np.split(active, np.flatnonzero((np.diff(active) - 1) * dx > e.gap) + 1) if len(active) else ():
        part = np.full(mask.shape, np.nan)
        part[:, group] = np.where(mask[:, group], sure[:, group], np.nan)
        rows = best_path(part, dx, dy, e.smoothness)[group]
        values = sure[rows, group]
        if len(group) * dx < e.least_length or values.mean() < e.least_confidence:
            continue
        span = np.arange(group[0], group[-1] + 1)
        raw = np.interp(span, group, rows).astype(float)
        holes = np.setdiff1d(span, group)
        if len(holes):
            raw[holes - group[0]] = monotone_fill(group.astype(float), rows.astype(float), holes.astype(float))
        weight = np.zeros(len(span))
        weight[group - group[0]] = values
        smooth = huber_smooth(raw * dy, weight, dx, most=e.most_move) / dy
        depth[span], observed[group] = smooth, True
        conf[group] = np.clip(values * np.exp(-np.abs(smooth - raw)[group - group[0]] * dy / e.most_move), 0, 1)
        for a, b in zip(group, group[1:]):
            if b > a + 1:
                conf[a + 1 : b] = min(conf[a], conf[b]) * np.exp(-(b - a - 1) * dx / e.gap) if e.gap > 0 else 0.0
    return depth, observed, conf


def bone_surfaces(frames: DataFrame, id_col: str, dx: float, dy: float, evidence: Evidence = Evidence(), candidates: Segmentation = Segmentation()) -> DataFrame:
    """Per frame (id, width, height, image): depth of the surface per column in rows (null: none), confidence per column, n_observed, n_filled and mean_confidence.

    Candidates are the pixels of the segmentation. Frames whose image is null or has the wrong length have nulls. ``dx`` and ``dy`` are mm a pixel.
    """

    def trace(image: np.ndarray) -> tuple:
        depth, observed, conf = traced(image / 255.0, segment(image, candidates)[0], dx, dy, evidence)
        known = ~np.isnan(depth)
        plain = lambda x: [None if np.isnan(v) else float(v) for v in x]
        return plain(depth), plain(conf), int(observed.sum()), int((known & ~observed).sum()), float(conf[observed].mean()) if observed.any() else None

    names = ["depth", "confidence", "n_observed", "n_filled", "mean_confidence"]
    kinds = f"{id_col} {dict(frames.dtypes)[id_col]}, depth array<double>, confidence array<double>, n_observed double, n_filled double, mean_confidence double"
    out = frames.select(id_col, "width", "height", "image").mapInPandas(_each(trace, names, id_col), kinds)
    return out.withColumns({c: F.col(c).cast("int") for c in ("n_observed", "n_filled")})

"""Grey images of frames: segmentation, and the bone surface in each column.

Spark spreads frames over tasks; each task works on one image at a time with numpy. A frame is the largest group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Segmentation:
    """threshold None: Otsu's. Radii in pixels; components with fewer pixels than min_area go."""

    brightness: float = 0.0
    contrast: float = 1.0
    threshold: int | None = None
    open_radius: int = 0
    close_radius: int = 0
    min_area: int = 25


def otsu(image: np.ndarray) -> int:
    """The grey value above which a pixel is foreground, from the 256-bin histogram."""
    h = np.bincount(image.ravel(), minlength=256).astype(float)
    n = np.cumsum(h)
    m = np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((m[-1] * n / n[-1] - m) ** 2 / (n * (n[-1] - n)))
    best = np.flatnonzero(between == between.max())
    return int(np.floor(best.mean() + 0.5))


def _shifted(mask: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def _disk(r: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= r * r]


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    return np.logical_or.reduce([_shifted(mask, y, x, False) for y, x in _disk(r)])


def erode(mask: np.ndarray, r: int) -> np.ndarray:
    return np.logical_and.reduce([_shifted(mask, y, x, True) for y, x in _disk(r)])


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels of connected pixels, 0 outside; each label is one more than the smallest index of its pixels.

    Runs of pixels are joined with the runs of the row above that they touch (union and find); pixels take their run's label.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded.ravel(), prepend=0)
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # of the padded rows, stop not in it
    if not len(start):
        return np.zeros(mask.shape, int)
    reach = int(diagonal)
    # runs of the row above that end after this run's begin and begin before its end
    first = np.searchsorted(stop, start - (w + 2) - reach, "right")
    last = np.searchsorted(start, stop - (w + 2) + reach, "left")
    many = np.maximum(last - first, 0)
    mine = np.repeat(np.arange(len(start)), many)
    theirs = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(mine))
    root = list(range(len(start)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(mine.tolist(), theirs.tolist()):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    roots = np.array([find(i) for i in range(len(root))])
    place = start - 1 - 2 * (start // (w + 2))  # index in the mask
    out = np.zeros(mask.size, int)
    out[mask.ravel()] = np.repeat(place[roots] + 1, stop - start)
    return out.reshape(mask.shape)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that no path of side neighbours joins to the border becomes foreground."""
    label = components(~mask, diagonal=False)
    outer = np.unique(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]]))
    return ~np.isin(label, outer[outer > 0]) | mask


def perimeter(mask: np.ndarray) -> np.ndarray:
    """Foreground pixels with a background pixel, or the outside, among their eight neighbours."""
    return mask & ~np.logical_and.reduce([_shifted(mask, y, x, False) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x])


def segment(image: np.ndarray, p: Segmentation) -> tuple[np.ndarray, int, int]:
    """Brightness and contrast, threshold, opening, closing, holes, small components, in this order: the mask, its number of components, the threshold used."""
    grey = np.clip(np.floor((image.astype(float) - 127.5) * p.contrast + 127.5 + p.brightness + 0.5), 0, 255).astype(np.uint8)
    threshold = otsu(grey) if p.threshold is None else p.threshold
    mask = grey >= threshold
    if p.open_radius:
        mask = dilate(erode(mask, p.open_radius), p.open_radius)
    if p.close_radius:
        mask = erode(dilate(mask, p.close_radius), p.close_radius)
    label = components(fill_holes(mask))
    sizes = np.bincount(label.ravel())
    sizes[0] = 0
    return sizes[label] >= max(p.min_area, 1), int((sizes >= max(p.min_area, 1)).sum()), threshold


def _each(f: Callable[[np.ndarray], tuple], names: list[str], id_col: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, data, w, h in zip(pdf[id_col], pdf["image"], pdf["width"], pdf["height"]):
                whole = data is not None and not pd.isna(w) and not pd.isna(h) and w > 0 and h > 0 and len(data) == int(w) * int(h)
                out.append((key, *(f(np.frombuffer(bytes(data), np.uint8).reshape(int(h), int(w))) if whole else [None] * len(names))))
            yield pd.DataFrame(out, columns=[id_col, *names])

    return run


def segmented(frames: DataFrame, id_col: str, parameters: Segmentation = Segmentation()) -> DataFrame:
    """Per frame (id, width, height, image row by row): threshold, n_pixels, n_edge, n_blobs and quality of its segmentation.

    Quality is No blobs, Good (1), Fair (2 to 5) or Bad. Frames whose image is null or has the wrong length have nulls.
    """

    def measure(image: np.ndarray) -> tuple:
        mask, blobs, threshold = segment(image, parameters)
        quality = "No blobs" if not blobs else "Good" if blobs == 1 else "Fair" if blobs <= 5 else "Bad"
        return threshold, int(mask.sum()), int(perimeter(mask).sum()), blobs, quality

    names = ["threshold", "n_pixels", "n_edge", "n_blobs", "quality"]
    kind = dict(frames.dtypes)[id_col]
    out = frames.select(id_col, "width", "height", "image").mapInPandas(_each(measure, names, id_col), f"{id_col} {kind}, threshold double, n_pixels double, n_edge double, n_blobs double, quality string")
    return out.select(id_col, *[F.col(n).cast("int").alias(n) for n in names[:4]], "quality")


def best_path(confidence: np.ndarray, dx: float = 1.0, dy: float = 1.0, smoothness: float = 2.0) -> np.ndarray:
    """A row for each column: the way through the image with the least sum of -ln(confidence) and smoothness times slope squared.

    ``confidence``: rows by columns, NaN where there is no candidate; columns without any get -1 and are passed over. Ties take the smallest row.
    """
    columns = np.flatnonzero(~np.isnan(confidence).all(0))
    out = np.full(confidence.shape[1], -1)
    if not len(columns):
        return out
    # only candidates are weighed against each other, so that a column costs the product of two columns' candidates
    rows = np.flatnonzero(~np.isnan(confidence[:, columns[0]]))
    cost, steps = -np.log(np.maximum(confidence[rows, columns[0]], 1e-6)), []
    for a, b in zip(columns, columns[1:]):
        step, here = (b - a) * dx, np.flatnonzero(~np.isnan(confidence[:, b]))
        through = cost[None, :] + smoothness * ((here[:, None] - rows[None, :]) * dy / step) ** 2 * step
        best = through.argmin(1)
        steps.append((rows, best))
        cost, rows = through[np.arange(len(here)), best] - np.log(np.maximum(confidence[here, b], 1e-6)), here
    at = int(cost.argmin())
    out[columns[-1]] = rows[at]
    for c, (before, best) in zip(columns[-2::-1], steps[::-1]):
        at = int(best[at])
        out[c] = before[at]
    return out


def huber_smooth(depth: np.ndarray, weight: np.ndarray, dx: float, wavelength: float = 2.5, delta: float = 0.15, most: float = 0.75, rounds: int = 10, close: float = 0.001) -> np.ndarray:
    """Depths with small second differences, within ``most`` of what they were; columns of weight 0 follow the others.

    Reweighted least squares: a residual beyond delta counts with delta over its size; curvature counts with (wavelength / 2 pi)^4.
    """
    z0 = np.asarray(depth, float)
    n = len(z0)
    if n < 3:
        return z0.copy()
    d2 = np.diff(np.eye(n), 2, axis=0) / dx**2
    penalty = (wavelength / (2 * np.pi)) ** 4 * d2.T @ d2
    z, base = z0.copy(), np.asarray(weight, float)
    for _ in range(rounds):
        size = np.abs(z - z0)
        w = base * np.where(size > delta, delta / np.maximum(size, 1e-12), 1.0)
        free = np.ones(n, bool)
        for _ in range(n):  # bounds that are met hold
            fixed = np.where(free, 0.0, np.clip(z, z0 - most, z0 + most))
            h = np.diag(w) + penalty
            new = fixed.copy()
            new[free] = np.linalg.lstsq(h[np.ix_(free, free)], (w * z0 - h @ fixed)[free], rcond=None)[0]
            over = free & (np.abs(new - z0) > most)
            z_new = np.clip(new, z0 - most, z0 + most)
            if not over.any():
                break
            free &= ~over
            z = z_new
        moved = np.abs(z_new - z).max() if free.all() else np.abs(z_new - z).max()
        z = z_new
        if moved < close:
            break
    return z


def surfaces(frames: DataFrame, id_col: str, dx: float = 1.0, dy: float = 1.0, least: float = 0.2, smooth: bool = True) -> DataFrame:
    """Per frame: rows (a depth in pixels from 0 for each column, -1: none), n_columns and roughness of the brightest smooth way.

    The confidence of a pixel is its grey value over the image's largest, candidates are pixels of at least ``least``.
    Columns without candidates cut the way into stretches; each is smoothed by itself, and roughness counts bends within stretches only.
    """

    def trace(image: np.ndarray) -> tuple:
        c = image.astype(float) / max(int(image.max()), 1)
        path = best_path(np.where(c >= least, c, np.nan), dx, dy).astype(float)
        on = np.flatnonzero(path >= 0)
        stretches = np.split(on, np.flatnonzero(np.diff(on) > 1) + 1)
        for at in stretches:
            if smooth and len(at) >= 3:
                path[at] = huber_smooth(path[at] * dy, c[path[at].astype(int), at], dx) / dy
        bend = np.concatenate([np.diff(path[at], 2) for at in stretches])
        return path.tolist(), len(on), float(np.sqrt((bend**2).mean())) if len(bend) else None

    kind = dict(frames.dtypes)[id_col]
    out = frames.select(id_col, "width", "height", "image").mapInPandas(_each(trace, ["rows", "n_columns", "roughness"], id_col), f"{id_col} {kind}, rows array<double>, n_columns double, roughness double")
    return out.withColumn("n_columns", F.col("n_columns").cast("int"))


def grey_sums(frames: DataFrame, id_col: str, least: int) -> DataFrame:
    """Per frame: n and total of the grey values of at least ``least``, whatever the image's length; no row for a null image."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grey = [np.frombuffer(bytes(x), np.uint8) for x in pdf["image"]]
            yield pd.DataFrame({id_col: pdf[id_col], "n": [int((g >= least).sum()) for g in grey], "total": [int(g[g >= least].sum(dtype=np.int64)) for g in grey]})

    return frames.where("image is not null").select(id_col, "image").mapInPandas(sums, f"{id_col} {dict(frames.dtypes)[id_col]}, n bigint, total bigint")

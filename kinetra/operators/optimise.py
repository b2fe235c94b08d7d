"""Evolution strategy over many runs at once; Spark evaluates every candidate of every run of a generation in one job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.operators.common import written

_STATE = "run string, seed bigint, generation int, mean array<double>, sigma double, cov array<double>, ps array<double>, pc array<double>, best array<double>, best_cost double"


def _constants(n: int, lam: int) -> tuple:
    mu = max(lam // 2, 1)
    w = np.log(max(mu, lam / 2) + 0.5) - np.log(np.arange(1, mu + 1))
    w = w / w.sum()
    eff = w.sum() ** 2 / (w**2).sum()
    cs = (eff + 2) / (n + eff + 3)
    cc = (4 + eff / n) / (n + 4 + 2 * eff / n)
    c1 = 2 / ((n + 1.3) ** 2 + eff)
    cmu = min(1 - c1, 2 * (eff - 2 + 1 / eff) / ((n + 2) ** 2 + eff))
    damp = 1 + 2 * max(0.0, np.sqrt((eff - 1) / (n + 1)) - 1) + cs
    return mu, w, eff, cs, cc, c1, cmu, damp, np.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))


def _sample(row, lam: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw and repaired candidates of a run's generation; the same for the same seed wherever they are drawn."""
    n = len(row.mean)
    values, vectors = np.linalg.eigh(np.array(row.cov, float).reshape(n, n))
    z = np.random.default_rng([int(row.seed), int(row.generation)]).standard_normal((lam, n))
    raw = np.array(row.mean, float) + row.sigma * (z * np.sqrt(np.maximum(values, 1e-20))) @ vectors.T
    return raw, np.clip(raw, low, high)


def evolve(runs: DataFrame, objective: Callable[[DataFrame], DataFrame], low: list[float], high: list[float], population: int, generations: int) -> DataFrame:
    """The best point of each run: run, seed, best, best_cost.

    ``runs``: run, seed. ``objective`` takes (run, candidate, x: array<double>) and gives (run, candidate, cost); it is one
    Spark job a generation. Candidates start around the middle of the box, are moved into it before they are
    evaluated, and pay for the distance; a null or NaN cost counts as 1e6. A run's state is a row of a few numbers;
    states are written to the shared folder every generation, so that a lost executor repeats one generation.
    """
    lo, hi = np.array(low, float), np.array(high, float)
    n, lam = len(lo), int(population)
    start, sigma = ((lo + hi) / 2).tolist(), 0.3
    scale = (np.diag(((hi - lo) / 2) ** 2)).ravel().tolist()
    none = "cast(null as array<double>)"
    state = runs.select(
        F.col("run").cast("string").alias("run"), F.col("seed").cast("bigint").alias("seed"), F.lit(0).alias("generation"), F.array(*map(F.lit, start)).alias("mean"), F.lit(sigma).alias("sigma"),
        F.array(*map(F.lit, scale)).alias("cov"), F.array(*[F.lit(0.0)] * n).alias("ps"), F.array(*[F.lit(0.0)] * n).alias("pc"), F.expr(none).alias("best"), F.lit(float("inf")).alias("best_cost"),
    )
    mu, w, eff, cs, cc, c1, cmu, damp, chi = _constants(n, lam)

    def draw(pdfs):
        for pdf in pdfs:
            out = [(r.run, r.seed, k, x.tolist()) for r in pdf.itertuples() for k, x in enumerate(_sample(r, lam, lo, hi)[1])]
            yield pd.DataFrame(out, columns=["run", "seed", "candidate", "x"])

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        r = next(pdf.itertuples())
        raw, inside = _sample(r, lam, lo, hi)
        cost = np.full(lam, 1e6)
        for k, c in zip(pdf["candidate"], pdf["cost"]):
            if not pd.isna(k) and c is not None and np.isfinite(c):
                cost[int(k)] = c
        spread = np.array(r.cov, float).reshape(n, n)
        order = np.argsort(cost + ((raw - inside) ** 2 / np.maximum(np.diag(spread), 1e-20)).sum(1), kind="stable")
        mean, ps, pc, s = (np.array(v, float) for v in (r.mean, r.ps, r.pc, [r.sigma]))
        s = float(s[0])
        step = (w @ raw[order[:mu]] - mean) / s
        values, vectors = np.linalg.eigh(spread)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-20))) @ vectors.T
        ps = (1 - cs) * ps + np.sqrt(cs * (2 - cs) * eff) * root @ step
        h = np.linalg.norm(ps) / np.sqrt(1 - (1 - cs) ** (2 * (r.generation + 1))) / chi < 1.4 + 2 / (n + 1)
        pc = (1 - cc) * pc + h * np.sqrt(cc * (2 - cc) * eff) * step
        y = (raw[order[:mu]] - mean) / s
        spread = (1 - c1 - cmu) * spread + c1 * (np.outer(pc, pc) + (1 - h) * cc * (2 - cc) * spread) + cmu * (y.T * w) @ y
        s = s * np.exp(min(1.0, cs / damp * (np.linalg.norm(ps) / chi - 1)))
        k = int(np.argmin(cost))
        better = cost[k] < r.best_cost
        best, best_cost = (inside[k].tolist(), float(cost[k])) if better else (r.best, r.best_cost)
        return pd.DataFrame([(r.run, r.seed, r.generation + 1, (mean + s * 0 + float(r.sigma) * step).tolist(), s, spread.ravel().tolist(), ps.tolist(), pc.tolist(), best, best_cost)], columns=[c.split()[0] for c in _STATE.split(", ")])

    state = written(state)
    for _ in range(generations):
        drawn = state.mapInPandas(draw, "run string, seed bigint, candidate int, x array<double>")
        costs = objective(drawn.select(F.concat_ws("#", "run", F.col("seed").cast("string")).alias("run"), "candidate", "x")).select("run", "candidate", "cost")
        keyed = state.withColumn("_k", F.concat_ws("#", "run", F.col("seed").cast("string"))).join(costs.withColumnRenamed("run", "_k"), "_k", "left")
        state = written(keyed.drop("_k").groupBy("run", "seed").applyInPandas(update, _STATE))
    return state.select("run", "seed", "best", "best_cost")

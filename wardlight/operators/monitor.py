"""Batch staleness: kernel two-sample test between the training profile and incoming rows.

The exact pairwise kernel sums are replaced by random Fourier features of the
same kernel: each side becomes one sum vector, so whole training table and whole batch
count, the cost is linear and partial sums merge. The same features serve the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.schema import ROW
from wardlight.session import spread

WIDTH = 1024


@dataclass
class Monitor:
    """``reference`` is the feature sum of the whole training table, ``rows`` its number of rows."""

    features: list[str]
    reference: np.ndarray
    rows: int
    gamma: float
    threshold: float
    seed: int = 42


def fourier(x: np.ndarray, gamma: float, seed: int, width: int = WIDTH) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], width))
    angle = x @ w
    return np.concatenate([np.cos(angle), np.sin(angle)], axis=1) / np.sqrt(width)


def fourier_sum(x: np.ndarray, gamma: float, seed: int, width: int = WIDTH, rows: int = 512) -> np.ndarray:
    """``fourier(...).sum(0)`` over a few hundred rows at a time.

    Angles are counted in turns and brought into half a turn in double precision; only then are they narrowed, since
    single precision cosines take a third of the time. A row's error stays near 1e-7; sums are kept in double precision.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], width)) / (2 * np.pi)
    out = np.zeros(2 * width)
    for at in range(0, len(x), rows):
        turns = x[at:at + rows] @ w
        turns -= np.rint(turns)
        angle = turns.astype(np.float32) * np.float32(2 * np.pi)
        out[:width] += np.cos(angle).sum(0, dtype=float)
        out[width:] += np.sin(angle).sum(0, dtype=float)
    return out / np.sqrt(width)


def kernel_width(df: DataFrame, features: list[str]) -> float:
    """1 / (2 * mean squared distance of two rows), which is twice the sum of the variances of the whole table."""
    spread = df.agg(*[F.var_pop(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"v{i}")
                      for i, c in enumerate(features)]).first()
    distance = 2.0 * sum(v for v in spread if v is not None)
    return 1.0 / (2.0 * distance) if distance > 0 else 1.0 / max(len(features), 1)


def discrepancy(sum_x: np.ndarray, n_x: int, sum_y: np.ndarray, n_y: int) -> float:
    """Unbiased squared discrepancy from feature sums; each row's own kernel value is 1."""
    if not n_x or not n_y:
        return 0.0
    xx = (sum_x @ sum_x - n_x) / (n_x * (n_x - 1)) if n_x > 1 else 0.0
    yy = (sum_y @ sum_y - n_y) / (n_y * (n_y - 1)) if n_y > 1 else 0.0
    return max(0.0, float(xx + yy - 2.0 * (sum_x / n_x) @ (sum_y / n_y)))


def feature_sums(df: DataFrame, features: list[str], gamma: float, seed: int, groups: Column | None = None
                 ) -> dict[int, tuple[np.ndarray, int]]:
    """For each group its feature sum and row count: one small vector per task and group, added up by Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            pdf = pdf[np.isfinite(pdf[features].to_numpy(dtype=float)).all(axis=1)]
            for group, rows in pdf.groupby("_group"):
                part = fourier_sum(rows[features].to_numpy(dtype=float), gamma, seed)
                held[group] = held.get(group, 0.0) + np.append(part, len(rows))
        for group, total in held.items():
            yield pd.DataFrame({"_group": group, "i": np.arange(len(total)), "v": total})

    cast = [F.col(c).cast("double").alias(c) for c in features]
    # A row costs two thousand cosines: a batch that arrives as one file is dealt to all cores first.
    narrow = spread(df.select((F.lit(0) if groups is None else groups).cast("int").alias("_group"), *cast))
    sums = (narrow.mapInPandas(partial, "_group int, i int, v double")
            .groupBy("_group", "i").agg(F.sum("v").alias("v")).collect())  # groups x (2 * WIDTH + 1) rows
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["_group"], np.zeros(2 * WIDTH + 1))[r["i"]] = r["v"]
    return {g: (v[:-1], int(v[-1])) for g, v in out.items()}


def fit_monitor(df: DataFrame, features: list[str], row: str = ROW, batch: int = 32, trials: int = 64,
                quantile: float = 0.95, gamma: float | None = None, seed: int = 42) -> Monitor | None:
    """Profile of the whole table and the alarm threshold.

    The threshold is a quantile of the discrepancies between pairs of disjoint
    row groups, drawn by hash so that a group has about ``batch`` rows.
    """
    n = df.count()
    if n < 2:
        return None
    g = gamma if gamma is not None else kernel_width(df, features)
    total, rows = feature_sums(df, features, g, seed).get(0, (np.zeros(2 * WIDTH), 0))
    wanted = 2 * max(8, trials)
    # group numbers from hashing the row id; rows beyond the wanted groups stay out of the trials
    slots = max(2, min(n // 2, max(wanted, -(-n // max(1, batch)))))
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(row)), F.lit(slots))
    parts = list(feature_sums(df.where(slot < wanted), features, g, seed, slot).values())
    scores = [discrepancy(*x, *y) for x, y in zip(parts[::2], parts[1::2])]
    return Monitor(features, total, rows, g, float(np.quantile(scores, quantile)) if scores else float("inf"), seed)


def batch_sums(df: DataFrame, monitor: Monitor) -> tuple[np.ndarray, int]:
    """Feature sums over the whole batch."""
    return feature_sums(df, monitor.features, monitor.gamma, monitor.seed).get(0, (np.zeros(2 * WIDTH), 0))


def score_batch(df: DataFrame, monitor: Monitor) -> tuple[float, bool]:
    """Discrepancy of the batch and whether it passes the threshold."""
    y, n = batch_sums(df, monitor)
    score = discrepancy(monitor.reference, monitor.rows, y, n)
    return score, bool(np.isfinite(monitor.threshold) and score > monitor.threshold)


def mark_batch(df: DataFrame, features_df: DataFrame, monitor: Monitor | None) -> DataFrame:
    score, alarm = score_batch(features_df, monitor) if monitor else (0.0, False)
    return df.withColumns({
        "distribution_mmd_score": F.lit(score), "distribution_mmd_batch_score": F.lit(score),
        "distribution_mmd_threshold": F.lit(monitor.threshold if monitor else None).cast("double"),
        "distribution_staleness_alarm": F.lit(alarm)})

"""Score-stream drift per patient: CUSUM as window sums, adaptive windowing as a stream scan."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.numeric import finite
from wardlight.operators.ordered import PatientOrder
from wardlight.schema import KEY, ROW, TIME


def per_patient(order: PatientOrder, aggs: dict[str, Column]) -> PatientOrder:
    """Attach whole-history aggregates: a window for ordinary patients, a join for hot ones."""
    if not order.chunked:
        w = Window.partitionBy(*order.groups)
        return order.replace(order.df.withColumns({n: a.over(w) for n, a in aggs.items()}))
    stats = (order.df.where(F.col("_lone").isNull()).groupBy(order.key)
             .agg(*[a.alias(n) for n, a in aggs.items()]))
    return order.replace(order.df.join(stats, order.key, "left"))


def cusum(order: PatientOrder, score: str, baseline_window: int = 5, k: float = 0.25,
          h: float = 5.0) -> PatientOrder:
    """One-sided CUSUM against the mean of the first visits.

    S_t = max(0, S_{t-1} + z_t - k) equals C_t - min(0, min C) for the running
    sum C of (z - k), so two window aggregates replace the recurrence.
    Adds ``visit_index``, ``cusum_stat``, ``cusum_change_index``.
    """
    order = order.position("visit_index")
    order = order.replace(order.df.withColumn("_s", finite(F.col(score))))
    first = F.when(F.col("visit_index") < baseline_window, F.col("_s"))
    order = per_patient(order, {
        "_fm": F.avg(first), "_fs": F.stddev_pop(first), "_am": F.avg("_s"), "_as": F.stddev_pop("_s")})
    mean = F.coalesce(F.col("_fm"), F.col("_am"))
    raw = F.when(F.col("_fm").isNotNull(), F.col("_fs")).otherwise(F.col("_as"))
    narrow = F.greatest(F.lit(1e-6), F.abs(mean) * 0.1 + 1e-6)
    std = F.when(raw > 0, raw).otherwise(narrow)
    df = order.df.withColumns({"drift_baseline_mean": mean, "drift_baseline_std": std})
    df = df.withColumn("_step", (F.col("_s") - F.col("drift_baseline_mean"))
                       / F.col("drift_baseline_std") - F.lit(k))
    order = order.replace(df.drop("_fm", "_fs", "_am", "_as")).running_sum_and_low("_step", "_c", "_low")
    placed = F.col("_lone").isNull()
    stat = F.coalesce(F.col("_c") - F.least(F.lit(0.0), F.col("_low")), F.lit(0.0))
    order = order.replace(order.df.withColumn("cusum_stat", F.when(placed, stat)).drop("_c", "_low", "_step"))
    fired = F.when((F.col("cusum_stat") > h) & F.col("_s").isNotNull(), F.col("visit_index"))
    order = per_patient(order, {"cusum_change_index": F.min(fired)})
    return order.replace(order.df.drop("_s"))


class AdaptiveWindow:
    """Running state of the two-window mean test for one patient.

    A split s of n scores alarms when its prefix sum P strays from s times the
    mean by more than sqrt(c * s * (n - s) / n). Splits lie in blocks of
    ``BLOCK``; a block keeps the largest and smallest stray at some past mean.
    The mean moves little and the allowance only grows with n, so the two
    numbers bound every split of the block for many scores to come. Only blocks
    whose bound turns positive are looked through, and take the mean of that
    moment; the last, open splits are tested one by one. Scores come in runs,
    so a quiet stream costs a few vector operations for each run.

    Differences of prefix sums lose a little to rounding, so they only find
    suspects. Plain sums of both sides in the order of time decide whether one
    alarms and at which split; of equal splits the first counts.
    """

    BLOCK, RUN = 256, 64

    def __init__(self, min_window: int, delta: float):
        self.min_window = min_window
        self.c = 0.5 * math.log(4.0 / min(max(delta, 1e-6), 0.5))
        self.values = np.empty(64)
        self.sums = np.empty(64)
        self.size = 0
        self._reset()

    def _reset(self) -> None:
        self.high, self.low, self.mean = np.empty(0), np.empty(0), np.empty(0)

    def _append(self, xs: np.ndarray) -> None:
        while self.size + len(xs) > len(self.values):
            self.values = np.concatenate([self.values, np.empty(len(self.values))])
            self.sums = np.concatenate([self.sums, np.empty(len(self.sums))])
        at = slice(self.size, self.size + len(xs))
        self.values[at] = xs
        before = self.sums[self.size - 1:self.size]
        self.sums[at] = np.cumsum(np.concatenate([before, xs]))[len(before):]
        self.size += len(xs)

    def _excess(self, n: int, first: int, stop: int) -> np.ndarray:
        """Excess over the bound of the splits first to stop - 1 of the first n scores."""
        left = np.arange(first, stop)
        right = n - left
        heads = self.sums[first - 1:stop - 1]
        gap = np.abs((self.sums[n - 1] - heads) / right - heads / left)
        return gap - np.sqrt(self.c * (1.0 / left + 1.0 / right))

    def _loss(self, n: int) -> float:
        """What an excess among the first n scores may lose to rounding."""
        return 1e-15 * math.sqrt(n) * (1.0 + float(np.abs(self.sums[:n]).max()))

    def _best(self, n: int) -> tuple[float, int]:
        """The strongest split of the first n scores, from plain sums of both sides."""
        m = self.min_window
        every = self._excess(n, m, n - m + 1)
        best, split = -math.inf, m
        for s in np.flatnonzero(every >= every.max() - 2 * self._loss(n)) + m:
            right = n - s
            gap = abs(np.cumsum(self.values[s:n])[-1] / right - self.sums[s - 1] / s)
            found = float(gap - np.sqrt(self.c * (1.0 / s + 1.0 / right)))
            if found > best:
                best, split = found, int(s)
        return best, split

    def _stray(self, block: int, mean: float) -> None:
        """Measure a block at a mean; blocks are measured in order."""
        left = np.arange(block * self.BLOCK + 1, (block + 1) * self.BLOCK + 1)
        stray = self.sums[left - 1] - left * mean
        if block == len(self.high):
            self.high, self.low, self.mean = (np.append(x, 0.0) for x in (self.high, self.low, self.mean))
        self.high[block], self.low[block], self.mean[block] = stray.max(), stray.min(), mean

    def _truncate(self) -> None:
        m = self.min_window
        kept = self.values[self.size - m:self.size].copy()
        self.size = 0
        self._append(kept)
        self._reset()

    def _first_suspect(self, n0: int) -> tuple[int, np.ndarray] | None:
        """The first length after ``n0`` at which a split may alarm, and the blocks that say so."""
        m, block = self.min_window, self.BLOCK
        n = np.arange(n0 + 1, self.size + 1)
        total = self.sums[n - 1]
        closed = max(0, (n0 - m) // block)
        while len(self.high) < closed:
            self._stray(len(self.high), self.sums[n0 - 1] / n0)
        left = np.arange(max(m, closed * block + 1), self.size - m + 1)
        alarm = np.zeros(len(n), bool)
        loss = self._loss(self.size)
        if len(left):
            right = n[:, None] - left[None]
            with np.errstate(divide="ignore", invalid="ignore"):
                heads = self.sums[left - 1][None]
                gap = np.abs((total[:, None] - heads) / right - heads / left[None])
                alarm = ((gap - np.sqrt(self.c * (1.0 / left[None] + 1.0 / right)) > -loss) & (right >= m)).any(axis=1)
        bound = np.zeros((len(n), closed), bool)
        if closed:
            mean = total / n
            ends = np.arange(1, closed + 1) * block
            starts = np.maximum(ends - block + 1, m)
            moved = np.abs(mean[:, None] - self.mean[None]) * ends[None]
            stray = np.maximum(self.high, -self.low)[None] + moved
            allowed = np.sqrt(self.c * np.minimum(starts[None] * (1 - starts[None] / n[:, None]),
                                                  ends[None] * (1 - ends[None] / n[:, None])))
            bound = stray * (1 + 1e-9) + 1e-9 * (1 + np.abs(total[:, None])) > allowed
        suspect = alarm | bound.any(axis=1)
        if not suspect.any():
            return None
        at = int(np.argmax(suspect))
        return int(n[at]), np.flatnonzero(bound[at])

    def extend(self, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add scores; for each the excess over the bound (0 when quiet) and the split (-1 when quiet)."""
        excess, split = np.zeros(len(xs)), np.full(len(xs), -1)
        places = np.flatnonzero(np.isfinite(xs))
        m, at = self.min_window, 0
        while at < len(places):
            n0 = self.size
            run = places[at:at + self.RUN]
            self._append(xs[run])
            found = self._first_suspect(n0) if self.size >= 2 * m else None
            if found is None:
                at += len(run)
                continue
            n, blocks = found
            self.size = n
            at += n - n0
            closed = max(0, (n0 - m) // self.BLOCK)
            tail = max(m, closed * self.BLOCK + 1)
            open_ = self._excess(n, tail, n - m + 1) if n - m + 1 > tail else np.zeros(0)
            loss = self._loss(n)
            hit = bool((open_ > -loss).any())
            for b in blocks:
                first = max(m, b * self.BLOCK + 1)
                hit = hit or bool((self._excess(n, first, (b + 1) * self.BLOCK + 1) > -loss).any())
                self._stray(b, self.sums[n - 1] / n)
            best, where = self._best(n) if hit else (0.0, -1)
            if best > 0:
                excess[places[at - 1]], split[places[at - 1]] = best, where
                self._truncate()
        return excess, split

    def push(self, x: float) -> tuple[float, int | None]:
        """Add one score; returns (excess over the bound, split) with excess 0 when quiet."""
        excess, split = self.extend(np.array([x], float))
        return float(excess[0]), int(split[0]) if split[0] >= 0 else None


ADWIN_SCHEMA = ("row_id {row}, adwin_stat double, adwin_window_index long, adwin_visit_index long")


def adaptive_scan(df: DataFrame, score: str, key: str = KEY, time: str = TIME, row: str = ROW,
                  delta: float = 0.01, min_window: int = 5) -> DataFrame:
    """Two-window mean test along every patient's score stream.

    The test forgets its past after each alarm, so it is a true recurrence:
    rows are sorted per patient by Spark and pass through Arrow batches in runs
    (see ``AdaptiveWindow``), with only the live window held in memory. Only
    four narrow columns travel.

    Adds ``adwin_stat`` per row; ``adwin_window_index`` (position inside the
    live window) and ``adwin_visit_index`` (visit number) on alarm rows.
    """
    kind = df.schema[row].dataType.simpleString()
    narrow = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).cast("string").alias("_k"), F.col(time).alias("_t"), F.col(row).alias("_r"),
        F.col(score).cast("double").alias("_s"))
    # A stream shorter than the window floor can never alarm, so the floor is constant.
    floor = max(2, int(min_window))
    ordered = narrow.repartition("_k").sortWithinPartitions("_k", "_t", "_r")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, visit = None, None, 0
        for pdf in batches:
            n = len(pdf)
            stats, split, visits = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
            scores, keys = pdf["_s"].to_numpy(dtype=float), pdf["_k"].to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.zeros(0, int)
            for a, b in zip(starts, np.append(starts[1:], n), strict=True):
                if state is None or keys[a] != current:
                    current, visit = keys[a], 0
                    state = AdaptiveWindow(floor, delta)
                stats[a:b], split[a:b] = state.extend(scores[a:b])
                visits[a:b] = np.arange(visit, visit + b - a)
                visit += b - a
            quiet = split < 0
            yield pd.DataFrame({
                "row_id": pdf["_r"], "adwin_stat": stats,
                "adwin_window_index": pd.arrays.IntegerArray(np.maximum(split - 1, 0).astype(np.int64), quiet),
                "adwin_visit_index": pd.arrays.IntegerArray(visits, quiet.copy())})

    return ordered.mapInPandas(scan, ADWIN_SCHEMA.format(row=kind)).withColumnRenamed("row_id", row)


def drift_alarms(order: PatientOrder, score: str, baseline_window: int = 5, k: float = 0.25,
                 h: float = 5.0, delta: float = 0.01, min_window: int = 5,
                 adaptive: bool = True) -> PatientOrder:
    """Per-row drift columns; once a stream changes, every later visit is alarmed."""
    order = cusum(order, score, baseline_window, k, h)
    if adaptive:
        scan = adaptive_scan(order.df, score, order.key, order.time, order.row, delta, min_window)
        order = order.replace(order.df.join(scan, order.row, "left"))
        at = F.struct("visit_index", "adwin_window_index")
        order = per_patient(order, {"_hit": F.min(F.when(F.col("adwin_visit_index").isNotNull(), at))})
        hit = F.col("_hit")["adwin_window_index"]
    else:
        order = order.replace(order.df.withColumn("adwin_stat", F.lit(0.0)).withColumn("_hit", F.lit(None)))
        hit = F.lit(None).cast("long")
    by_sum = F.col("cusum_change_index").isNotNull()
    by_window = hit.isNotNull()
    change = F.coalesce(F.col("cusum_change_index"), hit)
    after = F.coalesce(F.col("visit_index") >= change, F.lit(False))
    method = (F.when(by_sum & by_window, "hybrid").when(by_sum, "cusum").otherwise("adwin"))
    df = order.df.withColumns({
        "score_stream_drift_alarm": after,
        "score_stream_cusum_alarm": after & by_sum,
        "score_stream_adwin_alarm": after & by_window,
        "score_stream_cusum_stat": F.coalesce(F.col("cusum_stat"), F.lit(0.0)),
        "score_stream_adwin_stat": F.coalesce(F.col("adwin_stat"), F.lit(0.0)),
        "score_stream_drift_change_index": F.when(after, change).otherwise(F.lit(-1)),
        "score_stream_drift_method": F.when(after, method).otherwise(F.lit("none")),
    })
    return order.replace(df.drop(
        "cusum_stat", "cusum_change_index", "adwin_stat", "adwin_window_index", "adwin_visit_index",
        "_hit", "drift_baseline_mean", "drift_baseline_std"))

"""Structured Streaming forms of the batch operators.

Per-patient state needs a restart-safe store: ``use_state_store`` selects the
RocksDB provider. Checkpoint locations belong in shared storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from wardlight.functions.numeric import finite
from wardlight.operators.drift import AdaptiveWindow
from wardlight.operators.feedback import normalize_feedback
from wardlight.operators.fusion import decide
from wardlight.operators.heads import score_point
from wardlight.operators.monitor import Monitor, score_batch
from wardlight.operators.ranking import ordered_totals
from wardlight.operators.risk import clinical_risk
from wardlight.schema import KEY, ROW, TIME
from wardlight.session import cut_lineage, fits

# A calibration profile of more rows is looked up by a join instead of broadcast.
CALIBRATION_ROWS = 2_000_000
# Distinct scores of the profile in one row of its table.
SCORES_PER_BIN = 512


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _profile(calibration: DataFrame, column: str) -> DataFrame:
    return calibration.select(finite(F.col(column)).alias("v")).where("v IS NOT NULL")


def p_value(score: str, calibration: DataFrame, column: str | None = None):
    """Conformal p-value against a calibration profile small enough to broadcast (checked)."""
    values = _profile(calibration, column or score)
    if not fits(values, CALIBRATION_ROWS):
        raise ValueError("calibration profile too large to broadcast; use with_p_value")
    ordered = np.sort(values.toPandas()["v"].to_numpy(dtype=float))
    shared = calibration.sparkSession.sparkContext.broadcast(ordered)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        cal = shared.value
        x = s.to_numpy(dtype=float)
        above = len(cal) - np.searchsorted(cal, x, side="left")
        return pd.Series(np.where(np.isfinite(x) & (len(cal) > 0), (1.0 + above) / (len(cal) + 1.0), np.nan))

    return F.nanvl(run(F.col(score)), F.lit(None).cast("double"))


def with_p_value(df: DataFrame, score: str, calibration: DataFrame, column: str | None = None) -> DataFrame:
    """``conformal_p_value`` for a stream or a table, whatever the size of the profile.

    Beyond ``CALIBRATION_ROWS`` the profile becomes a table of ``SCORES_PER_BIN``
    distinct scores a row, each with its count of scores at or above it. A score
    finds its row by the highest score of every row (the only part that is
    broadcast) in a stream-static join, and its count inside that row.
    """
    values = _profile(calibration, column or score)
    if fits(values, CALIBRATION_ROWS):
        return df.withColumn("conformal_p_value", p_value(score, calibration, column))
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).withColumn("r", F.lit(1).cast("long"))
    totals = ordered_totals(counted, [], "v", ["c", "r"], descending=True)
    table = cut_lineage(totals.groupBy(F.floor((F.col("cum_r") - 1) / SCORES_PER_BIN).alias("_b")).agg(
        F.max("v").alias("_top"), F.max("cum_c").alias("_n"),
        F.collect_list(F.struct("v", F.col("cum_c").alias("c"))).alias("_scores")))
    held = table.select("_b", "_top", "_n").toPandas().sort_values("_top")
    n = int(held["_n"].max())
    shared = df.sparkSession.sparkContext.broadcast((held["_top"].to_numpy(float), held["_b"].to_numpy(np.int64)))

    @F.pandas_udf("long")
    def row_of(s: pd.Series) -> pd.Series:
        tops, rows = shared.value
        at = np.searchsorted(tops, s.to_numpy(dtype=float), side="left")
        return pd.Series(np.where(at < len(tops), rows[np.minimum(at, len(rows) - 1)], -1))

    x = finite(F.col(score))
    above = F.aggregate("_scores", F.lit(0).cast("long"), lambda a, s: F.when(s["v"] >= x, F.greatest(a, s["c"])).otherwise(a))
    out = df.withColumn("_b", row_of(x)).join(table.select("_b", "_scores"), "_b", "left")
    p = F.when(x.isNotNull(), (F.coalesce(above, F.lit(0)) + 1.0) / F.lit(n + 1.0))
    return out.withColumn("conformal_p_value", p).select(*df.columns, "conformal_p_value")


def score_stream(df: DataFrame, baseline: dict[str, tuple[float, float]], threshold: float,
                 calibration: DataFrame | None = None, alpha: float = 0.05,
                 score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stateless scoring with fitted profiles: point head, decision, p-value and clinical risk.

    ``score`` may replace the point score as ``anomaly_score`` (any row-wise scorer).
    """
    out = score_point(df, baseline)
    out = score(out) if score else out.withColumn("anomaly_score", F.col("point_anomaly_score"))
    out = decide(out, "anomaly_score", threshold)
    if calibration is not None:
        out = with_p_value(out, "anomaly_score", calibration)
        out = out.withColumn("conformal_is_anomalous", F.coalesce(F.col("conformal_p_value") <= alpha, F.lit(False)))
    return clinical_risk(out)


def _in_order(batches: Iterator[pd.DataFrame], time: str, row: str) -> pd.DataFrame:
    """One key's rows of one micro-batch; the trigger's size limit bounds them."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return pd.DataFrame()
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
    # two stable sorts by one column take a fraction of the time of one sort by two
    return pdf.sort_values(row, kind="stable").sort_values(time, kind="stable")


class ContextualState(StatefulProcessor):
    """Running count, mean and squared deviation of every feature of a patient.

    A missing measurement neither scores nor counts for its feature, as in the
    batch operator; the visit still counts as history.
    """

    def __init__(self, features: list[str], key: str = KEY, time: str = TIME, row: str = ROW):
        self.features, self.key, self.time, self.row = features, key, time, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "n long, counts array<long>, mean array<double>, m2 array<double>")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        d = len(self.features)
        n, counts, mean, m2 = 0, np.zeros(d), np.zeros(d), np.zeros(d)
        if self.state.exists():
            held = self.state.get()
            n, counts, mean, m2 = int(held[0]), *(np.array(x, dtype=float) for x in held[1:])
        pdf = _in_order(rows, self.time, self.row)
        if not len(pdf):
            return
        x = pdf[self.features].to_numpy(dtype=float)
        there = ~np.isnan(x)
        # deviations from a fixed point of each feature: its mean so far, or the first value
        first = x[there.argmax(axis=0), np.arange(d)]
        centre = np.where(counts > 0, mean, np.where(there.any(axis=0), first, 0.0))
        gap = np.where(there, x - centre, 0.0)
        before = lambda part, start: start + np.cumsum(part, axis=0) - part
        seen = before(there.astype(float), counts)
        size = np.maximum(seen, 1.0)
        shift = before(gap, 0.0) / size
        std = np.sqrt(np.maximum(before(gap ** 2, m2) / size - shift ** 2, 0.0))
        z = np.where(there & (seen > 0), (gap - shift) / np.where(std > 1e-12, std, 1.0), 0.0)
        top = np.abs(z).argmax(axis=1)
        peak = np.abs(z).max(axis=1)
        known = (there & (seen > 0)).any(axis=1)
        yield pd.DataFrame({
            self.row: pdf[self.row].to_numpy(), "contextual_anomaly_score": peak / (peak + 3.0),
            "contextual_anomaly_max_abs_zscore": peak,
            "contextual_anomaly_top_feature": np.where(known, np.array(self.features, object)[top], ""),
            "contextual_anomaly_top_feature_zscore": z[np.arange(len(z)), top],
            "contextual_anomaly_history_length": n + np.arange(len(x))})
        total = counts + there.sum(axis=0)
        moved = gap.sum(axis=0) / np.maximum(total, 1.0)
        spread = m2 + (gap ** 2).sum(axis=0) - total * moved ** 2
        self.state.update((n + len(x), total.astype(int).tolist(), (centre + moved).tolist(),
                           np.maximum(spread, 0.0).tolist()))

    def close(self) -> None:
        pass


def contextual_stream(df: DataFrame, features: list[str], key: str = KEY, time: str = TIME, row: str = ROW) -> DataFrame:
    kind = dict(df.dtypes)[row]
    schema = (f"{row} {kind}, contextual_anomaly_score double, contextual_anomaly_max_abs_zscore double, "
              "contextual_anomaly_top_feature string, contextual_anomaly_top_feature_zscore double, "
              "contextual_anomaly_history_length long")
    return (df.select(key, time, row, *features).groupBy(key).transformWithStateInPandas(
        ContextualState(features, key, time, row), schema, "Append", "None"))


class DriftState(StatefulProcessor):
    """CUSUM and adaptive window of one patient's score stream.

    The first ``warm_up`` scores set the baseline and report no statistic;
    afterwards the values equal the batch operator's.
    """

    def __init__(self, score: str, time: str = TIME, row: str = ROW, warm_up: int = 5, k: float = 0.25,
                 h: float = 5.0, delta: float = 0.01, min_window: int = 5):
        self.score, self.time, self.row = score, time, row
        self.warm_up, self.k, self.h, self.delta, self.min_window = warm_up, k, h, delta, min_window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "drift", "n long, first array<double>, s double, change long, live array<double>, jump long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        n, first, s, change, live, jump = 0, [], 0.0, -1, [], -1
        if self.state.exists():
            n, first, s, change, live, jump = self.state.get()
            first = list(first)
        window = AdaptiveWindow(max(2, self.min_window), self.delta)
        window._append(np.asarray(live, float))
        pdf = _in_order(rows, self.time, self.row)
        if not len(pdf):
            return
        scores = pdf[self.score].to_numpy(dtype=float)
        excess, splits = window.extend(scores)
        mean, std = self._baseline(first) if n >= self.warm_up else (0.0, 1.0)
        visits, stats, alarms = np.arange(n, n + len(scores)), [], []
        for x, ok, split in zip(scores.tolist(), np.isfinite(scores).tolist(), splits.tolist()):
            if n < self.warm_up:
                first.append(x if ok else float("nan"))
                if n == self.warm_up - 1:
                    mean, std = self._baseline(first)
                    for i, v in enumerate(first):
                        if np.isfinite(v):
                            s = max(0.0, s + (v - mean) / std - self.k)
                            if s > self.h and change < 0:
                                change = i
            elif ok:
                s = max(0.0, s + (x - mean) / std - self.k)
                if s > self.h and change < 0:
                    change = n
            if split >= 0 and jump < 0:
                jump = max(0, split - 1)
            at = change if change >= 0 else jump
            stats.append(s if n >= self.warm_up - 1 else 0.0)
            alarms.append(at >= 0 and n >= at)
            n += 1
        self.state.update((n, first, float(s), int(change), window.values[:window.size].tolist(), int(jump)))
        yield pd.DataFrame({self.row: pdf[self.row].to_numpy(), "visit_index": visits, "cusum_stat": stats,
                            "adwin_stat": excess, "drift_alarm": alarms})

    def _baseline(self, first: list[float]) -> tuple[float, float]:
        base = np.array([v for v in first if np.isfinite(v)])
        mean = float(base.mean()) if len(base) else 0.0
        std = float(base.std()) if len(base) else 1.0
        return mean, std if std > 0 else max(1e-6, abs(mean) * 0.1 + 1e-6)

    def close(self) -> None:
        pass


def drift_stream(df: DataFrame, score: str, key: str = KEY, time: str = TIME, row: str = ROW, **options) -> DataFrame:
    kind = dict(df.dtypes)[row]
    schema = f"{row} {kind}, visit_index long, cusum_stat double, adwin_stat double, drift_alarm boolean"
    return df.select(key, time, row, score).groupBy(key).transformWithStateInPandas(
        DriftState(score, time, row, **options), schema, "Append", "None")


class WindowState(StatefulProcessor):
    """The last few feature vectors of a patient, for visit windows."""

    def __init__(self, features: list[str], size: int = 4, time: str = TIME, row: str = ROW):
        self.features, self.size, self.time, self.row = features, size, time, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "held array<double>")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        d = len(self.features)
        held = list(np.reshape(self.state.get()[0], (-1, d))) if self.state.exists() else []
        pdf = _in_order(rows, self.time, self.row)
        out = []
        for rid, x in zip(pdf[self.row], pdf[self.features].to_numpy(dtype=float)):
            held = (held + [x])[-self.size:]
            pad = [np.zeros(d)] * (self.size - len(held))
            out.append((rid, np.concatenate(pad + held).tolist(), len(held)))
        self.state.update((np.concatenate(held[-(self.size - 1):]).tolist(),) if self.size > 1 else ([],))
        yield pd.DataFrame(out, columns=[self.row, "window", "sequence_history_length"])

    def close(self) -> None:
        pass


def window_stream(df: DataFrame, features: list[str], size: int = 4, key: str = KEY, time: str = TIME,
                  row: str = ROW) -> DataFrame:
    """Flattened zero-padded windows of the last ``size`` visits."""
    kind = dict(df.dtypes)[row]
    return df.select(key, time, row, *features).groupBy(key).transformWithStateInPandas(
        WindowState(features, size, time, row), f"{row} {kind}, window array<double>, sequence_history_length long",
        "Append", "None")


def trend_stream(df: DataFrame, time: str = TIME, score: str = "anomaly_score", late: str = "1 day",
                 alert_at: float = 0.7) -> DataFrame:
    """Daily trend; a day is emitted once the watermark has passed it, later rows are dropped."""
    return (df.withWatermark(time, late).groupBy(F.window(time, "1 day"))
            .agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
                 F.sum((F.col(score) >= alert_at).cast("long")).alias("alerts"), F.count(F.lit(1)).alias("rows"))
            .select(F.col("window.start").alias("day"), "mean_score", "max_score", "alerts", "rows"))


def monitor_stream(df: DataFrame, monitor: Monitor, sink: Callable[[DataFrame, int], None],
                   checkpoint: str, **trigger) -> StreamingQuery:
    """Staleness of every micro-batch: ``sink`` receives one row (batch, score, alarm).

    A batch may be run again after a failure with the same number: the sink
    should overwrite by it.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        if not held.isEmpty():
            value, alarm = score_batch(held, monitor)
            sink(batch.sparkSession.createDataFrame(
                [(batch_id, value, alarm)], "batch_id long, mmd double, alarm boolean"), batch_id)
        held.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def ledger_stream(df: DataFrame, path: str, checkpoint: str, late: str = "7 days", **trigger) -> StreamingQuery:
    """Append arriving feedback payloads to the ledger, each review once.

    Duplicates are dropped by (alert_id, reviewed_at) inside the watermark; each
    micro-batch writes its own folder, so a replay overwrites instead of repeating.
    """
    rows = normalize_feedback(df).withColumn("_at", F.col("reviewed_at").try_cast("timestamp"))
    once = rows.withWatermark("_at", late).dropDuplicatesWithinWatermark(["alert_id", "reviewed_at"]).drop("_at")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.where("feedback_label IS NOT NULL").write.mode("overwrite").json(f"{path}/batch={batch_id}")

    writer = once.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_trigger: int = 100) -> DataFrame:
    """Arriving files as a stream; the per-trigger limit bounds every micro-batch."""
    return (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path))

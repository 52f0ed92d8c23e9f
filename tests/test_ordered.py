"""The chunked form for hot patients must equal the plain form."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators.assembly import as_of
from wardlight.operators.drift import AdaptiveWindow, adaptive_scan, cusum, drift_alarms
from wardlight.operators.heads import score_contextual
from wardlight.operators.history import (
    longitudinal_features, previous_run, readmissions, sequence_windows, visit_intervals)
from wardlight.operators.ordered import PatientOrder, hot_keys
from wardlight.sources.standins import visits


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """A third of all visits belong to one patient; some values are missing."""
    df = visits(spark, sf)
    return df.withColumns({
        "patient_id": F.when(F.col("row_id") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("patient_id")),
        "value": F.when(F.col("row_id") % 11 != 0, F.col("value")),
    }).persist()


def both(df, build, columns):
    plain = build(PatientOrder(df, hot=None)).done()
    hot = hot_keys(df, max_rows=100)
    assert hot is not None and hot.count() == 1
    chunked = build(PatientOrder(df, hot=hot)).done()
    a = plain.select("row_id", *columns).toPandas().sort_values("row_id").reset_index(drop=True)
    b = chunked.select("row_id", *columns).toPandas().sort_values("row_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)
    return a


def test_position_and_lags(skewed):
    both(skewed, lambda o: o.position().lag(["value", "k"], (1, 2, 3)),
         ["visit_index", "value_lag1", "value_lag2", "k_lag3"])


def test_rolling_windows(skewed):
    both(skewed, lambda o: longitudinal_features(o, ["value", "k"], (7, 30), (1,)),
         ["value_mean_7d", "value_std_7d", "k_mean_30d", "k_std_30d", "value_lag1"])


def test_contextual(skewed):
    out = both(skewed.fillna(0.0, ["value"]), lambda o: score_contextual(o, ["value", "k"]),
               ["contextual_anomaly_score", "contextual_anomaly_history_length", "contextual_anomaly_top_feature"])
    first = out[out["contextual_anomaly_history_length"] == 0]
    assert (first["contextual_anomaly_score"] == 0).all() and (first["contextual_anomaly_top_feature"] == "").all()


def test_constant_series_has_no_spread(skewed):
    flat = skewed.withColumn("value", F.lit(0.1))
    out = both(flat, lambda o: score_contextual(o, ["value"]), ["contextual_anomaly_score"])
    assert out["contextual_anomaly_score"].max() < 1e-9


def test_cusum(skewed):
    both(skewed, lambda o: cusum(o, "value"), ["cusum_stat", "cusum_change_index"])


def test_windows_and_intervals(skewed):
    both(skewed, lambda o: previous_run(o, "k"), ["score_delta", "direction"])
    both(skewed, lambda o: visit_intervals(o, 7, keep=3), ["days_since_last_visit", "visits_last_7_days"])
    both(skewed, lambda o: readmissions(o, F.col("source_type") == "error", 7), ["readmissions_7d"])
    plain = sequence_windows(PatientOrder(skewed, hot=None), ["value", "k"]).done()
    hot = sequence_windows(PatientOrder(skewed, max_rows=100), ["value", "k"]).done()
    same = plain.select("row_id", "sequence_window").exceptAll(hot.select("row_id", "sequence_window"))
    assert same.isEmpty()


def test_cusum_against_the_recurrence(skewed):
    df = cusum(PatientOrder(skewed, hot=None), "value").done().toPandas().sort_values(["patient_id", "recorded_at"])
    for _, g in df.groupby("patient_id"):
        x = g["value"].to_numpy(dtype=float)
        base = x[:5][np.isfinite(x[:5])]
        base = base if len(base) else x[np.isfinite(x)]
        mean, std = (base.mean(), base.std()) if len(base) else (0.0, 1.0)
        std = std if std > 0 else max(1e-6, abs(mean) * 0.1 + 1e-6)
        s, expected = 0.0, []
        for v in x:
            if np.isfinite(v):
                s = max(0.0, s + (v - mean) / std - 0.25)
            expected.append(s)
        np.testing.assert_allclose(g["cusum_stat"].to_numpy(), expected, atol=1e-8)


def reference_adaptive(x, m=5, delta=0.01):
    """Plain double loop over all splits."""
    live, stats, first = [], [], None
    for v in x:
        if np.isfinite(v):
            live.append(v)
        best, cut = 0.0, None
        if len(live) >= 2 * m:
            for s in range(m, len(live) - m + 1):
                a, b = np.array(live[:s]), np.array(live[s:])
                e = abs(b.mean() - a.mean()) - np.sqrt(0.5 * np.log(4 / delta) * (1 / len(a) + 1 / len(b)))
                if e > best:
                    best, cut = e, s
            if best > 0:
                first = first if first is not None else cut - 1
                live = live[-m:]
        stats.append(best)
    return stats, first


def test_adaptive_window_matches_all_splits(spark, skewed):
    scan = adaptive_scan(skewed, "value").toPandas().set_index("row_id")
    df = skewed.toPandas().sort_values(["patient_id", "recorded_at"])
    for pid, g in df.groupby("patient_id"):
        stats, _ = reference_adaptive(g["value"].to_numpy(dtype=float))
        np.testing.assert_allclose(scan.loc[g["row_id"], "adwin_stat"], stats, atol=1e-8)
    w = AdaptiveWindow(5, 0.01)
    hits = [w.push(v)[1] for v in [0.0] * 20 + [5.0] * 20]
    assert any(h is not None for h in hits)


def plain_windows(x, m, delta):
    """All splits of every window, with numpy."""
    live, out = np.empty(0), []
    c = 0.5 * np.log(4 / delta)
    for v in x:
        if np.isfinite(v):
            live = np.append(live, v)
        n = len(live)
        out.append((0.0, -1))
        if n >= 2 * m:
            s = np.arange(m, n - m + 1)
            p = np.cumsum(live)
            e = np.abs((p[-1] - p[s - 1]) / (n - s) - p[s - 1] / s) - np.sqrt(c * (1 / s + 1 / (n - s)))
            if e.max() > 0:
                out[-1] = (e.max(), s[e.argmax()])
                live = live[-m:]
    return np.array(out)


@pytest.mark.parametrize("name", ["quiet", "drift", "steps", "edge", "gaps"])
def test_adaptive_window_in_runs_equals_all_splits(name):
    rng = np.random.default_rng(8)
    n = 3000
    x = {"quiet": rng.normal(0, 0.05, n), "drift": np.linspace(0, 2, n) + rng.normal(0, 0.3, n),
         "steps": np.repeat(rng.normal(0, 1, 30), 100) + rng.normal(0, 0.2, n),
         "edge": rng.normal(0, 1.5, n), "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.normal(0, 0.6, n))}[name]
    expected = plain_windows(x, 5, 0.01)
    for cuts in ([], [1, 2, 700, 701, 2048]):  # however the stream is cut into batches
        w = AdaptiveWindow(5, 0.01)
        got = [np.column_stack(w.extend(part)) for part in np.split(x, cuts)]
        np.testing.assert_allclose(np.vstack(got), expected, atol=1e-12)
    w = AdaptiveWindow(5, 0.01)
    assert [w.push(v)[1] or -1 for v in x[:400]] == expected[:400, 1].tolist()


@pytest.mark.parametrize("seed", range(80, 340, 4))
def test_adaptive_window_ties_go_to_the_first_split(seed):
    """Few levels and repeats make equal splits; plain sums in the order of time, as in SQL, tell which are equal."""
    for rng in (np.random.default_rng(seed), np.random.default_rng(seed + 23)):
        x = np.round(rng.integers(0, 4, 60) * rng.choice([0.1, 0.7, 1.1, 3.3]), 2)
        x = np.repeat(x[:20], 3) if seed % 8 == 0 else x
        live, expected = [], []
        for v in x.tolist():
            live.append(v)
            best, cut, n = 0.0, -1, len(live)
            for s in range(5, n - 4):
                left, right = float(np.cumsum(live[:s])[-1]), float(np.cumsum(live[s:])[-1])
                e = abs(right / (n - s) - left / s) - np.sqrt(0.5 * np.log(4 / 0.01) * (1.0 / s + 1.0 / (n - s)))
                best, cut = (e, s) if e > best else (best, cut)
            live = live[-5:] if best > 0 else live
            expected.append((float(best), cut))
        excess, split = AdaptiveWindow(5, 0.01).extend(x)
        assert [*zip(excess.tolist(), split.tolist(), strict=True)] == expected


def test_adaptive_window_grows_nearly_in_proportion():
    """A quiet stream of 16 times the length costs far less than 256 times the work."""
    def seconds(n):
        x = np.random.default_rng(1).normal(0, 0.05, n)
        start = time.perf_counter()
        AdaptiveWindow(5, 0.01).extend(x)
        return time.perf_counter() - start

    seconds(2000)
    assert min(seconds(80_000) for _ in range(2)) < 60 * max(min(seconds(5_000) for _ in range(3)), 1e-3)


def test_alarms_persist_and_name_their_method(skewed):
    out = drift_alarms(PatientOrder(skewed, hot=None), "value").done().toPandas()
    for _, g in out.sort_values(["patient_id", "recorded_at"]).groupby("patient_id"):
        flags = g["score_stream_drift_alarm"].to_numpy()
        assert (np.diff(flags.astype(int)) >= 0).all()
    assert set(out["score_stream_drift_method"]) <= {"none", "cusum", "adwin", "hybrid"}
    on = out[out["score_stream_drift_alarm"]]
    assert (on["visit_index"] >= on["score_stream_drift_change_index"]).all()


def test_later_visits_never_change_earlier_rows(skewed):
    cut = skewed.agg(F.expr("percentile(cast(recorded_at as double), 0.5)")).first()[0]
    early = skewed.where(F.col("recorded_at").cast("double") < cut)

    def run(df):
        o = longitudinal_features(PatientOrder(df, hot=None), ["value"], (7,), (1,))
        return score_contextual(o, ["k"]).done().select("row_id", "value_mean_7d", "value_lag1", "contextual_anomaly_score")

    lost = run(early).exceptAll(run(skewed))
    assert lost.isEmpty()


def test_rows_without_key_or_time_are_kept(spark):
    df = spark.createDataFrame(
        [(1, None, "2024-01-01", 1.0), (2, None, "2024-01-02", 2.0), (3, "a", None, 3.0), (4, "a", "2024-01-03", 4.0)],
        "row_id long, patient_id string, t string, value double").selectExpr(
        "row_id", "patient_id", "cast(t as timestamp) recorded_at", "value")
    out = longitudinal_features(PatientOrder(df), ["value"], (7,), (1,)).done().toPandas()
    assert len(out) == 4 and out["value_lag1"].isna().all()


def test_as_of_with_hot_key(spark):
    left = spark.range(200).selectExpr("id rid", "1 as k", "timestamp_seconds(id * 3600) at")
    right = spark.range(60).selectExpr("id mid", "1 as k", "timestamp_seconds(id * 10000) seen", "id * 2.0 v")
    plain = as_of(left, right, "k", "at", "seen", "mid", ["mid", "v"], "rid")
    hot = as_of(left, right, "k", "at", "seen", "mid", ["mid", "v"], "rid", max_rows=10)
    assert plain.exceptAll(hot).isEmpty() and plain.count() == 200
    row = plain.where("rid = 10").first()
    assert row["mid"] == 3

"""Registered queries over patient history (events as visits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators.drift import adaptive_scan, cusum, drift_alarms
from wardlight.operators.heads import fit_baseline, score_contextual, score_point
from wardlight.operators.history import (
    duplicate_measurements, previous_run, sequence_windows, visit_intervals)
from wardlight.operators.ordered import PatientOrder
from wardlight.plans.screening import patient_alerts
from wardlight.sources.standins import table, visits

FEATURES = ["value", "k"]

VISITS = """
visits AS (
  SELECT event_id AS row_id, user_id AS patient_id, ts AS recorded_at, event_type AS source_type,
         value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def r8(df, *columns):
    """Short histories give exact decimal ties at the sixth digit; the eighth is safe."""
    return df.withColumns({c: F.round(c, 8) for c in columns})


def lag_features(spark, d):
    out = PatientOrder(visits(spark, d)).lag(FEATURES, (1, 2)).done()
    return out.select("row_id", "value_lag1", "value_lag2", "k_lag1", "k_lag2")


def rolling_prior_stats(spark, d):
    order = PatientOrder(visits(spark, d)).lag(FEATURES, (1,), "_{c}")
    order = order.rolling_moments(["_value", "_k"], (7, 30), "{c}_mean_{d}d", "{c}_std_{d}d")
    names = {f"_{c}_{s}_{n}d": f"{c}_{s}_{n}d" for c in FEATURES for s in ("mean", "std") for n in (7, 30)}
    return order.done().select("row_id", *[F.round(k, 6).alias(v) for k, v in names.items()])


def point_head(spark, d):
    df = visits(spark, d)
    out = score_point(df, fit_baseline(df, FEATURES))
    cols = [c for c in out.columns if c.startswith("point_")]
    return r6(out.select("row_id", *cols), *[c for c in cols if "top_feature" not in c or "zscore" in c])


def contextual_head(spark, d):
    out = score_contextual(PatientOrder(visits(spark, d)), FEATURES).done()
    cols = [c for c in out.columns if c.startswith("contextual_")]
    return r8(out.select("row_id", *cols), *[c for c in cols if c not in (
        "contextual_anomaly_top_feature", "contextual_anomaly_history_length")])


def cusum_drift(spark, d):
    out = cusum(PatientOrder(visits(spark, d)), "value").done()
    out = out.withColumn("alarm", F.coalesce(F.col("visit_index") >= F.col("cusum_change_index"), F.lit(False)))
    return r6(out.select("row_id", "visit_index", "cusum_stat", "cusum_change_index", "alarm"), "cusum_stat")


def adaptive_window_drift(spark, d):
    return r6(adaptive_scan(visits(spark, d), "value"), "adwin_stat")


def drift_alarm_columns(spark, d):
    out = drift_alarms(PatientOrder(visits(spark, d)), "value").done()
    cols = [c for c in out.columns if c.startswith("score_stream_")]
    return r6(out.select("row_id", *cols), "score_stream_cusum_stat", "score_stream_adwin_stat")


def previous_run_direction(spark, d):
    return previous_run(PatientOrder(visits(spark, d)), "value").done().select(
        "row_id", F.round("score_delta", 6).alias("score_delta"), "direction")


def visit_interval_features(spark, d):
    out = visit_intervals(PatientOrder(visits(spark, d)), 90).done()
    return out.select("row_id", F.round("days_since_last_visit", 6).alias("days_since_last_visit"),
                      "visits_last_90_days")


def last_four_visits(spark, d):
    out = sequence_windows(PatientOrder(visits(spark, d)), FEATURES, 4).done()
    return out.select("row_id", "sequence_history_length",
                      *[F.col("sequence_window")[i][j].alias(f"{c}_{i}")
                        for i in range(4) for j, c in enumerate(FEATURES)])


def duplicate_measurement_flags(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("device_id"), F.col("l_shipdate").cast("timestamp").alias("recorded_at"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = duplicate_measurements(li, "device_id", "recorded_at")
    return out.select("device_id", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                      "duplicate_measurement")


def alert_summary(spark, d):
    return r6(patient_alerts(visits(spark, d), FEATURES), "mean_score", "max_score", "peak_cusum")


QUERIES = {
    "w1_lag_features": lag_features,
    "w2_rolling_prior_stats": rolling_prior_stats,
    "w3_contextual_head": contextual_head,
    "w4_last_four_visits": last_four_visits,
    "w5_cusum_drift": cusum_drift,
    "w6_adaptive_window_drift": adaptive_window_drift,
    "w7_drift_alarm_columns": drift_alarm_columns,
    "w9_previous_run_direction": previous_run_direction,
    "w11_visit_intervals": visit_interval_features,
    "w12_duplicate_measurements": duplicate_measurement_flags,
    "m19_point_head": point_head,
    "m25_alert_summary": alert_summary,
}

_Z = """
stats AS (SELECT avg(value) vm, stddev_pop(value) vs, avg(k) km, stddev_pop(k) ks FROM visits),
point AS (
  SELECT v.*, (value - vm) / vs AS zv, (k - km) / ks AS zk FROM visits v, stats)"""

_CONTEXT = """
prior AS (
  SELECT *, count(*) OVER w AS n, avg(value) OVER w AS vm, stddev_pop(value) OVER w AS vs,
         avg(k) OVER w AS km, stddev_pop(k) OVER w AS ks
  FROM visits
  WINDOW w AS (PARTITION BY patient_id ORDER BY recorded_at, row_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
context AS (
  SELECT *, CASE WHEN n > 0 THEN (value - vm) / (CASE WHEN vs > 1e-12 THEN vs ELSE 1 END) ELSE 0 END AS zv,
         CASE WHEN n > 0 THEN (k - km) / (CASE WHEN ks > 1e-12 THEN ks ELSE 1 END) ELSE 0 END AS zk
  FROM prior)"""

# Two-window mean test, visit by visit: floor 5, delta 0.01. ``best`` is the strongest split of the live window.
_ADAPTIVE = """
v AS (SELECT row_id, patient_id, value, row_number() OVER (PARTITION BY patient_id ORDER BY recorded_at, row_id) AS i
      FROM visits WHERE patient_id IS NOT NULL AND recorded_at IS NOT NULL),
w AS (
  SELECT patient_id, 0::BIGINT AS i, []::DOUBLE[] AS live, NULL::DOUBLE AS e, NULL::BIGINT AS s
  FROM (SELECT DISTINCT patient_id FROM v)
  UNION ALL
  SELECT patient_id, i, CASE WHEN best.e > 0 THEN seen[-5:] ELSE seen END, best.e, -best.s FROM (
    SELECT patient_id, i, seen, list_sort(list_transform(generate_series(5, len(seen) - 5), lambda s: {
      'e': abs(list_sum(seen[s + 1:]) / (len(seen) - s) - list_sum(seen[1:s]) / s)
           - sqrt(0.5 * ln(4 / 0.01) * (1.0 / s + 1.0 / (len(seen) - s))), 's': -s}))[-1] AS best
    FROM (SELECT w.patient_id, v.i, CASE WHEN isfinite(v.value) THEN list_append(w.live, v.value) ELSE w.live END AS seen
          FROM w JOIN v ON v.patient_id = w.patient_id AND v.i = w.i + 1))),
windows AS (SELECT v.row_id, v.patient_id, v.i, CASE WHEN e > 0 THEN e ELSE 0 END AS adwin_stat,
                   CASE WHEN e > 0 THEN greatest(0, s - 1) END AS at_window, CASE WHEN e > 0 THEN v.i - 1 END AS at_visit
            FROM v JOIN w USING (patient_id, i))"""

_CUSUM = """
pos AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY recorded_at, row_id) - 1 AS visit_index
  FROM {source}),
base AS (
  SELECT patient_id, avg(s) AS m, stddev_pop(s) AS sd FROM pos WHERE visit_index < 5 GROUP BY patient_id),
step AS (
  SELECT pos.*, (s - m) / (CASE WHEN sd > 0 THEN sd ELSE greatest(1e-6, abs(m) * 0.1 + 1e-6) END) - 0.25 AS st
  FROM pos JOIN base USING (patient_id)),
run AS (
  SELECT *, sum(st) OVER (PARTITION BY patient_id ORDER BY visit_index) AS c FROM step),
low AS (
  SELECT *, c - least(0, min(c) OVER (PARTITION BY patient_id ORDER BY visit_index)) AS cusum_stat FROM run),
hit AS (
  SELECT *, min(CASE WHEN cusum_stat > 5 THEN visit_index END) OVER (PARTITION BY patient_id)
         AS cusum_change_index
  FROM low)"""

ORACLE = {
    "w1_lag_features": f"""
WITH {VISITS}
SELECT row_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2,
       lag(k, 1) OVER w AS k_lag1, lag(k, 2) OVER w AS k_lag2
FROM visits WINDOW w AS (PARTITION BY patient_id ORDER BY recorded_at, row_id)""",
    "w2_rolling_prior_stats": f"""
WITH {VISITS},
p AS (SELECT *, lag(value) OVER w AS pv, lag(k) OVER w AS pk FROM visits
      WINDOW w AS (PARTITION BY patient_id ORDER BY recorded_at, row_id))
SELECT row_id,
       round(avg(pv) OVER w7, 6) AS value_mean_7d, round(stddev_pop(pv) OVER w7, 6) AS value_std_7d,
       round(avg(pk) OVER w7, 6) AS k_mean_7d, round(stddev_pop(pk) OVER w7, 6) AS k_std_7d,
       round(avg(pv) OVER w30, 6) AS value_mean_30d, round(stddev_pop(pv) OVER w30, 6) AS value_std_30d,
       round(avg(pk) OVER w30, 6) AS k_mean_30d, round(stddev_pop(pk) OVER w30, 6) AS k_std_30d
FROM p WINDOW
 w7 AS (PARTITION BY patient_id ORDER BY recorded_at
        RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW),
 w30 AS (PARTITION BY patient_id ORDER BY recorded_at
         RANGE BETWEEN INTERVAL '29 days 23:59:59.999999' PRECEDING AND CURRENT ROW)""",
    "m19_point_head": f"""
WITH {VISITS}, {_Z}
SELECT row_id,
       round(greatest(abs(zv), abs(zk)) / (greatest(abs(zv), abs(zk)) + 3), 6) AS point_anomaly_score,
       round(greatest(abs(zv), abs(zk)), 6) AS point_anomaly_max_abs_zscore,
       round((abs(zv) + abs(zk)) / 2, 6) AS point_anomaly_mean_abs_zscore,
       CASE WHEN abs(zv) >= abs(zk) THEN 'value' ELSE 'k' END AS point_anomaly_top_feature,
       round(CASE WHEN abs(zv) >= abs(zk) THEN zv ELSE zk END, 6) AS point_anomaly_top_feature_zscore
FROM point""",
    "w3_contextual_head": f"""
WITH {VISITS}, {_CONTEXT}
SELECT row_id,
       round(greatest(abs(zv), abs(zk)) / (greatest(abs(zv), abs(zk)) + 3), 8) AS contextual_anomaly_score,
       round(greatest(abs(zv), abs(zk)), 8) AS contextual_anomaly_max_abs_zscore,
       round((abs(zv) + abs(zk)) / 2, 8) AS contextual_anomaly_mean_abs_zscore,
       CASE WHEN n = 0 THEN '' WHEN abs(zv) >= abs(zk) THEN 'value' ELSE 'k' END AS contextual_anomaly_top_feature,
       round(CASE WHEN abs(zv) >= abs(zk) THEN zv ELSE zk END, 8) AS contextual_anomaly_top_feature_zscore,
       n AS contextual_anomaly_history_length
FROM context""",
    "w4_last_four_visits": f"""
WITH {VISITS}
SELECT row_id, least(row_number() OVER w, 4) AS sequence_history_length,
       coalesce(lag(value, 3) OVER w, 0) AS value_0, coalesce(lag(k, 3) OVER w, 0) AS k_0,
       coalesce(lag(value, 2) OVER w, 0) AS value_1, coalesce(lag(k, 2) OVER w, 0) AS k_1,
       coalesce(lag(value, 1) OVER w, 0) AS value_2, coalesce(lag(k, 1) OVER w, 0) AS k_2,
       value AS value_3, k AS k_3
FROM visits WINDOW w AS (PARTITION BY patient_id ORDER BY recorded_at, row_id)""",
    "w5_cusum_drift": f"""
WITH {VISITS}, {_CUSUM.format(source="(SELECT *, value AS s FROM visits)")}
SELECT row_id, visit_index, round(cusum_stat, 6) AS cusum_stat, cusum_change_index,
       coalesce(visit_index >= cusum_change_index, false) AS alarm
FROM hit""",
    "w6_adaptive_window_drift": f"""
WITH RECURSIVE {VISITS}, {_ADAPTIVE}
SELECT row_id, round(adwin_stat, 6) AS adwin_stat, at_window AS adwin_window_index, at_visit AS adwin_visit_index FROM windows""",
    "w7_drift_alarm_columns": f"""
WITH RECURSIVE {VISITS}, {_ADAPTIVE}, {_CUSUM.format(source="(SELECT *, value AS s FROM visits)")},
jump AS (SELECT patient_id, arg_min(at_window, at_visit) AS jump FROM windows WHERE at_visit IS NOT NULL GROUP BY patient_id),
a AS (SELECT hit.row_id, cusum_stat, adwin_stat, cusum_change_index AS c, jump, coalesce(cusum_change_index, jump) AS change,
             coalesce(visit_index >= coalesce(cusum_change_index, jump), false) AS alarm
      FROM hit JOIN windows ON windows.row_id = hit.row_id LEFT JOIN jump ON jump.patient_id = windows.patient_id)
SELECT row_id, alarm AS score_stream_drift_alarm, alarm AND c IS NOT NULL AS score_stream_cusum_alarm,
       alarm AND jump IS NOT NULL AS score_stream_adwin_alarm, round(cusum_stat, 6) AS score_stream_cusum_stat,
       round(adwin_stat, 6) AS score_stream_adwin_stat, CASE WHEN alarm THEN change ELSE -1 END AS score_stream_drift_change_index,
       CASE WHEN NOT alarm THEN 'none' WHEN c IS NOT NULL AND jump IS NOT NULL THEN 'hybrid'
            WHEN c IS NOT NULL THEN 'cusum' ELSE 'adwin' END AS score_stream_drift_method
FROM a""",
    "w9_previous_run_direction": f"""
WITH {VISITS},
p AS (SELECT row_id, round(value - lag(value) OVER (PARTITION BY patient_id ORDER BY recorded_at, row_id), 6)
             AS score_delta FROM visits)
SELECT row_id, score_delta, CASE WHEN score_delta IS NULL THEN 'baseline' WHEN score_delta < 0 THEN 'improving'
       WHEN score_delta > 0 THEN 'worsening' ELSE 'stable' END AS direction
FROM p""",
    "w11_visit_intervals": f"""
WITH {VISITS}
SELECT row_id,
       round((epoch_us(recorded_at) - epoch_us(lag(recorded_at) OVER (
           PARTITION BY patient_id ORDER BY recorded_at, row_id))) / 86400000000.0, 6) AS days_since_last_visit,
       count(*) OVER (PARTITION BY patient_id ORDER BY recorded_at
           RANGE BETWEEN INTERVAL '89 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS visits_last_90_days
FROM visits""",
    "w12_duplicate_measurements": """
SELECT l_suppkey AS device_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       count(*) OVER (PARTITION BY l_suppkey, l_shipdate) > 1 AS duplicate_measurement
FROM lineitem""",
    "m25_alert_summary": f"""
WITH {VISITS}, {_Z}, {_CONTEXT},
heads AS (
  SELECT p.row_id, p.patient_id, p.recorded_at,
         greatest(abs(p.zv), abs(p.zk)) / (greatest(abs(p.zv), abs(p.zk)) + 3) AS ps,
         greatest(abs(c.zv), abs(c.zk)) / (greatest(abs(c.zv), abs(c.zk)) + 3) AS cs
  FROM point p JOIN context c USING (row_id)),
ranges AS (SELECT min(ps) a, max(ps) b, min(cs) c, max(cs) d FROM heads),
fused AS (
  SELECT row_id, patient_id, recorded_at, 0.5 * (ps - a) / (b - a) + 0.5 * (cs - c) / (d - c) AS s
  FROM heads, ranges),
cut AS (SELECT quantile_cont(s, 0.95) AS t FROM fused),
{_CUSUM.format(source="fused")}
SELECT patient_id, count(*) AS visits, round(avg(s), 6) AS mean_score, round(max(s), 6) AS max_score,
       count(*) FILTER (s >= t) AS alerts, round(max(cusum_stat), 6) AS peak_cusum,
       min(cusum_change_index) AS drift_from_visit
FROM hit, cut GROUP BY patient_id""",
}

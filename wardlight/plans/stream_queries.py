"""Registered streaming queries: each drains the event files once and returns what the sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlight.operators.monitor import fit_monitor
from wardlight.plans.evaluation_queries import rounded
from wardlight.session import shared_dir, spread
from wardlight.sources import splits
from wardlight.sources.standins import table, visits
from wardlight.streaming import jobs


def _visits_stream(spark, d):
    raw = jobs.file_stream(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    return raw.select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("patient_id"),
        F.col("ts").cast("timestamp").alias("recorded_at"), F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))


def _drain(stream, spark):
    """Run over what has arrived, write to shared storage, read it back."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start(f"{base}/out"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def contextual(spark, d):
    jobs.use_state_store(spark)
    out = _drain(jobs.contextual_stream(_visits_stream(spark, d), ["value", "k"]), spark)
    return rounded(out, digits=8)


def drift(spark, d):
    jobs.use_state_store(spark)
    out = _drain(jobs.drift_stream(_visits_stream(spark, d), "value"), spark)
    # the first five visits set the baseline: no statistic before the fifth
    return rounded(out.select("row_id", "visit_index", F.when(F.col("visit_index") >= 4, F.col("cusum_stat")).alias(
        "cusum_stat")))


def windows(spark, d):
    jobs.use_state_store(spark)
    out = _drain(jobs.window_stream(_visits_stream(spark, d), ["value", "k"]), spark)
    return out.select("row_id", "sequence_history_length", *[F.col("window")[i].alias(f"w{i}") for i in range(8)])


def point(spark, d):
    from wardlight.operators.heads import fit_baseline
    from wardlight.sources.standins import visits
    baseline = fit_baseline(visits(spark, d), ["value", "k"])
    out = _drain(jobs.score_stream(_visits_stream(spark, d), baseline, 0.5).select(
        "row_id", "anomaly_score", "is_anomaly", "risk_level"), spark)
    return rounded(out)


def trend(spark, d):
    return rounded(_drain(jobs.trend_stream(_visits_stream(spark, d), score="value", alert_at=100.0), spark))


def monitored(spark, d):
    """Visits arrive three times, the third far from the rest: the monitor's alarms, batch by batch.

    A part is written by all cores; the stream starts again from its checkpoint and takes the files that are new as one batch.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = visits(spark, d).select("row_id", F.col("value"), F.col("k"))
    part = F.pmod(F.xxhash64("row_id"), F.lit(3))
    out = spark.createDataFrame([], "batch_id long, mmd double, alarm boolean").schema
    monitor = fit_monitor(rows, ["value", "k"])
    for i in range(3):
        moved = [(F.col(c) * 8 + 5000).alias(c) if i == 2 else F.col(c) for c in ("value", "k")]
        spread(rows.where(part == i).select("row_id", *moved)).write.mode("append").parquet(f"{base}/in")
        # above any number of files a part is written in: one part, one batch
        stream = jobs.file_stream(spark, f"{base}/in", rows.schema, files_per_trigger=1_000_000)
        jobs.monitor_stream(
            stream, monitor, lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/part={n}"),
            f"{base}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(out).parquet(f"{base}/out").groupBy("alarm").agg(F.count(F.lit(1)).alias("batches"))


def ingested(spark, d):
    """Reviews arrive in three files, some twice, then the stream starts again from its checkpoint: each review counts once."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("alert_id"), F.col("conv_id").cast("string").alias("patient_id"),
        F.length("text").cast("double").alias("value"), F.lit("2026-06-01").alias("reviewed_at"),
        F.when(F.col("role") == "user", "TP").when(F.col("role") == "assistant", "no").otherwise("unsure").alias("feedback_label"))
    part = F.pmod(F.xxhash64("alert_id"), F.lit(4))
    for takes in ([0, 1], [1, 2], [2, 3, 0]):
        rows.where(part.isin(takes)).coalesce(1).write.mode("append").json(f"{base}/in")
    for _ in range(2):
        stream = jobs.file_stream(spark, f"{base}/in", rows.schema, "json", files_per_trigger=1)
        jobs.ledger_stream(stream, f"{base}/ledger", f"{base}/checkpoint", availableNow=True).awaitTermination()
    return splits.load_ledger(spark, f"{base}/ledger").groupBy("feedback_label").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("alert_id").alias("alerts"),
        F.sum(F.get_json_object("record_json", "$.value").cast("double")).alias("total"))


QUERIES = {
    "s5_monitor_stream": monitored,
    "s6_ledger_stream": ingested,
    "s1_point_stream": point,
    "s2_contextual_stream": contextual,
    "s3_drift_stream": drift,
    "s4_trend_stream": trend,
    "s7_window_stream": windows,
}

from wardlight.plans.history_queries import _CONTEXT, _CUSUM, _Z, VISITS  # noqa: E402

_M = "greatest(abs(zv), abs(zk))"
ORACLE = {
    "s5_monitor_stream": "SELECT event_id % 3 = 2 AS alarm, count(DISTINCT event_id % 3) AS batches FROM events GROUP BY 1",
    "s6_ledger_stream": """
SELECT CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS feedback_label, count(*) AS rows, count(*) AS alerts,
       sum(length(text))::DOUBLE AS total FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1""",
    "s1_point_stream": f"""
WITH {VISITS}, {_Z}, p AS (SELECT row_id, {_M} / ({_M} + 3) AS s FROM point)
SELECT row_id, round(s, 6) AS anomaly_score, s >= 0.5 AS is_anomaly,
       CASE WHEN round(s, 4) < 0.4 THEN 'Low' WHEN round(s, 4) < 0.65 THEN 'Medium' ELSE 'High' END AS risk_level FROM p""",
    "s2_contextual_stream": f"""
WITH {VISITS}, {_CONTEXT}
SELECT row_id, round({_M} / ({_M} + 3), 8) AS contextual_anomaly_score, round({_M}, 8) AS contextual_anomaly_max_abs_zscore,
       CASE WHEN n = 0 THEN '' WHEN abs(zv) >= abs(zk) THEN 'value' ELSE 'k' END AS contextual_anomaly_top_feature,
       round(CASE WHEN abs(zv) >= abs(zk) THEN zv ELSE zk END, 8) AS contextual_anomaly_top_feature_zscore,
       n AS contextual_anomaly_history_length FROM context""",
    "s3_drift_stream": f"""
WITH {VISITS}, {_CUSUM.format(source="(SELECT *, value AS s FROM visits)")}
SELECT row_id, visit_index, CASE WHEN visit_index >= 4 THEN round(cusum_stat, 6) END AS cusum_stat FROM hit""",
    "s4_trend_stream": """
WITH w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(avg(value), 6) AS mean_score, round(max(value), 6) AS max_score,
       count(*) FILTER (value >= 100) AS alerts, count(*) AS rows FROM events, w
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1""",
    "s7_window_stream": f"""
WITH {VISITS}
SELECT row_id, least(row_number() OVER w, 4) AS sequence_history_length,
       {", ".join(f"coalesce(lag({c}, {3 - i}) OVER w, 0) AS w{2 * i + j}" for i in range(4) for j, c in enumerate(("value", "k")))}
FROM visits WINDOW w AS (PARTITION BY patient_id ORDER BY recorded_at, row_id)""",
}

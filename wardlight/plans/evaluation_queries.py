"""Registered queries over score tables (order lines as scored rows, text labels)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from wardlight.operators import evaluate as ev
from wardlight.operators.conformal import conformal_p_values
from wardlight.operators.ranking import exact_quantiles
from wardlight.sources.standins import table, visits

MODELS = ["isolation_forest_anomaly_score", "autoencoder_anomaly_score",
          "deep_svdd_anomaly_score", "anomaly_score"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def scored(spark, d):
    li = table(spark, d, "lineitem")
    a, b, c = F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 105000.0, F.col("l_discount") * 10.0
    return li.select(
        *KEYS, F.concat_ws("-", *KEYS).alias("row_id"), F.col("l_shipdate").cast("timestamp").alias("recorded_at"),
        F.col("l_suppkey").alias("patient_id"),
        a.alias(MODELS[0]), b.alias(MODELS[1]), c.alias(MODELS[2]),
        (0.3 * a + 0.4 * b + 0.3 * c).alias("anomaly_score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("signed_label"),
    )


def rounded(df, keep=(), digits=6):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in keep else F.col(c)
                       for c in df.columns])


def model_metrics(spark, d):
    return rounded(ev.evaluate_scores(scored(spark, d), MODELS, "label"))


def signed_label_metrics(spark, d):
    out = ev.evaluate_scores(scored(spark, d), MODELS, "signed_label", threshold=0.7)
    return rounded(out.select("model", "precision", "recall", "f1", "accuracy", "roc_auc", "auprc"))


def best_model(spark, d):
    table_ = ev.evaluate_scores(scored(spark, d), MODELS, "label")
    return rounded(ev.best_single_model(table_).select("model", "f1", "auprc", "roc_auc"))


def comparison(spark, d):
    table_ = ev.evaluate_scores(scored(spark, d), MODELS, "label")
    wide = ev.comparison_matrix(table_)
    return rounded(wide.select("metric", "metric_order", *[
        F.col(f"`{ev.friendly_name(m)}`").alias(m) for m in MODELS]))


def score_histogram(spark, d):
    return rounded(ev.histogram(scored(spark, d), "autoencoder_anomaly_score", 10))


def grid(spark, d):
    return rounded(ev.threshold_grid(scored(spark, d), "anomaly_score", "label"))


def calibrated(spark, d):
    return rounded(ev.calibrate_threshold(scored(spark, d), "anomaly_score", "label"))


def pair_rates(spark, d):
    return rounded(ev.pairwise_agreement(scored(spark, d), MODELS[:3]))


def agreement(spark, d):
    return rounded(ev.agreement_summary(scored(spark, d), MODELS[:3]))


def matrix(spark, d):
    return rounded(ev.agreement_matrix(scored(spark, d), MODELS[:3]))


def disagreements(spark, d):
    out = ev.top_disagreements(scored(spark, d), MODELS[:3], top_n=20)
    return rounded(out.select("row_id", "disagreement_count", "score_range", "flag_pattern",
                              "worst_disagreement_pair",
                              F.concat_ws(",", "worst_disagreement_pairs").alias("worst_pairs")))


def trend(spark, d):
    return rounded(ev.daily_trend(scored(spark, d)))


def kpi_row(spark, d):
    df = scored(spark, d).withColumn("is_anomaly", F.col("anomaly_score") >= 0.6)
    return rounded(ev.kpis(df))


def bands(spark, d):
    return ev.risk_map(scored(spark, d)).groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("patient_label").alias("patients"))


def most_anomalous(spark, d):
    return rounded(scored(spark, d).orderBy(F.desc("anomaly_score"), "row_id").limit(1)
                   .select("row_id", "anomaly_score"))


def labelled_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.length("text") / 5000.0).alias("score"))
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    both = docs.join(labels, "doc_id")
    out = ev.evaluate_scores(both, ["score"], "toxic", threshold=0.2)
    return rounded(out.select("model", "count", "precision", "recall", "f1", "accuracy", "roc_auc", "auprc"))


def contamination_cut(spark, d):
    return rounded(exact_quantiles(visits(spark, d), "value", {"threshold": 0.95}, ["source_type"]))


def p_values(spark, d):
    df = scored(spark, d)
    calibration = df.where("label = 0")
    out = conformal_p_values(df, calibration, "anomaly_score")
    return rounded(out.select(*KEYS, "conformal_p_value", "conformal_is_anomalous"), keep=("l_extendedprice",), digits=8)


def p_value_summary(spark, d):
    df = scored(spark, d)
    out = conformal_p_values(df, df.where("label = 0"), "anomaly_score")
    return rounded(ev.conformal_summary(out))


def readiness(spark, d):
    """Runtime columns from order totals: one verdict per run is read from the first filled row."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 5000.0).alias("inference_latency_ms_per_patient"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") * 1000.0).alias("model_size_bytes"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") * 10000.0).alias("estimated_ram_usage_bytes"))
    return rounded(ev.runtime_summary(o))


QUERIES = {
    "d1_d6_model_metrics": model_metrics,
    "b8_signed_label_metrics": signed_label_metrics,
    "d18_best_single_model": best_model,
    "d17_comparison_matrix": comparison,
    "d7_score_histogram": score_histogram,
    "c10_threshold_grid": grid,
    "d8_calibrated_threshold": calibrated,
    "c13_pair_rates": pair_rates,
    "d9_agreement_summary": agreement,
    "d9_agreement_matrix": matrix,
    "t2_top_disagreements": disagreements,
    "d12_daily_trend": trend,
    "d13_kpis": kpi_row,
    "r10_risk_bands": bands,
    "t7_most_anomalous": most_anomalous,
    "c1_labelled_documents": labelled_documents,
    "d16_contamination_cut": contamination_cut,
    "m23_conformal_p_values": p_values,
    "d11_conformal_summary": p_value_summary,
    "d10_runtime_readiness": readiness,
}

SCORED = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate AS recorded_at,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_id,
         l_quantity / 50.0 AS isolation_forest_anomaly_score,
         l_extendedprice / 105000.0 AS autoencoder_anomaly_score,
         l_discount * 10.0 AS deep_svdd_anomaly_score,
         0.3 * (l_quantity / 50.0) + 0.4 * (l_extendedprice / 105000.0) + 0.3 * (l_discount * 10.0) AS anomaly_score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem)"""
LONG = """
long AS (
  SELECT 'isolation_forest_anomaly_score' AS model, isolation_forest_anomaly_score AS s, label AS y FROM scored
  UNION ALL SELECT 'autoencoder_anomaly_score', autoencoder_anomaly_score, label FROM scored
  UNION ALL SELECT 'deep_svdd_anomaly_score', deep_svdd_anomaly_score, label FROM scored
  UNION ALL SELECT 'anomaly_score', anomaly_score, label FROM scored)"""


def metrics_sql(threshold, source="long"):
    return f"""
ranked AS (
  SELECT model, s, y,
         row_number() OVER (PARTITION BY model ORDER BY s DESC) AS down,
         row_number() OVER (PARTITION BY model ORDER BY s) AS up,
         count(*) OVER (PARTITION BY model) AS n
  FROM {source}),
dist AS (
  SELECT model, count(*) AS count, min(s) AS score_min, avg(s) AS score_mean,
         quantile_cont(s, 0.5) AS score_median, stddev_pop(s) AS score_std,
         quantile_cont(s, 0.75) - quantile_cont(s, 0.25) AS score_iqr,
         quantile_cont(s, 0.95) AS score_p95, quantile_cont(s, 0.99) AS score_p99,
         avg(CASE WHEN s >= {threshold} THEN 1.0 ELSE 0.0 END) AS above_threshold_rate,
         avg(s) FILTER (down <= ceil(n * 0.1)) AS top_fraction_mean,
         avg(s) FILTER (up <= ceil(n * 0.1)) AS bottom_fraction_mean,
         sum(CASE WHEN s >= {threshold} AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
         sum(CASE WHEN s >= {threshold} AND y = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
         sum(CASE WHEN s < {threshold} AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn,
         sum(CASE WHEN s < {threshold} AND y = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn
  FROM ranked GROUP BY model),
steps AS (SELECT model, s, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM {source} GROUP BY model, s),
cum AS (
  SELECT *, sum(n) OVER w AS taken, sum(pos) OVER w AS hit,
         sum(n - pos) OVER (PARTITION BY model ORDER BY s) - (n - pos) AS below
  FROM steps WINDOW w AS (PARTITION BY model ORDER BY s DESC)),
area AS (
  SELECT model, sum(pos * (below + 0.5 * (n - pos))) / (sum(pos) * sum(n - pos)) AS roc_auc,
         sum(pos * hit / taken) / sum(pos) AS auprc
  FROM cum GROUP BY model),
metrics AS (
  SELECT model, count, score_min, score_mean, score_median, score_std, score_iqr, score_p95, score_p99,
         above_threshold_rate, top_fraction_mean, bottom_fraction_mean,
         top_fraction_mean - bottom_fraction_mean AS score_spread,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
         (tp + tn) / count AS accuracy, roc_auc, auprc
  FROM dist JOIN area USING (model))"""


def _round(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


ALL_METRICS = ["score_min", "score_mean", "score_median", "score_std", "score_iqr", "score_p95", "score_p99",
               "above_threshold_rate", "top_fraction_mean", "bottom_fraction_mean", "score_spread",
               "precision", "recall", "f1", "accuracy", "roc_auc", "auprc"]
LABEL_METRICS = ALL_METRICS[-6:]
GRID = """
grid AS (SELECT unnest(range(0, 201)) * 0.005::DOUBLE AS threshold),
conf AS (
  SELECT threshold,
         sum(CASE WHEN anomaly_score >= threshold AND label = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
         sum(CASE WHEN anomaly_score >= threshold AND label = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
         sum(CASE WHEN anomaly_score < threshold AND label = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn,
         sum(CASE WHEN anomaly_score < threshold AND label = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn
  FROM scored, grid GROUP BY threshold),
curve AS (
  SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
         (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM conf)"""
FLAGS = """
flags AS (
  SELECT *, (isolation_forest_anomaly_score >= 0.5)::INT AS a, (autoencoder_anomaly_score >= 0.5)::INT AS b,
         (deep_svdd_anomaly_score >= 0.5)::INT AS c FROM scored)"""
A, B, C = MODELS[:3]
P_VALUES = f"""
WITH {SCORED},
cal AS (SELECT anomaly_score AS s FROM scored WHERE label = 0),
both_ AS (SELECT anomaly_score AS s, 0 AS c FROM scored UNION ALL SELECT s, 1 FROM cal),
run AS (SELECT s, sum(c) OVER (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM both_),
dedup AS (SELECT s, any_value(above) AS above FROM run GROUP BY s),
pv AS (SELECT scored.*, (1.0 + above) / ((SELECT count(*) FROM cal) + 1.0) AS p
       FROM scored JOIN dedup ON scored.anomaly_score = dedup.s)"""

ORACLE = {
    "d1_d6_model_metrics": f"WITH {SCORED}, {LONG}, {metrics_sql(0.5)} SELECT model, count, {_round(ALL_METRICS)} FROM metrics",
    "b8_signed_label_metrics": f"WITH {SCORED}, {LONG}, {metrics_sql(0.7)} SELECT model, {_round(LABEL_METRICS)} FROM metrics",
    "d18_best_single_model": f"""WITH {SCORED}, {LONG}, {metrics_sql(0.5)}
SELECT model, {_round(["f1", "auprc", "roc_auc"])} FROM metrics WHERE model <> 'anomaly_score'
ORDER BY metrics.f1 DESC, metrics.auprc DESC, metrics.roc_auc DESC, model LIMIT 1""",
    "d17_comparison_matrix": f"""WITH {SCORED}, {LONG}, {metrics_sql(0.5)},
cells AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {i + 1} AS metric_order, model, {m} AS v FROM metrics" for i, m in enumerate(ev.MATRIX_METRICS))})
SELECT metric, metric_order, {", ".join(f"round(max(v) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS)}
FROM cells GROUP BY metric, metric_order""",
    "d7_score_histogram": f"""WITH {SCORED},
r AS (SELECT min(autoencoder_anomaly_score) lo, max(autoencoder_anomaly_score) hi FROM scored),
b AS (SELECT least(floor((autoencoder_anomaly_score - lo) / ((hi - lo) / 10)), 9)::INT AS bin FROM scored, r),
every AS (SELECT unnest(range(0, 10))::INT AS bin)
SELECT every.bin, round(any_value(lo) + every.bin * ((any_value(hi) - any_value(lo)) / 10), 6) AS lower,
       round(any_value(lo) + (every.bin + 1) * ((any_value(hi) - any_value(lo)) / 10), 6) AS upper, count(b.bin) AS count
FROM every CROSS JOIN r LEFT JOIN b USING (bin) GROUP BY every.bin""",
    "c10_threshold_grid": f"""WITH {SCORED}, {GRID}
SELECT {_round(["threshold", "precision", "recall", "f1", "accuracy"])} FROM curve""",
    "d8_calibrated_threshold": f"""WITH {SCORED}, {GRID}
SELECT {_round(["threshold", "precision", "recall", "f1", "accuracy"])} FROM curve
ORDER BY curve.f1 DESC, curve.accuracy DESC, curve.precision DESC, curve.threshold DESC LIMIT 1""",
    "c13_pair_rates": f"""WITH {SCORED}, {FLAGS}
""" + " UNION ALL ".join(
        f"SELECT '{m}' AS left_model, '{n}' AS right_model, round(avg(({x} = {y})::INT), 6) AS agreement_rate, "
        f"round(1.0 - avg(({x} = {y})::INT), 6) AS disagreement_rate FROM flags"
        for (m, x), (n, y) in combinations(zip((A, B, C), "abc"), 2)),
    "d9_agreement_summary": f"""WITH {SCORED}, {FLAGS}
SELECT round(avg(((a = b)::INT + (a = c)::INT + (b = c)::INT) / 3.0), 6) AS mean_pairwise_agreement_rate,
       round(avg((a + b + c >= 2)::INT), 6) AS at_least_two_flag_rate,
       round(avg((a + b + c = 3)::INT), 6) AS all_models_flag_rate,
       count(*) FILTER (a + b + c = 3) AS all_models_flag_count, 3 AS component_count FROM flags""",
    "d9_agreement_matrix": f"""WITH {SCORED}, {FLAGS},
r AS (SELECT round(avg((a = b)::INT), 6) ab, round(avg((a = c)::INT), 6) ac, round(avg((b = c)::INT), 6) bc FROM flags)
SELECT '{A}' AS model, 1.0 AS {A}, ab AS {B}, ac AS {C} FROM r
UNION ALL SELECT '{B}', ab, 1.0, bc FROM r UNION ALL SELECT '{C}', ac, bc, 1.0 FROM r""",
    "t2_top_disagreements": f"""WITH {SCORED}, {FLAGS},
d AS (SELECT *, (a <> b)::INT + (a <> c)::INT + (b <> c)::INT AS disagreement_count,
      greatest({A}, {B}, {C}) - least({A}, {B}, {C}) AS score_range FROM flags),
t AS (SELECT * FROM d ORDER BY disagreement_count DESC, score_range DESC, row_id LIMIT 20),
w AS (SELECT *, CASE WHEN disagreement_count = 0 OR a <> b THEN '{A}__{B}' END AS p1,
      CASE WHEN disagreement_count = 0 OR a <> c THEN '{A}__{C}' END AS p2,
      CASE WHEN disagreement_count = 0 OR b <> c THEN '{B}__{C}' END AS p3 FROM t)
SELECT row_id, disagreement_count, round(score_range, 6) AS score_range, a::VARCHAR || b::VARCHAR || c::VARCHAR AS flag_pattern,
       coalesce(p1, p2, p3) AS worst_disagreement_pair, concat_ws(',', p1, p2, p3) AS worst_pairs FROM w""",
    "d12_daily_trend": f"""WITH {SCORED}
SELECT date_trunc('day', recorded_at)::TIMESTAMP AS day, round(avg(anomaly_score), 6) AS mean_score,
       round(max(anomaly_score), 6) AS max_score, count(*) FILTER (anomaly_score >= 0.7) AS alerts, count(*) AS rows
FROM scored GROUP BY 1""",
    "d13_kpis": f"""WITH {SCORED}
SELECT count(*) AS patients, count(*) FILTER (anomaly_score >= 0.6) AS alerts,
       count(*) FILTER (anomaly_score >= 0.7) AS high_risk, round(avg(anomaly_score), 6) AS mean_score FROM scored""",
    "r10_risk_bands": f"""WITH {SCORED}
SELECT CASE WHEN anomaly_score < 0.4 THEN 'Low' WHEN anomaly_score < 0.7 THEN 'Medium' ELSE 'High' END AS risk_band,
       count(*) AS rows, count(DISTINCT l_suppkey) AS patients FROM scored GROUP BY 1""",
    "t7_most_anomalous": f"""WITH {SCORED}
SELECT row_id, round(anomaly_score, 6) AS anomaly_score FROM scored ORDER BY scored.anomaly_score DESC, row_id LIMIT 1""",
    "c1_labelled_documents": f"""WITH long AS (
  SELECT 'score' AS model, length(text) / 5000.0 AS s, toxic AS y FROM documents JOIN labels USING (doc_id)),
{metrics_sql(0.2)} SELECT model, count, {_round(LABEL_METRICS)} FROM metrics""",
    "d16_contamination_cut": """
SELECT event_type AS source_type, round(quantile_cont(value, 0.95), 6) AS threshold FROM events GROUP BY 1""",
    "m23_conformal_p_values": f"""{P_VALUES}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(p, 8) AS conformal_p_value,
       p <= 0.05 AS conformal_is_anomalous FROM pv""",
    "d11_conformal_summary": f"""{P_VALUES}
SELECT count(*) AS count, round(min(p), 6) AS p_value_min, round(avg(p), 6) AS p_value_mean,
       round(quantile_cont(p, 0.5), 6) AS p_value_median, round(quantile_cont(p, 0.95), 6) AS p_value_p95,
       round(avg((p <= 0.05)::INT), 6) AS anomalous_rate_at_alpha, 0.05::DOUBLE AS alpha FROM pv""",
    "d10_runtime_readiness": """
WITH f AS (
  SELECT arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') / 5000.0 AS lat,
         arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') * 1000.0 AS size,
         arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') * 10000.0 AS ram FROM orders),
c AS (SELECT *, lat <= 100 AS l, size IS NULL OR size <= 104857600 AS m, ram IS NULL OR ram <= 536870912 AS r FROM f)
SELECT round(lat, 6) AS inference_latency_ms_per_patient, round(size, 6) AS model_size_bytes,
       round(ram, 6) AS estimated_ram_usage_bytes, l AS latency_ok, m AS model_size_ok, r AS ram_ok,
       CASE WHEN l AND m AND r THEN 'ready' WHEN l OR m OR r THEN 'needs_optimization' ELSE 'not_ready' END
       AS edge_readiness_status FROM c""",
}

"""Registered queries for detectors, fusion, monitoring and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import fusion
from wardlight.operators.detectors import fit_detector, fit_sequence, score_sequence
from wardlight.operators.history import sequence_windows
from wardlight.operators.monitor import fit_monitor, score_batch
from wardlight.operators.ordered import PatientOrder
from wardlight.plans.evaluation_queries import MODELS, SCORED, rounded, scored
from wardlight.session import spread
from wardlight.sources.standins import table, visits

DIMS = [f"x{i}" for i in range(64)]


def vectors(spark, d, n=64):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label",
        *[F.col("embedding")[i].cast("double").alias(DIMS[i]) for i in range(n)])


def _detector(name):
    def run(spark, d):
        df = vectors(spark, d)
        fitted = fit_detector(name, df, DIMS)
        return rounded(fitted.score(df).select("row_id", f"{name}_raw_score", f"{name}_score"))
    return run


def line_forest(spark, d):
    li = spread(table(spark, d, "lineitem")).select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("row_id"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    fitted = fit_detector("isolation_forest", li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(fitted.score(li).select("row_id", "isolation_forest_score"))


def forest_invariants(spark, d):
    """What any forest must show: a score for every line, between 0 and 1, the same for equal lines, not all alike."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = spread(table(spark, d, "lineitem")).select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("row_id"), *names)
    out = fit_detector("isolation_forest", li, names).score(li)
    raw = F.col("isolation_forest_raw_score")
    by = out.groupBy(*names).agg(F.max(raw).alias("high"), F.min(raw).alias("low"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.min(F.col("low") > 0).alias("above_zero"),
                  F.max(F.col("high") < 1).alias("below_one"), F.sum((F.col("high") - F.col("low") > 1e-12).cast("long")).alias(
                      "unequal"), (F.max("high") - F.min("low") > 0.05).alias("spread"))


def scaled_components(spark, d):
    df = scored(spark, d)
    parts = MODELS[:3]
    out = fusion.scale_components(df, fusion.fit_ranges(df, parts))
    weights = fusion.resolve_weights(["isolation_forest", "autoencoder", "deep_svdd"])
    fused = fusion.weighted_average(weights, lambda c: F.col(f"{c}_anomaly_score"))
    out = out.withColumns({"fused": fused, "voted": fusion.max_vote(parts)})
    return rounded(out.select("row_id", *parts, "fused", "voted"))


def decisions(spark, d):
    df = scored(spark, d)
    cut = fusion.contamination_threshold(df, "anomaly_score", 0.05)
    out = fusion.decide(df, "anomaly_score", cut)
    return rounded(out.select("row_id", "decision_margin", "anomaly_flag", "is_anomaly"))


def gate_shares(spark, d):
    out = fusion.gate_targets(scored(spark, d), MODELS[:3], "label")
    return rounded(out.select("row_id", *[F.col("_gate")[i].alias(f"share_{i}") for i in range(3)]))


def stacked(spark, d):
    df = scored(spark, d)
    model = fusion.fit_stacking(df, MODELS[:3], "label", "gbt")
    return rounded(fusion.apply_stacking(df, model, MODELS[:3], "stacked_score").select("row_id", "stacked_score"))


def gated(spark, d):
    df = scored(spark, d)
    features = ["l_extendedprice"]
    model = fusion.fit_gate(df, features, MODELS[:3], "label")
    out = fusion.apply_gate(df, model, features, MODELS[:3], "gated_score")
    return rounded(out.select("row_id", "gated_score", *[f"{m}_gate_weight" for m in MODELS[:3]]))


def staleness(spark, d):
    df = visits(spark, d)
    stats = df.agg(F.avg("value").alias("vm"), F.stddev("value").alias("vs"), F.avg("k").alias("km"), F.stddev("k").alias("ks")).first()
    z = df.select("row_id", ((F.col("value") - stats["vm"]) / stats["vs"]).alias("a"), ((F.col("k") - stats["km"]) / stats["ks"]).alias("b"))
    monitor = fit_monitor(z, ["a", "b"])
    same = score_batch(z, monitor)
    moved = score_batch(z.select("row_id", (F.col("a") * 8 + 50).alias("a"), (F.col("b") * 8 + 50).alias("b")), monitor)
    rows = [("same", *same), ("moved", *moved)]
    return spark.createDataFrame(rows, "batch string, mmd double, alarm boolean")


def sequence_errors(spark, d):
    order = sequence_windows(PatientOrder(visits(spark, d)), ["value", "k"])
    df = order.done().withColumn("sequence_window", F.transform(
        "sequence_window", lambda v: F.array(v[0] / 100.0, v[1] / 100.0)))
    model = fit_sequence(df, ["value", "k"])
    out = score_sequence(df, model).withColumn("blended", fusion.blend_sequence(
        F.lit(0.5), F.col("sequence_anomaly_score"), model["mean"], model["std"]))
    return rounded(out.select("row_id", "sequence_anomaly_score", "blended"))


QUERIES = {
    "m1_isolation_forest": line_forest,
    "m1_forest_invariants": forest_invariants,
    "m2_one_class_svm": _detector("one_class_svm"),
    "m3_local_outlier_factor": _detector("local_outlier_factor"),
    "m10_sequence_detector": sequence_errors,
    "m12_pca_reconstruction": _detector("pca_reconstruction"),
    "m13_m15_scaled_fusion": scaled_components,
    "m16_stacked_fusion": stacked,
    "m17_gate_targets": gate_shares,
    "m17_gated_fusion": gated,
    "m18_decisions": decisions,
    "m22_batch_staleness": staleness,
}

_U = "least(greatest({c} - {c0}, 0) / ({c1} - {c0}), 1)"
A, B, C = MODELS[:3]
ORACLE = {
    "m1_forest_invariants": """
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem))
       AS distinct_rows, true AS above_zero, true AS below_one, 0::BIGINT AS unequal, true AS spread FROM lineitem""",
    "m3_local_outlier_factor": """
WITH p AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
dist AS (SELECT a.i AS q, b.i AS r, list_distance(a.x, b.x) AS d FROM p a, p b),
own AS (SELECT q, r, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, r) AS k FROM dist WHERE q <> r) WHERE k <= 20),
kd AS (SELECT q AS r, max(d) AS kd FROM own GROUP BY q),
lrd AS (SELECT q AS r, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM own JOIN kd USING (r) GROUP BY q),
near AS (SELECT q, r, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, r) AS k FROM dist) WHERE k <= 20),
mine AS (SELECT q, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS own_lrd, avg(lrd) AS around
         FROM near JOIN kd USING (r) JOIN lrd USING (r) GROUP BY q),
f AS (SELECT q, around / own_lrd AS v FROM mine)
SELECT q AS row_id, round(v, 6) AS local_outlier_factor_raw_score,
       round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS local_outlier_factor_score FROM f""",
    "m13_m15_scaled_fusion": f"""
WITH {SCORED},
r AS (SELECT min({A}) a0, max({A}) a1, min({B}) b0, max({B}) b1, min({C}) c0, max({C}) c1 FROM scored),
u AS (SELECT row_id, {_U.format(c=A, c0="a0", c1="a1")} AS a, {_U.format(c=B, c0="b0", c1="b1")} AS b,
      {_U.format(c=C, c0="c0", c1="c1")} AS c FROM scored, r)
SELECT row_id, round(a, 6) AS {A}, round(b, 6) AS {B}, round(c, 6) AS {C},
       round(0.3 * a + 0.4 * b + 0.3 * c, 6) AS fused, round(greatest(a, b, c), 6) AS voted FROM u""",
    "m17_gate_targets": f"""
WITH {SCORED},
t AS (SELECT row_id, CASE WHEN label = 1 THEN {A} ELSE 1 - {A} END AS a, CASE WHEN label = 1 THEN {B} ELSE 1 - {B} END AS b,
      CASE WHEN label = 1 THEN {C} ELSE 1 - {C} END AS c FROM scored),
p AS (SELECT row_id, greatest(a, 0) AS a, greatest(b, 0) AS b, greatest(c, 0) AS c FROM t)
SELECT row_id, round(CASE WHEN a + b + c > 1e-12 THEN a / (a + b + c) ELSE 1.0 / 3 END, 6) AS share_0,
       round(CASE WHEN a + b + c > 1e-12 THEN b / (a + b + c) ELSE 1.0 / 3 END, 6) AS share_1,
       round(CASE WHEN a + b + c > 1e-12 THEN c / (a + b + c) ELSE 1.0 / 3 END, 6) AS share_2 FROM p""",
    "m18_decisions": f"""
WITH {SCORED}, q AS (SELECT quantile_cont(anomaly_score, 0.95) AS t FROM scored)
SELECT row_id, round(t - anomaly_score, 6) AS decision_margin, CASE WHEN anomaly_score >= t THEN -1 ELSE 1 END AS anomaly_flag,
       anomaly_score >= t AS is_anomaly FROM scored, q""",
}

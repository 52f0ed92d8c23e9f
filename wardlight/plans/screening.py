"""The screening job: history, heads, fusion, drift and one summary row per patient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators.drift import cusum
from wardlight.operators.fusion import contamination_threshold, fit_ranges, scale_components
from wardlight.operators.heads import fit_baseline, score_contextual, score_point
from wardlight.operators.ordered import PatientOrder
from wardlight.schema import KEY


def head_scores(df: DataFrame, features: list[str], order: PatientOrder | None = None) -> PatientOrder:
    order = order or PatientOrder(df)
    order = order.replace(score_point(order.df, fit_baseline(df, features)))
    return score_contextual(order, features)


def screen(df: DataFrame, features: list[str], contamination: float = 0.05,
           weights: tuple[float, float] = (0.5, 0.5)) -> PatientOrder:
    """Point + contextual scores, scaled by fit ranges, fused, thresholded, drift-checked."""
    order = head_scores(df, features)
    parts = ["point_anomaly_score", "contextual_anomaly_score"]
    # The scored columns feed two fits and the result: keep them instead of
    # running the windows three times. Lost blocks are recomputed from lineage.
    order = order.replace(order.df.persist())
    scaled = scale_components(order.df, fit_ranges(order.df, parts),
                              names={p: f"_scaled_{p}" for p in parts})
    fused = sum((F.lit(w) * F.col(f"_scaled_{p}") for w, p in zip(weights, parts)), F.lit(0.0))
    scaled = scaled.withColumn("anomaly_score", fused).drop(*[f"_scaled_{p}" for p in parts])
    threshold = contamination_threshold(scaled, "anomaly_score", contamination)
    flagged = scaled.withColumn("is_anomaly", F.col("anomaly_score") >= F.lit(threshold))
    return cusum(order.replace(flagged), "anomaly_score")


def patient_alerts(df: DataFrame, features: list[str], contamination: float = 0.05) -> DataFrame:
    """Per-patient alert summary of a screened table."""
    scored = screen(df, features, contamination).df
    return scored.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("visits"),
        F.avg("anomaly_score").alias("mean_score"),
        F.max("anomaly_score").alias("max_score"),
        F.sum(F.col("is_anomaly").cast("long")).alias("alerts"),
        F.max("cusum_stat").alias("peak_cusum"),
        F.min("cusum_change_index").alias("drift_from_visit"),
    )

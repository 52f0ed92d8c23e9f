"""Conformal p-values by counting on running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions.numeric import finite
from wardlight.operators.ranking import ordered_totals
from wardlight.session import broadcast_if_fits


def conformal_p_values(df: DataFrame, calibration: DataFrame, score: str,
                       calibration_score: str | None = None, alpha: float = 0.05) -> DataFrame:
    """p = (1 + #{calibration >= score}) / (n + 1) for every row of ``df``.

    Both sides are first counted per distinct score; one descending running
    total of the calibration counts then answers every score at once. No row
    pairs are formed and equal scores travel as one row.
    """
    cal = calibration.select(finite(F.col(calibration_score or score)).alias("_v")).where("_v IS NOT NULL")
    n = cal.count()
    text = (F.when(F.col("conformal_p_value").isNull(),
                   F.lit("No calibration rows: only the raw score is given."))
            .when(F.col("conformal_is_anomalous"),
                  F.lit(f"Anomalous: p is at most {alpha:.2f}."))
            .otherwise(F.lit(f"Within the calibration scores: p is above {alpha:.2f}.")))
    if n == 0:
        out = df.withColumn("conformal_p_value", F.lit(None).cast("double"))
    else:
        seen = df.select(finite(F.col(score)).alias("_v")).where("_v IS NOT NULL")
        counted = (seen.select("_v", F.lit(0).cast("long").alias("c"))
                   .unionByName(cal.select("_v", F.lit(1).cast("long").alias("c")))
                   .groupBy("_v").agg(F.sum("c").alias("c")))
        totals = ordered_totals(counted, [], "_v", ["c"], descending=True)
        lookup = totals.select("_v", ((F.col("cum_c") + 1.0) / F.lit(n + 1.0)).alias("conformal_p_value"))
        out = df.withColumn("_v", finite(F.col(score))).join(broadcast_if_fits(lookup), "_v", "left").drop("_v")
    out = out.withColumn("conformal_is_anomalous", F.coalesce(F.col("conformal_p_value") <= alpha, F.lit(False)))
    return out.withColumns({"conformal_assessment": text, "conformal_alpha": F.lit(alpha),
                            "conformal_calibration_size": F.lit(n)})

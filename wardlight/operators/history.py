"""Visit-level history features built on the per-patient order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.operators.ordered import DAY_MICROS, PatientOrder


def longitudinal_features(order: PatientOrder, features: list[str], windows: tuple[int, ...] = (7, 30),
                          lags: tuple[int, ...] = (1,), interactions: tuple[tuple[str, str], ...] = (),
                          block: int = 12) -> PatientOrder:
    """Lags, rolling mean / std of prior values and products of column pairs.

    Rolling statistics look at the previous visits only: values are shifted by
    one visit before the time window is applied. Features go through in blocks
    so one stage never carries hundreds of window expressions.
    """
    for i in range(0, len(features), block):
        part = features[i:i + block]
        order = order.lag(part, (1,), "_p_{c}")
        order = order.rolling_moments([f"_p_{c}" for c in part], windows)
        df = order.df
        for c in part:
            for d in windows:
                df = df.withColumnsRenamed({
                    f"_p_{c}_mean_{d}d": f"{c}_mean_{d}d", f"_p_{c}_std_{d}d": f"{c}_std_{d}d"})
        df = df.withColumns({f"{c}_lag1": F.col(f"_p_{c}") for c in part if 1 in lags})
        order = order.replace(df.drop(*[f"_p_{c}" for c in part]))
        deeper = tuple(k for k in lags if k != 1)
        if deeper:
            order = order.lag(part, deeper)
    pairs = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in interactions
             if a in order.df.columns and b in order.df.columns}
    return order.replace(order.df.withColumns(pairs)) if pairs else order


def sequence_windows(order: PatientOrder, features: list[str], size: int = 4,
                     output: str = "sequence_window") -> PatientOrder:
    """The last ``size`` visits as an array of feature arrays, zero rows in front."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    order = order.replace(order.df.withColumn("_vec", vector)).previous(["_vec"], size - 1, "_before")
    zeros = F.array(*[F.lit(0.0) for _ in features])
    held = F.concat(F.transform("_before", lambda s: s["_vec"]), F.array(F.col("_vec")))
    pad = F.array_repeat(zeros, F.greatest(F.lit(size) - F.size(held), F.lit(0)))
    df = order.df.withColumns({
        output: F.concat(pad, held), "sequence_history_length": F.size(held)})
    return order.replace(df.drop("_vec", "_before"))


def previous_run(order: PatientOrder, score: str) -> PatientOrder:
    """Change against the patient's previous result."""
    order = order.lag([score], (1,), "_previous_{c}")
    delta = F.round(F.col(score) - F.col(f"_previous_{score}"), 6)
    word = (F.when(delta.isNull(), "baseline").when(delta < 0, "improving")
            .when(delta > 0, "worsening").otherwise("stable"))
    df = order.df.withColumns({"score_delta": delta, "direction": word})
    return order.replace(df.drop(f"_previous_{score}"))


def visit_intervals(order: PatientOrder, days: int = 90, keep: int = 0) -> PatientOrder:
    """Days since the last visit and visits in the last ``days`` days.

    ``keep`` > 0 also lists the latest ``keep`` intervals, oldest first.
    """
    order = order.lag(["_us"], (1,), "_last_us")
    gap = (F.col("_us") - F.col("_last_us")) / F.lit(float(DAY_MICROS))
    order = order.replace(order.df.withColumn("days_since_last_visit", gap))
    name = f"visits_last_{days}_days"
    order = order.rolling_moments(["_us"], (days,), mean=None, std=None, count=name)
    if keep:
        order = order.previous(["days_since_last_visit"], keep - 1, "_gaps") if keep > 1 else order
        older = F.transform("_gaps", lambda s: s["days_since_last_visit"]) if keep > 1 else F.array()
        listed = F.array_compact(F.concat(older, F.array("days_since_last_visit")))
        order = order.replace(order.df.withColumn("days_between_visits_trend", listed).drop("_gaps"))
    return order.replace(order.df.drop("_last_us"))


def readmissions(order: PatientOrder, is_admission: Column, days: int = 30) -> PatientOrder:
    """Earlier admissions within ``days`` of the row, the row itself not counted."""
    mark = F.when(is_admission, F.lit(1.0))
    order = order.replace(order.df.withColumn("_adm", mark))
    order = order.rolling_moments(["_adm"], (days,), mean=None, std=None, count="_adm_n")
    own = F.col("_adm").isNotNull().cast("long")
    df = order.df.withColumn(f"readmissions_{days}d", F.col("_adm_n") - own)
    return order.replace(df.drop("_adm", "_adm_n"))


def duplicate_measurements(df: DataFrame, device: str = "device_id", time: str = "recorded_at") -> DataFrame:
    """Flag rows that share device and timestamp with another row.

    Counts are combined map-side and joined back, so one busy device-second
    does not land in a single window group (AQE splits the skewed join side).
    """
    counts = (df.where(F.col(device).isNotNull() & F.col(time).isNotNull())
              .groupBy(device, time).agg((F.count(F.lit(1)) > 1).alias("duplicate_measurement"))
              .where("duplicate_measurement"))
    out = df.join(counts, [device, time], "left")
    return out.withColumn("duplicate_measurement", F.coalesce("duplicate_measurement", F.lit(False)))

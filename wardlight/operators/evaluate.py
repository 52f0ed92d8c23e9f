"""Score-table evaluation: distributions, labelled metrics, agreement and calibration.

All models go through one job: scores are unpivoted, counted per distinct
(model, score), and every rank-based metric is read off running totals.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.numeric import add_all, finite, ratio
from wardlight.operators.ranking import exact_quantiles, interpolate, ordered_totals, quantile_parts

# Display names and order of the models in comparison tables.
MODEL_NAMES = {
    "point_anomaly_score": "Point Anomaly",
    "contextual_anomaly_score": "Contextual Anomaly",
    "collective_anomaly_score": "Collective Anomaly",
    "distribution_mmd_score": "Distribution MMD",
    "isolation_forest_anomaly_score": "Isolation Forest",
    "one_class_svm_anomaly_score": "One-Class SVM",
    "local_outlier_factor_anomaly_score": "Local Outlier Factor",
    "autoencoder_anomaly_score": "Autoencoder",
    "anomaly_transformer_anomaly_score": "Anomaly Transformer",
    "variational_autoencoder_anomaly_score": "Variational Autoencoder",
    "ganomaly_anomaly_score": "GANomaly",
    "cnn_autoencoder_anomaly_score": "CNN Autoencoder",
    "deep_svdd_anomaly_score": "Deep SVDD",
    "anomaly_score": "Ensemble",
}
OTHER_NAMES = {
    "distribution_staleness_alarm": "Staleness Alarm",
    "sequence_anomaly_score": "Temporal Sequence Detector",
    "score_stream_drift_alarm": "Score Stream Drift Alarm",
    "score_stream_cusum_alarm": "CUSUM Drift Alarm",
    "score_stream_adwin_alarm": "ADWIN Drift Alarm",
}
MATRIX_METRICS = [
    "precision", "recall", "f1", "roc_auc", "auprc", "score_mean", "score_std", "score_p95",
    "above_threshold_rate", "score_spread",
]
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def score_columns(columns: list[str], loose: bool = False) -> list[str]:
    """Columns that hold model scores.

    ``loose`` also takes any name mentioning score, error, distance or margin,
    which catches inputs such as ``nutritional_score``.
    """
    if loose:
        return [c for c in columns if any(w in c.lower() for w in ("score", "error", "distance", "margin"))]
    return [c for c in columns if c == "anomaly_score" or c.endswith("_anomaly_score")
            or c == "distribution_mmd_score"]


def label_rule(df: DataFrame, label: str) -> Column:
    """0/1 anomaly flag from 0/1, -1/1 (-1 is the anomaly) or boolean labels; else an error."""
    text = F.lower(F.trim(F.col(label).cast("string")))
    known = ["0", "1", "-1", "true", "false", "0.0", "1.0", "-1.0"]
    seen = df.select(
        F.max((text.isin("-1", "-1.0")).cast("int")).alias("minus"),
        F.max((text.isin("0", "0.0")).cast("int")).alias("zero"),
        F.max((~text.isin(known) | text.isNull()).cast("int")).alias("bad")).first()
    if seen["bad"] or (seen["minus"] and seen["zero"]):
        raise ValueError("labels must be 0/1, -1/1 or boolean")
    if seen["minus"]:
        return F.when(text.isin("-1", "-1.0"), 1).otherwise(0)
    return F.when(text.isin("1", "1.0", "true"), 1).otherwise(0)


def join_labels(scores: DataFrame, labels: DataFrame, on: str, label: str) -> DataFrame:
    """Scores with their labels; unmatched keys on either side are an error."""
    left = scores.select(on, F.lit(1).alias("_s"))
    right = labels.select(on, F.lit(1).alias("_l"))
    lost = left.join(right, on, "full").where(F.col("_s").isNull() | F.col("_l").isNull())
    if not lost.isEmpty():
        raise ValueError("labels and scores must cover the same rows")
    return scores.join(labels.select(on, label), on)


def long_scores(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    cast = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(keep, columns, "model", "score").where(finite(F.col("score")).isNotNull())


def evaluate_scores(df: DataFrame, columns: list[str] | None = None, label: str | None = None,
                    threshold: float = 0.5, top_fraction: float = 0.1) -> DataFrame:
    """One row per score column: distribution metrics and, with labels, accuracy metrics."""
    columns = columns or score_columns(df.columns) or list(df.columns)
    if label is None:
        base = df.withColumn("_y", F.lit(0))
    else:
        base = df.withColumn("_y", label_rule(df, label))
    counted = long_scores(base, columns, ["_y"]).groupBy("model", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    totals = ordered_totals(counted, ["model"], "score", ["n", "pos"], descending=False)
    sizes = counted.groupBy("model").agg(
        F.sum("n").alias("rows_all"), F.sum("pos").alias("pos_all"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score_mean"))
    rows = totals.join(F.broadcast(sizes), "model")  # one row a score column; by model all rows would go to a few tasks

    s, n, pos, size, p = (F.col(c) for c in ("score", "n", "pos", "rows_all", "pos_all"))
    f = min(max(float(top_fraction), 0.01), 0.5)
    take = F.greatest(F.lit(1), F.ceil(size * F.lit(f)))
    zero = F.lit(0).cast("long")
    top = F.least(F.greatest(take - (size - F.col("cum_n")), zero), n)
    bottom = F.least(F.greatest(take - (F.col("cum_n") - n), zero), n)
    hit = s >= F.lit(threshold)
    neg = n - pos
    neg_below = F.col("cum_n") - F.col("cum_pos") - neg
    tp_at = p - (F.col("cum_pos") - pos)
    taken_at = size - (F.col("cum_n") - n)
    aggs = [
        F.first("rows_all").alias("rows_all"), F.first("pos_all").alias("pos_all"), F.first("score_mean").alias("score_mean"),
        F.min("score").alias("score_min"),
        F.sqrt(F.sum(n * (s - F.col("score_mean")) * (s - F.col("score_mean"))) / F.first("rows_all")).alias("score_std"),
        (F.sum(F.when(hit, n).otherwise(0)) / F.first("rows_all")).alias("above_threshold_rate"),
        (F.sum(s * top) / F.sum(top)).alias("top_fraction_mean"),
        (F.sum(s * bottom) / F.sum(bottom)).alias("bottom_fraction_mean"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(pos * (neg_below + neg * 0.5)).alias("_u"),
        F.sum(pos / F.when(p > 0, p) * tp_at / taken_at).alias("_ap"),
    ]
    for name, prob in QUARTILES.items():
        low, high = quantile_parts(prob, "score", size)
        aggs += [low.alias(f"_l_{name}"), high.alias(f"_h_{name}")]
    g = rows.groupBy("model").agg(*aggs)
    q = {k: interpolate(F.col(f"_l_{k}"), F.col(f"_h_{k}"), v, F.col("rows_all")) for k, v in QUARTILES.items()}
    out = [
        F.col("model"), F.col("rows_all").alias("count"), "score_min", "score_mean", q["q50"].alias("score_median"),
        "score_std", (q["q75"] - q["q25"]).alias("score_iqr"), q["q95"].alias("score_p95"),
        q["q99"].alias("score_p99"), "above_threshold_rate", "top_fraction_mean", "bottom_fraction_mean",
        (F.col("top_fraction_mean") - F.col("bottom_fraction_mean")).alias("score_spread"),
    ]
    if label is None:
        return g.select(*out)
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("pos_all") - tp
    tn = F.col("rows_all") - F.col("pos_all") - fp
    both = (F.col("pos_all") > 0) & (F.col("pos_all") < F.col("rows_all"))
    return g.select(
        *out,
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, F.col("rows_all")).alias("accuracy"),
        F.when(both, F.col("_u") / (F.col("pos_all") * (F.col("rows_all") - F.col("pos_all")))).alias("roc_auc"),
        F.when(both, F.col("_ap")).alias("auprc"),
    )


def rank_models(table: DataFrame) -> DataFrame:
    """Best model first; ties fall to the name."""
    return table.orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("auprc"),
                         F.desc_nulls_last("roc_auc"), "model")


def best_single_model(table: DataFrame) -> DataFrame:
    return rank_models(table.where(F.col("model") != "anomaly_score")).limit(1)


def friendly_name(model: str) -> str:
    return MODEL_NAMES.get(model) or OTHER_NAMES.get(model) or model.replace("_", " ").title()


def comparison_matrix(table: DataFrame) -> DataFrame:
    """Metric by model, models in display order; the metric order is kept in ``metric_order``."""
    metrics = [m for m in MATRIX_METRICS if m in table.columns]
    long = table.unpivot(["model"], metrics, "metric", "value")
    order = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    wide = long.groupBy("metric").pivot("model", list(MODEL_NAMES)).agg(F.first("value"))
    wide = wide.withColumn("metric_order", order)
    return wide.withColumnsRenamed(MODEL_NAMES)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed on the right; empty bins included."""
    values = df.select(finite(F.col(column)).alias("x")).where("x IS NOT NULL")
    row = values.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    count = max(1, min(int(bins), row["n"]))
    lo, hi = (row["lo"], row["hi"]) if row["n"] else (0.0, 1.0)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / count
    at = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(count - 1))
    counts = values.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(count if row["n"] else 0).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("count"))


def threshold_grid(df: DataFrame, score: str, label: str, candidates: int = 201) -> DataFrame:
    """Confusion metrics at evenly spaced thresholds.

    Each score falls into the slot of the highest threshold it reaches, so the
    data is read once and grouped into ``candidates`` slots; no row meets the
    whole grid.
    """
    candidates = max(3, int(candidates))
    step = 1.0 / (candidates - 1)
    s = finite(F.col(score))
    guess = F.floor(s / step)
    slot = (F.when((guess + 1) * step <= s, guess + 1).when(guess * step > s, guess - 1).otherwise(guess))
    slot = F.least(F.greatest(slot, F.lit(-1)), F.lit(candidates - 1)).cast("int")
    counts = (df.where(s.isNotNull()).select(slot.alias("slot"), label_rule(df, label).alias("y"))
              .groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")))
    every = df.sparkSession.range(-1, candidates).select(F.col("id").cast("int").alias("slot"))
    filled = every.join(counts, "slot", "left").select(
        "slot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).alias("pos"))
    grid = ordered_totals(filled.withColumn("slot", F.col("slot").cast("double")), [], "slot", ["n", "pos"])
    grid = grid.withColumn("all", F.lit(1))
    size = grid.groupBy("all").agg(F.max("cum_n").alias("rows_all"), F.max("cum_pos").alias("pos_all"))
    grid = grid.join(size, "all").where("slot >= 0")
    tp, fp = F.col("cum_pos"), F.col("cum_n") - F.col("cum_pos")
    fn = F.col("pos_all") - tp
    tn = F.col("rows_all") - F.col("pos_all") - fp
    return grid.select(
        (F.col("slot") * step).alias("threshold"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, F.col("rows_all")).alias("accuracy"))


def calibrate_threshold(df: DataFrame, score: str, label: str, candidates: int = 201,
                        use_accuracy: bool = True) -> DataFrame:
    """The best threshold by (F1, accuracy, precision, threshold); one row."""
    keys = ["f1"] + (["accuracy"] if use_accuracy else []) + ["precision", "threshold"]
    return threshold_grid(df, score, label, candidates).orderBy(*[F.desc(k) for k in keys]).limit(1)


def _flags(columns: list[str], threshold: float) -> list[Column]:
    return [F.coalesce((F.col(c) >= threshold), F.lit(False)).cast("int") for c in columns]


def pairwise_agreement(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Agreement and disagreement rate per model pair: one aggregate over the table."""
    flags = dict(zip(columns, _flags(columns, threshold)))
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.avg((flags[a] == flags[b]).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("left_model"), F.lit(b).alias("right_model"),
                 F.col(f"r{i}").alias("agreement_rate"), (1.0 - F.col(f"r{i}")).alias("disagreement_rate"))
        for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def agreement_summary(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    flags = _flags(columns, threshold)
    hits = add_all(flags)
    pairs = list(combinations(range(len(columns)), 2))
    same = add_all([(flags[a] == flags[b]).cast("double") for a, b in pairs]) / F.lit(float(len(pairs)))
    return df.agg(
        F.avg(same).alias("mean_pairwise_agreement_rate"),
        F.avg((hits >= 2).cast("double")).alias("at_least_two_flag_rate"),
        F.avg((hits == len(columns)).cast("double")).alias("all_models_flag_rate"),
        F.sum((hits == len(columns)).cast("long")).alias("all_models_flag_count"),
        F.lit(len(columns)).alias("component_count"))


def agreement_matrix(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Symmetric model x model agreement, 1 on the diagonal."""
    pairs = pairwise_agreement(df, columns, threshold).select("left_model", "right_model", "agreement_rate")
    mirrored = pairs.union(pairs.select("right_model", "left_model", "agreement_rate"))
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], mirrored.schema)
    return (mirrored.union(own).groupBy(F.col("left_model").alias("model"))
            .pivot("right_model", columns).agg(F.first("agreement_rate")))


def top_disagreements(df: DataFrame, columns: list[str], row: str = "row_id", threshold: float = 0.5,
                      top_n: int = 5, preview: list[str] | None = None) -> DataFrame:
    """Rows on which the models disagree most, with the flag pattern and the pairs at odds."""
    flags = _flags(columns, threshold)
    pairs = list(combinations(range(len(columns)), 2))
    odd = [flags[a] != flags[b] for a, b in pairs]
    names = [f"{columns[a]}__{columns[b]}" for a, b in pairs]
    hits = add_all(flags)
    count = hits * (F.lit(len(columns)) - hits)
    split = F.array_compact(F.array(*[F.when(o, F.lit(n)) for o, n in zip(odd, names)]))
    worst = F.when(count > 0, split).otherwise(F.array(*[F.lit(n) for n in names]))
    ranked = df.select(
        row, *(preview or []), *columns, count.alias("disagreement_count"),
        (F.greatest(*columns) - F.least(*columns)).alias("score_range"),
        F.concat_ws("", *[f.cast("string") for f in flags]).alias("flag_pattern"),
        worst.alias("worst_disagreement_pairs"), worst[0].alias("worst_disagreement_pair"))
    return ranked.orderBy(F.desc("disagreement_count"), F.desc("score_range"), row).limit(max(1, int(top_n)))


# Runtime columns and their limits.
RUNTIME_COLUMNS = [
    "training_time_seconds", "training_time_ms", "model_size_bytes", "estimated_ram_usage_bytes",
    "inference_batch_latency_ms", "inference_latency_ms_per_patient", "inference_throughput_rows_per_second",
]
LATENCY_MS, MODEL_BYTES, RAM_BYTES = 100.0, 100 * 1024 * 1024, 512 * 1024 * 1024


def runtime_summary(df: DataFrame, order: str = "row_id") -> DataFrame:
    """First non-null value per runtime column and the readiness verdict; one row."""
    present = [c for c in RUNTIME_COLUMNS if c in df.columns]
    first = df.agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in present])
    if "inference_latency_ms_per_patient" not in present:
        return first

    def small(c, limit):
        if c not in present:
            return F.lit(True)
        v = F.col(c).cast("double")
        return v.isNull() | F.isnan(v) | (v <= limit)

    checks = {
        "latency_ok": F.col("inference_latency_ms_per_patient") <= LATENCY_MS,
        "model_size_ok": small("model_size_bytes", MODEL_BYTES),
        "ram_ok": small("estimated_ram_usage_bytes", RAM_BYTES),
    }
    out = first.withColumns(checks)
    passed = add_all([F.col(c).cast("int") for c in checks])
    status = F.when(passed == 3, "ready").when(passed > 0, "needs_optimization").otherwise("not_ready")
    return out.withColumn("edge_readiness_status", status)


def conformal_summary(df: DataFrame, p: str = "conformal_p_value", alpha: float = 0.05) -> DataFrame:
    """Count, spread and rate of p <= alpha over the finite p-values; one row."""
    values = df.select(finite(F.col(p)).alias("p")).where("p IS NOT NULL").withColumn("all", F.lit(1))
    stats = values.groupBy("all").agg(
        F.count("p").alias("count"), F.min("p").alias("p_value_min"), F.avg("p").alias("p_value_mean"),
        F.avg((F.col("p") <= alpha).cast("double")).alias("anomalous_rate_at_alpha"))
    q = exact_quantiles(values, "p", {"p_value_median": 0.5, "p_value_p95": 0.95}, ["all"])
    return stats.join(q, "all").drop("all").withColumn("alpha", F.lit(alpha))


# -- dashboard tables -----------------------------------------------------


def daily_trend(df: DataFrame, time: str = "recorded_at", score: str = "anomaly_score",
                alert_at: float = 0.7, tz: str | None = None) -> DataFrame:
    """Mean, max, alerts and rows per day; rows without a time are left out."""
    stamp = F.col(time) if tz is None else F.from_utc_timestamp(F.col(time), tz)
    return (df.where(F.col(time).isNotNull()).groupBy(F.date_trunc("day", stamp).alias("day"))
            .agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
                 F.sum((F.col(score) >= alert_at).cast("long")).alias("alerts"),
                 F.count(F.lit(1)).alias("rows")))


def kpis(df: DataFrame, score: str = "anomaly_score", alert: str = "is_anomaly") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("patients"), F.sum(F.col(alert).cast("long")).alias("alerts"),
        F.sum((F.col(score) >= 0.7).cast("long")).alias("high_risk"), F.avg(score).alias("mean_score"))


def risk_map(df: DataFrame, score: str = "anomaly_score", row: str = "row_id") -> DataFrame:
    """Dashboard band per row (0.4 / 0.7) and the label shown for it."""
    ids = [F.col(c).cast("string") for c in ("patient_id", "record_id", row) if c in df.columns]
    band = F.when(F.col(score) < 0.4, "Low").when(F.col(score) < 0.7, "Medium").otherwise("High")
    return df.select(row, F.coalesce(*ids).alias("patient_label"), score,
                     F.when(F.col(score).isNotNull(), band).alias("risk_band"))

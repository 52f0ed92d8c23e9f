"""Train, score, evaluate and retrain: compositions of the operators."""

from __future__ import annotations

import json
import pickle
import time
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel)
from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import evaluate as ev
from wardlight.operators import fusion
from wardlight.operators.conformal import conformal_p_values
from wardlight.operators.detectors import Fitted, build, fit_detectors, fit_sequence, score_sequence
from wardlight.operators.drift import drift_alarms
from wardlight.operators.features import FeatureModel, fit_features
from wardlight.operators.feedback import retraining_rows
from wardlight.operators.heads import (
    collective_groups, fit_baseline, score_collective, score_contextual, score_point)
from wardlight.operators.history import sequence_windows
from wardlight.operators.monitor import Monitor, fit_monitor, mark_batch
from wardlight.operators.ordered import PatientOrder, hot_keys
from wardlight.operators.risk import assessments, clinical_risk
from wardlight.schema import KEY, ROW, TIME, Settings
from wardlight.session import compiled_methods, cut_lineage


@dataclass
class Model:
    """Everything a scoring job needs."""

    settings: Settings
    features: FeatureModel
    detectors: list[Fitted]
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    baseline: dict[str, tuple[float, float]] = field(default_factory=dict)
    threshold: float = 0.5
    calibrated: bool = False
    meta: object | None = None
    monitor: Monitor | None = None
    sequence: dict | None = None
    calibration: DataFrame | None = None
    calibration_source: str = "unavailable"
    training_seconds: float = 0.0
    nonconformity_source: str = "anomaly_score"

    @property
    def components(self) -> list[str]:
        return [d.name for d in self.detectors]


def _component_scores(table: DataFrame, model: Model, scaling: str = "fit",
                      available: list[str] | None = None) -> DataFrame:
    """Each detector's score scaled into [0, 1] as ``<name>_anomaly_score``; detectors that are not available do not run."""
    running = [d for d in model.detectors if available is None or d.name in available]
    if not running:
        raise ValueError("no detector of the model is available")
    out = table
    for d in running:
        out = d.raw(out, f"{d.name}_raw_score")
    return _scaled(out, model, running, scaling)


def _scaled(out: DataFrame, model: Model, running: list[Fitted], scaling: str = "fit") -> DataFrame:
    """Component scores of rows that hold the raw ones."""
    for d in running:
        out = d.standard(out)
    names = {f"{d.name}_score": f"{d.name}_anomaly_score" for d in running}
    ranges = {c: r for c, r in model.ranges.items() if c in names} if scaling == "fit" else None
    out = fusion.scale_components(out, ranges, list(names), names)
    return out.drop(*names, *[f"{d.name}_raw_score" for d in running])


def _fuse(df: DataFrame, model: Model, output: str, available: list[str] | None = None) -> DataFrame:
    """Fuse the component scores; components that are not available give their weight to the others.

    A stacked model was fitted on all components: a missing one counts as 0.5.
    """
    s = model.settings
    held = [c for c in model.components if available is None or c in available]
    parts = [f"{c}_anomaly_score" for c in held]
    if s.fusion_strategy == "weighted_average":
        weights = fusion.resolve_weights(model.components, s.fusion_weights, s.normalize_weights)
        if len(held) < len(weights):
            weights = fusion.resolve_weights(held, {c: weights[c] for c in held})
        return df.withColumn(output, fusion.weighted_average(weights, lambda c: F.col(f"{c}_anomaly_score")))
    if s.fusion_strategy == "max_score_voting":
        return df.withColumn(output, fusion.max_vote(parts))
    every = [f"{c}_anomaly_score" for c in model.components]
    if s.fusion_strategy == "stacking":
        missing = {c: F.lit(0.5) for c in every if c not in parts}
        return fusion.apply_stacking(df.withColumns(missing) if missing else df, model.meta, every, output).drop(*missing)
    if s.fusion_strategy == "moe":
        return fusion.apply_gate(df, model.meta, model.features.names, every, output, parts)
    raise ValueError("fusion must be weighted_average, max_score_voting, stacking or moe")


def _nonconformity(df: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """The score that p-values compare: the mean reconstruction error of the detectors that have one, else the final score."""
    errors = [c for c in (f"{n}_reconstruction_error" for n in model.components) if c in df.columns]
    if not errors:
        return df.withColumn("nonconformity", F.col("anomaly_score")), "anomaly_score"
    return df.withColumn("nonconformity", fusion.mean_of_available([F.col(c) for c in errors])), "reconstruction_error"


def _residuals(df: DataFrame, model: Model) -> str | None:
    """The residual array that the collective head reads: the first detector's that keeps one."""
    return next((c for c in (f"{n}_residual" for n in model.components) if c in df.columns), None)


def _sequence_score(df: DataFrame, model: Model, hot) -> DataFrame:
    if model.sequence is None:
        return df.withColumns({"sequence_anomaly_score": F.lit(0.0), "sequence_history_length": F.lit(0)})
    s = model.settings
    order = sequence_windows(PatientOrder(df, hot=hot), model.features.names, s.sequence_window)
    return score_sequence(order.done(), model.sequence).drop("sequence_window")


def _final_score(table: DataFrame, model: Model, hot, scaling: str = "fit",
                 available: list[str] | None = None) -> DataFrame:
    """Components, fused ``tabular_anomaly_score`` and blended ``anomaly_score``."""
    out = _fuse(_component_scores(table, model, scaling, available), model, "tabular_anomaly_score", available)
    out = _sequence_score(out, model, hot)
    if model.sequence is None:
        return out.withColumn("anomaly_score", F.col("tabular_anomaly_score"))
    return out.withColumn("anomaly_score", fusion.blend_sequence(
        F.col("tabular_anomaly_score"), F.col("sequence_anomaly_score"), model.sequence["mean"],
        model.sequence["std"], model.settings.sequence_weight))


def train(df: DataFrame, settings: Settings | None = None, label: str | None = None,
          calibration: DataFrame | None = None, sequence: bool = True) -> Model:
    """Fit features, detectors, fusion, heads, monitor and calibration on ``df``.

    The feature table is computed once, checkpointed and read by every fit.
    """
    started = time.time()
    s = settings or Settings()
    compiled_methods(df.sparkSession)
    hot = hot_keys(df)
    features = fit_features(df.drop(label) if label else df, s, hot)
    keep = [ROW, KEY, TIME] + ([label] if label else [])
    table = cut_lineage(features.transform(df, keep, hot))
    names = features.names
    detectors, raw = fit_detectors(s.detectors, table, names, contamination=s.contamination, seed=s.seed)
    model = Model(s, features, detectors)
    standard = raw
    for d in detectors:
        standard = d.standard(standard)
    model.ranges = fusion.fit_ranges(standard, [f"{c}_score" for c in model.components])
    parts = [f"{c}_anomaly_score" for c in model.components]
    scored = _scaled(raw, model, detectors)
    if s.fusion_strategy == "stacking":
        if label is None:
            raise ValueError("stacking needs labels")
        y = scored.withColumn("_y", ev.label_rule(scored, label))
        model.meta = fusion.fit_stacking(y, parts, "_y", s.stacking_meta_model, s.seed)
    elif s.fusion_strategy == "moe":
        y = scored.withColumn("_y", ev.label_rule(scored, label)) if label else scored
        model.meta = fusion.fit_gate(y, names, parts, "_y" if label else None)
    fused = _fuse(scored, model, "tabular_anomaly_score")
    model.baseline = fit_baseline(table, names)
    model.monitor = fit_monitor(table, names, ROW, s.monitor_calibration_batch,
                                s.monitor_trials, s.monitor_quantile, seed=s.seed)
    if sequence:
        order = sequence_windows(PatientOrder(table, hot=hot), names, s.sequence_window)
        model.sequence = fit_sequence(order.done(), names, s.sequence_window)
    final = _sequence_score(fused, model, hot)
    score = F.col("tabular_anomaly_score") if model.sequence is None else fusion.blend_sequence(
        F.col("tabular_anomaly_score"), F.col("sequence_anomaly_score"), model.sequence["mean"],
        model.sequence["std"], s.sequence_weight)
    final, model.nonconformity_source = _nonconformity(final.withColumn("anomaly_score", score), model)
    final = cut_lineage(final.select(ROW, *([label] if label else []), "anomaly_score", "nonconformity"))
    _set_threshold(model, final, label)
    if calibration is not None:
        set_calibration(model, calibration, label, "validation")
    else:
        normal = final.where(ev.label_rule(final, label) == 0) if label else final
        model.calibration = normal.select("nonconformity")
        model.calibration_source = "train_normal_only" if label else "train"
    model.training_seconds = time.time() - started
    return model


def _set_threshold(model: Model, scored: DataFrame, label: str | None) -> None:
    s = model.settings
    usable = False
    if label and s.calibrate_threshold and s.fusion_strategy != "max_score_voting":
        y = ev.label_rule(scored, label)
        row = scored.agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        usable = row["n"] >= s.calibration_min_samples and row["lo"] != row["hi"]
    if usable:
        model.threshold = float(ev.calibrate_threshold(scored, "anomaly_score", label).first()["threshold"])
        model.calibrated = True
    elif s.fusion_strategy == "max_score_voting":
        model.threshold = s.max_score_threshold
    else:
        model.threshold = fusion.contamination_threshold(scored, "anomaly_score", s.contamination)


def set_calibration(model: Model, df: DataFrame, label: str | None, source: str) -> None:
    """Calibrate p-values on a held-out frame: its normal rows where labels exist."""
    scored = final_scores(df, model)
    if label and label in df.columns:
        scored = scored.join(df.select(ROW, label), ROW)
        normal = scored.where(ev.label_rule(scored, label) == 0)
        if not normal.isEmpty():
            scored, source = normal, f"{source}_normal_only"
    model.calibration = cut_lineage(scored.select("nonconformity"))
    model.calibration_source = source


def final_scores(df: DataFrame, model: Model) -> DataFrame:
    hot = hot_keys(df)
    out = _final_score(model.features.transform(df, [ROW, KEY, TIME], hot), model, hot)
    return _nonconformity(out, model)[0].select(ROW, "anomaly_score", "nonconformity")


def train_from_splits(splits: dict[str, DataFrame], label: str | None = None,
                      settings: Settings | None = None, **kwargs) -> tuple[Model, dict]:
    """Train on the train split, calibrate on validation, report on test."""
    train_df, val, test = splits["train"], splits.get("validation"), splits.get("test")
    model = train(train_df, settings, label, **kwargs)
    metrics: dict = {f"{n}_rows": f.count() for n, f in splits.items()}
    if val is not None and metrics["validation_rows"]:
        if label and label in val.columns:
            scored = final_scores(val, model).join(val.select(ROW, label), ROW)
            best = ev.calibrate_threshold(scored, "anomaly_score", label).first()
            model.threshold, model.calibrated = float(best["threshold"]), True
            metrics["validation_calibration"] = best.asDict()
        set_calibration(model, val, label, "validation")
    if test is not None and metrics["test_rows"] and label and label in test.columns:
        scored = final_scores(test, model).join(test.select(ROW, label), ROW)
        table = ev.evaluate_scores(scored, ["anomaly_score"], label, model.threshold)
        metrics["test_metrics"] = table.select("precision", "recall", "f1", "accuracy", "roc_auc").first().asDict()
    return model, metrics


def score(df: DataFrame, model: Model, scaling: str = "fit", available: list[str] | None = None,
          keep_z: bool = False, adaptive_drift: bool = True) -> DataFrame:
    """Every score, alarm, p-value and risk column next to the input columns, joined by row id."""
    s = model.settings
    compiled_methods(df.sparkSession)
    hot = hot_keys(df)
    names = model.features.names
    table = cut_lineage(model.features.transform(df, [ROW, KEY, TIME], hot))
    out = score_point(table, model.baseline, keep_z)
    out = score_contextual(PatientOrder(out, hot=hot), names, keep_z).done()
    out = _final_score(out, model, hot, scaling, available)
    out, source = _nonconformity(out, model)
    if model.calibration is not None and source != model.nonconformity_source:  # a detector is missing: compare like with like
        raise ValueError(f"p-values were calibrated on {model.nonconformity_source}, this batch has {source}")
    out = score_collective(out, collective_groups(model.features.feature_map()), _residuals(out, model), names)
    out = mark_batch(out, table, model.monitor)
    out = out.drop(*names, *[c for c in out.columns if c.endswith("_residual")])
    # Drift, p-values and risk all read the final score: keep the scored table once.
    out = cut_lineage(out)
    out = drift_alarms(PatientOrder(out, hot=hot), "anomaly_score", s.drift_baseline_window, s.drift_cusum_k,
                       s.drift_cusum_h, s.drift_adwin_delta, s.drift_adwin_min_window, adaptive_drift).done()
    calibration = model.calibration if model.calibration is not None else out.where(F.lit(False)).select("nonconformity")
    out = conformal_p_values(out, calibration, "nonconformity", alpha=s.conformal_alpha).drop("nonconformity")
    out = out.withColumns({"conformal_calibration_source": F.lit(model.calibration_source),
                           "conformal_nonconformity_source": F.lit(source)})
    out = fusion.decide(out, "anomaly_score", model.threshold).drop(KEY, TIME, "visit_index")
    joined = df.join(out.drop(*[c for c in df.columns if c != ROW and c in out.columns]), ROW, "left")
    return assessments(clinical_risk(joined, "anomaly_score", s.risk_weights))


def score_with_runtime(df: DataFrame, model: Model, path: str, **kwargs) -> DataFrame:
    """Write the scored table and return its one-row runtime table (latency, throughput, training time)."""
    started = time.time()
    score(df, model, **kwargs).write.mode("overwrite").parquet(path)
    spent = time.time() - started
    rows = df.sparkSession.read.parquet(path).count()
    return df.sparkSession.createDataFrame(
        [(1, model.training_seconds, spent * 1000.0, spent * 1000.0 / max(rows, 1), rows / spent if spent else None)],
        "row_id int, training_time_seconds double, inference_batch_latency_ms double, "
        "inference_latency_ms_per_patient double, inference_throughput_rows_per_second double")


def evaluation_report(scored: DataFrame, label: str | None = None, columns: list[str] | None = None,
                      threshold: float = 0.5) -> dict[str, DataFrame]:
    """The report's tables by name."""
    columns = columns or ev.score_columns(scored.columns)
    models = [c for c in columns if c not in ("anomaly_score", "distribution_mmd_score")]
    comparison = ev.evaluate_scores(scored, columns, label, threshold)
    out = {"comparison": comparison, "matrix": ev.comparison_matrix(comparison)}
    if label:
        out["best_single_model"] = ev.best_single_model(comparison)
    if len(models) > 1:
        out["agreement"] = ev.agreement_summary(scored, models, threshold)
        out["pairs"] = ev.pairwise_agreement(scored, models, threshold)
        out["disagreements"] = ev.top_disagreements(scored, models, threshold=threshold)
    for c in scored.columns:
        if "reconstruction_error" in c:
            out[f"histogram_{c}"] = ev.histogram(scored, c)
    if "conformal_p_value" in scored.columns:
        out["conformal"] = ev.conformal_summary(scored)
    if any(c in scored.columns for c in ev.RUNTIME_COLUMNS):
        out["runtime"] = ev.runtime_summary(scored)
    return out


def retrain(base: DataFrame, ledger: DataFrame, settings: Settings | None = None, **kwargs) -> Model:
    """Train again on the base rows (normal) plus the reviewed records.

    Base rows keep their ids and stay, as normal visits, beside a reviewed copy
    of them; reviewed rows get ids of their own from ``retraining_rows``.
    """
    rows = retraining_rows(base, ledger, base.drop("label").schema)
    rows = rows.withColumn(ROW, F.coalesce(F.col(ROW).cast("string"), F.xxhash64(*rows.columns).cast("string")))
    return train(rows, settings, "label", **kwargs)


# -- persistence ---------------------------------------------------------


def save_model(model: Model, path: str, spark: SparkSession) -> str:
    """Write state tables, Spark ML stages and a one-row manifest; returns the version."""
    plain, tables = [], {}
    for d in model.detectors:
        state = {}
        for k, v in d.state.items():
            if isinstance(v, DataFrame):
                tables[f"{d.name}__{k}"] = v
            else:
                state[k] = v
        plain.append((d.name, d.features, d.mean, d.std, state))
    fm = model.features
    payload = {
        "settings": asdict(model.settings), "detectors": plain, "ranges": model.ranges, "baseline": model.baseline,
        "threshold": model.threshold, "calibrated": model.calibrated, "monitor": model.monitor,
        "sequence": model.sequence, "source": model.calibration_source, "seconds": model.training_seconds,
        "nonconformity": model.nonconformity_source,
        "features": {k: getattr(fm, k) for k in (
            "numeric", "engineered_from", "kinds", "vocabularies", "domains", "list_columns", "means", "scales",
            "pca_columns", "coded")},
        "meta": type(model.meta).__name__ if model.meta is not None else None}
    if model.calibration is not None:
        tables["calibration"] = model.calibration
    if fm.donors is not None:
        tables["donors"] = fm.donors
    if fm.codes is not None:
        tables["codes"] = fm.codes
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    if fm.pca is not None:
        fm.pca.write().overwrite().save(f"{path}/pca")
    if model.meta is not None:
        model.meta.write().overwrite().save(f"{path}/meta")
    state = spark.createDataFrame([(bytearray(pickle.dumps(payload)), json.dumps(sorted(tables)))],
                                  "state binary, tables string")
    state.write.mode("overwrite").parquet(f"{path}/state")
    manifest = spark.read.parquet(f"{path}/state").select(
        F.sha2("state", 256).alias("sha256"),
        F.substring(F.sha2("state", 256), 1, 12).alias("version"), F.length("state").alias("size_bytes"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("saved_at"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest").first()["version"]


def load_model(path: str, spark: SparkSession) -> Model:
    """Load a model written by ``save_model``. Only open models you trust: the state is a pickle."""
    row = spark.read.parquet(f"{path}/state").first()
    p = pickle.loads(bytes(row["state"]))
    tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in json.loads(row["tables"])}
    settings = Settings(**p["settings"])
    features = FeatureModel(settings, **p["features"])
    features.donors, features.codes = tables.get("donors"), tables.get("codes")
    if features.pca_columns:
        features.pca = PCAModel.load(f"{path}/pca")
    detectors = []
    for name, names, mean, std, state in p["detectors"]:
        state.update({n.split("__", 1)[1]: t for n, t in tables.items() if n.startswith(f"{name}__")})
        detectors.append(build(name, spark, names, state, mean, std))
    kinds = {c.__name__: c for c in (
        GBTClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel, PipelineModel)}
    meta = kinds[p["meta"]].load(f"{path}/meta") if p["meta"] else None
    return Model(settings, features, detectors, p["ranges"], p["baseline"], p["threshold"], p["calibrated"], meta,
                 p["monitor"], p["sequence"], tables.get("calibration"), p["source"], p["seconds"],
                 p["nonconformity"])

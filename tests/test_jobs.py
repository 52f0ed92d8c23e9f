import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.operators import fusion
from wardlight.operators.detectors import DETECTORS, fit_detector, fit_sequence, register_scorer, score_sequence
from wardlight.operators.features import fit_features
from wardlight.operators.feedback import normalize_feedback
from wardlight.plans.job_queries import SMALL
from wardlight.plans.jobs import (
    evaluation_report, load_model, retrain, save_model, score, score_with_runtime, train, train_from_splits)
from wardlight.plans.model_queries import DIMS, vectors
from wardlight.schema import Settings
from wardlight.sources.standins import visits


@pytest.fixture(scope="module")
def data(spark, sf):
    return visits(spark, sf).withColumn("label", (F.col("value") > 150).cast("int")).persist()


@pytest.fixture(scope="module")
def model(data):
    return train(data, SMALL, "label")


def test_scores_stay_in_range_and_every_row_is_kept(data, model):
    out = score(data.drop("label"), model).persist()
    assert out.count() == data.count()
    r = out.agg(F.min("anomaly_score").alias("a"), F.max("anomaly_score").alias("b"),
                F.min("conformal_p_value").alias("p"), F.max("conformal_p_value").alias("q")).first()
    assert 0 <= r["a"] <= r["b"] <= 1 and 0 < r["p"] <= r["q"] <= 1
    assert model.calibrated and out.where("risk_level IS NULL").isEmpty()
    tables = evaluation_report(out.join(data.select("row_id", "label"), "row_id"), "label")
    assert {"comparison", "matrix", "best_single_model", "agreement", "conformal"} <= set(tables)
    assert tables["comparison"].where("model = 'anomaly_score'").first()["roc_auc"] > 0.6


def test_single_row_scores_like_the_batch(data, model):
    batch = score(data.drop("label"), model).select("row_id", "isolation_forest_anomaly_score")
    some = data.drop("label").orderBy("recorded_at").limit(1)
    alone = score(some, model).select("row_id", "isolation_forest_anomaly_score").first()
    held = batch.where(F.col("row_id") == alone["row_id"]).first()
    assert alone[1] == pytest.approx(held[1], abs=1e-9)


def test_save_and_load(spark, data, model, tmp_path):
    version = save_model(model, str(tmp_path / "m"), spark)
    assert len(version) == 12
    again = load_model(str(tmp_path / "m"), spark)
    cols = ["row_id", "anomaly_score", "conformal_p_value", "risk_score"]
    a = score(data.drop("label"), model, adaptive_drift=False).select(*cols).toPandas().sort_values("row_id")
    b = score(data.drop("label"), again, adaptive_drift=False).select(*cols).toPandas().sort_values("row_id")
    np.testing.assert_allclose(a[cols[1:]], b[cols[1:]], atol=1e-9)
    run = score_with_runtime(data.drop("label"), model, str(tmp_path / "out"), adaptive_drift=False).first()
    assert run["inference_throughput_rows_per_second"] > 0


def test_p_values_and_groups_read_the_reconstruction(data, model):
    """Calibration and batch compare the same source: the reconstruction error; the collective head reads its residuals."""
    assert model.nonconformity_source == "reconstruction_error"
    out = score(data.drop("label"), model, adaptive_drift=False).toPandas()
    errors = np.sort(model.calibration.toPandas()["nonconformity"].to_numpy())
    expected = (1 + len(errors) - np.searchsorted(errors, out["pca_reconstruction_reconstruction_error"] - 1e-12)) / (len(errors) + 1)
    np.testing.assert_allclose(out["conformal_p_value"], expected, atol=2.5 / len(errors))
    assert set(out["conformal_nonconformity_source"]) == {"reconstruction_error"}
    groups = [c for c in out.columns if c.startswith("collective_group_error__")]
    whole = out["pca_reconstruction_reconstruction_error"].to_numpy() * len(model.features.names)
    assert groups and (out[groups].to_numpy().max(axis=1) ** 2 <= whole + 1e-9).all()


def test_missing_detectors_hand_on_their_weight(data, model):
    only = score(data.drop("label"), model, available=["pca_reconstruction"], adaptive_drift=False)
    assert "isolation_forest_anomaly_score" not in only.columns
    gap = only.where(F.abs(F.col("tabular_anomaly_score") - F.col("pca_reconstruction_anomaly_score")) > 1e-9)
    assert gap.isEmpty()
    with pytest.raises(ValueError):  # calibrated on reconstruction errors, which this batch would not have
        score(data.drop("label"), model, available=["isolation_forest"], adaptive_drift=False)
    with pytest.raises(ValueError):
        score(data.drop("label"), model, available=[])


def test_gate_weights_over_available_experts(spark):
    df = spark.createDataFrame([(i, i % 2 / 1.0, 0.2, 0.9, 0.5) for i in range(20)], "row_id int, x double, a double, b double, c double")
    gate = fusion.fit_gate(df, ["x"], ["a", "b", "c"])
    out = fusion.apply_gate(df, gate, ["x"], ["a", "b", "c"], "y", ["a", "c"]).toPandas()
    np.testing.assert_allclose(out["a_gate_weight"] + out["c_gate_weight"], 1.0)
    np.testing.assert_allclose(out["y"], out["a_gate_weight"] * 0.2 + out["c_gate_weight"] * 0.5)


def test_split_training_and_retraining(spark, data):
    quick = Settings(**{**SMALL.__dict__, "detectors": ("pca_reconstruction",), "fusion_weights": None})
    parts = {n: f.persist() for n, f in zip(("train", "validation", "test"), data.randomSplit([0.6, 0.2, 0.2], 1))}
    fitted, metrics = train_from_splits(parts, "label", quick, sequence=False)
    assert fitted.calibration_source == "validation_normal_only" and metrics["test_metrics"]["roc_auc"] > 0.5
    reviewed = data.limit(20).select("row_id", "patient_id", "recorded_at", "source_type", "value", "k",
                                     F.lit("tp").alias("feedback_label"))
    again = retrain(data.drop("label"), normalize_feedback(reviewed), quick, sequence=False)
    assert again.calibration_source == "train_normal_only"


@pytest.mark.parametrize("strategy", ["stacking", "moe", "max_score_voting"])
def test_fusion_strategies(data, strategy):
    s = Settings(**{**SMALL.__dict__, "fusion_strategy": strategy, "stacking_meta_model": "gbt"})
    m = train(data, s, "label", sequence=False)
    out = score(data.drop("label"), m, adaptive_drift=False)
    r = out.agg(F.min("anomaly_score").alias("a"), F.max("anomaly_score").alias("b")).first()
    assert -1e-9 <= r["a"] <= r["b"] <= 1 + 1e-9


def test_gate_weights_sum_to_one(data, model):
    df = data.withColumns({"a": F.rand(1), "b": F.rand(2)})
    gate = fusion.fit_gate(df, ["value", "k"], ["a", "b"], "label")
    out = fusion.apply_gate(df, gate, ["value", "k"], ["a", "b"], "s")
    assert out.where(F.abs(F.col("a_gate_weight") + F.col("b_gate_weight") - 1) > 1e-9).isEmpty()


def test_weights_and_missing_detectors():
    w = fusion.resolve_weights(["isolation_forest", "autoencoder", "deep_svdd"])
    assert sum(w.values()) == pytest.approx(1.0)
    assert fusion.resolve_weights(["a", "b"], {"a": 0.0}) == {"a": 0.5, "b": 0.5}
    raw = fusion.resolve_weights(["isolation_forest", "autoencoder"], normalize=False)
    assert raw == {"isolation_forest": 0.3, "autoencoder": 0.4}


def test_every_detector_ranks_planted_outliers(spark, sf):
    names = DIMS[:8]
    df = vectors(spark, sf, 8)
    far = df.limit(5).select((F.col("row_id") + 100000).alias("row_id"), "label", *[(F.col(n) + 4).alias(n) for n in names])
    both = df.unionByName(far).persist()
    for name in DETECTORS:
        if name == "mean_distance":
            continue
        out = fit_detector(name, df, names, **({} if name != "isolation_forest" else {"trees": 50})).score(both)
        odd = out.where("row_id >= 100000").agg(F.avg(f"{name}_score")).first()[0]
        rest = out.where("row_id < 100000").agg(F.avg(f"{name}_score")).first()[0]
        assert odd > rest + 1.0, name


def test_custom_scorer(spark, sf):
    names = DIMS[:4]
    df = vectors(spark, sf, 4)
    register_scorer("mean_distance",
                    lambda d, f: np.array([d.agg(F.avg(c)).first()[0] for c in f]),
                    lambda centre, x: np.abs(x - centre).mean(axis=1))
    out = fit_detector("mean_distance", df, names).score(df)
    assert out.agg(F.avg("mean_distance_score")).first()[0] == pytest.approx(0.0, abs=1e-9)
    del DETECTORS["mean_distance"]


def test_one_class_margin_is_the_same_in_any_layout(spark, sf):
    df = vectors(spark, sf, 4)
    states = [fit_detector("one_class_svm", d, DIMS[:4]).state for d in (df, df.repartition(7))]
    np.testing.assert_allclose(states[0]["weights"], states[1]["weights"], atol=1e-3)


def test_sequence_errors_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 6)) + 0.01 * rng.normal(size=(300, 6))
    x[0] += [5, 0, 0, 0, 0, -5]
    rows = [(i, 3, v.reshape(3, 2).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id int, sequence_history_length int, sequence_window array<array<double>>")
    model = fit_sequence(df, ["a", "b"], 3)
    got = score_sequence(df, model).orderBy("row_id").toPandas()["sequence_anomaly_score"].to_numpy()
    d = x - x.mean(axis=0)
    axes = np.linalg.svd(d, full_matrices=False)[2][:model["axes"].shape[1]].T
    np.testing.assert_allclose(got, ((d - d @ axes @ axes.T) ** 2).mean(axis=1), atol=1e-9)
    assert got.argmax() == 0 and got[0] > model["threshold"]
    assert fit_sequence(df.where("false"), ["a", "b"], 3) is None


def test_features_unseen_tokens_and_all_missing_rows(spark):
    rows = [(i, f"P{i % 3}", f"2026-01-{i + 1:02d}", 60.0 + i, ["diabetes"] if i % 2 else ["copd"], [7.0, 9.0], "male" if i % 2 else None)
            for i in range(9)]
    ddl = "row_id int, patient_id string, t string, heart_rate_bpm double, comorbidities array<string>, days_between_visits_trend array<double>, gender string"
    df = spark.createDataFrame(rows, ddl).withColumn("recorded_at", F.col("t").cast("timestamp"))
    m = fit_features(df, Settings(apply_pca=False))
    new = spark.createDataFrame([(99, "P9", "2026-03-01", None, ["asthma"], None, "other")], ddl).withColumn(
        "recorded_at", F.col("t").cast("timestamp"))
    r = m.transform(new).first()
    assert all(np.isfinite(r[n]) for n in m.names)
    kinds = {e["final_feature"]: e for e in m.feature_map()}
    assert kinds["comorbidities__diabetes"]["source_columns"] == ["comorbidities"]
    assert kinds["comorbidities__diabetes"]["transformation_path"] == ["raw", "multi_value_expand"]
    assert kinds["heart_rate_bpm_lag1"]["feature_type"] == "engineered_time_series"
    mm = fit_features(df, Settings(apply_pca=False, scaler="minmax", imputer="mean"))
    top = mm.transform(df).agg(F.max("heart_rate_bpm"), F.min("heart_rate_bpm")).first()
    assert tuple(top) == (1.0, 0.0)

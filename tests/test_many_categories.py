"""A categorical column of any number of values: coded by frequency beyond the width of one-hot columns."""

import math

import numpy as np
from pyspark.sql import functions as F

from wardlight.operators import features
from wardlight.plans.jobs import load_model, save_model, score, train
from wardlight.schema import Settings

SETTINGS = Settings(numeric_features=["value"], categorical_features=["device_id", "kind"], multi_value_features=[],
                    list_numeric_features=[], rolling_windows_days=(7,), imputer="mean", apply_pca=False)


def cohort(spark, devices):
    """One visit a device, and one device with a third of all visits."""
    rows = spark.range(devices * 3 // 2)
    return rows.select(
        F.col("id").alias("row_id"), F.pmod("id", F.lit(500)).cast("string").alias("patient_id"),
        F.timestamp_seconds(F.col("id") * 60).alias("recorded_at"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("value"),
        F.when(F.col("id") % 3 == 0, "common").otherwise(F.col("id").cast("string")).alias("device_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"))


def test_train_and_score_on_fifty_thousand_devices(spark, tmp_path):
    df = cohort(spark, 50_000)
    model = train(df, SETTINGS, sequence=False)
    assert "device_id_surprise" in model.features.names and "kind_a" in model.features.names
    assert len(model.features.names) < 12
    save_model(model, str(tmp_path / "m"), spark)
    some = df.limit(40).withColumn("device_id", F.when(F.col("row_id") % 4 == 0, F.col("device_id")).otherwise("never seen"))
    out = score(some, load_model(str(tmp_path / "m"), spark), adaptive_drift=False)
    assert out.where("anomaly_score IS NULL").isEmpty() and out.count() == 40


def test_codes_of_seen_missing_and_new_values(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_VOCABULARY", 3)
    values = ["x"] * 4 + ["y"] * 2 + ["z", "w", None]
    df = spark.createDataFrame([(i, "p", v, 1.0) for i, v in enumerate(values)], "row_id int, patient_id string, device_id string, value double")
    df = df.withColumn("recorded_at", F.timestamp_seconds(F.col("row_id"))).withColumn("kind", F.lit("k"))
    m = features.fit_features(df, SETTINGS)
    got = {r["row_id"]: r["device_id_surprise"] for r in m.engineer(df).collect()}
    want = [-math.log(4 / 8)] * 4 + [-math.log(2 / 8)] * 2 + [-math.log(1 / 8)] * 2 + [-math.log(4 / 8)]  # a gap reads as the mode
    np.testing.assert_allclose([got[i] for i in range(9)], want)
    new = df.withColumn("device_id", F.lit("new"))
    assert {round(r["device_id_surprise"], 9) for r in m.engineer(new).collect()} == {round(math.log(16.0), 9)}
    kinds = {e["final_feature"]: e for e in m.feature_map()}
    assert kinds["device_id_surprise"]["transformation_path"] == ["raw", "frequency_encode"]
    assert set(m.domains) == {"kind"}
    assert m.engineer(df.drop("device_id")).where(F.abs(F.col("device_id_surprise") - math.log(2)) > 1e-9).isEmpty()

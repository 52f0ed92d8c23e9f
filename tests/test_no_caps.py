"""What was bounded works beyond the bound: lab test names as a map, stream p-values by a join."""

import numpy as np
from pyspark.sql import functions as F

from wardlight.operators.assembly import MAX_TESTS, assemble
from wardlight.operators.conformal import conformal_p_values
from wardlight.streaming import jobs


def test_more_lab_tests_than_columns(spark):
    n = MAX_TESTS + 100
    encounters = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "encounter_id long, patient_id long")
    patients = spark.createDataFrame([(1, "a")], "patient_id long, name string")
    labs = spark.range(n).select(
        F.lit(1).cast("long").alias("encounter_id"), F.concat(F.lit("t"), "id").alias("test_name"),
        F.col("id").cast("double").alias("result_value"))
    labs = labs.union(spark.createDataFrame([(1, "t5", 9.0), (2, "t5", None), (2, None, 1.0)], "encounter_id long, test_name string, result_value double"))
    got = {r["encounter_id"]: r["labs"] for r in assemble(encounters, patients, lab_results=labs, lab_map="labs").collect()}
    assert got == {1: {f"t{i}": float(i) for i in range(n)} | {"t5": 9.0}, 2: {"t5": None}, 3: None}


def profile(spark):
    v = [float(x) for x in np.round(np.random.default_rng(5).normal(size=3000), 2)] + [float("nan"), float("inf"), None]
    cal = spark.createDataFrame([(x,) for x in v], "x double")
    some = [-9.0, 9.0, 0.0, 0.005, None, float("nan"), max(v[:3000]), min(v[:3000]), *v[:200]]
    return cal, spark.createDataFrame(list(enumerate(some)), "row_id long, x double")


def test_p_values_of_a_large_profile(spark, monkeypatch):
    cal, rows = profile(spark)
    want = {r["row_id"]: r["conformal_p_value"] for r in conformal_p_values(rows, cal, "x").collect()}
    small = {r["row_id"]: r["conformal_p_value"] for r in jobs.with_p_value(rows, "x", cal).collect()}
    monkeypatch.setattr(jobs, "CALIBRATION_ROWS", 100)
    monkeypatch.setattr(jobs, "SCORES_PER_BIN", 7)
    large = {r["row_id"]: r["conformal_p_value"] for r in jobs.with_p_value(rows, "x", cal).collect()}
    assert len(want) == 208 and want == small == large


def test_p_values_of_a_stream(spark, monkeypatch, tmp_path):
    cal, rows = profile(spark)
    monkeypatch.setattr(jobs, "CALIBRATION_ROWS", 100)
    rows.write.parquet(f"{tmp_path}/in")
    stream = jobs.with_p_value(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "x", cal)
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at")
             .trigger(availableNow=True).start(f"{tmp_path}/out"))
    query.awaitTermination(60)
    got = {r["row_id"]: r["conformal_p_value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["row_id"]: r["conformal_p_value"] for r in conformal_p_values(rows, cal, "x").collect()}

"""The given tables seen as clinical records: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as patient visits with two measurements, ``value`` and ``k``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("patient_id"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
        F.col("event_type").alias("source_type"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def line_key() -> list[str]:
    return ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as encounters: each clinical field is a fixed formula of line columns."""
    li = spread(table(spark, sf_dir, "lineitem"))
    q, price, disc, tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return li.select(
        *line_key(),
        F.col("l_suppkey").cast("string").alias("patient_id"),
        F.col("l_shipdate").cast("timestamp").alias("recorded_at"),
        (F.lit(55.0) + q).alias("heart_rate_bpm"),
        (F.lit(70.0) + q * 2.5).alias("systolic_bp_mmhg"),
        (F.lit(50.0) + q).alias("diastolic_bp_mmhg"),
        (F.lit(100.0) - disc * 120.0).alias("spo2_percent"),
        (F.lit(36.0) + tax * 40.0).alias("body_temperature_c"),
        (F.lit(12.0) + disc * 150.0).alias("respiratory_rate_bpm"),
        (F.lit(18.0) + q / 2.0).alias("bmi_kg_m2"),
        (F.lit(45.0) + price / 270.0).alias("glucose_fasting_mg_dl"),
        F.when(F.col("l_linenumber") > 3, F.lit(60.0) + price / 400.0).alias("glucose_poc_mg_dl"),
        (F.lit(4.5) + tax * 70.0).alias("hba1c_percent"),
        (F.lit(17.0) - q / 6.0).alias("hb_g_dl"),
        (F.lit(0.5) + disc * 18.0).alias("creatinine_mg_dl"),
        (F.lit(5.0) + q).alias("bun_mg_dl"),
        F.when(F.col("l_returnflag") != "N", F.lit(60.0) + q * 2.0).alias("ldl_mg_dl"),
        (F.lit(130.0) + q / 2.0).alias("sodium_mmol_l"),
        (F.lit(3.0) + disc * 30.0).alias("potassium_mmol_l"),
        (q / 5.0).alias("visits_last_90_days"),
        F.when(F.col("l_linestatus") == "O", disc * 10.0).alias("drug_adherence_rate"),
        F.when(F.col("l_linenumber") > 1, F.array_join(F.slice(
            F.array(*[F.lit(t) for t in CONDITIONS]), F.col("l_linenumber"),
            F.pmod(F.col("l_partkey"), F.lit(9)).cast("int")), ", ")).alias("comorbidities"),
    )


CONDITIONS = [
    "CKD", "Type 2 Diabetes", "Hypertension", "Obesity", "none", "Asthma", "COPD",
    "migraine", "T2D", "Dyslipidemia", "cad", "gout", "anaemia", "eczema", "Depression", "n/a",
]

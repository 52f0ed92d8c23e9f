"""Reviewer feedback: normalise payloads and fold them back into training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.cleaning import Fields, feedback_label
from wardlight.schema import ROW

# Payload keys that are not part of the patient record.
META = ["is_true_positive", "feedback_label", "reviewer", "clinician_id", "reviewed_at", "notes",
        "feedback_notes", "comment", "alert_id", "prediction", "patient"]
LEDGER = ("alert_id string, patient_id string, recorded_at string, feedback_label int, "
          "feedback_label_text string, is_true_positive boolean, reviewed_at string, reviewer string, "
          "notes string, prediction_json string, record_json string")
LEDGER_COLUMNS = [f.split()[0] for f in LEDGER.split(", ")]


def _text(fields: Fields, *names: str):
    """First alias that is neither null nor empty."""
    found = [F.col(f"`{n}`").cast("string") for n in names if n in fields.types]
    if not found:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(c != "", c) for c in found])


def normalize_feedback(df: DataFrame, strict: bool = False) -> DataFrame:
    """Payload rows as ledger rows; rows without a usable verdict get a null label.

    The record is the ``patient`` struct where there is one, else every column
    that is not feedback meta data, kept as JSON text with sorted keys.
    """
    fields = Fields(df)
    nested = isinstance(fields.types.get("patient"), T.StructType)
    flat = sorted(c for c in df.columns if c not in META)
    if nested:
        inner = sorted(fields.types["patient"].names)
        own = F.to_json(F.struct(*[F.col(f"patient.`{c}`").alias(c) for c in inner]))
        record = F.when(F.col("patient").isNotNull(), own)
        if flat:
            record = F.coalesce(record, F.to_json(F.struct(*[F.col(f"`{c}`") for c in flat])))
    elif flat:
        record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in flat]))
    else:
        raise ValueError("feedback needs a patient record")

    def of_record(name):
        return F.get_json_object("record_json", f"$.{name}")

    verdict = [F.col(c).cast("string") for c in ("is_true_positive", "feedback_label") if c in fields.types]
    if not verdict:
        raise ValueError("feedback needs is_true_positive or feedback_label")
    prediction = F.lit(None).cast("string")
    if "prediction" in fields.types:
        kind = fields.types["prediction"]
        prediction = F.col("prediction") if isinstance(kind, T.StringType) else F.to_json("prediction")
    label = feedback_label(F.coalesce(*verdict), strict)
    out = df.withColumn("record_json", record).withColumn("_label", label)
    alert = F.coalesce(
        *([F.col("alert_id").cast("string")] if "alert_id" in fields.types else []),
        of_record("alert_id"), of_record("patient_id"), of_record("record_id"), of_record("sample_id"))
    return out.select(
        alert.alias("alert_id"), of_record("patient_id").alias("patient_id"),
        of_record("recorded_at").alias("recorded_at"), F.col("_label").alias("feedback_label"),
        F.when(F.col("_label") == 1, "true_positive").when(F.col("_label") == 0, "false_positive")
        .alias("feedback_label_text"),
        (F.col("_label") == 1).alias("is_true_positive"),
        F.coalesce(_text(fields, "reviewed_at"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
        .alias("reviewed_at"),
        _text(fields, "reviewer", "clinician_id").alias("reviewer"),
        _text(fields, "notes", "feedback_notes", "comment").alias("notes"),
        prediction.alias("prediction_json"), F.col("record_json"))


def split_rejects(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ledger.where("feedback_label IS NOT NULL"), ledger.where("feedback_label IS NULL")


def feedback_rows(ledger: DataFrame, schema: T.StructType) -> DataFrame:
    """Records of the ledger as typed rows with their label."""
    kept = ledger.where(F.col("record_json").isNotNull() & (F.trim("record_json") != ""))
    return kept.select(F.from_json("record_json", schema).alias("_r"),
                       F.coalesce("feedback_label", F.lit(0)).alias("label")).select("_r.*", "label")


def retraining_rows(base: DataFrame, ledger: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Base rows as normal (0) plus the reviewed records with their label.

    A base row stays beside its reviewed copies. Where rows have an id, the
    reviewed ones get one of their own: text that no base row has, made from
    the content and the number of equal records before it.
    """
    reviewed = feedback_rows(ledger, schema or base.drop("label").schema)
    if ROW in base.columns:
        content = F.sha2(F.to_json(F.struct(*reviewed.columns)), 256)
        equal = Window.partitionBy("_content").orderBy("_content")
        reviewed = (reviewed.withColumn("_content", content).withColumn("_again", F.row_number().over(equal))
                    .withColumn(ROW, F.concat(F.lit("reviewed-"), F.col("_content"), F.lit("-"),
                                              F.col("_again").cast("string"))).drop("_content", "_again"))
        base = base.withColumn(ROW, F.col(ROW).cast("string"))
    return base.drop("label").withColumn("label", F.lit(0)).unionByName(reviewed, allowMissingColumns=True)

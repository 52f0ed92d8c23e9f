"""Split tables with a manifest, and the feedback ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions.cleaning import clean_frame
from wardlight.operators.feedback import LEDGER, LEDGER_COLUMNS, normalize_feedback
from wardlight.operators.split import with_split
from wardlight.sources.tabular import exists, load_encounters, read_csv, with_row_id


def save_splits(df: DataFrame, path: str) -> None:
    """Write ``df`` partitioned by its ``split`` column, plus a manifest of counts and columns."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    columns = [c for c in df.columns if c != "split"]
    (written.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
     .withColumns({"columns": F.array(*[F.lit(c) for c in columns]),
                   "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")})
     .coalesce(1).write.mode("overwrite").json(f"{path}/manifest"))


def load_splits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Train / validation / test frames; train must be there, the others may be missing.

    Reads a table partitioned by ``split`` or one sub-folder per split.
    """
    out = {}
    if exists(spark, f"{path}/data"):
        table = spark.read.parquet(f"{path}/data")
        present = {r["split"] for r in table.select("split").distinct().collect()}
        out = {n: table.where(F.col("split") == n).drop("split")
               for n in ("train", "validation", "test") if n in present}
    else:
        for n in ("train", "validation", "test"):
            if exists(spark, f"{path}/{n}"):
                out[n] = load_encounters(spark, f"{path}/{n}")
    if "train" not in out:
        raise ValueError(f"{path} holds no train split")
    return out


def prepare_splits(spark: SparkSession, source: str, target: str, **kwargs) -> None:
    """Load, split and save in one job."""
    save_splits(with_split(with_row_id(load_encounters(spark, source)), **kwargs), target)


def append_feedback(df: DataFrame, path: str, strict: bool = True) -> int:
    """Append normalised feedback to the JSON-lines ledger; returns the rows written."""
    rows = normalize_feedback(df, strict)
    seen = rows.count()
    rows.write.mode("append").json(path)
    return seen


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; raw payload lines are normalised on the way, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    raw = spark.read.json(path)
    if "record_json" not in raw.columns:
        return normalize_feedback(raw)
    typed = raw.select(*[
        (F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c)
        for c, t in (f.split() for f in LEDGER.split(", "))]).where("record_json IS NOT NULL")
    legacy = raw.where("record_json IS NULL")
    extra = [c for c in raw.columns if c in LEDGER_COLUMNS and c not in ("feedback_label", "is_true_positive",
             "alert_id", "reviewer", "notes", "reviewed_at", "patient_id", "recorded_at")]
    if legacy.isEmpty():
        return typed
    return typed.unionByName(normalize_feedback(legacy.drop(*extra)))


def load_lab_reports(spark: SparkSession, path: str) -> DataFrame:
    """Lab CSV files: wide rows when a header is a known field, else key / value pairs per file."""
    from wardlight.operators.labs import alias_rows, pivot_fields, resolve_fields

    raw = read_csv(spark, path)
    known = dict(alias_rows())
    fields = {c: known[c.strip().lower()] for c in raw.columns if c.strip().lower() in known}
    if fields:
        renamed = raw.withColumnsRenamed({c: f for c, f in fields.items() if c != f})
        return clean_frame(renamed, list(set(fields.values())))
    # Keys and values sit in the first two cells of each line, and the last value
    # given for a field wins. Multi-line mode keeps a report in one task, in order.
    pairs = (spark.read.option("header", False).option("multiLine", True).csv(path)
             .select(F.input_file_name().alias("report"), F.col("_c0").alias("key"), F.col("_c1").alias("value"),
                     F.monotonically_increasing_id().alias("_line")))
    return pivot_fields(resolve_fields(pairs), ["report"], order="_line")

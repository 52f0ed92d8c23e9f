"""Encounter tables in and out: CSV, Parquet, JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.cleaning import clean_frame


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names under ``path`` on whatever file system it lives."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header and quoted multi-line cells; every cell is text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def load_encounters(spark: SparkSession, path: str, numeric: list[str] | None = None) -> DataFrame:
    """Load and clean a CSV / Parquet file or folder.

    A folder prefers ``data.csv``, then ``data.parquet``, then all its CSV part
    files, then all its Parquet part files.
    """
    kind = re.sub(r".*\.", "", path.rstrip("/").lower()) if "." in path.rsplit("/", 1)[-1] else ""
    if kind == "csv":
        return clean_frame(read_csv(spark, path), numeric)
    if kind == "parquet":
        return clean_frame(spark.read.parquet(path), numeric)
    names = _files(spark, path)
    for name in ("data.csv", "data.parquet"):
        if name in names:
            return load_encounters(spark, f"{path}/{name}", numeric)
    if any(n.endswith(".csv") for n in names):
        return clean_frame(read_csv(spark, f"{path}/*.csv"), numeric)
    if any(n.endswith(".parquet") for n in names) or any("=" in n for n in names):
        return clean_frame(spark.read.parquet(path), numeric)
    raise ValueError(f"{path} holds no CSV or Parquet data")


def load_score_table(spark: SparkSession, path: str) -> DataFrame:
    """A score table in CSV, Parquet, JSON lines or a JSON array."""
    name = path.lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if name.endswith(".jsonl"):
        return spark.read.json(path)
    return spark.read.option("multiLine", True).json(path)


def flat_columns(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, for CSV."""
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def write_scored_csv(df: DataFrame, path: str) -> None:
    flat_columns(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON records, one per line (metrics tables, feature maps)."""
    df.write.mode("overwrite").json(path)


def with_row_id(df: DataFrame, row: str = "row_id") -> DataFrame:
    """A stable row id: ``encounter_id`` when it is unique, else a hash of the whole row.

    Identical rows are told apart by a number within their own copies, counted
    over (hash, salt) pieces so that no copy group lands in one task.
    """
    if row in df.columns:
        return df
    if "encounter_id" in df.columns:
        twice = df.groupBy("encounter_id").count().where("count > 1 OR encounter_id IS NULL")
        if twice.isEmpty():
            return df.withColumn(row, F.col("encounter_id"))
    key = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    marked = df.withColumn("_h", key)
    if marked.groupBy("_h").count().where("count > 1").isEmpty():
        return marked.withColumn(row, F.col("_h").cast("string")).drop("_h")
    # Copies are interchangeable, so any distinct suffix will do; the suffix is
    # frozen by writing it once.
    from wardlight.session import cut_lineage
    return cut_lineage(marked.withColumn(
        row, F.concat_ws("-", "_h", F.monotonically_increasing_id())).drop("_h"))


def load_labels(spark: SparkSession, path: str, column: str | None = None, on: str | None = None) -> DataFrame:
    """Labels from a separate file: the only column, or the named one, with its key if given."""
    raw = load_score_table(spark, path)
    names = raw.columns
    if column is None:
        rest = [c for c in names if c != on]
        if len(rest) != 1:
            raise ValueError("name the label column: the file has several")
        column = rest[0]
    if column not in names:
        raise ValueError(f"label column {column} is not in the file")
    return raw.select(*([on] if on else []), F.col(column).alias("label"))

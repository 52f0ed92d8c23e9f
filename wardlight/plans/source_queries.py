"""Registered queries over sources and sinks: given tables are written in a format, read back by the loader and reported."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlight.operators.evaluate import join_labels
from wardlight.operators.features import fit_features
from wardlight.operators.feedback import split_rejects
from wardlight.plans.evaluation_queries import rounded
from wardlight.plans.feature_queries import LINEAGE, SCALED
from wardlight.session import shared_dir
from wardlight.sources import splits, tabular
from wardlight.sources.standins import table, visits


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


def _encounters(spark, d):
    """Orders as raw encounter cells: padded numbers, words for missing values, a quoted note over two lines."""
    o = table(spark, d, "orders")
    kind = F.pmod("o_orderkey", F.lit(5))
    rate = (F.when(kind == 0, "  NaN ").when(kind == 1, "None").when(kind == 2, "fast")
            .otherwise(F.concat(F.lit("  "), F.format_string("%.2f", F.col("o_totalprice") / 1000), F.lit(" "))))
    return o.select(
        F.col("o_orderkey").cast("string").alias("encounter_id"), F.col("o_custkey").cast("string").alias("patient_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded_at"), rate.alias("heart_rate_bpm"),
        F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit('",\nthen left')).alias("notes"))


def csv_encounters(spark, d):
    """A folder of CSV parts, loaded and cleaned."""
    path = _folder(spark)
    tabular.write_scored_csv(_encounters(spark, d), path)
    out = tabular.load_encounters(spark, path)
    return rounded(out.select(F.col("encounter_id").cast("long").alias("encounter_id"), "patient_id",
                              F.date_format("recorded_at", "yyyy-MM-dd").alias("day"), "heart_rate_bpm", "notes"))


def score_tables(spark, d):
    """One score table as Parquet, CSV and JSON lines."""
    path, scores = _folder(spark), table(spark, d, "labels").select("doc_id", "quality", (F.col("doc_id") / 4).alias("risk_score"))
    scores.write.parquet(f"{path}/scores.parquet")
    scores.write.option("header", True).csv(f"{path}/scores.csv")
    tabular.write_records(scores, f"{path}/scores.jsonl")
    parts = [tabular.load_score_table(spark, f"{path}/scores.{k}").select(
        F.lit(k).alias("format"), F.col("doc_id").cast("long"), F.col("quality").cast("long"), F.col("risk_score").cast("double"))
        for k in ("parquet", "csv", "jsonl")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(every.groupBy("format").agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"),
                                               F.sum("quality").alias("good"), F.avg("risk_score").alias("mean_risk")))


def split_tables(spark, d):
    """Encounters loaded, split by patient, saved with a manifest and loaded again."""
    path = _folder(spark)
    _encounters(spark, d).write.parquet(f"{path}/raw.parquet")
    splits.prepare_splits(spark, f"{path}/raw.parquet", f"{path}/splits")
    found = splits.load_splits(spark, f"{path}/splits")
    rows = spark.read.json(f"{path}/splits/manifest").select("split", F.col("rows").alias("manifest_rows"))
    parts = [f.select(F.lit(n).alias("split"), "patient_id") for n, f in found.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sizes = every.groupBy("split").agg(F.countDistinct("patient_id").alias("patients"), F.count(F.lit(1)).alias("n"))
    return sizes.join(rows, "split").select(
        "split", "patients", (F.col("n") == F.col("manifest_rows")).alias("as_in_manifest"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all_rows"))  # three rows


def ledger_files(spark, d):
    """Reviews appended to the JSON-lines ledger in two rounds, loaded, and parted from those without a verdict."""
    path, c = _folder(spark), table(spark, d, "conversations")
    rows = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("alert_id"), F.col("conv_id").cast("string").alias("patient_id"),
        F.length("text").cast("double").alias("value"), F.lit("2026-06-01").alias("reviewed_at"),
        F.when(F.col("role") == "user", "TP").when(F.col("role") == "assistant", "no").otherwise("unsure").alias("feedback_label"))
    for half in (0, 1):
        splits.append_feedback(rows.where(F.pmod("patient_id", F.lit(2)) == half), path, strict=False)
    kept, rejects = split_rejects(splits.load_ledger(spark, path))

    def part(df, name):
        return df.select(F.lit(name).alias("part"), "feedback_label", F.get_json_object("record_json", "$.value").cast("double").alias("v"))

    return part(kept, "ledger").unionByName(part(rejects, "rejects")).groupBy("part", "feedback_label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("v").alias("total"))


def scored_csv(spark, d):
    """Arrays and structs as JSON text in CSV, and numbers read back."""
    e = table(spark, d, "embeddings").select(
        "vec_id", F.transform(F.slice("embedding", 1, 64), lambda v: F.round(v.cast("double"), 3)).alias("residuals"),
        F.struct(F.col("vec_id").alias("rank"), F.lit('a "quoted", name').alias("feature")).alias("top"))
    path = f"{_folder(spark)}/scored.csv"
    tabular.write_scored_csv(e, path)
    back = tabular.read_csv(spark, path)
    values = F.from_json("residuals", "array<double>")
    return rounded(back.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(values).alias("n"),
                               F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"),
                               F.get_json_object("top", "$.rank").cast("long").alias("rank"),
                               F.get_json_object("top", "$.feature").alias("feature")), digits=4)


def feature_map_file(spark, d):
    """The lineage of a fitted model as JSON records and back."""
    path = _folder(spark)
    tabular.write_records(fit_features(visits(spark, d), SCALED).feature_map_frame(spark), path)
    return spark.read.json(path).select(
        "final_feature", "feature_type", "provenance_depth", F.array_join("source_columns", ",").alias("source_columns"),
        F.array_join("transformation_path", ">").alias("transformation_path"))


def label_file(spark, d):
    """Labels from a keyed file of their own, joined to scores that must cover the same rows."""
    path, labels = _folder(spark), table(spark, d, "labels")
    labels.select("doc_id", "quality").write.option("header", True).csv(f"{path}/labels.csv")
    loaded = tabular.load_labels(spark, f"{path}/labels.csv", on="doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    scores = labels.select("doc_id", F.pmod("doc_id", F.lit(10)).alias("score"))
    return join_labels(scores, loaded, "doc_id", "label").groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("score").alias("total"))


def wide_lab_files(spark, d):
    """Lab tables with foreign headers, each known column renamed and read as numbers."""
    path, li = _folder(spark), table(spark, d, "lineitem")
    li.select(F.col("l_orderkey").cast("string").alias("report"), F.format_string(" %.1f ", F.col("l_quantity") * 2).alias("FBG"),
              F.when(F.col("l_linenumber") == 1, "null").otherwise(F.col("l_tax").cast("string")).alias(" Serum Creatinine ")
              ).write.option("header", True).csv(path)
    out = splits.load_lab_reports(spark, path)
    return rounded(out.groupBy(F.col("report").cast("long").alias("report")).agg(
        F.sum("fastingGlucose").alias("glucose"), F.count("creatinine").alias("measured"), F.sum("creatinine").alias("creatinine")))


QUERIES = {
    "a1_a3_csv_encounters": csv_encounters,
    "a2_score_tables": score_tables,
    "a5_a7_split_tables": split_tables,
    "a8_a9_ledger_files": ledger_files,
    "a10_scored_csv": scored_csv,
    "a11_a12_feature_map_file": feature_map_file,
    "a14_wide_lab_files": wide_lab_files,
    "a16_c1_label_file": label_file,
}

_CELL = "o_orderkey % 5"
_FORMAT = """SELECT '{f}' AS format, count(*) AS rows, sum(doc_id)::BIGINT AS ids, sum(quality)::BIGINT AS good,
       round(avg(doc_id / 4), 6) AS mean_risk FROM labels"""
ORACLE = {
    "a1_a3_csv_encounters": f"""
SELECT o_orderkey AS encounter_id, o_custkey::VARCHAR AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS day,
       CASE WHEN {_CELL} > 2 THEN round(o_totalprice / 1000, 2) END AS heart_rate_bpm,
       'said "' || o_orderpriority || '",' || chr(10) || 'then left' AS notes FROM orders""",
    "a2_score_tables": " UNION ALL ".join(_FORMAT.format(f=f) for f in ("parquet", "csv", "jsonl")),
    "a5_a7_split_tables": """
WITH n AS (SELECT count(DISTINCT o_custkey) AS n, count(*) AS rows FROM orders),
c AS (SELECT n, rows, greatest(1, round_even(n * 0.7, 0))::BIGINT AS a FROM n),
e AS (SELECT n, rows, a, least(n, greatest(a + 1, round_even(n * (0.7 + 0.15), 0)::BIGINT)) AS b FROM c)
SELECT 'train' AS split, a AS patients, true AS as_in_manifest, rows AS all_rows FROM e
UNION ALL SELECT 'validation', b - a, true, rows FROM e UNION ALL SELECT 'test', n - b, true, rows FROM e""",
    "a8_a9_ledger_files": """
SELECT CASE WHEN role IN ('user', 'assistant') THEN 'ledger' ELSE 'rejects' END AS part,
       CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS feedback_label, count(*) AS rows,
       sum(length(text))::DOUBLE AS total FROM conversations GROUP BY 1, 2""",
    "a10_scored_csv": """
SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding::DOUBLE[], lambda v: round(v, 3))), 4) AS total,
       vec_id AS rank, 'a "quoted", name' AS feature FROM embeddings""",
    "a11_a12_feature_map_file": LINEAGE,
    "a14_wide_lab_files": """
SELECT l_orderkey AS report, round(sum(l_quantity * 2), 6) AS glucose, count(*) FILTER (l_linenumber <> 1) AS measured,
       round(sum(l_tax) FILTER (l_linenumber <> 1), 6) AS creatinine FROM lineitem GROUP BY 1""",
    "a16_c1_label_file": """
SELECT quality::BIGINT AS label, count(*) AS rows, sum(doc_id % 10)::BIGINT AS total FROM labels GROUP BY 1""",
}

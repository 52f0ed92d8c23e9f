"""Explanations: ablation attributions, interactions, residual tables, projection, payload parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.operators.ranking import exact_quantiles
from wardlight.schema import ROW
from wardlight.session import broadcast_if_fits

METHOD = "ablation"


def ablation(df: DataFrame, features: list[str], background: dict[str, float],
             score: Callable[[DataFrame], DataFrame], output: str, row: str = ROW) -> DataFrame:
    """score(x) - score(x with one feature at its background mean), for every row and feature.

    Each row becomes one variant per feature plus itself, all scored in a single
    pass. Variants of a row are put side by side again by one grouping on the
    row id, so groups hold one row per feature.
    """
    d = len(features)
    variants = df.select(row, *features, F.explode(F.sequence(F.lit(-1), F.lit(d - 1))).alias("_j"))
    moved = variants.withColumns({
        f: F.when(F.col("_j") == i, F.lit(background[f])).otherwise(F.col(f)) for i, f in enumerate(features)})
    scored = score(moved.withColumn("_id", F.col(row))).select("_id", "_j", F.col(output).alias("_s"))
    whole = F.max(F.when(F.col("_j") == -1, F.col("_s")))
    kept = F.filter(F.collect_list(F.struct("_j", "_s")), lambda e: e["_j"] >= 0)
    per_row = scored.groupBy("_id").agg(whole.alias("_whole"), kept.alias("_v"))
    names = F.array(*[F.lit(f) for f in features])
    long = per_row.select(F.col("_id").alias(row), "_whole", F.explode("_v").alias("_e"))
    return long.select(row, F.element_at(names, F.col("_e._j") + 1).alias("feature"),
                       (F.col("_whole") - F.col("_e._s")).alias("attribution"))


def top_attributions(attributions: DataFrame, top_k: int, feature_map: DataFrame | None = None,
                     method: str = METHOD, row: str = ROW) -> DataFrame:
    """The strongest ``top_k`` attributions per row with the lineage of each feature."""
    w = Window.partitionBy(row).orderBy(F.desc("_a"), "feature")
    ranked = (attributions.withColumn("_a", F.abs("attribution"))
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k))
    if feature_map is not None:
        lineage = feature_map.select(F.col("final_feature").alias("feature"), "source_columns",
                                     "transformation_path", "provenance_depth", "feature_type")
        ranked = ranked.join(broadcast_if_fits(lineage), "feature", "left")
    return ranked.withColumnRenamed("_a", "absolute_attribution").withColumn("method", F.lit(method))


def nested_explanations(top: DataFrame, row: str = ROW) -> DataFrame:
    """One row per record with ``feature_explanations`` (array of structs, strongest first)."""
    item = F.struct(
        F.col("rank"), F.col("feature"), F.col("attribution").alias("shap_value"),
        F.col("absolute_attribution").alias("absolute_shap_value"), F.col("source_columns"),
        F.col("feature_type"), F.col("method"))
    return top.groupBy(row).agg(F.sort_array(F.collect_list(item)).alias("feature_explanations"))


def top_alerts(df: DataFrame, explanations: DataFrame, score: str = "anomaly_score", alerts: int = 5,
               features: int = 5, row: str = ROW) -> DataFrame:
    """The highest scored rows, each with its strongest features."""
    best = df.orderBy(F.desc(score), row).limit(alerts)
    kept = explanations.where(F.col("rank") <= features)
    return best.join(kept, row, "left")


def _deviations(df: DataFrame, features: list[str], background: dict[str, float], strength: Column | None,
                row: str) -> tuple[DataFrame, Column]:
    dev = F.array(*[F.col(f) - F.lit(background[f]) for f in features])
    held = df.select(row, dev.alias("_d"), (strength if strength is not None else F.lit(1.0)).alias("_scale"))
    peak = F.array_max(F.transform("_d", lambda v: F.abs(v)))
    return held.withColumn("_p", peak * peak), F.array(*[F.lit(f) for f in features])


def _pair_value(x: Column, y: Column) -> Column:
    return F.when(F.col("_p") > 0, x * y / F.col("_p")).otherwise(0.0) * F.greatest("_scale", F.lit(1e-6))


def interactions(df: DataFrame, features: list[str], background: dict[str, float], strength: Column | None = None,
                 row: str = ROW) -> DataFrame:
    """Outer product of the deviations from the background, normalised per row and scaled.

    Long form (row, feature_i, feature_j, value), i < j; the grid of one row is
    built from its own columns.
    """
    held, names = _deviations(df, features, background, strength, row)
    a = held.select(row, "_d", "_p", "_scale", F.posexplode("_d").alias("_i", "_x"))
    later = F.slice("_d", F.col("_i") + 2, F.greatest(F.size("_d") - F.col("_i") - 1, F.lit(0)))
    b = a.select(row, "_i", "_x", "_p", "_scale", F.posexplode(later).alias("_k", "_y"))
    value = _pair_value(F.col("_x"), F.col("_y"))
    return b.select(row, F.element_at(names, F.col("_i") + 1).alias("feature_i"),
                    F.element_at(names, F.col("_i") + F.col("_k") + 2).alias("feature_j"), value.alias("interaction_value"))


def top_interactions(df: DataFrame, features: list[str], background: dict[str, float], top_k: int,
                     strength: Column | None = None, row: str = ROW) -> DataFrame:
    """``top_pairs(interactions(...), top_k)``, but every pair of a row is ranked where the row is.

    Only ``top_k`` pairs a row are shuffled, to rank rows that share an id together.
    """
    held, names = _deviations(df, features, background, strength, row)

    def pair(v: Column, i: Column, k: Column) -> Column:
        # as in a descending order: NaN first, null last
        kind = F.when(v.isNull(), 2).when(F.isnan(v), 0).otherwise(1)
        size = F.when(kind == 1, -F.abs(v)).otherwise(0.0)
        return F.struct(kind.alias("kind"), size.alias("size"), names[i].alias("feature_i"),
                        names[i + k + 1].alias("feature_j"), v.alias("interaction_value"))

    def later(i: Column) -> Column:
        return F.slice("_d", i + 2, F.greatest(F.size("_d") - i - 1, F.lit(0)))

    # a value is worked out once, in a list of its own, and then described
    every = F.flatten(F.transform("_d", lambda x, i: F.transform(
        F.transform(later(i), lambda y: _pair_value(x, y)), lambda v, k: pair(v, i, k))))
    best = held.select(row, F.slice(F.sort_array(every), 1, top_k).alias("_t"))
    # The outer form keeps Spark from copying the whole array expression into a filter.
    long = best.select(row, F.explode_outer("_t").alias("_e")).where("_e IS NOT NULL")
    return top_pairs(long.select(row, "_e.feature_i", "_e.feature_j", "_e.interaction_value"), top_k, row)


def top_pairs(pairs: DataFrame, top_k: int, row: str = ROW) -> DataFrame:
    w = Window.partitionBy(row).orderBy(F.desc(F.abs("interaction_value")), "feature_i", "feature_j")
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
            .withColumn("absolute_interaction_value", F.abs("interaction_value")))


def symmetric_strength(matrix: DataFrame) -> DataFrame:
    """A supplied (feature_i, feature_j, value) matrix, symmetrised, with each feature's total strength."""
    v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")).otherwise(0.0)
    both = matrix.select("feature_i", "feature_j", (v * 0.5).alias("v")).union(
        matrix.select("feature_j", "feature_i", (v * 0.5).alias("v")))
    even = both.groupBy("feature_i", "feature_j").agg(F.sum("v").alias("interaction_value"))
    total = even.groupBy("feature_i").agg(F.sum(F.abs("interaction_value")).alias("interaction_strength"))
    return even.join(total, "feature_i")


def local_interactions(top: DataFrame, size: int = 8, row: str = ROW) -> DataFrame:
    """Interaction proxy over the ``size`` strongest features of each row.

    |value| = sqrt(ci * cj) * (0.35 + 0.55 * closeness of ranks); the sign says
    whether both push the same way. Contributions are scaled by the largest.
    """
    kept = top.where(F.col("rank") <= size)
    listed = kept.groupBy(row).agg(F.sort_array(F.collect_list(
        F.struct("rank", "feature", "attribution", "absolute_attribution"))).alias("_f"))
    n = F.size("_f")
    held = listed.withColumn("_n", n)
    a = held.select(row, "_f", "_n", F.posexplode("_f").alias("_i", "_a"))
    rest = F.slice("_f", F.col("_i") + 2, F.greatest(F.col("_n") - F.col("_i") - 1, F.lit(0)))
    b = a.select(row, "_n", "_i", "_a", F.posexplode(rest).alias("_k", "_b"))
    gap = (F.col("_k") + 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    size_ = F.sqrt(F.col("_a.absolute_attribution") * F.col("_b.absolute_attribution"))
    same = (F.col("_a.attribution") < 0) == (F.col("_b.attribution") < 0)
    value = F.when(same, 1.0).otherwise(-1.0) * size_ * (F.lit(0.35) + (F.lit(1.0) - gap) * 0.55)
    return b.select(row, F.col("_a.feature").alias("feature_i"), F.col("_b.feature").alias("feature_j"),
                    value.alias("interaction_value"))


def residual_table(df: DataFrame, residuals: dict[str, str], features: list[str], row: str = ROW) -> DataFrame:
    """Per row and model: mean and largest |residual| and the feature behind it."""
    names = F.array(*[F.lit(f) for f in features])
    parts = []
    for model, column in residuals.items():
        size = F.transform(column, lambda v: F.abs(v))
        peak = F.array_max(size)
        parts.append(F.struct(
            F.lit(model).alias("model"),
            (F.aggregate(size, F.lit(0.0), lambda a, v: a + v) / F.size(size)).alias("mean_abs_residual"),
            peak.alias("max_abs_residual"),
            F.element_at(names, F.array_position(size, peak).cast("int")).alias("top_feature")))
    return df.select(row, F.explode(F.array(*parts)).alias("_r")).select(row, "_r.*")


def projection(df: DataFrame, features: list[str], row: str = ROW, share: float = 0.8,
               keep: list[str] | None = None) -> DataFrame:
    """Two principal axes with distance from the centre and inside / outside of its ``share`` quantile."""
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    centred = df.select(row, *(keep or []), *[(F.col(f) - F.lit(means[f])).alias(f) for f in features])
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(centred)
    if len(features) < 2:
        held = rows.select(row, *(keep or []), F.col(features[0]).alias("x"), F.lit(0.0).alias("y"))
    else:
        model = PCA(k=2, inputCol="_x", outputCol="_y").fit(rows)
        out = model.transform(rows).withColumn("_p", vector_to_array("_y"))
        held = out.select(row, *(keep or []), F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))
    held = held.withColumn("distance", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    radius = exact_quantiles(held, "distance", {"r": share}).first()["r"]
    return held.withColumns({"boundary_radius": F.lit(radius), "inside": F.col("distance") <= F.lit(radius)})


def near_boundary(points: DataFrame, distance: str, radius: float) -> DataFrame:
    """Projected centre and mean radius of the rows whose latent distance is within 5 % of ``radius``."""
    near = points.where(F.abs(F.col(distance) - radius) <= max(0.05 * abs(radius), 1e-6)).withColumn("all", F.lit(1))
    centre = near.groupBy("all").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("points"))
    gap = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    return near.join(centre, "all").groupBy("cx", "cy", "points").agg(F.avg(gap).alias("boundary_radius"))


EXPLANATION = ("array<struct<feature:string,shap_value:double,absolute_shap_value:double,"
               "source_columns:array<string>,feature_type:string,method:string>>")


def parse_explanations(df: DataFrame, blob: str, row: str = ROW) -> DataFrame:
    """Explanation payload text as rows: a JSON list, a single object, or an object wrapping the list.

    Quotes of the other kind are accepted; a missing magnitude is taken from the value.
    """
    text = F.trim(F.col(blob))
    fixed = F.when(text.contains('"'), text).otherwise(F.regexp_replace(text, "'", '"'))
    wrapped = F.get_json_object(fixed, "$.feature_explanations")
    body = F.coalesce(wrapped, fixed)
    listed = F.when(body.startswith("["), body).when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]")))
    long = df.select(row, F.posexplode(F.from_json(listed, EXPLANATION)).alias("_p", "_e")).where("_e IS NOT NULL")
    value = F.coalesce(F.col("_e.shap_value"), F.lit(0.0))
    out = long.select(
        row, F.col("_e.feature").alias("feature"), value.alias("shap_value"),
        F.coalesce(F.col("_e.absolute_shap_value"), F.abs(value)).alias("absolute_shap_value"),
        F.coalesce(F.col("_e.source_columns"), F.array().cast("array<string>")).alias("source_columns"),
        F.col("_e.feature_type").alias("feature_type"), F.col("_e.method").alias("method"), "_p")
    w = Window.partitionBy(row).orderBy(F.desc("absolute_shap_value"), "_p")
    return out.withColumn("rank", F.row_number().over(w)).drop("_p")


def flatten_batch(df: DataFrame, results: str = "results") -> DataFrame:
    """Explain-batch payload rows (prediction and explanation structs) as one flat row per record."""
    long = df.select(F.explode(results).alias("_r"))
    fields = long.schema["_r"].dataType
    cols = [F.col("_r.patient_index").alias("patient_index")]
    if "prediction" in fields.names:
        cols += [F.col(f"_r.prediction.`{n}`").alias(n) for n in fields["prediction"].dataType.names]
    if "explanation" in fields.names:
        inner = fields["explanation"].dataType.names
        cols += [F.col(f"_r.explanation.{n}").alias(a) for n, a in (
            ("feature_explanations", "feature_explanations"), ("method", "explanation_method"),
            ("top_k", "explanation_top_k")) if n in inner]
    return long.select(*cols)

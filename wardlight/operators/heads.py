"""Point, contextual and collective anomaly heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.numeric import add_all, squash, usable_std
from wardlight.operators.ordered import PatientOrder
from wardlight.operators.ranking import exact_quantiles


def fit_baseline(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Population mean and usable std per feature: one map-side combined pass."""
    row = df.agg(*[e for f in features for e in (
        F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    out = {}
    for f in features:
        mean, std = row[f"m_{f}"], row[f"s_{f}"]
        out[f] = (mean if mean is not None else 0.0,
                  std if std is not None and std == std and std > 1e-12 else 1.0)
    return out


SCRATCH = ("_sizes", "_peak", "_at")


def with_peak(df: DataFrame, values: list[Column], names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Adds the values and their peak as scratch columns; returns also name and value of the first largest one.

    Every step reads columns of the step before: Spark would work out a whole expression at each of its places again,
    thirty times for a value below a condition.
    """
    held = [f"_v{i}" for i in range(len(values))]
    df = df.withColumns(dict(zip(held, values)))
    df = df.withColumn("_sizes", F.array(*[F.abs(F.col(c)) for c in held]))
    df = df.withColumn("_peak", F.array_max("_sizes"))
    at = F.array_position("_sizes", F.col("_peak")).cast("int")
    df = df.withColumn("_at", F.when(at > 0, at))
    return df, {"name": F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_at")),
                "value": F.element_at(F.array(*[F.col(c) for c in held]), F.col("_at"))}


def _summary(df: DataFrame, zs: dict[str, Column], prefix: str, keep_z: bool) -> tuple[DataFrame, dict[str, Column], list[str]]:
    df, top = with_peak(df, list(zs.values()), list(zs))
    there = F.filter("_sizes", lambda v: v.isNotNull())
    df = df.withColumn("_there", there)
    total = F.aggregate("_there", F.lit(0.0), lambda a, v: a + v)
    out = {
        f"{prefix}_anomaly_score": squash(F.col("_peak")),
        f"{prefix}_anomaly_max_abs_zscore": F.col("_peak"),
        f"{prefix}_anomaly_mean_abs_zscore": total / F.when(F.size("_there") > 0, F.size("_there")),
        f"{prefix}_anomaly_top_feature": top["name"],
        f"{prefix}_anomaly_top_feature_zscore": top["value"],
    }
    if keep_z:
        out.update({f"{prefix}_zscore__{f}": F.col(f"_v{i}") for i, f in enumerate(zs)})
    return df, out, [*SCRATCH, "_there", *[f"_v{i}" for i in range(len(zs))]]


def score_point(df: DataFrame, baseline: dict[str, tuple[float, float]], keep_z: bool = False) -> DataFrame:
    """Deviation from the population baseline; row-wise, no shuffle."""
    zs = {f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in baseline.items()}
    out, cols, scratch = _summary(df, zs, "point", keep_z)
    return out.withColumns(cols).drop(*scratch)


def score_contextual(order: PatientOrder, features: list[str], keep_z: bool = False) -> PatientOrder:
    """Deviation from the patient's own earlier visits (never the current or a later one)."""
    seen = order.position("_seen").prior_moments(features)
    history = F.coalesce(F.col("_seen"), F.lit(0))
    zs = {
        f: (F.col(f) - F.col(f"{f}_prior_mean")) / usable_std(F.col(f"{f}_prior_std"))
        for f in features
    }
    df, cols, held = _summary(seen.df.withColumn("_history", history), zs, "contextual", keep_z)
    blank = {k: F.lit("") if k.endswith("top_feature") else F.lit(0.0) for k in cols}
    df = df.withColumns({
        k: F.when(F.col("_history") > 0, v).otherwise(blank[k]) for k, v in cols.items()})
    df = df.withColumn("contextual_anomaly_history_length", F.col("_history"))
    scratch = ["_history", *held] + [f"{f}_prior_{s}" for f in features for s in ("n", "mean", "std")]
    return seen.replace(df.drop("_seen", *scratch))


def group_slug(name: str) -> str:
    """Group names as column suffixes: runs of other characters become one ``_``."""
    cleaned = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in str(name))
    return "_".join(cleaned.split()) or "group"


def slug_column(c: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(trimmed == "", F.lit("group")).otherwise(trimmed)


def collective_groups(feature_map: list[dict]) -> dict[str, list[str]]:
    """Feature groups from the lineage spec: derived or multi-source features by origin."""
    groups: dict[str, list[str]] = {}
    for entry in feature_map:
        sources = entry["source_columns"]
        if entry["feature_type"] != "direct" or len(sources) > 1:
            name = f"{entry['feature_type']}:{'|'.join(sorted(sources))}"
            groups.setdefault(name, []).append(entry["final_feature"])
    if not groups:
        groups["all_features"] = [e["final_feature"] for e in feature_map]
    return groups


def score_collective(df: DataFrame, groups: dict[str, list[str]], residual: str | None = None,
                     features: list[str] | None = None) -> DataFrame:
    """Root mean square error per feature group, row-wise.

    ``residual`` is an array column with one residual for each of ``features``;
    without it the transformed values themselves are used.
    """
    at = {f: i for i, f in enumerate(features or [])}
    value_of = lambda f: F.col(residual)[at[f]] if residual else F.col(f)
    errors = {
        group_slug(g): F.sqrt(add_all([value_of(f) * value_of(f) for f in fs]) / F.lit(float(len(fs))))
        for g, fs in groups.items()
    }
    out, top = with_peak(df, list(errors.values()), list(errors))
    out = out.withColumn("_value", top["value"])
    return out.withColumns({
        **{f"collective_group_error__{g}": F.col(f"_v{i}") for i, g in enumerate(errors)},
        "collective_anomaly_score": squash(F.col("_value")),
        "collective_anomaly_top_group": top["name"],
        "collective_anomaly_top_group_error": F.col("_value"),
    }).drop("_value", *SCRATCH, *[f"_v{i}" for i in range(len(errors))])


def head_summary(df: DataFrame, score: str) -> DataFrame:
    """Training summary of a head: rows, mean, max and exact p95 of its score."""
    stats = df.agg(F.count(score).alias("training_row_count"), F.avg(score).alias("score_mean"),
                   F.max(score).alias("score_max")).withColumn("head", F.lit(score))
    p95 = exact_quantiles(df, score, {"score_p95": 0.95}).withColumn("head", F.lit(score))
    return stats.join(p95, "head")

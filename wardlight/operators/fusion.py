"""Component scaling, score fusion, thresholds and decisions."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.numeric import add_all, clamp01
from wardlight.operators.ranking import exact_quantiles
from wardlight.session import cut_lineage

# Default fusion weight per detector, before normalising.
DEFAULT_WEIGHTS = {
    "isolation_forest": 0.3, "one_class_svm": 0.0, "local_outlier_factor": 0.0,
    "autoencoder": 0.4, "variational_autoencoder": 0.1, "ganomaly": 0.1,
    "anomaly_transformer": 0.1, "cnn_autoencoder": 0.1, "deep_svdd": 0.3,
}


def fit_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Min and max per component in one pass."""
    row = df.agg(*[e for c in columns for e in (F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))]).first()
    return {c: (row[f"l_{c}"] or 0.0, row[f"h_{c}"] or 0.0) for c in columns}


def scale_components(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None,
                     columns: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Clip each component into [0, 1] by its range; a flat component scales to 0.

    Pass fitted ``ranges`` to score; ``ranges=None`` takes them from this batch.
    """
    if ranges is None:
        ranges = fit_ranges(df, columns)
    names = names or {}
    return df.withColumns({
        names.get(c, c): clamp01((F.col(c) - F.lit(lo)) / F.lit(hi - lo)) if hi > lo
        else F.when(F.col(c).isNotNull(), F.lit(0.0))
        for c, (lo, hi) in ranges.items()})


def resolve_weights(components: list[str], weights: dict[str, float] | None = None,
                    normalize: bool = True) -> dict[str, float]:
    given = DEFAULT_WEIGHTS if weights is None else weights
    raw = {c: float(given.get(c, 0.0)) for c in components}
    total = sum(raw.values())
    if not total > 0.0:
        return {c: 1.0 / len(components) for c in components}
    if weights is None and not normalize:
        return raw
    return {c: w / total for c, w in raw.items()}


def weighted_average(weights: dict[str, float], column=lambda c: F.col(c)) -> Column:
    return add_all([F.lit(w) * column(c) for c, w in weights.items()])


def weighted_available(weights: dict[str, float], available: list[str]) -> Column:
    """Weights renormalised over the detectors present in this deployment."""
    return weighted_average(resolve_weights(available, {c: weights.get(c, 0.0) for c in available}))


def max_vote(columns: list[str]) -> Column:
    return F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])


def fit_stacking(df: DataFrame, components: list[str], label: str, kind: str = "mlp", seed: int = 42):
    """Supervised fusion on the component scores."""
    if len(components) < 2:
        raise ValueError("stacking needs at least two component scores")
    rows = VectorAssembler(inputCols=components, outputCol="_components").transform(
        df.select(*components, F.col(label).cast("double").alias("label")))
    if kind == "mlp":
        model = MultilayerPerceptronClassifier(
            featuresCol="_components", layers=[len(components), 32, 16, 2], maxIter=200, seed=seed)
    elif kind in ("gbt", "xgboost"):
        return _boosted(rows, components, GBTClassifier(featuresCol="_components", maxIter=40, maxDepth=3, seed=seed))
    else:
        raise ValueError("stacking model must be 'mlp' or 'gbt'")
    return model.fit(rows)


def _split_candidates(rows: DataFrame, trees: GBTClassifier) -> list[list[float]]:
    """The thresholds between which the trees may choose for each feature: MLlib's own, from its own sample of the rows."""
    jvm = rows.sparkSession._jvm
    impl = jvm.org.apache.spark.ml.tree.impl
    trees._transfer_params_to_java()
    utils = getattr(jvm.org.apache.spark.ml.util, "DatasetUtils$")
    instances = getattr(utils, "MODULE$").extractInstances(trees._java_obj, rows._jdf, jvm.scala.Some(2))
    strategy = jvm.org.apache.spark.mllib.tree.configuration.Strategy.defaultStrategy("Regression")
    strategy.setMaxBins(trees.getMaxBins())
    metadata = impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, trees.getFeatureSubsetStrategy())
    forest = getattr(getattr(impl, "RandomForest$"), "MODULE$")
    return [[split.threshold() for split in feature] for feature in forest.findSplits(instances, metadata, trees.getSeed())]


def _boosted(rows: DataFrame, components: list[str], trees: GBTClassifier) -> PipelineModel:
    """Boosted trees, fitted on the counts of equal rows.

    A tree sees a component only through the bin between two split candidates, so rows of equal bins and labels are one
    row with their number as weight: two passes over the rows, whatever the number of trees and levels.
    """
    names = [f"_bin{i}" for i in range(len(components))]
    # a value at a threshold goes left with those below, in the trees; a bucket ends before its upper bound
    bounds = [[-math.inf, *([math.nextafter(t, math.inf) for t in cuts] or [0.0]), math.inf]
              for cuts in _split_candidates(rows, trees)]
    bins = Bucketizer(splitsArray=bounds, inputCols=components, outputCols=names)
    vector = VectorAssembler(inputCols=names, outputCol="_components")
    plain = [(F.col(n) + F.lit(0.0)).alias(n) for n in names]  # numbers, where bins would be categories
    counted = cut_lineage(bins.transform(rows).select("label", *plain).groupBy("label", *names).agg(
        F.count(F.lit(1)).cast("double").alias("_rows")))
    # enough bins that MLlib takes the candidates from all of these rows: each of them lies between two bins
    most = max(trees.getMaxBins(), math.isqrt(counted.count()) + 1)
    fitted = trees.copy({trees.maxBins: most, trees.weightCol: "_rows"}).fit(vector.transform(counted))
    return PipelineModel([bins, vector, fitted])


def apply_stacking(df: DataFrame, model, components: list[str], output: str) -> DataFrame:
    if isinstance(model, PipelineModel):  # with its own bins of the components
        scored = model.transform(df).drop(*model.stages[0].getOutputCols())
    else:
        scored = model.transform(VectorAssembler(inputCols=components, outputCol="_components").transform(df))
    extra = [c for c in ("rawPrediction", "prediction", "probability", "_components") if c in scored.columns]
    return scored.withColumn(output, vector_to_array("probability")[1]).drop(*extra)


def gate_targets(df: DataFrame, components: list[str], label: str | None = None) -> DataFrame:
    """Soft expert targets: agreement with the label, or deviation from the consensus.

    Rows where no expert stands out fall back to equal shares. Adds ``_gate`` (array).
    """
    if label is None:
        consensus = add_all([F.col(c) for c in components]) / F.lit(float(len(components)))
        raw = [F.abs(F.col(c) - consensus) for c in components]
    else:
        y = F.col(label).cast("double")
        raw = [F.when(y >= 0.5, F.col(c)).otherwise(F.lit(1.0) - F.col(c)) for c in components]
    raw = [F.greatest(r, F.lit(0.0)) for r in raw]
    total = add_all(raw)
    even = F.lit(1.0 / len(components))
    return df.withColumn("_gate", F.array(*[F.when(total > 1e-12, r / total).otherwise(even) for r in raw]))


def fit_gate(df: DataFrame, features: list[str], components: list[str], label: str | None = None):
    """Gate over experts: each row counts once per expert, weighted by its target share."""
    targets = gate_targets(df, components, label)
    rows = targets.select(*features, F.posexplode("_gate").alias("_expert", "_share")).where("_share > 0")
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(
        rows.withColumn("label", F.col("_expert").cast("double")))
    return LogisticRegression(
        featuresCol="_x", weightCol="_share", family="multinomial", regParam=1e-5, maxIter=50).fit(rows)


def mean_of_available(values: list[Column]) -> Column:
    """The mean of those that are there; null where none is."""
    held = F.array_compact(F.array(*values))
    return F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.when(F.size(held) > 0, F.size(held))


def apply_gate(df: DataFrame, model, features: list[str], components: list[str], output: str,
               available: list[str] | None = None) -> DataFrame:
    """Adds ``<component>_gate_weight`` (summing to 1 over the available ones) and the fused score."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    scored = model.transform(rows).withColumn("_w", vector_to_array("probability"))
    known = model.numClasses
    weights = {c: (F.col("_w")[i] if i < known else F.lit(0.0)) for i, c in enumerate(components)}
    if available is not None and len(available) < len(components):
        total = add_all([weights[c] for c in available])
        even = F.lit(1.0 / len(available))
        weights = {c: F.when(total > 1e-12, weights[c] / total).otherwise(even) for c in available}
    out = scored.withColumns({
        **{f"{c}_gate_weight": w for c, w in weights.items()},
        output: add_all([F.col(c) * w for c, w in weights.items()])})
    return out.drop("_x", "_w", "rawPrediction", "probability", "prediction")


def contamination_threshold(df: DataFrame, score: str, contamination: float) -> float:
    """Exact upper quantile of the training scores."""
    row = exact_quantiles(df, score, {"q": 1.0 - contamination}).first()
    return float(row["q"])


def decide(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Margin and flag; a score exactly at the threshold is anomalous."""
    hit = F.col(score) >= F.lit(threshold)
    return df.withColumns({
        "decision_margin": F.lit(threshold) - F.col(score),
        "anomaly_flag": F.when(hit, F.lit(-1)).otherwise(F.lit(1)),
        "is_anomaly": F.coalesce(hit, F.lit(False)),
    })


def blend_sequence(raw: Column, sequence: Column, mean: float, std: float, weight: float = 0.25) -> Column:
    """Mix the tabular score with the sequence error, squashed by the fitted spread."""
    w = min(max(weight, 0.0), 1.0)
    spread = std if std and std > 0 else 1.0
    unit = F.lit(1.0) / (F.lit(1.0) + F.exp(-(sequence - F.lit(mean)) / F.lit(spread)))
    return F.lit(1.0 - w) * raw + F.lit(w) * unit

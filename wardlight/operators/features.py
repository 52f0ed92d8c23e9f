"""Feature preparation: engineered history, expansion, imputation, scaling, encoding, PCA, lineage."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators.history import longitudinal_features
from wardlight.operators.nearest import impute_nearest
from wardlight.operators.ordered import PatientOrder
from wardlight.schema import KEY, ROW, TIME, Settings
from wardlight.session import broadcast_if_fits, collect_bounded, cut_lineage

#: Values of one column that become columns of their own; a column with more is coded by frequency.
MAX_VOCABULARY = 5_000


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, v, n): how often each value of each categorical column occurs, however many there are."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "c", "v")
    return long.where("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))


def frequency_codes(counts: DataFrame) -> DataFrame:
    """(c, v, code): the surprise of each value, -ln of its share of the column. A value never seen counts half a row."""
    total = counts.groupBy("c").agg(F.sum("n").alias("all"))
    return (counts.join(F.broadcast(total), "c")  # one row a column
            .select("c", "v", (-F.log(F.col("n") / F.col("all"))).alias("code")))


def with_codes(df: DataFrame, codes: DataFrame, columns: dict[str, tuple[str | None, float]]) -> DataFrame:
    """Add ``<c>_surprise`` for every column of ``columns``: (value that fills gaps, code of a value never seen)."""
    for c, (fill, unseen) in columns.items():
        known = codes.where(F.col("c") == c).select(F.col("v").alias("_v"), F.col("code").alias("_code"))
        held = F.coalesce(F.col(c).cast("string"), F.lit(fill)) if c in df.columns else F.lit(fill).cast("string")
        df = (df.withColumn("_v", held).join(broadcast_if_fits(known), "_v", "left")
              .withColumn(f"{c}_surprise", F.coalesce("_code", F.lit(unseen))).drop("_v", "_code"))
    return df


def learn_vocabulary(df: DataFrame, column: str) -> list[str]:
    """Distinct tokens of a list column, sorted. Each becomes a column, hence the bound."""
    tokens = df.select(F.explode(column).alias("t")).where("t IS NOT NULL").distinct()
    return sorted(r["t"] for r in collect_bounded(tokens, MAX_VOCABULARY))


def category_domains(df: DataFrame, columns: list[str]) -> dict[str, tuple[str | None, list[str]]]:
    """Mode (ties to the smallest) and sorted categories for every column, in one pass."""
    if not columns:
        return {}
    counts = collect_bounded(value_counts(df, columns), MAX_VOCABULARY * len(columns))
    out: dict[str, tuple[str | None, list[str]]] = {}
    for c in columns:
        mine = sorted((r["v"], r["n"]) for r in counts if r["c"] == c)
        mode = min(mine, key=lambda p: (-p[1], p[0]))[0] if mine else None
        out[c] = (mode, [v for v, _ in mine])
    return out


def indicator_columns(column: str, tokens: list[str]) -> dict[str, Column]:
    held = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return {f"{column}__{t}": F.array_contains(held, t).cast("double") for t in tokens}


def list_summary(column: str) -> dict[str, Column]:
    """Mean, population std, last and count of a numeric list; an empty list gives nulls and 0."""
    x = F.filter(F.coalesce(F.col(column), F.array().cast("array<double>")), lambda v: v.isNotNull() & ~F.isnan(v))
    n = F.size(x)
    some = F.when(n > 0, n)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / some
    square = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    return {
        f"{column}_mean": mean, f"{column}_std": F.sqrt(square / some),
        f"{column}_last": F.try_element_at(x, F.lit(-1)), f"{column}_count": n.cast("double"),
    }


def one_hot(column: str, categories: list[str], fill: str | None) -> dict[str, Column]:
    held = F.coalesce(F.col(column).cast("string"), F.lit(fill))
    return {f"{column}_{v}": F.coalesce((held == v).cast("double"), F.lit(0.0)) for v in categories}


def scale_stats(df: DataFrame, columns: list[str], kind: str) -> dict[str, tuple[float, float]]:
    """(centre, width) per column: population mean / std, or min / range."""
    if kind == "standard":
        pairs = [(F.avg(c), F.stddev_pop(c)) for c in columns]
    elif kind == "minmax":
        pairs = [(F.min(c), F.max(c) - F.min(c)) for c in columns]
    else:
        raise ValueError("scaler must be 'standard' or 'minmax'")
    row = df.agg(*[e.alias(f"{p}{i}") for i, pair in enumerate(pairs) for p, e in zip("cw", pair)]).first()
    out = {}
    for i, c in enumerate(columns):
        centre, width = row[f"c{i}"] or 0.0, row[f"w{i}"]
        out[c] = (centre, width if width and width > 1e-12 else 1.0)
    return out


@dataclass
class FeatureModel:
    """Everything learnt at fit: plain values, plus the donor table and the projection."""

    settings: Settings
    numeric: list[str] = field(default_factory=list)
    engineered_from: dict[str, list[str]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    vocabularies: dict[str, list[str]] = field(default_factory=dict)
    domains: dict[str, tuple[str | None, list[str]]] = field(default_factory=dict)
    list_columns: list[str] = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    donors: DataFrame | None = None
    coded: dict[str, tuple[str | None, float]] = field(default_factory=dict)
    codes: DataFrame | None = None
    pca: PCAModel | None = None
    pca_columns: int = 0

    @property
    def plain_names(self) -> list[str]:
        return self.numeric + [f"{c}_{v}" for c, (_, vs) in self.domains.items() for v in vs]

    @property
    def names(self) -> list[str]:
        return [f"pca_{i + 1}" for i in range(self.pca_columns)] if self.pca else self.plain_names

    def engineer(self, df: DataFrame, hot=True) -> DataFrame:
        """Raw history, list and token columns, before imputation."""
        s = self.settings
        have = set(df.columns)
        base = [c for c in s.numeric_features if c in have]
        order = PatientOrder(df, hot=hot)
        out = longitudinal_features(order, base, s.rolling_windows_days, s.lag_steps, s.interaction_terms).done()
        if self.coded:
            out = with_codes(out, self.codes, self.coded)
        extra: dict[str, Column] = {}
        for c in self.list_columns:
            extra.update(list_summary(c) if c in have else {
                f"{c}_{k}": F.lit(None).cast("double") for k in ("mean", "std", "last", "count")})
        for c, tokens in self.vocabularies.items():
            extra.update(indicator_columns(c, tokens) if c in have else {f"{c}__{t}": F.lit(0.0) for t in tokens})
        missing = {c: F.lit(None).cast("double") for c in self.numeric if c not in set(out.columns) | set(extra)}
        return out.withColumns({**extra, **missing}) if extra or missing else out

    def impute(self, engineered: DataFrame) -> DataFrame:
        s = self.settings
        if s.imputer == "knn" and self.donors is not None:
            return impute_nearest(engineered, self.donors, self.numeric, self.means, s.knn_neighbors, ROW)
        return engineered.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in self.means.items()})

    def finish(self, filled: DataFrame, keep: list[str]) -> DataFrame:
        """Scale, encode and (when fitted) project."""
        cols = {c: (F.col(c) - F.lit(m)) / F.lit(w) for c, (m, w) in self.scales.items()}
        for c, (mode, categories) in self.domains.items():
            if c in filled.columns:
                cols.update(one_hot(c, categories, mode))
            else:
                cols.update({f"{c}_{v}": F.lit(1.0 if v == mode else 0.0) for v in categories})
        out = filled.select(*keep, *[cols[n].alias(n) for n in self.plain_names])
        if self.pca is None:
            return out
        rows = VectorAssembler(inputCols=self.plain_names, outputCol="_x").transform(out)
        held = self.pca.transform(rows).withColumn("_p", vector_to_array("_y"))
        return held.select(*keep, *[F.col("_p")[i].alias(f"pca_{i + 1}") for i in range(self.pca_columns)])

    def transform(self, df: DataFrame, keep: list[str] | None = None, hot=True) -> DataFrame:
        keep = keep or [c for c in (ROW, KEY, TIME) if c in df.columns]
        return self.finish(self.impute(self.engineer(df, hot)), keep)

    def feature_map(self) -> list[dict]:
        """Lineage of every final feature, read off the fitted spec itself."""
        rows = []
        for c in self.numeric:
            kind = self.kinds[c]
            path = {"direct": ["raw"], "engineered_time_series": ["raw", "time_series_engineer"],
                    "expanded_multi_value": ["raw", "multi_value_expand"],
                    "frequency_encoded": ["raw", "frequency_encode"]}[kind]
            sources = self.engineered_from[c]
            rows.append(_lineage(c, c if kind != "expanded_multi_value" else sources[0], sources, path, kind))
        for c, (_, categories) in self.domains.items():
            rows += [_lineage(f"{c}_{v}", c, [c], ["raw", "one_hot_encode"], "one_hot") for v in categories]
        if self.pca is None:
            return rows
        sources = list(dict.fromkeys(s for r in rows for s in r["source_columns"]))
        text = ", ".join(self.plain_names)
        return [_lineage(n, text, sources, ["raw", "scaling", "pca"], "pca_component") for n in self.names]

    def feature_map_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [tuple(r[k] for k in MAP_COLUMNS) for r in self.feature_map()],
            "final_feature string, source_features string, source_columns array<string>, "
            "transformation_path array<string>, provenance_depth int, feature_type string")


MAP_COLUMNS = ["final_feature", "source_features", "source_columns", "transformation_path",
               "provenance_depth", "feature_type"]


def _lineage(name, source, columns, path, kind) -> dict:
    return dict(zip(MAP_COLUMNS, (name, source, columns, path, len(path), kind)))


def _fit_codes(m: FeatureModel, df: DataFrame, categories: list[str]) -> list[str]:
    """Code the columns with more values than columns can be made of; returns the others."""
    counts = cut_lineage(value_counts(df, categories))
    sizes = {r["c"]: r for r in counts.groupBy("c").agg(
        F.count(F.lit(1)).alias("values"), F.sum("n").alias("all")).collect()}  # one row a column
    many = [c for c in categories if c in sizes and sizes[c]["values"] > MAX_VOCABULARY]
    if many:
        most = counts.where(F.col("c").isin(many)).groupBy("c", "n").agg(F.min("v").alias("v"))
        modes = {r["c"]: r["v"] for r in most.groupBy("c").agg(F.max_by("v", "n").alias("v")).collect()}
        m.codes = cut_lineage(frequency_codes(counts.where(F.col("c").isin(many))))
        for c in many:
            m.coded[c] = (modes[c], math.log(2.0 * sizes[c]["all"]))
            m.kinds[f"{c}_surprise"], m.engineered_from[f"{c}_surprise"] = "frequency_encoded", [c]
    return [c for c in categories if c not in many]


def fit_features(df: DataFrame, settings: Settings | None = None, hot=True) -> FeatureModel:
    s = settings or Settings()
    have = dict(df.dtypes)
    m = FeatureModel(s)
    base = [c for c in s.numeric_features if c in have]
    for c in base:
        m.kinds[c], m.engineered_from[c] = "direct", [c]
    for c in base:
        made = [f"{c}_{k}_{d}d" for d in s.rolling_windows_days for k in ("mean", "std")]
        made += [f"{c}_lag{k}" for k in s.lag_steps]
        for name in made:
            m.kinds[name], m.engineered_from[name] = "engineered_time_series", [KEY, TIME, c]
    for a, b in s.interaction_terms:
        if a in have and b in have:
            m.kinds[f"{a}_x_{b}"], m.engineered_from[f"{a}_x_{b}"] = "direct", [a, b]
    for c in s.list_numeric_features:
        if c in have:
            m.list_columns.append(c)
            for k in ("mean", "std", "last", "count"):
                m.kinds[f"{c}_{k}"], m.engineered_from[f"{c}_{k}"] = "direct", [c]
    for c in s.multi_value_features:
        if c in have:
            m.vocabularies[c] = learn_vocabulary(df, c)
            for t in m.vocabularies[c]:
                m.kinds[f"{c}__{t}"], m.engineered_from[f"{c}__{t}"] = "expanded_multi_value", [c]
    categories = [c for c in s.categorical_features if c in have]
    wide = _fit_codes(m, df, categories) if categories else []
    m.numeric = list(m.kinds)
    m.domains = category_domains(df, wide)

    raw = m.engineer(df, hot).persist()
    stats = raw.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(m.numeric)]).first()
    m.means = {c: (stats[f"m{i}"] if stats[f"m{i}"] is not None else 0.0) for i, c in enumerate(m.numeric)}
    if s.imputer == "knn":
        m.donors = raw.select(ROW, *m.numeric)
    filled = m.impute(raw)
    m.scales = scale_stats(filled, m.numeric, s.scaler)
    if s.apply_pca and len(m.numeric) + len(m.domains) > s.pca_feature_threshold:
        m.pca, m.pca_columns = fit_projection(m.finish(filled, [ROW]), m.plain_names, s.pca_variance_threshold)
    return m


def fit_projection(df: DataFrame, columns: list[str], share: float) -> tuple[PCAModel, int]:
    """Principal axes and how many reach a cumulative variance above ``share``."""
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(df)
    model = PCA(k=len(columns), inputCol="_x", outputCol="_y").fit(rows)
    total, keep = 0.0, 0
    for ratio in model.explainedVariance.toArray():
        total, keep = total + float(ratio), keep + 1
        if total > share:
            break
    return model, keep


def raw_against_scaled(df: DataFrame, model: FeatureModel, row: str = ROW) -> DataFrame:
    """Long view: each feature's filled value, scaled value and how it was scaled."""
    filled = model.impute(model.engineer(df))
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("raw_value"),
                      ((F.col(c) - F.lit(m)) / F.lit(w)).alias("scaled_value")) for c, (m, w) in model.scales.items()]
    return filled.select(row, F.explode(F.array(*parts)).alias("_e")).select(row, "_e.*")


def encoded_view(df: DataFrame, model: FeatureModel, row: str = ROW) -> DataFrame:
    """Long view of one-hot and token features: source, value, active or not."""
    cols: dict[str, tuple[str, Column]] = {}
    for c, (mode, categories) in model.domains.items():
        cols.update({k: (c, v) for k, v in one_hot(c, categories, mode).items()})
    for c, tokens in model.vocabularies.items():
        cols.update({k: (c, v) for k, v in indicator_columns(c, tokens).items()})
    parts = [F.struct(F.lit(k).alias("feature"), F.lit(c).alias("source"), v.alias("value"),
                      F.when(v > 0, "active").otherwise("inactive").alias("state")) for k, (c, v) in cols.items()]
    return df.select(row, F.explode(F.array(*parts)).alias("_e")).select(row, "_e.*")

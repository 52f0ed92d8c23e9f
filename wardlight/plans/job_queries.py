"""Registered queries for the composed jobs and the explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators.detectors import fit_detector
from wardlight.operators import explain
from wardlight.operators.heads import fit_baseline, score_collective, score_point
from wardlight.plans.evaluation_queries import rounded
from wardlight.plans.history_queries import VISITS, _Z
from wardlight.plans.jobs import score, train
from wardlight.plans.model_queries import DIMS, vectors
from wardlight.schema import Settings
from wardlight.sources.standins import table, visits

SMALL = Settings(numeric_features=["value", "k"], categorical_features=["source_type"], multi_value_features=[],
                 list_numeric_features=[], rolling_windows_days=(7,), imputer="mean", apply_pca=False,
                 detectors=("isolation_forest", "pca_reconstruction"),
                 fusion_weights={"isolation_forest": 0.5, "pca_reconstruction": 0.5})


def full_scoring(spark, d):
    df = visits(spark, d)
    model = train(df, SMALL)
    out = score(df, model)
    return rounded(out.select(
        "row_id", "anomaly_score", "is_anomaly", "point_anomaly_score", "contextual_anomaly_score",
        "collective_anomaly_score", "conformal_p_value", "score_stream_drift_method", "risk_score", "risk_level"))


def _point_score(baseline):
    return lambda df: score_point(df, baseline)


def _background(df, features):
    row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return {f: row[f] for f in features}


def ablation(spark, d):
    df = visits(spark, d)
    names = ["value", "k"]
    out = explain.ablation(df, names, _background(df, names), _point_score(fit_baseline(df, names)),
                           "point_anomaly_score")
    return rounded(out)


def attribution_top(spark, d):
    df = visits(spark, d)
    names = ["value", "k"]
    base = explain.ablation(df, names, _background(df, names), _point_score(fit_baseline(df, names)),
                            "point_anomaly_score")
    return rounded(explain.top_attributions(base, 1).select("row_id", "feature", "attribution", "rank"))


def pair_interactions(spark, d):
    df = vectors(spark, d)
    pairs = explain.top_interactions(df, DIMS, _background(df, DIMS), 3)
    return rounded(pairs.select("row_id", "feature_i", "feature_j", "interaction_value", "rank"))


def residuals(spark, d):
    df = vectors(spark, d)
    out = fit_detector("pca_reconstruction", df, DIMS).score(df)
    return rounded(explain.residual_table(out, {"pca_reconstruction": "pca_reconstruction_residual"}, DIMS))


def latent_map(spark, d):
    out = explain.projection(vectors(spark, d), DIMS)
    return rounded(out.select("row_id", "distance", "boundary_radius", "inside"))


def payloads(spark, d):
    """Explanation payloads written from order lines, then parsed back."""
    li = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.format_string('{"feature_explanations": [{"feature": "a", "shap_value": %.2f}, {"feature": "b", '
                        '"shap_value": -200000.5, "method": "m"}]}', F.col("o_totalprice")).alias("blob"))
    return rounded(explain.parse_explanations(li, "blob").select("row_id", "feature", "shap_value", "absolute_shap_value", "method", "rank"))


def _coordinate_attributions(spark, d):
    """Embedding coordinates read as signed contributions of features."""
    df = vectors(spark, d)
    return df, df.unpivot(["row_id"], DIMS, "feature", "attribution")


def local_interactions(spark, d):
    _, long = _coordinate_attributions(spark, d)
    return rounded(explain.local_interactions(explain.top_attributions(long, 4), 4), digits=9)


def top_alerts(spark, d):
    df, long = _coordinate_attributions(spark, d)
    scored = df.select("row_id", F.greatest(*[F.abs(c) for c in DIMS]).alias("anomaly_score"))
    out = explain.top_alerts(scored, explain.top_attributions(long, len(DIMS)), alerts=10, features=3)
    return rounded(out.select("row_id", "anomaly_score", "feature", "attribution", "rank"), digits=9)


def collective_groups(spark, d):
    df = vectors(spark, d)
    out = score_collective(df, {"first:a|b": DIMS[:3], "second:c": DIMS[3:]})
    return rounded(out.select("row_id", "collective_anomaly_score", "collective_anomaly_top_group",
                              "collective_anomaly_top_group_error"), digits=8)


QUERIES = {
    "m29_full_scoring": full_scoring,
    "m21_collective_head": collective_groups,
    "x1_ablation": ablation,
    "x2_top_attribution": attribution_top,
    "x3_pair_interactions": pair_interactions,
    "x4_residual_table": residuals,
    "x5_latent_projection": latent_map,
    "x6_parsed_payloads": payloads,
    "x7_local_interactions": local_interactions,
    "t3_top_alerts": top_alerts,
}

_ABL = f"""
WITH {VISITS}, {_Z},
s AS (SELECT row_id, greatest(abs(zv), abs(zk)) AS m, abs(zv) AS v, abs(zk) AS w FROM point),
a AS (SELECT row_id, 'value' AS feature, m / (m + 3) - w / (w + 3) AS attribution FROM s
      UNION ALL SELECT row_id, 'k', m / (m + 3) - v / (v + 3) FROM s)"""
_LONG = """
WITH long AS (SELECT vec_id, 'x' || (k - 1) AS feature, v FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)),"""
_RANKED = f"""{_LONG}
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, feature) AS rank FROM long)"""
ORACLE = {
    "x7_local_interactions": f"""{_RANKED}, k AS (SELECT * FROM r WHERE rank <= 4)
SELECT a.vec_id AS row_id, a.feature AS feature_i, b.feature AS feature_j,
       round((CASE WHEN (a.v < 0) = (b.v < 0) THEN 1.0 ELSE -1.0 END) * sqrt(abs(a.v) * abs(b.v))
             * (0.35 + (1.0 - (b.rank - a.rank) / 3.0) * 0.55), 9) AS interaction_value
FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.rank < b.rank""",
    "t3_top_alerts": f"""{_RANKED},
s AS (SELECT vec_id, max(abs(v)) AS score FROM long GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 10)
SELECT s.vec_id AS row_id, round(score, 9) AS anomaly_score, feature, round(v, 9) AS attribution, rank
FROM s JOIN r USING (vec_id) WHERE rank <= 3""",
    "x1_ablation": f"{_ABL} SELECT row_id, feature, round(attribution, 6) AS attribution FROM a",
    "x2_top_attribution": f"""{_ABL}
SELECT row_id, feature, round(attribution, 6) AS attribution, 1 AS rank FROM a
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(attribution) DESC, feature) = 1""",
    "x3_pair_interactions": f"""{_LONG}
m AS (SELECT feature, avg(v) AS m FROM long GROUP BY feature),
d AS (SELECT vec_id, feature, substr(feature, 2)::INT AS k, v - m AS x FROM long JOIN m USING (feature)),
p AS (SELECT vec_id, max(abs(x)) AS p FROM d GROUP BY vec_id),
pairs AS (SELECT a.vec_id, a.feature AS feature_i, b.feature AS feature_j, a.x * b.x / (p * p) AS v
  FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.k < b.k JOIN p ON p.vec_id = a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, feature_i, feature_j) AS rank FROM pairs)
SELECT vec_id AS row_id, feature_i, feature_j, round(v, 6) AS interaction_value, rank FROM r WHERE rank <= 3""",
    "x6_parsed_payloads": """
WITH v AS (SELECT o_orderkey AS row_id, o_totalprice AS a FROM orders)
SELECT row_id, 'a' AS feature, round(a, 6) AS shap_value, round(abs(a), 6) AS absolute_shap_value, NULL AS method,
       CASE WHEN abs(a) >= 200000.5 THEN 1 ELSE 2 END AS rank FROM v
UNION ALL SELECT row_id, 'b', -200000.5, 200000.5, 'm', CASE WHEN abs(a) >= 200000.5 THEN 2 ELSE 1 END FROM v""",
    "m21_collective_head": """
WITH g AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v * v) AS s FROM embeddings),
e AS (SELECT vec_id, sqrt(list_sum(s[1:3]) / 3) AS a, sqrt(list_sum(s[4:]) / (len(s) - 3)) AS b FROM g)
SELECT vec_id AS row_id, round(greatest(a, b) / (greatest(a, b) + 3), 8) AS collective_anomaly_score,
       CASE WHEN a >= b THEN 'first_a_b' ELSE 'second_c' END AS collective_anomaly_top_group,
       round(greatest(a, b), 8) AS collective_anomaly_top_group_error FROM e""",
}

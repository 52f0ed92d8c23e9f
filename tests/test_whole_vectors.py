"""Queries over embeddings and document tags use every coordinate and the whole value: against brute force."""

import inspect
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wardlight.operators import detectors, explain
from wardlight.plans import job_queries, model_queries

QUERIES = entry.queries()
FULL = ("m2_one_class_svm", "m12_pca_reconstruction")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """40 vectors of 64 coordinates, those after the 16th the larger ones, and documents of 3 sources."""
    path = str(tmp_path_factory.mktemp("vectors"))
    x = np.round(np.random.default_rng(3).normal(size=(40, 64)), 3)
    x[:, 16:] *= 3
    spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)],
                          "vec_id long, label int, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(i, "en", f"src{i % 3}") for i in range(7)],
                          "doc_id long, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path, x


@pytest.mark.parametrize("name", FULL)
def test_detectors_are_fitted_on_coordinates_with_defaults(spark, small, name, monkeypatch):
    seen = []

    def fit(kind, df, features, **options):
        seen.append((features, options))
        return detectors.Fitted(kind, features, lambda d, c: d.withColumn(c, F.lit(1.0)))

    monkeypatch.setattr(model_queries, "fit_detector", fit)
    assert QUERIES[name](spark, small[0]).count() == 40
    assert seen == [([f"x{i}" for i in range(64)], {})]


def test_forest_sequence_and_scoring_keep_their_defaults(spark, sf, monkeypatch):
    class Stop(Exception):
        pass

    def check(module, fn, query):
        def fit(*args, **options):
            assert not {"trees", "share"} & set(options)
            raise Stop

        monkeypatch.setattr(module, fn, fit)
        with pytest.raises(Stop):
            query(spark, sf)

    check(model_queries, "fit_detector", model_queries.line_forest)
    check(model_queries, "fit_sequence", model_queries.sequence_errors)
    check(job_queries, "train", job_queries.full_scoring)
    assert inspect.signature(detectors.fit_isolation_forest).parameters["trees"].default == 300


def test_residuals_of_coordinates(spark, small):
    path, x = small
    got = QUERIES["x4_residual_table"](spark, path).collect()
    assert len(got) == 40 and any(int(r["top_feature"][1:]) >= 16 for r in got)


def test_collective_head(spark, small):
    path, x = small
    for r in QUERIES["m21_collective_head"](spark, path).collect():
        v = x[r["row_id"]]
        a, b = np.sqrt((v[:3] ** 2).mean()), np.sqrt((v[3:] ** 2).mean())
        assert r["collective_anomaly_top_group_error"] == pytest.approx(max(a, b), abs=1e-7)
        assert r["collective_anomaly_top_group"] == ("first_a_b" if a >= b else "second_c")


def test_pair_interactions(spark, small):
    path, x = small
    dev = x - x.mean(axis=0)
    got = {(r["row_id"], r["rank"]): (r["feature_i"], r["feature_j"], r["interaction_value"])
           for r in QUERIES["x3_pair_interactions"](spark, path).collect()}
    assert len(got) == 120
    for q, v in enumerate(dev):
        peak = np.abs(v).max() ** 2
        pairs = sorted(((-abs(v[i] * v[j] / peak), i, j) for i, j in combinations(range(64), 2)))[:3]
        for k, (_, i, j) in enumerate(pairs, 1):
            assert got[q, k] == (f"x{i}", f"x{j}", pytest.approx(v[i] * v[j] / peak, abs=2e-6))


def strongest(v):
    return sorted(range(64), key=lambda i: (-abs(v[i]), f"x{i}"))


def test_local_interactions(spark, small):
    path, x = small
    got = {(r["row_id"], r["feature_i"], r["feature_j"]): r["interaction_value"]
           for r in QUERIES["x7_local_interactions"](spark, path).collect()}
    want = {}
    for q, v in enumerate(x):
        for (a, i), (b, j) in combinations(enumerate(strongest(v)[:4]), 2):
            sign = 1 if (v[i] < 0) == (v[j] < 0) else -1
            want[q, f"x{i}", f"x{j}"] = sign * np.sqrt(abs(v[i] * v[j])) * (0.35 + (1 - (b - a) / 3) * 0.55)
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}


def test_top_alerts(spark, small):
    path, x = small
    got = {(r["row_id"], r["rank"]): (r["feature"], r["attribution"], r["anomaly_score"])
           for r in QUERIES["t3_top_alerts"](spark, path).collect()}
    peak = np.abs(x).max(axis=1)
    want = {(q, k): (f"x{i}", pytest.approx(x[q, i]), pytest.approx(peak[q]))
            for q in sorted(range(40), key=lambda q: (-peak[q], q))[:10] for k, i in enumerate(strongest(x[q])[:3], 1)}
    assert got == want


def test_nearest_imputation(spark, small):
    path, x = small
    gaps = np.array([[np.nan if (q * 7 + i * 3) % 5 == 0 else x[q, i] for i in range(64)] for q in range(40)])
    means = np.nanmean(gaps, axis=0)
    for r in QUERIES["i4_c4_nearest_imputation"](spark, path).collect():
        q = gaps[r["vec_id"]]
        both = ~np.isnan(gaps) & ~np.isnan(q)
        n = both.sum(axis=1)
        d = np.sqrt(np.where(both, (gaps - q) ** 2, 0).sum(axis=1) * 64 / np.where(n, n, 1))
        for i in range(64):
            have = [(d[k], k) for k in range(40) if n[k] and not np.isnan(gaps[k, i])]
            near = [gaps[k, i] for _, k in sorted(have)[:5]]
            fill = np.mean(near) if near else means[i]
            assert r[f"x{i}"] == pytest.approx(fill if np.isnan(q[i]) else q[i], abs=2e-6)


def test_token_indicators(spark, small):
    got = {r["feature"]: r["rows"] for r in QUERIES["i2_d19_token_indicators"](spark, small[0]).collect()}
    assert got == {"tags__en": 7, "tags__src0": 3, "tags__src1": 2, "tags__src2": 2}


def test_pairs_are_ranked_before_they_are_shuffled(spark, sf):
    rows = [(1, 1.0, -2.0, 3.0, 0.5), (2, 0.0, 0.0, 0.0, 0.0), (3, 1.0, None, 2.0, -2.0), (4, float("nan"), 1.0, 2.0, 3.0),
            (5, 1.0, 1.0, 1.0, 1.0), (5, 9.0, 1.0, 0.5, 4.0)]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    means = dict.fromkeys(names, 0.0)
    plain = explain.top_pairs(explain.interactions(df, names, means), 3)
    fast = explain.top_interactions(df, names, means, 3)
    order = ["row_id", "rank"]
    assert [str(r) for r in fast.orderBy(order).collect()] == [str(r) for r in plain.orderBy(order).collect()]
    out = job_queries.QUERIES["x3_pair_interactions"](spark, sf)
    assert "posexplode" not in spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "extended")

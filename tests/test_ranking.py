import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators import nearest as nn
from wardlight.operators.conformal import conformal_p_values
from wardlight.operators.monitor import discrepancy, feature_sums, fit_monitor, fourier, score_batch
from wardlight.operators.ranking import exact_quantiles, hash_sample, ordered_totals, rank_cuts
from wardlight.operators.split import with_split


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.33, 0.25, rng.gamma(1.5, 1.0, 3000))  # a third share one value
    return spark.createDataFrame(pd.DataFrame({"id": range(3000), "g": rng.integers(0, 3, 3000), "x": x})).persist()


def test_totals_do_not_depend_on_bins(values):
    counted = values.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    one = ordered_totals(counted, ["g"], "x", ["n"])
    many = ordered_totals(counted, ["g"], "x", ["n"], rows_per_bin=50)
    assert one.exceptAll(many).isEmpty() and many.count() == one.count()


def test_exact_quantiles(values):
    pdf = values.toPandas()
    got = exact_quantiles(values, "x", {"a": 0.05, "b": 0.5, "c": 0.975}, ["g"], rows_per_bin=100).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(part["x"], [0.05, 0.5, 0.975]))
    whole = exact_quantiles(values, "x", {"q": 0.9}).first()["q"]
    assert whole == pytest.approx(np.quantile(pdf["x"], 0.9))


def test_rank_cuts_and_sample(spark, values):
    assert rank_cuts(spark.range(1, 101).select("id"), "id", [10, 90, 200]) == [10, 90, None]
    a = {r["id"] for r in hash_sample(values, 200, ["id"]).collect()}
    b = {r["id"] for r in hash_sample(values.repartition(7), 200, ["id"]).collect()}
    assert len(a) == 200 and a == b


def test_p_values_match_counting(values):
    cal = values.where("g = 0")
    out = conformal_p_values(values, cal, "x").toPandas()
    ref = np.sort(cal.toPandas()["x"].to_numpy())
    expected = (1 + (ref[:, None] >= out["x"].to_numpy()[None, :]).sum(0)) / (len(ref) + 1)
    np.testing.assert_allclose(out["conformal_p_value"], expected)
    empty = conformal_p_values(values, cal.where("false"), "x")
    assert empty.where("conformal_p_value IS NOT NULL").isEmpty()


def test_split_keeps_groups_together(spark):
    df = spark.range(5000).selectExpr("id row_id", "case when id % 3 = 0 then 'hot' else cast(id % 97 as string) end patient_id")
    out = with_split(df)
    spread = out.groupBy("patient_id").agg(F.countDistinct("split").alias("n"))
    assert spread.where("n > 1").isEmpty() and out.count() == 5000
    sizes = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.countDistinct("patient_id").alias("n")).collect()}
    assert sizes == {"train": round(98 * 0.7), "validation": round(98 * 0.85) - round(98 * 0.7), "test": 98 - round(98 * 0.85)}
    again = with_split(df.repartition(11))
    assert out.exceptAll(again).isEmpty()


def test_split_edges(spark):
    two = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, patient_id string")
    assert {r["split"] for r in with_split(two).collect()} == {"train"}
    rows = spark.range(10).selectExpr("id row_id", "'a' patient_id")
    got = {r["split"]: r["count"] for r in with_split(rows).groupBy("split").count().collect()}
    assert got == {"train": 8, "validation": 1, "test": 1}
    three = spark.createDataFrame([(i, p) for i, p in enumerate("abc")], "row_id int, patient_id string")
    got = {r["split"]: r["count"] for r in with_split(three).groupBy("split").count().collect()}
    assert got == {"train": 2, "test": 1}
    with pytest.raises(ValueError):
        with_split(two, train=-1)
    with pytest.raises(ValueError):
        with_split(two, train=0, validation=0, test=0)


def test_imputation_does_not_depend_on_the_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(row_id=range(300))
    df = spark.createDataFrame(pdf).select("row_id", *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in "abcd"])
    means = {c: float(np.nanmean(pdf[c])) for c in "abcd"}
    held = nn.impute_nearest(df, df, list("abcd"), means, 5).toPandas().sort_values("row_id")
    monkeypatch.setattr(nn, "PIVOTS", 5)
    monkeypatch.setattr(nn, "ROWS_PER_PIVOT", 1)
    monkeypatch.setattr(nn, "SPLIT_ROWS", 20)
    cut = nn.impute_nearest(df, df, list("abcd"), means, 5).toPandas().sort_values("row_id")
    np.testing.assert_allclose(held[list("abcd")], cut[list("abcd")])
    # brute force for one column
    d = nn.nan_distances(x, x)
    for i in np.flatnonzero(np.isnan(x[:, 0]))[:20]:
        ok = np.flatnonzero(~np.isnan(x[:, 0]) & ~np.isnan(d[i]))
        best = ok[np.argsort(d[i, ok], kind="stable")[:5]]
        assert held.iloc[i]["a"] == pytest.approx(x[best, 0].mean())


def test_discrepancy_tracks_the_exact_kernel(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(200, 3)), rng.normal(0.5, 1, size=(300, 3))
    g = 0.2

    def k(x, y):
        return np.exp(-g * ((x[:, None] - y[None]) ** 2).sum(2))

    kxx, kyy = k(a, a), k(b, b)
    exact = (kxx.sum() - 200) / (200 * 199) + (kyy.sum() - 300) / (300 * 299) - 2 * k(a, b).mean()
    fast = discrepancy(fourier(a, g, 1).sum(0), 200, fourier(b, g, 1).sum(0), 300)
    assert fast == pytest.approx(exact, abs=0.02)
    df = spark.createDataFrame(pd.DataFrame(a, columns=["p", "q", "r"]).assign(row_id=range(200)))
    m = fit_monitor(df, ["p", "q", "r"])
    assert not score_batch(df, m)[1]
    moved = df.select("row_id", *[(F.col(c) * 8 + 50).alias(c) for c in "pqr"])
    assert score_batch(moved, m)[1]


def test_totals_of_each_model_meet_its_rows_without_dealing_all_rows_by_model(spark):
    """Dealt by model alone, all rows would go to as many tasks as there are models."""
    import re

    from wardlight.operators.evaluate import evaluate_scores
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.range(200).select((F.col("id") / 200).alias("a"), (F.col("id") % 7 / 7).alias("b"),
                                     (F.col("id") % 2).cast("int").alias("label"))
        plan = evaluate_scores(df, ["a", "b"], "label")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"BroadcastHashJoin \[model#\d+\]", plan)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_feature_sums_of_one_file_use_all_cores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2500, 2)) * [1.0, 400.0] + [0.0, 5000.0]
    df = spark.createDataFrame(x.tolist(), "a double, b double").coalesce(1)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("feature-sums", "one file")
    total, rows = feature_sums(df, ["a", "b"], 0.3, 7)[0]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in tracker.getJobIdsForGroup("feature-sums") for s in tracker.getJobInfo(j).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) >= spark.sparkContext.defaultParallelism
    assert rows == 2500 and np.abs(total - fourier(x, 0.3, 7).sum(0)).max() < 1e-6 * rows

"""Costly values are worked out once: detector scores in training, z-scores in the heads."""

from wardlight.operators import detectors
from wardlight.operators.heads import score_collective, score_contextual, score_point
from wardlight.operators.ordered import PatientOrder
from wardlight.plans.job_queries import SMALL
from wardlight.plans.jobs import train
from wardlight.sources.standins import visits


def test_training_scores_its_rows_once(spark, sf, monkeypatch):
    calls = []
    for name in SMALL.detectors:
        def build(*args, make=detectors.BUILDERS[name], name=name):
            raw = make(*args)
            return lambda frame, output: (calls.append(name), raw(frame, output))[1]
        monkeypatch.setitem(detectors.BUILDERS, name, build)
    model = train(visits(spark, sf).limit(400), SMALL, sequence=False)
    assert sorted(calls) == sorted(SMALL.detectors)
    low, high = model.ranges["isolation_forest_score"]
    assert low < 0 < high


def test_heads_work_out_a_value_once(spark, sf):
    names = ["value", "k"]
    df = visits(spark, sf)
    heads = [score_point(df, {n: (1.0, 2.0) for n in names}), score_collective(df, {"a": ["value"], "b": ["k"]}),
             score_contextual(PatientOrder(df, hot=None), names).done()]
    for out in heads:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("abs(") == len(names)


def test_peak_with_nulls_and_ties(spark):
    df = spark.sql("SELECT * FROM VALUES (1, -3.0D, 3.0D), (2, NULL, 2.0D) AS t(row_id, a, b)").repartition(2)
    got = [r.asDict() for r in score_point(df, {"a": (0.0, 1.0), "b": (0.0, 1.0)}, keep_z=True).orderBy("row_id").collect()]
    assert [r["point_anomaly_top_feature"] for r in got] == ["a", "b"]
    assert [r["point_anomaly_top_feature_zscore"] for r in got] == [-3.0, 2.0]
    assert [r["point_anomaly_mean_abs_zscore"] for r in got] == [3.0, 2.0]
    assert [r["point_anomaly_score"] for r in got] == [0.5, 0.4]
    assert [r["point_zscore__a"] for r in got] == [-3.0, None]
    assert not any(c.startswith("_") for c in got[0])

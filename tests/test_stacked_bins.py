"""Boosted fusion is fitted on the counts of equal rows and gives the plain fit's scores."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardlight.operators import fusion

PARTS = ["a", "b", "flat"]


def rows(spark, n):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 12, n) / 11, np.round(rng.random(n), 3)
    y = (a + b + rng.normal(size=n) * 0.3 > 1.2).astype(int)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), 0.5, int(y[i])) for i in range(n)],
                                 "row_id long, a double, b double, flat double, label int")


def test_boosting_reads_counts_and_scores_as_the_plain_fit(spark, monkeypatch, tmp_path):
    df = rows(spark, 6_000).cache()
    plain = VectorAssembler(inputCols=PARTS, outputCol="x").transform(df.withColumn("label", F.col("label").cast("double")))
    expected = GBTClassifier(featuresCol="x", maxIter=40, maxDepth=3, seed=42).fit(plain).transform(plain).select(
        "row_id", vector_to_array("probability")[1].alias("p")).toPandas().set_index("row_id")["p"]
    given, fit = [], GBTClassifier.fit

    def spy(self, dataset, params=None):
        given.append(dataset.count())
        return fit(self, dataset, params)

    monkeypatch.setattr(GBTClassifier, "fit", spy)
    model = fusion.fit_stacking(df, PARTS, "label", "gbt")
    assert len(given) == 1 and given[0] <= 12 * 32 * 2  # bins and labels, not 6,000 rows
    model.write().save(f"{tmp_path}/meta")
    for held in (model, PipelineModel.load(f"{tmp_path}/meta")):
        out = fusion.apply_stacking(df, held, PARTS, "s")
        assert out.columns == [*df.columns, "s"]
        got = out.select("row_id", "s").toPandas().set_index("row_id")["s"]
        np.testing.assert_allclose(got, expected[got.index], atol=1e-9)
    df.unpersist()

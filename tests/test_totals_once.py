"""Running totals read what they count once, however many steps follow."""

from wardlight.operators.ranking import exact_quantiles, ordered_totals


def test_counted_values_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def passed(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    counted = spark.range(50).selectExpr("cast(id as double) AS v", "1L AS n").mapInPandas(passed, "v double, n long")
    totals = ordered_totals(counted, [], "v", ["n"], descending=False, rows_per_bin=10)
    assert [r["cum_n"] for r in totals.orderBy("v").collect()] == list(range(1, 51))
    assert made.value == 50
    rows = spark.range(50).selectExpr("cast(id as double) AS v", "1L AS n").mapInPandas(passed, "v double, n long")
    assert exact_quantiles(rows, "v", {"m": 0.5}, rows_per_bin=10).first()["m"] == 24.5
    assert made.value == 100

"""Global ordered totals, exact quantiles and rank cuts without a one-task sort.

Values are first counted per distinct value (map-side combined), then cut into
value bins of bounded size. Totals run inside each bin and the bin totals, a
tiny table, are carried over. Equal values always share a row, so a value held
by a third of all rows costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.session import cut_lineage

ROWS_PER_BIN = 1_000_000
MAX_BINS = 4096


def value_bins(counted: DataFrame, value: str, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Add ``_bin``: ranges of ``value`` with about ``rows_per_bin`` rows each."""
    n = counted.count()
    bins = min(MAX_BINS, -(-n // rows_per_bin))
    if bins <= 1:
        return counted.withColumn("_bin", F.lit(0.0))
    probs = [i / bins for i in range(1, bins)]
    cuts = counted.agg(
        F.percentile_approx(value, probs, max(10_000, 4 * bins)).alias("c")).first()["c"]
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) < 3:
        return counted.withColumn("_bin", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol="_bin").transform(counted)


def ordered_totals(counted: DataFrame, groups: list[str], value: str, measures: list[str],
                   descending: bool = True, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Running totals ``cum_<measure>`` up to and including each distinct ``value``.

    ``counted`` holds one row per (groups, value). It is kept once: its rows are counted, cut into bins and read on two
    sides of a join, and each of these would run everything before it again.
    """
    counted = cut_lineage(counted)
    binned = value_bins(counted, value, rows_per_bin)
    per_bin = binned.groupBy(*groups, "_bin").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    step = F.col("_bin").desc() if descending else F.col("_bin").asc()
    before = Window.partitionBy(*groups).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bin.select(*groups, "_bin", *[
        F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_b_{m}") for m in measures])
    inner = F.col(value).desc() if descending else F.col(value).asc()
    local = Window.partitionBy(*groups, "_bin").orderBy(inner).rowsBetween(Window.unboundedPreceding, 0)
    # carried has at most groups x MAX_BINS rows; Spark sizes the join itself.
    return (
        binned.withColumns({f"_c_{m}": F.sum(m).over(local) for m in measures})
        .join(carried, [*groups, "_bin"])
        .withColumns({f"cum_{m}": F.col(f"_c_{m}") + F.col(f"_b_{m}") for m in measures})
        .drop("_bin", *[f"_c_{m}" for m in measures], *[f"_b_{m}" for m in measures])
    )


def quantile_parts(p: float, value: str, n: Column, cum: str = "cum_n") -> list[Column]:
    """Two aggregates holding the neighbours of the linear-interpolated quantile ``p``.

    Needs ascending ``cum_n`` and the group size ``n`` on every row.
    """
    at = (n - 1) * F.lit(float(p))
    low = F.min(F.when(F.col(cum) > F.floor(at), F.col(value)))
    high = F.min(F.when(F.col(cum) > F.ceil(at), F.col(value)))
    return [low, high]


def interpolate(low: Column, high: Column, p: float, n: Column) -> Column:
    at = (n - 1) * F.lit(float(p))
    return low + (high - low) * (at - F.floor(at))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: list[str] | None = None,
                    rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Exact linear-interpolated quantiles per group, named by ``probs``."""
    if not groups:
        whole = exact_quantiles(df.withColumn("_all", F.lit(1)), value, probs, ["_all"], rows_per_bin)
        return whole.drop("_all")
    keep = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = keep.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    sized = _with_total(ordered_totals(counted, groups, value, ["n"], False, rows_per_bin), groups)
    aggs = [F.max("_n").alias("_n")]
    for name, p in probs.items():
        low, high = quantile_parts(p, value, F.col("_n"))
        aggs += [low.alias(f"_l_{name}"), high.alias(f"_h_{name}")]
    out = sized.groupBy(*groups).agg(*aggs)
    return out.select(*groups, *[
        interpolate(F.col(f"_l_{k}"), F.col(f"_h_{k}"), p, F.col("_n")).alias(k) for k, p in probs.items()])


def _with_total(totals: DataFrame, groups: list[str]) -> DataFrame:
    size = totals.groupBy(*groups).agg(F.max("cum_n").alias("_n"))
    return totals.join(size, groups)


def rank_cuts(df: DataFrame, value: str, ranks: list[int]) -> list:
    """The values at the given 1-based ranks (ascending) of ``df``; ``None`` past the end."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    totals = ordered_totals(counted, [], value, ["n"], descending=False)
    row = totals.agg(*[
        F.min(F.when(F.col("cum_n") >= r, F.col(value))).alias(f"r{i}") for i, r in enumerate(ranks)]).first()
    return [row[f"r{i}"] for i in range(len(ranks))]


def hash_sample(df: DataFrame, rows: int, keys: list[str], seed: int = 42) -> DataFrame:
    """A deterministic sample of exactly min(rows, n) rows: those with the lowest key hash.

    A hash threshold thins the input first, so the final sort sees about twice
    ``rows`` however large ``df`` is.
    """
    picked = df.withColumn("_h", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))
    n = df.count()
    share = (2.0 * rows + 1000.0) / n if n else 1.0
    if share < 1.0:
        thin = picked.where(F.col("_h") < F.lit(int(-(2 ** 63) + share * 2 ** 64)))
        if thin.limit(rows).count() == rows:
            picked = thin
    return picked.orderBy("_h", *keys).limit(rows).drop("_h")


def mean_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / F.lit(float(len(columns)))

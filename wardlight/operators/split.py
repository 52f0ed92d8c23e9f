"""Group-preserving train / validation / test split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators.ranking import rank_cuts
from wardlight.schema import KEY, ROW

NAMES = ("train", "validation", "test")


def _fractions(train: float, validation: float, test: float) -> list[float]:
    values = [float(train), float(validation), float(test)]
    if any(not math.isfinite(v) or v < 0 for v in values):
        raise ValueError("split fractions must be finite and non-negative")
    total = sum(values)
    if total <= 0:
        raise ValueError("at least one split fraction must be positive")
    return [v / total for v in values]


def _by_hash(h: Column, cuts: list) -> Column:
    first, second = cuts
    out = F.when(h <= F.lit(first), NAMES[0]) if first is not None else F.when(F.lit(False), NAMES[0])
    if second is not None:
        out = out.when(h <= F.lit(second), NAMES[1])
    return out.otherwise(NAMES[2])


def with_split(df: DataFrame, train: float = 0.7, validation: float = 0.15, test: float = 0.15,
               group: str = KEY, row: str = ROW, seed: int = 42) -> DataFrame:
    """Add ``split``; all rows of a group stay together and null groups go to train.

    Groups are ranked by a seeded hash and two cut values found; a row's split
    is then a function of its own group, so rows are neither joined nor moved.
    """
    f_train, f_val, f_test = _fractions(train, validation, test)
    n = df.limit(3).count()
    if n < 3:
        return df.withColumn("split", F.lit(NAMES[0]))
    groups = df.select(F.col(group).cast("string").alias("g")).where("g IS NOT NULL").distinct() \
        if group in df.columns else None
    count = groups.count() if groups is not None else 0
    if count >= 3:
        h = F.xxhash64(F.col(group).cast("string"), F.lit(seed))
        first = min(count, max(1, round(count * f_train)))
        second = min(count, max(first + 1, round(count * (f_train + f_val))))
        if second == count and second > first:
            second -= 1  # the last group tests
        cuts = rank_cuts(groups.select(F.xxhash64("g", F.lit(seed)).alias("h")), "h", [first, second])
        if second == first:
            cuts[1] = None
        return df.withColumn("split", F.when(F.col(group).isNull(), NAMES[0]).otherwise(_by_hash(h, cuts)))
    h = F.xxhash64(F.col(row), F.lit(seed))
    total = df.count()
    if count:
        held_out, last = 2, 1
    else:
        held_out = math.ceil(total * (f_val + f_test) - 1e-9)
        last = math.ceil(held_out * f_test / max(f_val + f_test, 1e-12) - 1e-9)
    if held_out <= 0 or (not count and held_out < 2):
        return df.withColumn("split", F.lit(NAMES[0]))
    cuts = rank_cuts(df.select(h.alias("h")), "h", [total - held_out, total - last])
    if total - held_out <= 0:
        cuts[0] = None
    if last >= held_out:
        cuts[1] = None
    return df.withColumn("split", _by_hash(h, cuts))


def split_frames(df: DataFrame, **kwargs) -> dict[str, DataFrame]:
    marked = with_split(df, **kwargs)
    return {n: marked.where(F.col("split") == n).drop("split") for n in NAMES}

"""Sets of large clusters are dealt only to blocks in reach of their size, and a hand-over leaves no shuffle files."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from wardlight.llm import jaccard
from wardlight.llm.textio import CLEANED, handed_over


def test_sets_out_of_reach_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    rng = np.random.default_rng(3)
    rows = [(1, i, int(n)) for i, n in enumerate(rng.choice([9, 10, 11, 50, 55, 56, 500, 1000], 80))]
    members = spark.createDataFrame(rows, "cluster long, node long, n_grams long").withColumn(
        "grams", F.col("n_grams").cast("string").cast("binary"))
    rest = members.where("node % 3 = 0").select("node")
    found = jaccard._block_pairs(members, rest, 90).select(
        "cluster", "size_i", "i", "size_j", "j", "node", "probe").toPandas()
    met = set()
    for _, g in found.groupby(["cluster", "size_i", "i", "size_j", "j"]):
        asks, told = g[g.probe].node, g[~g.probe].node
        assert len(asks) and len(told)
        met |= {(a, b) for a in asks for b in told}
    size = {i: n for _, i, n in rows}
    within = {(a, b) for a in size if a % 3 == 0 for b in size if 10 * size[a] >= 9 * size[b] and 10 * size[b] >= 9 * size[a]}
    assert within <= met
    assert all(0.9 ** 2 <= size[a] / size[b] * (1 + 1e-9) and size[a] / size[b] <= 0.9 ** -2 * (1 + 1e-9) for a, b in met)


def test_size_classes_hold_all_in_reach(spark):
    sizes = spark.createDataFrame([(n,) for n in range(1, 3_000)], "n_grams long")
    for percent in (1, 50, 80, 90, 99, 100):
        of = {r["n_grams"]: r["c"] for r in sizes.withColumn("c", jaccard._size_class(percent)).collect()}
        for n in of:
            assert abs(of[n] - of[-(-percent * n // 100)]) <= 1


def test_no_shuffle_files_stay(spark):
    env = spark.sparkContext._jsc.sc().env()
    folders = env.blockManager().diskBlockManager().localDirs()

    def files():
        return {f for d in folders for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}

    before, set_to = files(), spark.conf.get(CLEANED, None)
    df = spark.range(50_000).repartition(4, F.xxhash64("id"))
    held = handed_over(df, "narrow")
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.5)
    assert not left
    assert held.count() == 50_000 and spark.conf.get(CLEANED, None) == set_to

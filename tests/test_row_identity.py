"""Row ids of any kind in as-of joins, ids of reviewed rows, ties by id, and gaps in streamed measurements."""

import math

import numpy as np
import pandas as pd
import pytest

from wardlight.operators.assembly import as_of
from wardlight.operators.feedback import retraining_rows
from wardlight.operators.nearest import nearest
from wardlight.operators.risk import risk_weights
from wardlight.streaming.jobs import ContextualState


@pytest.mark.parametrize(("left_id", "right_id"), [
    (lambda i: -(2 ** 63) + i, lambda i: 2 ** 62 + i), (lambda i: f"row-{i:02d}", lambda i: -i), (int, lambda i: f"m{i:02d}")])
def test_as_of_with_ids_of_any_kind(spark, left_id, right_id):
    left = spark.createDataFrame([(left_id(i), "k", f"2026-01-0{1 + i} 12:00:00", i) for i in range(5)],
                                 f"rid {'string' if isinstance(left_id(0), str) else 'long'}, k string, at string, n int")
    rows = [(right_id(i), "k", f"2026-01-0{2 + i // 2} 12:00:00", float(i)) for i in range(6)]
    right = spark.createDataFrame(rows, f"mid {'string' if isinstance(right_id(0), str) else 'long'}, k string, seen string, v double")
    best = {}
    for mid, _, seen, v in rows:
        best[seen] = max(best.get(seen, (mid, v)), (mid, v))
    for bound in (None, 3):
        got = {r["n"]: r["v"] for r in as_of(left, right, "k", "at", "seen", "mid", ["v"], "rid", max_rows=bound).collect()}
        want = {i: max(((s, best[s][1]) for s in best if s <= f"2026-01-0{1 + i} 12:00:00"), default=(0, None))[1]
                for i in range(5)}
        assert got == want


class _Held:
    def __init__(self):
        self.value = None

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_contextual_state_skips_gaps_over_batches():
    dice = np.random.default_rng(2)
    x = np.where(dice.random((40, 3)) < 0.3, np.nan, dice.normal(50, 9, (40, 3)))
    rows = pd.DataFrame(x, columns=list("abc")).assign(t=range(40), r=range(40))
    state = ContextualState(list("abc"), time="t", row="r")
    state.init(_Held())
    out = pd.concat([o for a, b in ((0, 1), (1, 7), (7, 40)) for o in state.handleInputRows(None, iter([rows[a:b]]), None)])
    for i, got in enumerate(out.itertuples()):
        z = []
        for j in range(3):
            past = x[:i, j][~np.isnan(x[:i, j])]
            std = past.std() if len(past) else 0.0
            z.append(0.0 if not len(past) or np.isnan(x[i, j]) else (x[i, j] - past.mean()) / (std if std > 1e-12 else 1.0))
        peak = max(map(abs, z))
        assert got.contextual_anomaly_max_abs_zscore == pytest.approx(peak, abs=1e-9)
        assert got.contextual_anomaly_score == pytest.approx(peak / (peak + 3), abs=1e-9)
        assert got.contextual_anomaly_history_length == i


def test_reviewed_rows_have_ids_of_their_own(spark):
    base = spark.createDataFrame([(1, "p", 1.0), (2, "q", 2.0)], "row_id long, patient_id string, x double")
    record = '{"row_id": 1, "patient_id": "p", "x": 1.0}'
    ledger = spark.createDataFrame([(record, 1), (record, 1), ('{"patient_id": "q", "x": 5.0}', 0)],
                                   "record_json string, feedback_label int")
    rows = retraining_rows(base, ledger).collect()
    assert len({r["row_id"] for r in rows}) == len(rows) == 5
    assert sorted(r["label"] for r in rows) == [0, 0, 0, 1, 1]


def test_nearest_breaks_ties_by_id_in_any_cells(spark, monkeypatch):
    from wardlight.operators import nearest as module

    points = spark.createDataFrame([((i * 7) % 40, 0.0 if i % 2 else 1.0) for i in range(40)], "row_id long, x double")
    query = spark.createDataFrame([(100, 0.0)], "row_id long, x double")
    plain = [r["neighbour"] for r in nearest(query, points, ["x"], 3).orderBy("rank").collect()]
    monkeypatch.setattr(module, "PIVOTS", 1)
    monkeypatch.setattr(module, "SPLIT_ROWS", 7)
    assert [r["neighbour"] for r in nearest(query, points, ["x"], 3).orderBy("rank").collect()] == plain
    assert plain == sorted((i * 7) % 40 for i in range(40) if i % 2)[:3]


def test_risk_weights_are_shares():
    assert math.fsum(risk_weights({"anomaly": 3.0, "other": 9.0}).values()) == pytest.approx(1)
    for bad in ({"anomaly": -1.0}, {"labs": float("nan")}, {"vitals": None}, dict.fromkeys(risk_weights(), 0.0)):
        with pytest.raises(ValueError):
            risk_weights(bad)

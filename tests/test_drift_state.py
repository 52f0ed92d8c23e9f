"""The drift stream takes a patient's rows of a micro-batch as one run of scores."""

import numpy as np
import pandas as pd

from wardlight.operators.drift import AdaptiveWindow
from wardlight.streaming.jobs import DriftState


class Held:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def run(pdf, sizes):
    state = DriftState("value")
    state.state = Held()
    ends = np.cumsum(sizes)
    parts = [pdf[b - a:b] for a, b in zip(sizes, ends, strict=True)]
    return pd.concat([out for p in parts for out in state.handleInputRows(None, iter([p]), None)], ignore_index=True)


def test_rows_of_a_batch_are_one_run(monkeypatch):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=150), rng.normal(6, 1, 150), rng.normal(size=100)])
    values[[2, 40, 170]] = np.nan
    pdf = pd.DataFrame({"row_id": np.arange(400), "recorded_at": pd.date_range("2026-01-01", periods=400), "value": values})
    alone = run(pdf, [1] * 400)
    calls, extend = [], AdaptiveWindow.extend
    monkeypatch.setattr(AdaptiveWindow, "extend", lambda self, xs: (calls.append(len(xs)), extend(self, xs))[1])
    for sizes in ([400], [3, 197, 200]):
        calls.clear()
        pd.testing.assert_frame_equal(run(pdf, sizes), alone)
        assert calls == sizes
    assert (alone["adwin_stat"] > 0).any() and alone["drift_alarm"].any() and (alone["visit_index"] == np.arange(400)).all()

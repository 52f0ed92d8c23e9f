"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: of bytes (1 to 4), of words (1) and of
word shapes (1 to 3; a shape says case, symbols, ending, length and whether
the word repeats the one before it), hashed to ``2 ** BITS`` places. An
indicator is scaled by its log-count ratio between the classes, counted over
all labelled training rows. A linear hinge-loss model is fitted by dual
coordinate descent on a bounded sample of them (``sample_rows``), its margin
is turned into a probability on a part of the sample kept for that.

Defined results: null and empty texts have no feature and get the bias' score;
with labels of one class only, or none, every score is the smoothed share of
label 1; rows without a label never train; a document labelled more than once
trains once for each label row; repeated documents are rows of their own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.textio import Marks, handed_over, key_remainder, mix64, raw, slices, text_of, word_edges, word_hashes

BITS = 18
BYTE_GRAMS, SHAPE_GRAMS = (1, 2, 3, 4), (1, 2, 3)
SAMPLE_ROWS = 8_000
THRESHOLD = 0.3
#: Counts travel as compressed ranges of places; so many tasks' ranges are summed in one group at first.
RANGES, FAN = 16, 256
SMOOTHING, PENALTY, EPOCHS, INTERPOLATION = 1.0, 1.0, 30, 0.5


def _place(keys: np.ndarray, family: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(family) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        spread *= np.uint64(0xD6E8FEB86659FD93)
    return (spread >> np.uint64(64 - BITS)).astype(np.int32)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A small number for each word's form."""
    kind = np.zeros((4, 256), np.int64)
    kind[0, 65:91] = 1
    kind[1, 97:123] = 1
    kind[2, 48:58] = 1
    kind[3, [c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:'\"-()?"]] = 1
    upper, lower, digit, symbol = (np.add.reduceat(np.append(k[data], 0), np.stack([starts, ends], 1).ravel())[::2]
                                   for k in kind)
    size = ends - starts
    same = np.zeros(len(starts), np.int64)
    words = word_hashes(data, starts, ends)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    last = data[ends - 1]
    stop = np.select([(last == 46) | (last == 63), last == 44, last == 33], [1, 2, 3], 0)
    case = np.where(upper > 0, np.where(lower > 0, 1, 2), 0)
    form = case + 3 * (digit > 0) + 6 * np.minimum(symbol, 2) + 18 * stop + 72 * same
    return form * 4 + np.minimum(size // 4, 3), words


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a slice, the places of its n-grams (with repeats)."""
    data, bounds = raw(column)
    starts, ends, rows = word_edges(data, bounds)
    wide = data.astype(np.uint64)
    grams, gram = [], wide
    for n in BYTE_GRAMS:
        if n > 1:
            gram = (gram[:-1] << np.uint64(8)) | wide[n - 1:] if len(wide) >= n else gram[:0]
        grams.append((n, _place(gram, n)))
    if len(starts):
        shape, words = _shapes(data, starts, ends, rows)
    else:
        shape, words = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    forms, form = [], shape.astype(np.uint64)
    for n in SHAPE_GRAMS:
        if n > 1:
            form = form[:-1] * np.uint64(1024) + shape[n - 1:].astype(np.uint64) if len(shape) >= n else form[:0]
        forms.append((n, _place(form, 16 + n)))
    word = _place(mix64(words), 32)
    at = np.searchsorted(rows, np.arange(len(bounds)))
    for i in range(len(bounds) - 1):
        a, b, c, d = bounds[i], bounds[i + 1], at[i], at[i + 1]
        yield np.concatenate([word[c:d], *[g[a:max(a, b - n + 1)] for n, g in grams],
                              *[f[c:max(c, d - n + 1)] for n, f in forms]])


class _Distinct:
    """The distinct places of an array, by a table that is wiped after use."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        if len(places) < 2_000:
            return np.unique(places)
        self.seen[places] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def _training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """One pass over the labelled texts: sums by class for each place, and the features of the sample's rows."""
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("quality").cast("int").alias("label"))
    share = sample_rows / max(1, named.count())
    drawn = F.pmod(F.xxhash64(F.lit(4), F.col("doc_id")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    marks = Marks(named)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield marks.keep(batch).drop_columns(["at"])

    # texts without a label stay out of the shuffle by id
    texts = docs.where(key_remainder("doc_id", 5) != 0).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), marks.place("doc_id"))
    rows = (texts.mapInArrow(labelled, "doc_id long, text string")
            .join(named, "doc_id").select("text", "label", drawn.alias("drawn"),
                                          (F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(4)) == 0).alias("held")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, distinct = np.zeros((2, 1 << BITS), np.int64), _Distinct()
        seen = np.zeros(2, np.int64)
        schema = pa.schema([("task", pa.int32()), ("range", pa.int32()), ("counts", pa.binary()), ("label", pa.int32()),
                            ("held", pa.bool_()), ("places", pa.binary())])
        task = TaskContext.get().partitionId()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for part in slices(batches):
            label = part.column("label").to_numpy(zero_copy_only=False)
            drawn, held = part.column("drawn").to_pylist(), part.column("held").to_pylist()
            out = []
            for i, places in enumerate(features(part.column("text"))):
                places = distinct(places)
                counts[label[i], places] += 1
                seen[label[i]] += 1
                if drawn[i]:
                    out.append((task, None, None, int(label[i]), held[i], places.astype(np.int32).tobytes()))
            if out:
                yield batch(out)
        if seen.sum():
            yield batch([(task, -1, zlib.compress(seen.tobytes(), 1), None, None, None)] + [
                (task, r, zlib.compress(np.ascontiguousarray(part).tobytes(), 1), None, None, None)
                for r, part in enumerate(np.split(counts, RANGES, axis=1))])

    return rows.mapInArrow(run, "task int, range int, counts binary, label int, held boolean, places binary")


def _class_counts(rows: DataFrame) -> DataFrame:
    """(place, n0, n1): rows of each class that have the place; place -1 counts the rows themselves."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64).reshape(2, -1) for x in table.column("counts").to_pylist())
        at = np.flatnonzero(total.sum(axis=0))
        place = at + table.column("range")[0].as_py() * ((1 << BITS) // RANGES)
        if table.column("range")[0].as_py() < 0:
            at, place = np.zeros(1, np.int64), np.full(1, -1)
        return pa.table({"place": pa.array(place.astype(np.int32)), "n0": pa.array(total[0, at]),
                         "n1": pa.array(total[1, at])})

    return (rows.where("counts is not null").select("range", F.floor(F.col("task") / FAN).alias("group"), "counts")
            .groupBy("range", "group").applyInArrow(add, "place int, n0 long, n1 long")
            .groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The 32-bit numbers of each binary value, as views of the Arrow buffers."""
    out = []
    for chunk in column.chunks:
        chunk = chunk.cast(pa.large_binary())
        bounds = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset:chunk.offset + len(chunk) + 1] // 4
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        data = data[:len(data) // 4 * 4].view(np.int32)
        out += [data[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


class _Rows(Sequence):
    """The places of each row and, last, the bias; made when asked for, since a sample of them all is large."""

    def __init__(self, places: list[np.ndarray], ratio: np.ndarray) -> None:
        self.places, self.ratio = places, ratio

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.append(self.places[i], np.int32(len(self.ratio)))


class _Values(_Rows):
    """The scaled indicators of each row, a unit vector, and 1 for the bias."""

    def __getitem__(self, i: int) -> np.ndarray:
        value = self.ratio[self.places[i]]
        return np.append(value / max(np.sqrt(value @ value), 1e-9), 1.0)


def _descend(rows: Sequence[np.ndarray], values: Sequence[np.ndarray], signs: np.ndarray, size: int) -> np.ndarray:
    """Dual coordinate descent for the squared-norm regularised hinge loss; the last place is the bias."""
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(v @ v) for v in values])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if norms[i] == 0:
                continue
            at, value = rows[i], values[i]
            slope = signs[i] * float(weights[at] @ value) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), PENALTY)
            step = new - alpha[i]
            if step:
                weights[at] += step * signs[i] * value
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


def _sigmoid_fit(margins: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by damped Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((truth == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - target) * margins).sum(), (p - target).sum()])
        hess = np.array([[(w * margins ** 2).sum() + 1e-6, (w * margins).sum()],
                         [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, np.abs(step).max() / 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model: ratios, weights, bias and the sigmoid. Its size is ``2 ** BITS``, whatever the input's."""
    rows = handed_over(_training_rows(docs, labels, sample_rows), "nbsvm")
    n0, n1 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    totals = [0, 0]
    for place, a, b in _class_counts(rows).toArrow().to_pandas().itertuples(index=False):
        if place < 0:
            totals = [int(a), int(b)]
        else:
            n0[place], n1[place] = a, b
    prior = (totals[1] + 1) / (sum(totals) + 2)
    if not min(totals):
        return {"prior": prior}
    p, q = SMOOTHING + n1, SMOOTHING + n0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(n0 + n1) == 0] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        places = _views(table.column("places"))
        label = table.column("label").to_numpy()
        held = np.array(table.column("held").to_pylist(), bool)
        if len(set(label[~held])) < 2 or len(set(label[held])) < 2:
            held = np.zeros(len(held), bool)
        train = np.flatnonzero(~held)
        mine = [places[i] for i in train]
        weights = _descend(_Rows(mine, ratio), _Values(mine, ratio), 2.0 * label[train] - 1, len(ratio) + 1)
        mean = np.abs(weights[:-1]).sum() / max(1, np.count_nonzero(weights[:-1]))
        weights[:-1] = (1 - INTERPOLATION) * mean + INTERPOLATION * weights[:-1]
        check = np.flatnonzero(held) if held.any() else train
        rows, values = _Rows(places, ratio), _Values(places, ratio)
        margins = np.array([float(weights[rows[i]] @ values[i]) for i in check])
        slope, shift = _sigmoid_fit(margins, label[check])
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype(np.float64).tobytes()]), pa.array([slope]), pa.array([shift])],
            names=["weights", "slope", "shift"])

    # the sample is bounded by sample_rows, so one task may hold it; in id-free order of its content for reruns
    sample = rows.where("places is not null").select("label", "held", "places").repartition(1).sortWithinPartitions(
        "label", "held", "places")
    fitted = sample.mapInArrow(run, "weights binary, slope double, shift double").collect()
    if not fitted:
        return {"prior": prior}
    weights = np.frombuffer(fitted[0]["weights"], np.float64)
    return {"prior": prior, "ratio": ratio.astype(np.float32), "bias": float(weights[-1]),
            "weights": (weights[:-1] * ratio).astype(np.float32),
            "slope": fitted[0]["slope"], "shift": fitted[0]["shift"]}


def scores(column: pa.Array, model: dict, distinct: _Distinct) -> np.ndarray:
    """The probability of label 1 for each text of a slice."""
    out = np.full(len(column), model["prior"])
    if "weights" in model:
        for i, places in enumerate(features(column)):
            at = distinct(places)
            value = model["ratio"][at]
            margin = float(model["weights"][at].sum()) / max(float(np.sqrt(value @ value)), 1e-9) + model["bias"]
            out[i] = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["shift"], -30, 30)))
    return out


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every whole text, one Arrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = _Distinct()
        for part in slices(batches):
            out = scores(part.column("text"), model, distinct)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")


def good_documents(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = _Distinct()
        for part in slices(batches):
            yield part.filter(pa.array(scores(part.column("text"), model, distinct) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the training rows and score all: doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels, sample_rows))
    return out.select("doc_id", (key_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

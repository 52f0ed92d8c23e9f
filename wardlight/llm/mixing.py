"""Language-model scoring by online logistic context mixing.

Texts (A-Z lowered, as UTF-8, with an end byte) are predicted bit by bit. For
every order 0 to ``ORDER`` a predictor knows how often each node of a byte's
bit path followed a context in the training texts. The predictors' log-odds are
combined by two sets of weights: one gated by the longest known context and how
often it was seen, one by the bits of the byte so far. The weights learn
online, batch by batch, from the training texts (each occurrence is predicted
without itself), in every bucket of contexts on its own; buckets are averaged.
An adaptive table per gate then refines the mixed probability.

How it runs: one Arrow pass cuts the input into chunks and writes, for each,
its texts (compressed) and its distinct grams and tokens with their counts, as
blocks of one bucket. A bucket is a hash of the last three context bytes, so
all counts of orders 3 and above meet in one task; the counts of lower orders
(at most 2**24 grams) are sent to all. Buckets answer each chunk with the bits
its grams cost and the counts of its tokens, and a chunk adds them up by
document. What is shuffled are distinct grams of chunks, not occurrences, and
it grows with the input; nothing is sampled. On larger executors raise
``chunk_bytes``, so that grams repeat more often within a chunk.

Contexts, grams and tokens are compared by 64-bit keys: grams of up to six
bytes exactly, tokens by hash.

Defined results: null text is empty and scores its end alone; without training
texts every bit costs about one; repeated rows and ids are rows of their own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.textio import (
    handed_over, key_remainder, lowered, mix64, raw, slices, text_of, width, word_edges, word_hashes)

ORDER = 5
CHUNK_BYTES = 12 << 20
#: Bytes of text whose grams are sorted at once.
PIECE_BYTES = 1 << 19
MERGED_AT_ONCE = 5
END_BYTE = 0xFF
END_TOKEN = np.uint64(0x9E3779B97F4A7C15)
PRIOR = 0.1
#: Longest known order x how often it was seen (1, 2, 3-4, 5-8, 9-32, more), and no context at all.
SEEN_STEPS = np.array([2, 3, 5, 9, 33])
GATES = (ORDER + 1) * (len(SEEN_STEPS) + 1)
SETS = {"seen": GATES, "path": 255}
RATE, BATCH, PASSES = 0.3, 1 << 11, 2
TABLE_STEPS, TABLE_SPAN, TABLE_PRIOR = 33, 8.0, 50.0
GRAM, TOKEN, LOW, TEXT = 0, 1, 2, 3


def gram_stream(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of each text and at its end, oldest byte first, and the bounds of the texts.

    Contexts do not cross texts: before a text stand zero bytes.
    """
    data, bounds = raw(column)
    n = len(bounds) - 1
    gap = order + 1  # zeros before a text, the end byte behind it
    stream = np.zeros(len(data) + gap * n, np.uint8)
    moved = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(bounds)) * gap + order
    stream[moved] = lowered(data)
    ends = bounds[1:] + np.arange(n) * gap + order
    stream[ends] = END_BYTE
    keep = np.zeros(len(stream), bool)
    keep[moved] = True
    keep[ends] = True
    wide = stream.astype(np.uint64)
    gram = wide[order:].copy()
    for j in range(1, order + 1):
        gram |= wide[order - j:len(wide) - j] << np.uint64(8 * j)
    return gram[keep[order:]], bounds + np.arange(n + 1)


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with how often they occur or the sums of ``counts``."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if counts is not None else np.diff(np.append(first, len(keys)))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of a slice (words, then the end of each text) and the text each is in."""
    data, bounds = raw(column)
    data = lowered(data)
    starts, ends, rows = word_edges(data, bounds)
    n = len(bounds) - 1
    return (np.concatenate([word_hashes(data, starts, ends), np.full(n, END_TOKEN)]),
            np.concatenate([rows, np.arange(n)]))


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the three bytes before the last."""
    return (mix64((grams >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


BLOCKS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()),
                    ("counts", pa.binary())])
BLOCKS_DDL = "kind int, bucket int, chunk long, keys binary, counts binary"


def _shrunk(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as bytes with their count in front; rising ones as differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(values.tobytes(), asbytes=True)


def _grown(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n, width_ = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    out = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * width_, asbytes=True), kind)
    return np.cumsum(out, dtype=kind) if rising else out


def _block(kind: int, bucket: int, chunk: int, keys: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
        (kind, bucket, chunk, keys, counts), BLOCKS.types, strict=True)], schema=BLOCKS)


def _in_buckets(kind: int, chunk: int, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray,
                buckets: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")  # keys stay in order within a bucket
    keys, counts = keys[order], counts[order]
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if at[b] < at[b + 1]:
            yield _block(kind, b, chunk, _shrunk(keys[at[b]:at[b + 1]].astype(np.uint64), True),
                         _shrunk(counts[at[b]:at[b + 1]].astype(np.int64)))


def _chunk_sets(texts: pa.Array, train: np.ndarray) -> tuple[tuple, tuple]:
    """(grams, training counts), (tokens, training counts) of the texts of a chunk; what only held-out texts have counts 0."""
    grams, tokens = [], []
    for part in slices(iter([pa.record_batch({"text": texts, "train": pa.array(train)})]), "text", PIECE_BYTES):
        column, is_train = part.column("text"), part.column("train").to_numpy(zero_copy_only=False)
        gram, bounds = gram_stream(column)
        token, rows = _tokens(column)
        for kind, keys, learn in ((grams, gram, np.repeat(is_train, np.diff(bounds))), (tokens, token, is_train[rows])):
            known = _counted(keys[learn])
            other = _counted(keys[~learn])[0]
            kind.append((np.concatenate([known[0], other]), np.concatenate([known[1], np.zeros(len(other), np.int64)])))
            if len(kind) == MERGED_AT_ONCE:
                kind[:] = [_merged(kind)]
    return _merged(grams), _merged(tokens)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def _chunked(docs: DataFrame, buckets: int, chunk_bytes: int) -> DataFrame:
    """``docs`` (doc_id, text, train) as rows of chunks: their texts, blocks of grams and tokens, low-order counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for part in slices(_joined(batches, chunk_bytes), "text", chunk_bytes):
            chunk = (task << 24) | number
            number += 1
            train = part.column("train").to_numpy(zero_copy_only=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            yield _block(TEXT, 0, chunk, sink.getvalue().to_pybytes(), b"")
            (grams, gram_counts), (tokens, token_counts) = _chunk_sets(part.column("text"), train)
            yield from _in_buckets(GRAM, chunk, grams, gram_counts, _bucket_of(grams, buckets), buckets)
            yield from _in_buckets(TOKEN, chunk, tokens, token_counts,
                                   (mix64(tokens) % np.uint64(buckets)).astype(np.int64), buckets)
            seen = gram_counts > 0
            low, low_counts = _counted(grams[seen] & np.uint64(0xFFFFFF), gram_counts[seen])
            yield from _in_buckets(LOW, chunk, low, low_counts, (low & np.uint64(15)).astype(np.int64), 16)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, BLOCKS_DDL)


def _joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Put small batches together, up to ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys and counts of a bucket's blocks, and where each block starts."""
    keys = [_grown(k, np.uint64, True) for k in table.column("keys").to_pylist()]
    counts = [_grown(c, np.int64) for c in table.column("counts").to_pylist()]
    return (np.concatenate(keys), np.concatenate(counts), np.cumsum([0, *map(len, keys)]))


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts, _ = _blocks(table)
    return _counted(keys, counts)


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Predictors:
    """For distinct grams, how often each node of the last byte's path followed each context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> None:
        self.grams, self.counts = grams, counts
        self.low_keys, self.low_counts = low
        self.nodes = [self._nodes(o) for o in range(ORDER + 1)]

    def _nodes(self, order: int) -> np.ndarray:
        """(grams, 9): occurrences of the context, then of the path after each bit."""
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        if order < 3:
            keys, counts = _counted(self.low_keys & mask, self.low_counts)
        else:
            keys, counts = _counted(self.grams & mask, self.counts)
        running = np.concatenate([[0], np.cumsum(counts)])
        own = self.grams & mask
        out = np.empty((len(own), 9), np.float32)  # only their logarithms are used
        for depth in range(9):
            rest = np.uint64(8 - depth)
            first = (own >> rest) << rest
            last = first | np.uint64((1 << (8 - depth)) - 1)
            out[:, depth] = (running[np.searchsorted(keys, last, side="right")]
                             - running[np.searchsorted(keys, first, side="left")])
        return out

    def inputs(self, at: np.ndarray, without_self: bool) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Log-odds (events, orders + bias), the gates and the bits; events are the 8 bits of each gram of ``at``."""
        byte = (self.grams[at] & np.uint64(255)).astype(np.int64)
        bits = (byte[:, None] >> np.arange(7, -1, -1)) & 1
        node = (1 << np.arange(8)) - 1 + (byte[:, None] >> (8 - np.arange(8)))
        odds = np.zeros((len(at), 8, ORDER + 2), np.float32)
        longest = np.zeros((len(at), 8), np.int64)
        seen = np.zeros((len(at), 8), np.int64)
        for o in range(ORDER + 1):
            n = self.nodes[o][at] - (1 if without_self else 0)
            total, taken = np.maximum(n[:, :-1], 0), np.maximum(n[:, 1:], 0)
            odds[:, :, o] = np.log((taken + PRIOR) / (total - taken + PRIOR)) * np.where(bits == 1, 1, -1)
            known = total > 0
            longest = np.where(known, o, longest)
            seen = np.where(known, total, seen)
        odds[:, :, ORDER + 1] = 0.3
        gate = longest * (len(SEEN_STEPS) + 1) + np.searchsorted(SEEN_STEPS, seen, side="right")
        return odds.reshape(-1, ORDER + 2), {"seen": gate.ravel(), "path": node.ravel()}, bits.ravel()


def start_model() -> dict[str, np.ndarray]:
    weights = np.full((ORDER + 2), 0.5 / len(SETS), np.float64)
    weights[-1] = 0.0
    return {name: np.tile(weights, (size, 1)) for name, size in SETS.items()} | {
        "table": np.zeros((GATES, TABLE_STEPS, 2))}


def _mixed(model: dict, odds: np.ndarray, gates: dict[str, np.ndarray]) -> np.ndarray:
    """The combined log-odds."""
    return (sum(model[name][gates[name]] for name in SETS) * odds).sum(axis=1)


def learn_bucket(predictors: Predictors, seed: int) -> dict[str, np.ndarray]:
    """Online passes over a bucket's training grams; each occurrence counts, and is predicted without itself."""
    model = start_model()
    squares = {name: np.full((size, 1), 1e-2) for name, size in SETS.items()}
    known = np.flatnonzero(predictors.counts > 0)
    order = np.random.default_rng(seed)
    for turn in range(PASSES):
        for k in range(0, len(known), BATCH):
            if k == 0:
                known = order.permutation(known)
            at = known[k:k + BATCH]
            odds, gates, bits = predictors.inputs(at, True)
            times = np.repeat(predictors.counts[at].astype(np.float64), 8)
            mixed = _mixed(model, odds, gates)
            error = (bits - _squash(mixed)) * times
            if turn == PASSES - 1:
                step = np.clip((np.clip(mixed, -TABLE_SPAN, TABLE_SPAN) / TABLE_SPAN + 1) / 2 * (TABLE_STEPS - 1), 0,
                               TABLE_STEPS - 1).round().astype(np.int64)
                place = gates["seen"] * TABLE_STEPS + step
                model["table"][:, :, 0] += np.bincount(place, times, GATES * TABLE_STEPS).reshape(GATES, -1)
                model["table"][:, :, 1] += np.bincount(place, times * bits, GATES * TABLE_STEPS).reshape(GATES, -1)
            for name, size in SETS.items():
                where = gates[name]
                share = np.bincount(where, times, size)
                slope = np.stack([np.bincount(where, error * odds[:, i], size) for i in range(ORDER + 2)], 1)
                slope /= np.maximum(share, 1)[:, None]
                squares[name] += (slope ** 2).mean(axis=1, keepdims=True)
                model[name] += RATE * slope / np.sqrt(squares[name])
    model["weight"] = np.array([float(predictors.counts.sum())])
    return model


def averaged(models: list[dict]) -> dict[str, np.ndarray]:
    """Weights averaged by occurrences; the refinement tables add up."""
    start = start_model()
    total = sum(float(m["weight"][0]) for m in models)
    if not total:
        return start
    out = {k: sum(m[k] * (float(m["weight"][0]) / total) for m in models) for k in SETS}
    return out | {"table": sum(m["table"] for m in models)}


def gram_bits(predictors: Predictors, model: dict) -> np.ndarray:
    """Bits that the last byte of each gram costs under the model."""
    centre = _squash(np.linspace(-TABLE_SPAN, TABLE_SPAN, TABLE_STEPS))
    table = (model["table"][:, :, 1] + TABLE_PRIOR * centre) / (model["table"][:, :, 0] + TABLE_PRIOR)
    out = np.empty(len(predictors.grams), np.float32)
    for k in range(0, len(out), BATCH):
        at = np.arange(k, min(k + BATCH, len(out)))
        odds, gates, bits = predictors.inputs(at, False)
        gate, mixed = gates["seen"], _mixed(model, odds, gates)
        place = (np.clip(mixed, -TABLE_SPAN, TABLE_SPAN) / TABLE_SPAN + 1) / 2 * (TABLE_STEPS - 1)
        left = np.minimum(place.astype(np.int64), TABLE_STEPS - 2)
        part = place - left
        refined = table[gate, left] * (1 - part) + table[gate, left + 1] * part
        p = np.clip((_squash(mixed) + refined) / 2, 1e-7, 1 - 1e-7)
        out[at] = -np.log2(np.where(bits == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)
    return out


def _packed(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(model[k].astype(np.float64).tobytes() for k in (*SETS, "table", "weight"))


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    shapes = {name: (size, ORDER + 2) for name, size in SETS.items()} | {"table": (GATES, TABLE_STEPS, 2), "weight": (1,)}
    values, out, at = np.frombuffer(data, np.float64), {}, 0
    for name, shape in shapes.items():
        size = int(np.prod(shape))
        out[name] = values[at:at + size].reshape(shape)
        at += size
    return out


def _learned(blocks: DataFrame, low: tuple[np.ndarray, np.ndarray]) -> tuple[dict, int, int]:
    """The averaged model, and the number and the distinct number of training tokens."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, counts = _summed(table)
        keys, counts = keys[counts > 0], counts[counts > 0]
        model = b""
        if kind == GRAM and len(keys):
            model = _packed(learn_bucket(Predictors(keys, counts, low), bucket))
        return pa.table({"kind": pa.array([kind], pa.int32()), "n": pa.array([int(counts.sum())], pa.int64()),
                         "distinct": pa.array([len(keys)], pa.int64()), "model": pa.array([model], pa.binary())})

    out = (blocks.where(F.col("kind").isin(GRAM, TOKEN)).select("kind", "bucket", "keys", "counts")
           .groupBy("kind", "bucket").applyInArrow(run, "kind int, n long, distinct long, model binary"))
    models, tokens, distinct = [], 0, 0
    for row in out.toLocalIterator():  # one small model a bucket, added up as they come
        if row["kind"] == TOKEN:
            tokens, distinct = tokens + row["n"], distinct + row["distinct"]
        elif row["model"]:
            models.append(_unpacked(bytes(row["model"])))
            if len(models) == 64:
                models = [averaged(models) | {"weight": sum(m["weight"] for m in models)}]
    return averaged(models), tokens, distinct


def _low_counts(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of all three-byte grams: at most 2**24 of them, whatever the input."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _summed(table)
        return pa.table({"keys": pa.array([keys.astype(np.uint32).tobytes()], pa.binary()),
                         "counts": pa.array([counts.tobytes()], pa.binary())})

    rows = (blocks.where(F.col("kind") == LOW).select("bucket", "keys", "counts").groupBy("bucket")
            .applyInArrow(run, "keys binary, counts binary").collect())
    keys = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r["keys"], np.uint32) for r in rows)]).astype(np.uint64)
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)])
    order = np.argsort(keys)
    return keys[order], counts[order]


def _answers(blocks: DataFrame, low: tuple[np.ndarray, np.ndarray], model: dict) -> DataFrame:
    """(chunk, kind, bucket, values): bits of the grams, counts of the tokens of each chunk, in its blocks' order."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        keys, counts, at = _blocks(table)
        distinct, total = _counted(keys, counts)
        value = gram_bits(Predictors(distinct, total, low), model) if kind == GRAM else total
        value = value[np.searchsorted(distinct, keys)]
        return pa.table({"chunk": table.column("chunk"), "kind": table.column("kind"), "bucket": table.column("bucket"),
                         "answer": pa.array([_shrunk(value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)],
                                            pa.binary())})

    return (blocks.where(F.col("kind").isin(GRAM, TOKEN)).groupBy("kind", "bucket")
            .applyInArrow(run, "chunk long, kind int, bucket int, answer binary"))


def _score_chunk(buckets: int, tokens: int, distinct: int):
    base = np.log10(float(tokens + distinct + 1))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        docs = pa.ipc.open_stream(texts.column("keys")[0].as_buffer()).read_all().combine_chunks().to_batches()[0]
        train = docs.column("train").to_numpy(zero_copy_only=False)
        (grams, _), (token_keys, _) = _chunk_sets(docs.column("text"), train)
        found: dict[int, dict[int, bytes]] = {GRAM: {}, TOKEN: {}}
        for kind, bucket, answer in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "answer")),
                                        strict=True):
            found[kind][bucket] = answer
        cost = _laid_out(found[GRAM], _bucket_of(grams, buckets), np.float32)
        known = _laid_out(found[TOKEN], (mix64(token_keys) % np.uint64(buckets)).astype(np.int64), np.int64)
        out = {"bits": [], "n_bytes": [], "n_tokens": [], "n_known": [], "base_score": []}
        for part in slices(iter([docs]), "text", PIECE_BYTES):
            n = part.num_rows
            gram, bounds = gram_stream(part.column("text"))
            each = cost[np.searchsorted(grams, gram)].astype(np.float64)
            out["bits"].append(np.add.reduceat(each, bounds[:-1]))
            out["n_bytes"].append(np.diff(bounds) - 1)
            token, rows = _tokens(part.column("text"))
            times = known[np.searchsorted(token_keys, token)]
            out["n_tokens"].append(np.bincount(rows, minlength=n))
            out["n_known"].append(np.bincount(rows[times > 0], minlength=n))
            out["base_score"].append(np.bincount(rows, np.log10(times + 1.0), n) - base * out["n_tokens"][-1])
        bits = np.concatenate(out["bits"])
        size = np.concatenate(out["n_bytes"])
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": pa.array(~train),
            "n_tokens": pa.array(np.concatenate(out["n_tokens"]).astype(np.int64)),
            "n_known": pa.array(np.concatenate(out["n_known"]).astype(np.int64)),
            "base_score": pa.array(np.concatenate(out["base_score"])), "score": pa.array(-bits * np.log10(2.0)),
            "bits_per_byte": pa.array(bits / np.maximum(size, 1))})

    return run


def _laid_out(answers: dict[int, bytes], bucket: np.ndarray, kind: type) -> np.ndarray:
    """Values of the blocks, back in the order of the chunk's keys."""
    out = np.zeros(len(bucket), kind)
    order = np.argsort(bucket, kind="stable")
    values = [_grown(answers[b], kind) for b in sorted(answers)]
    if values:
        out[order] = np.concatenate(values)
    return out


def score_texts(docs: DataFrame, train, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``train`` is a boolean column: the rows to learn from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), train.alias("train"))
    buckets = max(16, width(docs))
    blocks = handed_over(_chunked(rows, buckets, chunk_bytes), "mixing")
    low = _low_counts(blocks)
    model, tokens, distinct = _learned(blocks, low)
    answers = _answers(blocks, low, model)
    scored = (blocks.where(F.col("kind") == TEXT).select("chunk", "keys").groupBy("chunk")
              .cogroup(answers.groupBy("chunk")).applyInArrow(
        _score_chunk(buckets, tokens, distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "bits_per_byte double"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                         "base_score", "score", "bits_per_byte")


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the training part of ``docs`` and score all."""
    return score_texts(docs, key_remainder("doc_id", 7) != 2)

"""Document fingerprints: SimHash with permuted block tables.

The terms of a text are its words (A-Z lowered) and its pairs of adjacent
words. A term's weight is its length in bytes (both words' mean for a pair, at
most 16) times ``1 + log2`` of how often the text has it. Each term votes with
its weight for or against every bit of its 128-bit hash; a bit of the
fingerprint is set where the votes are positive. Likeness is the share of
equal bits.

``within_radius`` finds all pairs of fingerprints that differ in at most
``radius`` bits: the bits are cut into blocks, and for every choice of
``blocks - radius`` of them there is a table keyed by the chosen blocks; two
fingerprints in reach agree in at least one table.

Defined results: null text is empty; a text without words has the fingerprint
0; equal texts have equal fingerprints; in the order by id nulls come last and
equal ids follow their text; repeated rows are rows of their own; with one row
it is its own next; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.textio import lowered, mix64, raw, slices, text_of, width, word_edges, word_hashes

BITS = 128
LONGEST = 16
RADIUS, BLOCKS = 3, 4
#: Terms whose bits are held at once.
TERMS_AT_ONCE = 1 << 15


def fingerprints(column: pa.Array) -> np.ndarray:
    """Two unsigned 64-bit halves for each text of a slice."""
    data, bounds = raw(column)
    data = lowered(data)
    starts, ends, rows = word_edges(data, bounds)
    words = word_hashes(data, starts, ends)
    size = np.minimum(ends - starts, LONGEST).astype(np.float32)
    with np.errstate(over="ignore"):
        pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]
    pair_size = (size[:-1] + size[1:]) / 2
    at = np.searchsorted(rows, np.arange(len(bounds)))
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for i in range(len(bounds) - 1):
        a, b = at[i], at[i + 1]
        if a == b:
            continue
        terms = np.concatenate([words[a:b], pairs[a:b - 1]])
        weigh = np.concatenate([size[a:b], pair_size[a:b - 1]])
        order = np.argsort(terms)
        terms = terms[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        times = np.diff(np.append(first, len(terms)))
        weight = weigh[order][first] * (1 + np.log2(times)).astype(np.float32)
        terms = terms[first]
        votes = np.zeros(BITS, np.float64)
        for k in range(0, len(terms), TERMS_AT_ONCE):
            part = terms[k:k + TERMS_AT_ONCE]
            both = np.stack([part, mix64(part ^ np.uint64(0xD1B54A32D192ED03))], 1).astype(">u8")
            bits = np.unpackbits(both.view(np.uint8), axis=1).reshape(len(part), BITS)
            w = weight[k:k + TERMS_AT_ONCE]
            votes += 2 * (w @ bits.astype(np.float32)).astype(np.float64) - float(w.sum())
        out[i] = np.packbits(votes > 0).view(">u8").astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(prints: np.ndarray) -> list[str]:
    return [f"{int(a):016x}{int(b):016x}" for a, b in prints]


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as text, and its halves as signed longs (high, low) for the block tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = fingerprints(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(_hex(found), pa.string()), pa.array(found[:, 0].view(np.int64)),
                 pa.array(found[:, 1].view(np.int64))], names=["doc_id", "fingerprint", "high", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string, high long, low long")


def _block(i: int, blocks: int, high: Column, low: Column) -> Column:
    size = BITS // blocks
    half, at = (high, i) if i < blocks // 2 else (low, i - blocks // 2)
    return F.shiftrightunsigned(half, 64 - size * (at + 1)).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))


def within_radius(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (fingerprint, other, distance) of different fingerprints at most ``radius`` bits apart.

    ``prints`` is a ``fingerprint_table``; equal fingerprints count once, so
    copies are not paired: join the table back for membership. A pair is
    reported by the first table in which it agrees. ``blocks`` must be even and
    above ``radius``; more blocks make longer keys, and more tables.
    """
    if blocks % 2 or BITS % blocks or not 0 <= radius < blocks:
        raise ValueError("blocks must be even, divide the bits and exceed the radius")
    tables = list(combinations(range(blocks), blocks - radius))
    distinct = prints.select("fingerprint", "high", "low").distinct()
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.concat_ws("-", *[
        F.hex(_block(i, blocks, F.col("high"), F.col("low"))) for i in chosen]).alias("key"))
        for t, chosen in enumerate(tables)])
    keyed = distinct.select("*", F.explode(keys).alias("k")).select("fingerprint", "high", "low", "k.table", "k.key")
    a, b = keyed.alias("a"), keyed.alias("b")
    differ = lambda i: (_block(i, blocks, F.col("a.high"), F.col("a.low"))
                        != _block(i, blocks, F.col("b.high"), F.col("b.low")))
    earlier = F.lit(False)
    for t, chosen in enumerate(tables):
        agrees = F.lit(True)
        for i in chosen:
            agrees = agrees & ~differ(i)
        earlier = earlier | ((F.col("a.table") > t) & agrees)
    distance = (F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high")))
                + F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low"))))
    return (a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key"))
                   & (F.col("a.fingerprint") < F.col("b.fingerprint")) & (distance <= radius) & ~earlier)
            .select(F.col("a.fingerprint").alias("fingerprint"), F.col("b.fingerprint").alias("other"),
                    distance.cast("int").alias("distance")))


def _routed(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Each row in its range of ids, and the first row of a range once more behind the range that comes before it.

    ``bounds`` are ids that occur, the largest id last: the first row, by
    falling id, of range k is the one with id ``bounds[k]``; it follows the
    last row of range k + 1. The largest id also follows the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(bounds)
        for batch in batches:
            ids = batch.column("doc_id")
            known = ~ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            home = np.where(known, np.searchsorted(bounds, value) if n else 0, 0)
            first = known & (bounds[np.minimum(home, n - 1)] == value) if n > 1 else np.zeros(len(value), bool)
            for rows, where, marker in ((np.arange(len(value)), home, False),
                                        (np.flatnonzero(first), (home[first] + 1) % max(n, 1), True)):
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where.astype(np.int32)), pa.array(np.full(len(rows), marker)), part.column("doc_id"),
                     part.column("text")], names=["range", "marker", "doc_id", "text"])

    return docs.mapInArrow(run, "range int, marker boolean, doc_id long, text string")


def _edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like they and the next document's are.

    The edited text ends with the start of the next document by falling id, so
    documents are dealt by id ranges: whole rows are shuffled once, and each
    range brings the one row that follows it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = width(docs)
    steps = [float(q) for q in np.linspace(0, 1, 4 * parts + 1)[1:]]
    found = rows.agg(F.percentile_approx("doc_id", steps, 20 * len(steps)).alias("q"),
                     F.max("doc_id").alias("top")).first()
    bounds = np.array(sorted({*(found["q"] or []), *([] if found["top"] is None else [found["top"]])}), np.int64)

    def finish(held: list[tuple], after: tuple) -> pa.RecordBatch:
        """``held``: (doc_id, text) in order, all of one range; ``after``: what follows the last."""
        texts = [t for _, t in held]
        edited = [_edited(t, o) for t, o in zip(texts, [*texts[1:], after[1]], strict=True)]
        own = fingerprints(pa.array([*texts, after[1]], pa.large_string()))
        new = fingerprints(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in held], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
             pa.array(_hex(own[:-1]), pa.string()), pa.array(_hex(new), pa.string()),
             pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the range at hand that wait for the row after them
        current, first, ended = None, None, False
        for part in slices(batches):
            for rng, marker, doc_id, text in zip(*(part.column(c).to_pylist() for c in (
                    "range", "marker", "doc_id", "text")), strict=True):
                if rng != current:
                    if held:  # no marker: the only range; its first row follows its last
                        yield finish(held, first)
                    held, current, first, ended = [], rng, (doc_id, text), False
                if marker:
                    if held and not ended:
                        yield finish(held, (doc_id, text))
                        held = []
                    ended = True
                else:
                    held.append((doc_id, text))
            if len(held) > 1:
                yield finish(held[:-1], held[-1])
                held = held[-1:]
        if held:
            yield finish(held, first)

    dealt = (_routed(rows, bounds).repartition(parts, "range")
             .sortWithinPartitions("range", "marker", F.col("doc_id").desc_nulls_last(), "text"))
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")

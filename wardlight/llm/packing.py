"""Bounded-space online packing of token sequences.

Each partition keeps ``OPEN`` windows of ``LENGTH`` tokens. A document is cut
into full windows and one rest; the rest goes into the open window that it
fills best; when none has room, a new window opens, and if all ``OPEN`` are
in use the fullest is emitted first. Windows still open at the end of a
partition are merged in groups of ``FAN`` partitions, level by level: their
pieces are placed anew, longest first. A group hands on at most
``open_windows`` of them, so no task sees more than ``FAN`` times that many.

Token ids come from a public tokenizer file; every text is encoded whole.

Defined results: null and empty texts are the end id alone; repeated rows and
ids are documents of their own; extra columns are ignored; an empty table
gives an empty result. A document id repeated in the table has one run of
pieces for each of its rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.textio import handed_over, raw, slices, text_of
from wardlight.llm.tokens import ByteLevel, byte_level_path

LENGTH = 1024
OPEN = 64
FAN = 64
END = 0
#: A leftover window with no more room than this is not merged again.
NEARLY_FULL = 8
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("part", pa.int64()), ("open", pa.bool_())])
PIECES_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "part long, open boolean")


class PieceEncoder:
    """Ids of whole texts, each closed by the end id."""

    def __init__(self, path: str) -> None:
        self.encode = ByteLevel(path)

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, bounds = raw(column)
        for i in range(len(bounds) - 1):
            text = data[bounds[i]:bounds[i + 1]].tobytes().decode("utf-8", "replace")
            yield np.append(self.encode(text), np.uint32(END))


class Windows:
    """At most ``limit`` open windows; places best-fit, hands over closed ones through ``emit``."""

    def __init__(self, limit: int, emit: Callable[[list], None], length: int = LENGTH) -> None:
        self.limit, self.emit, self.length = limit, emit, length
        self.room: list[tuple[int, int]] = []  # (room, key), sorted
        self.held: dict[int, list] = {}
        self.count = 0

    def place(self, size: int, items: list) -> None:
        if size >= self.length:
            self.emit(items)
            return
        at = bisect.bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, key = self.room.pop(at)
            self.held[key].extend(items)
        else:
            if len(self.room) >= self.limit:
                _, key = self.room.pop(0)
                self.emit(self.held.pop(key))
            room, key = self.length, self.count
            self.count += 1
            self.held[key] = items
        if room == size:
            self.emit(self.held.pop(key))
        else:
            bisect.insort(self.room, (room - size, key))

    def left(self) -> list[tuple[int, list]]:
        """What is still open, fullest first, as (tokens, items)."""
        return [(self.length - room, self.held[key]) for room, key in self.room]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in PIECES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES.types, strict=True)], schema=PIECES)


def _rows(items: list, sequence: int, part: int, is_open: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, length, crc, tokens in items:
        yield doc_id, start, length, crc, tokens, sequence, offset, part, is_open
        offset += length


def _pack_partition(path: str, open_windows: int, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = PieceEncoder(path), TaskContext.get().partitionId()
        out: list[tuple] = []
        made = 0

        def emit(items: list) -> None:
            nonlocal made
            out.extend(_rows(items, (part << 32) | made, part, False))
            made += 1

        windows = Windows(open_windows, emit, length)
        for batch in slices(batches):
            docs = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(docs, encode(batch.column("text")), strict=True):
                exact = ids.astype("<u4")
                for start in range(0, len(ids), length):
                    piece = exact[start:start + length]
                    windows.place(len(piece), [(doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))])
            yield _batch(out)
            out.clear()
        for _, items in windows.left():
            out.extend(_rows(items, (part << 32) | made, part, True))
            made += 1
        yield _batch(out)

    return run


def _merge_group(level: int, last: bool, length: int, open_windows: int = OPEN) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        group = rows[0]["part"] // FAN
        items = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
        out: list[tuple] = []
        made = 0

        def number() -> int:
            nonlocal made
            made += 1
            return (level << 58) | (group << 32) | made

        # all pieces are at hand, so the longest go first, best-fit over any number of windows
        windows = Windows(len(items), lambda x: out.extend(_rows(x, number(), group, False)), length)
        for item in sorted(items, key=lambda i: -i[2]):
            windows.place(item[2], [item])
        # the next level gets the emptiest ones, at most as many as a partition hands on
        left = windows.left()
        for i, (size, held) in enumerate(left, open_windows - len(left)):
            out.extend(_rows(held, number(), group, not last and i >= 0 and length - size > NEARLY_FULL))
        return pa.Table.from_batches([_batch(out)])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, open_windows: int = OPEN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or byte_level_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    packed = handed_over(rows.mapInArrow(_pack_partition(path, open_windows, length), PIECES_DDL), "packed")
    done, level = packed.where("not open"), 1
    parts = packed.where("open").agg(F.max("part")).first()[0]
    waiting = packed.where("open")
    while parts is not None:
        merged = waiting.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(
            _merge_group(level, parts < FAN, length, open_windows), PIECES_DDL)
        if parts < FAN:
            done = done.unionByName(merged)
            break
        merged = handed_over(merged, "merged")
        done, waiting = done.unionByName(merged.where("not open")), merged.where("open")
        parts, level = parts // FAN, level + 1
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

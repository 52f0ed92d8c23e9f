"""Shared byte-level text handling for the operators that run in Arrow batches, and the shared-folder hand-over.

Texts are handled as UTF-8 bytes. ASCII white space (0x20, 0x09-0x0D) never
occurs inside a multi-byte character, so runs of other bytes are exactly the
words ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import setting, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that an Arrow operator works on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bits of the largest filter of ids.
MARK_BITS = 1 << 26
#: Spark's setting to delete the shuffle files of a statement when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def low(column: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.translate(column, UPPER, LOWER)


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def key_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(modulus))


def width(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows: as many as the scan has splits, or the session's number."""
    spark = df.sparkSession
    return max(int(setting(spark, "spark.sql.shuffle.partitions") or 200), df.rdd.getNumPartitions())


def handed_over(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and later reads are pruned by column.

    The shuffle files of the write go when it ends; otherwise they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete folders of ``handed_over`` that no plan needs any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Marks:
    """A bitmap of the hashed ids of a table, about 16 bits an id and at most ``MARK_BITS``.

    It spares work before a join by id: rows without a mark have no partner.
    Past its bound it fills up and more rows pass; the join decides.
    """

    def __init__(self, ids: DataFrame) -> None:
        self.bits = min(MARK_BITS, 1 << max(16, int(16 * ids.count()).bit_length()))
        position = self.place("doc_id") + 1
        rows = (ids.groupBy(F.bitmap_bucket_number(position).alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")).collect())
        out = np.zeros(self.bits, bool)
        for r in rows:
            part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
            at = (r["bucket"] - 1) * len(part)
            out[at:at + len(part)] = part[:self.bits - at]
        self.marks = np.packbits(out)

    def place(self, doc_id: str) -> Column:
        return F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(self.bits)).alias("at")

    def keep(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a batch with a column ``at`` that are marked."""
        at = batch.column("at").to_numpy()
        return batch.filter(pa.array(((self.marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)))


class HashMarks:
    """A bitmap of 64-bit hashes, about 16 bits a hash and at most ``MARK_BITS``; past that more hashes seem to be found."""

    @staticmethod
    def of(df: DataFrame, column: str) -> np.ndarray:
        bits = min(MARK_BITS, 1 << max(16, int(16 * df.count()).bit_length()))
        position = F.col(column).bitwiseAND(bits - 1) + 1
        rows = (df.groupBy(F.bitmap_bucket_number(position).alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")).collect())
        out = np.zeros(bits >> 3, np.uint8)
        for r in rows:
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            at = (r["bucket"] - 1) * len(part)
            out[at:at + len(part)] = part[:len(out) - at]
        return out

    @staticmethod
    def found(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) & np.uint64(8 * len(marks) - 1)
        return ((marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one array and the row bounds in it; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def lowered(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it is in; words end at row bounds."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~blank(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, starts
    # the word ends at the next blank or at the next start, whichever comes first
    stops = np.flatnonzero(~inside)
    ends = stops[np.searchsorted(stops, starts)]
    ends[:-1] = np.minimum(ends[:-1], starts[1:])
    rows = np.searchsorted(bounds, starts, side="right") - 1
    ends = np.minimum(ends, bounds[rows + 1])
    return starts, ends, rows


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as one Arrow binary array."""
    cover = np.zeros(len(data) + 1, np.int8)
    np.add.at(cover, starts, 1)
    np.add.at(cover, ends, -1)
    kept = data[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)] if len(data) else data
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts),
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dense codes of the words in this slice, and the distinct words in code order."""
    coded = word_array(data, starts, ends).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, equal for equal words in any slice.

    A word is read as up to eight bytes at a time; the parts are chained.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    sizes = (ends - starts).astype(np.int64)
    out = mix64(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, step = np.arange(len(starts)), 0
    while len(live):
        at = starts[live] + step
        left = sizes[live] - step
        part = np.zeros(len(live), np.uint64)
        for j in range(8):
            part |= np.where(left > j, padded[at + j], 0).astype(np.uint64) << np.uint64(8 * j)
        with np.errstate(over="ignore"):
            out[live] = mix64(out[live] * np.uint64(0x9E3779B97F4A7C15) ^ part)
        step += 8
        live = live[left > 8]
    return out


def sums_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n) if len(rows) else np.zeros(n)

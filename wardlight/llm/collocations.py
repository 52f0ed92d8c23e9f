"""Phrase collocations counted in quotient filters.

Words are counted per language; those counted often enough get dense numbers,
since a phrase is never more frequent than its words. Texts become streams of
these numbers, where 0 is a break: the end of a piece, or a rarer word. Phrases
of two words and more are counted length by length in counting quotient
filters (``quotient``); a longer phrase is counted only where both phrases one
word shorter are frequent. A bitmap of bounded size says so; past its bound it
lets more through, and the exact counts decide.

Spread: texts are read once and kept as blocks of codes with each block's
distinct words, so that a frequent word is one row a block when words are
counted and when their numbers come back. A task fills filters of at most
``ENTRIES`` entries. Filters are merged in rounds: groups of ``FAN`` filters
by ``FAN`` ranges of the quotient, so no group holds more than about one full
filter's entries however many filters there are; permuted numbers are spread
evenly, so no phrase or prefix makes a hot range. Scores are computed with
decimals of 38 digits; only the candidates (at most a hundredth of the words)
are joined.

Defined results: a null language is ``und``; null and empty texts have no
words; repeated rows and ids count each time; ties in score and count go by
the phrase's bytes; extra columns are ignored; an empty table, or one without
frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.alignment import packed, unpacked
from wardlight.llm.quotient import Filter
from wardlight.llm.textio import HashMarks, handed_over, lowered, mix64, raw, release, slices, text_of, word_codes
from wardlight.session import broadcast_if_fits

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Filters merged in one group, and ranges of the quotient that one round deals out.
FAN_BITS = 6
FAN = 1 << FAN_BITS
#: Entries of the filter that a task fills before it hands it over.
ENTRIES = 2_000_000
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
#: Characters that end a piece, besides the line ends 0x0A to 0x0D.
BREAKS = b".,;:!?"
UNKNOWN = "und"

BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("stream", pa.large_binary()), ("lang", pa.list_(pa.string())),
                    ("word", pa.list_(pa.string())), ("count", pa.list_(pa.int64()))])
BLOCKS_DDL = "block long, n long, stream binary, lang array<string>, word array<string>, count array<long>"
STREAMS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("stream", pa.binary())])
FILTERS = pa.schema([("part", pa.int64()), ("range", pa.int64()), ("filter", pa.binary())])
GRAMS = pa.schema([("ids", pa.list_(pa.int64())), ("f", pa.int64()), ("mark", pa.int64())])


def _classes() -> np.ndarray:
    """0 for bytes of words, 1 for blanks, 2 for what ends a piece."""
    out = np.zeros(256, np.uint8)
    out[[32, 9]] = 1
    out[[*BREAKS, 10, 11, 12, 13]] = 2
    return out


CLASSES = _classes()


def piece_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, and whether a piece ends between it and the word before."""
    kind = CLASSES[data]
    inside = np.append(kind == 0, False)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, starts, np.zeros(0, bool)
    stops = np.flatnonzero(~inside)
    ends = stops[np.searchsorted(stops, starts)]
    ends[:-1] = np.minimum(ends[:-1], starts[1:])
    rows = np.searchsorted(bounds, starts, side="right") - 1
    ends = np.minimum(ends, bounds[rows + 1])
    broken = np.cumsum(kind == 2)[starts]
    apart = np.ones(len(starts), bool)
    apart[1:] = (broken[1:] != broken[:-1]) | (rows[1:] != rows[:-1])
    return starts, ends, rows, apart


class Block:
    """A stream of codes of (language, word), 0 between pieces, and the distinct words with their counts."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.parts: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []  # langs, words, codes, apart

    def add(self, batch: pa.RecordBatch) -> None:
        data, bounds = raw(batch.column("text"))
        self.size += len(data)
        starts, ends, rows, apart = piece_words(lowered(data), bounds)
        if not len(starts):
            return
        codes, words = word_codes(lowered(data), starts, ends)
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows]
        both, codes = np.unique(lang * len(words) + codes, return_inverse=True)
        self.parts.append((langs.dictionary.take(pa.array(both // len(words))),
                           words.take(pa.array(both % len(words))), codes, apart))

    def row(self) -> pa.RecordBatch:
        """Codes from 1, frequent words first."""
        if not self.parts:
            stream, names = np.zeros(0, np.uint32), pa.table({"lang": pa.array([], pa.string()),
                                                             "word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        else:
            langs, words = (pa.concat_arrays([p[i] for p in self.parts]) for i in (0, 1))
            words = words.cast(pa.binary()).cast(pa.string(), safe=False)
            counts = pa.array(np.concatenate([np.bincount(p[2], minlength=len(p[0])) for p in self.parts]))
            table = pa.table({"lang": langs, "word": words, "n": counts})
            names = table.group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])
            names = names.sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
            place = names.append_column("code", pa.array(np.arange(1, len(names) + 1)))
            where = table.append_column("at", pa.array(np.arange(len(table)))).join(place, ["lang", "word"])
            code = np.empty(len(table), np.uint32)
            code[where.column("at").to_numpy()] = where.column("code").to_numpy()
            out, at = [], 0
            for part in self.parts:
                mine = code[at:at + len(part[0])][part[2]]
                at += len(part[0])
                places = np.arange(len(mine)) + np.cumsum(part[3])  # a break before each piece
                stream = np.zeros(int(places[-1]) + 1, np.uint32)
                stream[places] = mine
                out.append(stream)
            stream = np.concatenate(out)
        names = names.combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), _one(names.column(c), t))
                 for c, t in (("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), pa.array([len(stream)], pa.int64()),
                                           pa.array([packed(stream)], pa.large_binary()), *lists], schema=BLOCKS)


def _one(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], kind)


def _blocks(block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, block = TaskContext.get().partitionId(), 0, None
        for batch in slices(batches, limit=SLICE_BYTES):
            if block is None:
                block = Block((part << 32) | made)
                made += 1
            block.add(batch)
            if block.size >= block_bytes:
                yield block.row()
                block = None
        if block is not None:
            yield block.row()

    return run


def _numbered(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """A block's stream with the numbers of its frequent words, 0 for the others."""
    one = blocks.slice(0, 1).to_batches()[0]
    codes = unpacked(one.column("stream")[0].as_py(), one.column("n")[0].as_py())
    number = np.zeros(int(codes.max(initial=0)) + 1, np.uint64)
    number[words.column("code").to_numpy()] = words.column("id").to_numpy().astype(np.uint64)
    stream = number[codes]
    live = stream > 0  # runs of zeros say no more than one does
    keep = live.copy()
    keep[1:] |= live[:-1]
    stream = stream[keep]
    planes = np.concatenate([(stream & np.uint64(0xFFFFFFFF)).astype(np.uint32), (stream >> np.uint64(32)).astype(np.uint32)])
    return pa.table([one.column("block"), pa.array([len(planes)], pa.int64()), pa.array([packed(planes)], pa.binary())],
                    schema=STREAMS)


def gram_marks(words: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(words[0]), len(words), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def _handed(f: Filter, part: int) -> Iterator[pa.RecordBatch]:
    for number, shard in f.cut(0, FAN_BITS):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()),
                                          pa.array([shard.encoded()], pa.binary())], schema=FILTERS)


def _filled(k: int, bits: int, marks: np.ndarray | None, entries: int) -> Callable:
    """Filters of the k-grams of streams; ``marks`` tells which (k-1)-grams may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[Filter] = []
        for batch in batches:
            for n, stream in zip(batch.column("n").to_pylist(), batch.column("stream"), strict=True):
                planes = unpacked(stream.as_py(), n).astype(np.uint64)
                ids = planes[:n // 2] | (planes[n // 2:] << np.uint64(32))
                if len(ids) < k:
                    continue
                at = len(ids) - k + 1
                ok = ids > 0
                whole = ok[:at].copy()
                for i in range(1, k):
                    whole &= ok[i:at + i]
                if marks is not None:
                    hit = HashMarks.found(marks, gram_marks([ids[i:len(ids) - k + 2 + i] for i in range(k - 1)]))
                    whole &= hit[:-1] & hit[1:]
                places = np.flatnonzero(whole)
                if len(places):
                    held.append(Filter.of([ids[places + i] for i in range(k)], bits))
                # filters of like size are merged, as in counting
                while len(held) > 1 and len(held[-2]) <= 2 * len(held[-1]):
                    held[-2:] = [Filter.merged(held[-2:])]
                if sum(map(len, held)) > entries:
                    yield from _handed(Filter.merged(held), (part << 32) | made)
                    held, made = [], made + 1
        if held:
            yield from _handed(Filter.merged(held), (part << 32) | made)

    return run


def _merged_range(upto: int, last: bool, least: int) -> Callable:
    """Merge the filters of one range; cut it further, or give its frequent grams in the last round."""
    def run(table: pa.Table) -> pa.Table:
        whole = Filter.merged([Filter.decoded(x.as_py()) for x in table.column("filter")])
        if not last:
            group = table.column("group")[0].as_py()
            cuts = whole.cut(upto, FAN_BITS)
            head = table.column("range")[0].as_py() << FAN_BITS
            return pa.table([pa.array([group] * len(cuts), pa.int64()), pa.array([head | i for i, _ in cuts], pa.int64()),
                             pa.array([f.encoded() for _, f in cuts], pa.binary())], schema=FILTERS)
        keep = np.flatnonzero(whole.counts >= least)
        kept = Filter(whole.k, whole.bits, [x[keep] for x in whole.limbs], whole.counts[keep])
        words = kept.words()
        flat = np.stack(words, 1).astype(np.int64).ravel() if len(keep) else np.zeros(0, np.int64)
        offsets = np.arange(len(keep) + 1, dtype=np.int32) * whole.k
        return pa.table([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(kept.counts),
                         pa.array(gram_marks(words).view(np.int64))], schema=GRAMS)

    return run


def frequent_grams(streams: DataFrame, k: int, bits: int, marks: np.ndarray | None, least: int,
                   entries: int = ENTRIES) -> DataFrame:
    """ids, f, mark of all k-grams found ``least`` times or more, written to the shared folder."""
    filters = handed_over(streams.mapInArrow(_filled(k, bits, marks, entries), "part long, range long, filter binary"),
                          "filters")
    parts = filters.select("part").distinct().count()
    upto, old = FAN_BITS, [filters]
    while True:
        groups = -(-parts // FAN) if parts else 1
        last = groups <= 1
        keyed = filters.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)))
        merged = keyed.groupBy("group", "range").applyInArrow(
            _merged_range(upto, last, least),
            "ids array<long>, f long, mark long" if last else "part long, range long, filter binary")
        filters = handed_over(merged, "grams" if last else "filters")
        if last:
            release(streams.sparkSession, *old)
            return filters
        old.append(filters)
        parts, upto = groups, upto + FAN_BITS


def numbered_words(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(id, lang, word, f) of the frequent words with dense ids from 1, (lang, n), and the bits of an id."""
    counted = (blocks.select(F.explode(F.arrays_zip("lang", "word", "count")).alias("w"))
               .groupBy(F.col("w.lang").alias("lang"), F.col("w.word").alias("word")).agg(F.sum("w.count").alias("f")))
    totals = blocks.select(F.explode(F.arrays_zip("lang", "count")).alias("w")).groupBy(F.col("w.lang").alias("lang")).agg(
        F.sum("w.count").alias("n"))
    totals = handed_over(totals, "totals")
    often = counted.where(F.col("f") >= least).withColumn("raw", F.monotonically_increasing_id())
    often = handed_over(often.select("raw", "lang", "word", "f"), "numbered")
    top = often.agg(F.max(F.col("raw").bitwiseAND((1 << 33) - 1)).alias("row"),
                    F.max(F.shiftright("raw", 33)).alias("part")).first()
    wide = int(top["row"] or 0).bit_length()
    ids = (F.shiftleft(F.shiftright("raw", 33), wide).bitwiseOR(F.col("raw").bitwiseAND((1 << 33) - 1)) + 1).alias("id")
    bits = ((int(top["part"] or 0) << wide) + (1 << wide) + 1).bit_length()
    return often.select(ids, "lang", "word", "f"), totals, bits


def scored(grams: DataFrame, words: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The report of each language from the frequent grams of two words and more."""
    known = grams.select("ids", "f").unionByName(words.select(F.array("id").alias("ids"), "f"))
    size = F.size("ids")
    cuts = grams.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("head"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("tail"))
    heads = known.select(F.col("ids").alias("head"), F.col("f").alias("l"))
    tails = known.select(F.col("ids").alias("tail"), F.col("f").alias("r"))
    langs = words.select(F.col("id").alias("first_id"), "lang").join(totals, "lang")
    rated = (cuts.join(heads, "head").join(tails, "tail").withColumn("first_id", F.element_at("ids", 1))
             .join(langs, "first_id")
             .withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)))"
                                         " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
             .groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    longer = grams.where(size > 2).select("f", F.explode(F.array(
        F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids") - 1))).alias("ids"))
    inside = longer.groupBy("ids").agg(F.max("f").alias("held"))
    kept = (rated.join(inside, "ids", "left").where("held is null or 100 * held < 100 * a")
            .select("ids", "lang", "a", "n", "cut.l", "cut.r", "cut.score"))
    spelled = (kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
               .groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))),
                                                            lambda x: x["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (kept.join(spelled, "ids").withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP,
                 block_bytes: int = BLOCK_BYTES, entries: int = ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language. ``docs`` has text and lang."""
    spark = docs.sparkSession
    rows = docs.select(text_of().alias("text"), F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"))
    blocks = handed_over(rows.mapInArrow(_blocks(block_bytes), BLOCKS_DDL), "blocks")
    words, totals, bits = numbered_words(blocks, least)
    asked = blocks.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("lang", "word")).alias("at", "w"))
    told = (asked.select("of", (F.col("at") + 1).alias("code"), F.col("w.lang").alias("lang"), F.col("w.word").alias("word"))
            .join(broadcast_if_fits(words.select("lang", "word", "id")), ["lang", "word"]).select("of", "code", "id"))
    streams = handed_over(blocks.select("block", "n", "stream").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(
        _numbered, "block long, n long, stream binary"), "streams")
    found, marks = None, None
    for k in range(2, longest + 1):
        grams = frequent_grams(streams, k, bits, marks, least, entries)
        found = grams if found is None else found.unionByName(grams)
        marks = HashMarks.of(grams, "mark")
    release(spark, streams, blocks)
    return scored(found, words, totals, top)

"""Alignment of two tokenizers by merge-path partitioning.

The ends of A's and of B's tokens in the same bytes are two sorted lists. Their
merge is a path; each diagonal ``i + j = d`` crosses it once, at a place that a
binary search finds without the rest of the path. Diagonals ``WORK`` apart cut
the merge into independent pieces of equal work, however long a text is and
whichever list is denser. A piece emits one link for every distinct end in it
(the A and the B token that lie before this end overlap); groups, which end
where both lists end, are stitched from the pieces on both sides of a cut.

Spread: texts are tokenised where they are read, in slices. About
``BLOCK_BYTES`` of texts form a block: its documents, and its distinct (A, B)
pairs with their counts. Pair counts are summed block by block, so a frequent
pair is one row for each block that has it, and come back to each block; then
every document looks its links up. Blocks are rows of a table in the shared
folder; nothing is broadcast or collected.

Defined results: a null or empty text, and a text whose joined bytes of A or B
differ from blank + text (such as one with U+2581), has no tokens: zeros and
an empty ``groups_sha256``. Repeated rows and ids are documents of their own
and all count; ties for a B token's highest count all count as best; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.textio import handed_over, raw, slices, text_of
from wardlight.llm.tokens import ByteLevel, Pieces, byte_level_path, gathered, piece_path

#: Ends of tokens in one piece of a merge.
WORK = 1 << 15
SLICE_BYTES = 1 << 20
#: Texts of a block; more texts share the rows of its pairs, fewer need less memory.
BLOCK_BYTES = 12 << 20

BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())),
    ("links", pa.large_binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
BLOCKS_DDL = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
              "sha array<string>, links binary, pairs array<long>, counts array<long>")
OUT = [("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("n_best", "long"),
       ("count_sum", "long"), ("groups_sha256", "string")]


def merge_cuts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` lie before each cut of their merge into pieces of ``work`` (equal: a's first).

    All diagonals are searched at once, each between the least and the most
    that ``a`` can give to it.
    """
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, work), total)
    low = np.maximum(diagonal - len(b), 0)
    high = np.minimum(diagonal, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low, diagonal - low
        mid = (low[open_] + high[open_]) >> 1
        # a[mid] comes before the last that b would give: then the cut takes more of a
        more = a[mid] <= b[diagonal[open_] - mid - 1]
        low[open_] = np.where(more, mid + 1, low[open_])
        high[open_] = np.where(more, high[open_], mid)


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece of the merge, after ``i`` of all A ends and ``j`` of all B ends: its ends in order, without repeats.

    Returns the ends, the A and the B token that each end closes or cuts (a
    link), and whether both lists end there. A tie that a cut runs through
    shows up as a repeated end at the start of the next piece.
    """
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    from_a = order < len(a)
    first = np.ones(len(ends), bool)
    first[1:] = ends[1:] != ends[:-1]
    both = np.zeros(len(ends), bool)
    both[:-1] = ~first[1:]
    before_a = np.cumsum(from_a) - from_a
    before_b = np.arange(len(ends)) - before_a
    return ends[first], i + before_a[first], j + before_b[first], both[first]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) of two lists of ends over the same bytes in order, and which of them close a group."""
    at_a, at_b = merge_cuts(a, b, work)
    parts = []
    last = -1
    for i, i2, j, j2 in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:], strict=True):
        ends, left, right, both = merge_piece(a[i:i2], b[j:j2], i, j)
        if len(ends) and ends[0] == last:  # the other half of a tie: its link is out, the group closes there
            parts[-1][2][-1] = True
            ends, left, right, both = ends[1:], left[1:], right[1:], both[1:]
        if len(ends):
            last = ends[-1]
            parts.append((left, right, both))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Digits:
    """Decimal ids as bytes, each followed by a place for a separator."""

    def __init__(self, n: int) -> None:
        shown = [b"%d," % i for i in range(n)]
        self.sizes = np.array([len(x) for x in shown], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(shown), np.uint8)


def written_groups(a_ids: np.ndarray, b_ids: np.ndarray, links: tuple, digits: Digits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` for every group, as bytes, and for each A token its group; the third is where groups end in the bytes."""
    left, right, closes = links
    last_a, last_b = left[closes], right[closes]  # the last tokens of each group
    group_a = np.searchsorted(last_a, np.arange(len(a_ids)))
    group_b = np.searchsorted(last_b, np.arange(len(b_ids)))
    before_b = np.append(0, last_b + 1)
    after_a = last_a + 1
    place_a = np.arange(len(a_ids)) + before_b[group_a]
    place_b = np.arange(len(b_ids)) + after_a[group_b]
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    ids[place_a], ids[place_b] = a_ids, b_ids
    sizes = digits.sizes[ids]
    ends = np.cumsum(sizes)
    out = gathered(digits.flat, digits.first[ids], sizes)
    out[ends[place_a[last_a]] - 1] = ord("|")
    out[ends[place_b[last_b]] - 1] = ord(";")
    return out, group_a, ends[place_b[last_b]]


class Aligner:
    """Tokens, links and groups of slices of texts."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.digits = Digits(max(len(self.a.entries), len(self.b.bytes.sizes)))

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers, None where their bytes are not blank + text."""
        if not text:
            return None
        plain = text.decode("utf-8", "replace")
        a, b = self.a(" " + plain), self.b(plain)
        whole = np.frombuffer(b" " + text, np.uint8)
        for ids, tokens in ((a, self.a.bytes), (b, self.b.bytes)):
            if int(tokens.sizes[ids].sum()) != len(whole) or not np.array_equal(tokens.joined(ids), whole):
                return None
        return a, b

    def __call__(self, column: pa.Array) -> tuple[dict[str, np.ndarray], list[str], np.ndarray]:
        """Per-document numbers, hashes of groups, and all links as A id * 2^32 + B id in order of documents."""
        data, bounds = raw(column)
        n = len(bounds) - 1
        found = [self.tokens(data[bounds[i]:bounds[i + 1]].tobytes()) for i in range(n)]
        held = [x for x in found if x is not None]
        n_a = np.array([0 if x is None else len(x[0]) for x in found], np.int64)
        n_b = np.array([0 if x is None else len(x[1]) for x in found], np.int64)
        numbers = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64)}
        shas = [""] * n
        if not held:
            return numbers, shas, np.zeros(0, np.int64)
        a_ids, b_ids = (np.concatenate([x[k] for x in held]).astype(np.int64) for k in (0, 1))
        # texts stand one after the other, and both lists end where a text ends
        links = overlaps(np.cumsum(self.a.bytes.sizes[a_ids]), np.cumsum(self.b.bytes.sizes[b_ids]))
        left, right, closes = links
        a_stop = np.cumsum(n_a)
        upto = np.searchsorted(left, a_stop)  # links of the documents up to each one
        numbers["n_links"] = np.diff(upto, prepend=0)
        groups = np.append(0, np.cumsum(closes))[upto]
        numbers["n_groups"] = np.diff(groups, prepend=0)
        text, _, stops = written_groups(a_ids, b_ids, links, self.digits)
        stops = np.append(0, stops)
        for i in range(n):
            if n_a[i]:
                start, stop = stops[groups[i - 1] if i else 0], stops[groups[i]]
                shas[i] = hashlib.sha256(text[start:stop - 1]).hexdigest()
        return numbers, shas, (a_ids[left] << 32) | b_ids[right]


class Block:
    """Documents whose pairs are counted together."""

    def __init__(self, number: int) -> None:
        self.number, self.ids, self.shas, self.size = number, [], [], 0
        self.numbers: dict[str, list[np.ndarray]] = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links")}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # distinct pairs, codes of the links, counts

    def add(self, ids: pa.Array, size: int, found: tuple) -> None:
        numbers, shas, links = found
        self.ids.append(ids)
        self.shas.extend(shas)
        for k, v in numbers.items():
            self.numbers[k].append(v)
        pairs, codes, counts = np.unique(links, return_inverse=True, return_counts=True)
        self.parts.append((pairs, codes.astype(np.uint32), counts))
        self.size += size

    def row(self) -> pa.RecordBatch:
        every, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.parts:
            every, where = np.unique(np.concatenate([p for p, _, _ in self.parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, _, c in self.parts]), len(every)).astype(np.int64)
        # frequent pairs first, so that most codes are small
        order = np.argsort(-counts, kind="stable")
        every, counts = every[order], counts[order]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        links, at = [], 0
        for pairs, codes, _ in self.parts:
            links.append(rank[where[at:at + len(pairs)]][codes])
            at += len(pairs)
        codes = np.concatenate(links) if links else np.zeros(0, np.uint32)
        lists = {"doc_id": pa.concat_arrays(self.ids), "sha": pa.array(self.shas, pa.string()), "pairs": pa.array(every),
                 "counts": pa.array(counts), **{k: pa.array(np.concatenate(v)) for k, v in self.numbers.items()}}
        whole = {"block": pa.array([self.number], pa.int64()), "links": pa.array([packed(codes)], pa.large_binary())}
        return pa.RecordBatch.from_arrays(
            [whole[f.name] if f.name in whole else pa.ListArray.from_arrays(pa.array([0, len(lists[f.name])], pa.int32()),
                                                                         lists[f.name]) for f in BLOCKS], schema=BLOCKS)


def packed(codes: np.ndarray) -> bytes:
    """Codes as planes of bytes, lowest first, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _blocks(byte_level: str, pieces: str, block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, part = Aligner(byte_level, pieces), TaskContext.get().partitionId()
        made, block = 0, None
        for batch in slices(batches, limit=SLICE_BYTES):
            if block is None:
                block = Block((part << 32) | made)
                made += 1
            block.add(batch.column("doc_id"), batch.column("text").nbytes, align(batch.column("text")))
            if block.size >= block_bytes:
                yield block.row()
                block = None
        if block is not None:
            yield block.row()

    return run


def _document_sums(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus-wide counts of its pairs looked up."""
    one = blocks.slice(0, 1).to_batches()[0]
    lists = {f: one.column(f).values for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")}
    n_links = lists["n_links"].to_numpy(zero_copy_only=False)
    codes = unpacked(one.column("links")[0].as_py(), int(n_links.sum()))
    at = counts.column("at").to_numpy()
    value, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    value[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
    ends = np.cumsum(n_links)
    sums = [np.diff(np.append(0, np.cumsum(v[codes]))[ends], prepend=0) for v in (best, value)]
    return pa.table({"doc_id": lists["doc_id"], "n_a": lists["n_a"], "n_b": lists["n_b"], "n_groups": lists["n_groups"],
                     "n_links": lists["n_links"], "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]),
                     "groups_sha256": lists["sha"]})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a_id, b_id, n for every pair of tokens that overlap somewhere, and whether n is the highest of its B token."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    summed = (pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
              .withColumn("b_id", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return summed.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id"))).select(
        "pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "n", "best")


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document of (doc_id, text): tokens, groups, links and how common its links are in the corpus."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    blocks = handed_over(rows.mapInArrow(
        _blocks(byte_level or byte_level_path(), pieces or piece_path(), block_bytes), BLOCKS_DDL), "aligned")
    counts = pair_counts(blocks).select("pair", "n", "best")
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(counts, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    return (blocks.drop("pairs", "counts").groupBy("block").cogroup(told.groupBy("of"))
            .applyInArrow(_document_sums, ", ".join(f"{n} {t}" for n, t in OUT)))

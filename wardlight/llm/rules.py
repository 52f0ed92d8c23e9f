"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger row keeps what was
measured and one long whose bit ``i`` says that rule ``i`` failed. Policies
are versioned masks over the ledger: applying one, comparing two, or asking
what each rule alone costs never reads a text again. Ablations aggregate the
ledger by mask first, so at most ``2 ** rules`` rows are left to expand.

Defined results: null text has no words and fails the length rule; a ratio
over nothing passes; repeated rows and ids are rows of their own; extra
columns are ignored; an empty table gives an empty ledger. Words and lines are
compared exactly (case and all), over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.textio import raw, slices, text_of, word_array, word_codes, word_edges

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_as_before",
            "n_upper", "n_lower", "n_marks")
SYMBOLS = b"#*$%&|<>"
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """A document fails when ``condition`` over the measures holds. The place in RULES is the bit."""

    name: str
    condition: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("stuttering", "100 * n_same_as_before > 30 * n_words"),
    Rule("capitals", "100 * n_upper > 50 * (n_upper + n_lower)"),
    Rule("exclamations", "100 * n_marks > 50 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Fixed rules of the contract.
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies: which failures reject a document.
POLICIES = {
    "v1-base": BASE,
    "v2-noise": BASE | BIT["symbols"] | BIT["capitals"] | BIT["exclamations"] | BIT["stuttering"],
    "v3-all": (1 << len(RULES)) - 1,
}
CURRENT = "v3-all"


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeat_words(codes: np.ndarray, rows: np.ndarray, distinct: int, n: int) -> np.ndarray:
    """Words that stand in a three-word window found again in the same row."""
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    base = max(distinct, 1)
    if base ** 3 < 1 << 62:
        key = (codes[:-2] * base + codes[1:-1]) * base + codes[2:]
    else:  # number the pairs first, so that the key fits
        _, pair = np.unique(codes[:-2] * base + codes[1:-1], return_inverse=True)
        key = pair * base + codes[2:]
    whole = np.flatnonzero(rows[:-2] == rows[2:])
    order = whole[np.argsort(key[whole], kind="stable")]
    again = (key[order][1:] == key[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= again
    twice[:-1] |= again
    found = order[twice]
    covered = np.zeros(len(codes), bool)
    for j in range(3):
        covered[found + j] = True
    return np.bincount(rows[covered], minlength=n)


def measure_slice(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of the texts of one slice."""
    data, bounds = raw(column)
    n = len(bounds) - 1
    starts, ends, rows = word_edges(data, bounds)
    codes, words = word_codes(data, starts, ends) if len(starts) else (np.zeros(0, np.int64), [])
    points = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    # lines: between line breaks, and at row bounds; only lines with a word count
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([bounds[:-1], breaks + 1])
    last = np.concatenate([bounds[1:], breaks])
    first.sort()
    last.sort()
    row = np.searchsorted(bounds, np.minimum(first, last), side="right") - 1
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=upto[1:])
    wordy = (last > first) & (upto[last] > upto[first])
    first, last, row = first[wordy], last[wordy], row[wordy]
    duplicates = np.zeros(n, np.int64)
    if len(first):
        coded = word_array(data, first, last).dictionary_encode()
        line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = np.unique(row * len(coded.dictionary) + line)
        duplicates = np.bincount(row, minlength=n) - np.bincount(distinct // len(coded.dictionary), minlength=n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    same = np.zeros(len(codes), bool)
    if len(codes):
        same[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    return {
        "n_words": np.bincount(rows, minlength=n), "word_chars": _per_row(points & inside, bounds),
        "n_symbols": _per_row(symbol[data], bounds), "n_dup_lines": duplicates,
        "n_repeat_words": _repeat_words(codes, rows, len(words), n), "n_lines": np.bincount(row, minlength=n),
        "n_same_as_before": np.bincount(rows[same], minlength=n),
        "n_upper": _per_row((data >= 65) & (data <= 90), bounds),
        "n_lower": _per_row((data >= 97) & (data <= 122), bounds), "n_marks": _per_row(data == 33, bounds)}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every document, one Arrow pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = measure_slice(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id")] + [pa.array(found[m].astype(np.int64)) for m in MEASURES],
                names=["doc_id", *MEASURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, LEDGER)


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """The bitmask over a row of measures."""
    mask = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        mask = mask + F.when(F.expr(rule.condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return mask


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures and ``failed``, the bitmask of the rules a document fails."""
    return measures(docs).withColumn("failed", failures(rules))


def apply_policy(book: DataFrame, policy: str | int = CURRENT) -> DataFrame:
    """``kept`` of every ledger row under a policy version or mask."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(book: DataFrame, policy: str | int = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, failing, only_by, any_failing: documents that fail a rule, and those the policy would keep without it."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    by_mask = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(
        F.count(F.lit(1)).alias("n"))
    bits = F.array(*[F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                     for i, rule in enumerate(rules) if mask >> i & 1])
    some = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return (by_mask.select("failed", "n", F.explode(bits).alias("b")).groupBy(F.col("b.rule").alias("rule"))
            .agg(some(F.col("failed").bitwiseAND(F.col("b.bit")) != 0).alias("failing"),
                 some(F.col("failed") == F.col("b.bit")).alias("only_by"),
                 some(F.col("failed") != 0).alias("any_failing"),
                 F.bit_or("failed").alias("seen")))


def screen(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``."""
    return apply_policy(ledger(docs), policy).withColumn(
        "base_failed", F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0)

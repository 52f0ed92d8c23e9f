"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (1 to 3 code
points, words padded with one blank) by falling count. A document goes to the
language whose profile its own is least out of place from: for each of the
document's n-grams the difference of the two ranks, or the profile's length
where the language lacks it.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and where no language was learned; rows with null text or language never
train; ties in counts go to the smaller n-gram, ties in distance to the first
language by code point; repeated rows are rows of their own; extra columns
are ignored; an empty table gives an empty result. Counts cover the whole
texts of all training rows; only the profiles (``PROFILE`` rows a language)
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.textio import key_remainder, raw, slices, text_of

ORDERS = 3
PROFILE = 300
UNKNOWN = "und"
#: Below it a text is like none of the languages learned.
LEAST_SCORE = 0.3


def gram_arrays(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-gram keys of each order over a slice, the bounds of each text in the letters, and who has a letter.

    Letters are lowered; every run of other characters, and each text's start
    and end, is one blank. A key holds up to three code points of 21 bits, so
    equal keys are equal n-grams.
    """
    data, bounds = raw(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    bounds = at[bounds]
    # a blank before each text and one at the very end, so that runs never cross texts
    points = np.append(np.insert(points, bounds[:-1], 32), 32)
    bounds = bounds + np.arange(len(bounds))
    seen = np.flatnonzero(np.bincount(points, minlength=33))
    code = np.zeros(int(seen[-1]) + 1, np.uint64)
    for c in seen:
        char = chr(c)
        if char.isalpha():
            lower = char.lower()
            code[c] = (ord(lower) if len(lower) == 1 else c) + 2
    letters = code[points]
    keep = letters > 0
    has = np.add.reduceat(keep.astype(np.int64), bounds[:-1]) > 0 if len(bounds) > 1 else np.zeros(0, bool)
    keep[1:] |= letters[:-1] > 0
    keep[bounds] = True
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    letters = np.maximum(letters[keep], 1)
    bounds = place[bounds]
    grams, gram = [letters], letters
    for n in range(1, ORDERS):
        gram = (gram[:-1] << np.uint64(21)) | letters[n:]
        grams.append(gram)
    return grams, bounds, has


def _row_grams(grams: list[np.ndarray], a: int, b: int) -> np.ndarray:
    """A text's n-grams of all orders, without the lone blank; the blank before the next text closes the last word."""
    end = b + 1 if grams[0][b - 1] > 1 else b
    one = grams[0][a:end]
    return np.concatenate([one[one > 1], *[g[a:max(a, end - n)] for n, g in enumerate(grams[1:], 1)]])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def learn(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of every language of ``docs`` (text, lang): n-gram keys by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in slices(batches):
            grams, bounds, _ = gram_arrays(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                rows = np.flatnonzero(langs == lang)
                keys, counts = _counted(np.concatenate([_row_grams(grams, bounds[i], bounds[i + 1]) for i in rows]))
                if lang in total:
                    both = np.concatenate([total[lang][0], keys])
                    keys, where = np.unique(both, return_inverse=True)
                    counts = np.bincount(where, np.concatenate([total[lang][1], counts])).astype(np.int64)
                total[lang] = keys, counts
        for lang, (keys, counts) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)),
                 pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    counts = (docs.where("text is not null and lang is not null").select("text", "lang")
              .mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= profile).select("lang", "gram", "rank").collect()
    profiles: dict[str, np.ndarray] = {}
    for lang in sorted({r["lang"] for r in top}):
        profiles[lang] = np.array([r["gram"] for r in sorted((r for r in top if r["lang"] == lang),
                                                             key=lambda r: r["rank"])], np.uint64)
    return profiles


class _Places:
    """Ranks of n-grams in all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int) -> None:
        self.langs = list(profiles)
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for j, grams in enumerate(profiles.values()):
            self.rank[np.searchsorted(self.keys, grams), j] = np.arange(len(grams))
        self.profile = profile

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """The nearest language of a text's n-grams, and 1 minus its distance over the largest possible."""
        keys, counts = _counted(grams)
        # falling count, then key: the keys are sorted, so a stable order of the counts is enough
        mine = keys[np.argsort(-counts, kind="stable")[:self.profile]]
        at = np.searchsorted(self.keys, mine)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == mine
        rank = np.where(known[:, None], self.rank[at], -1)
        off = np.where(rank >= 0, np.abs(rank - np.arange(len(mine))[:, None]), self.profile).sum(axis=0)
        best = int(np.argmin(off))
        return self.langs[best], 1 - float(off[best]) / (self.profile * len(mine))


def nearest_languages(column: pa.Array, places: _Places) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a slice."""
    grams, bounds, has = gram_arrays(column)
    found = [places.nearest(_row_grams(grams, bounds[i], bounds[i + 1])) if has[i] and places.langs
             else (UNKNOWN, 0.0) for i in range(len(column))]
    return [x[0] for x in found], np.array([x[1] for x in found], np.float64)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score for every whole text, one Arrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(profiles, profile)
        for part in slices(batches):
            langs, score = nearest_languages(part.column("text"), places)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def readable_documents(docs: DataFrame, profiles: dict[str, np.ndarray], least: float = LEAST_SCORE,
                       profile: int = PROFILE) -> DataFrame:
    """The rows of ``docs``, all columns, that are in a language learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(profiles, profile)
        for part in slices(batches):
            langs, score = nearest_languages(part.column("text"), places)
            yield part.filter(pa.array((np.array(langs, object) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def predict_languages(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """Learn from the training rows and predict all: doc_id, held_out, lang_pred, score."""
    profiles = learn(docs.where(key_remainder("doc_id", 4) != 2).select("text", "lang"), profile)
    out = identify(docs, profiles, profile)
    return out.select("doc_id", (key_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

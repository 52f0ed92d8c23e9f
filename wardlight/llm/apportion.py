"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's words, in a seeded order of its documents, form a stream that is
cut into blocks of ``block_words`` words. Seats (blocks) go to sources, and
from a source to its shards, by the highest quotients ``votes / (2k - 1)``.
A shard then takes whole passes over its blocks and, for the rest of its
quota, evenly spaced blocks from a seeded start. Everything is DataFrame
arithmetic: ``mix`` shuffles narrow (id, source, size) rows, ``mixed_texts``
moves whole rows once. Quotients over all sources are ranked in one task, on
one row for each source.

Defined results: null text has size 0 and takes 0; a null source is a source
of its own, ordered last; sources without words get target 0; an empty table
gives an empty result; repeated rows and ids are rows of their own; other
columns are ignored and never clash, since only the needed ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.textio import WORD, handed_over, text_of, word_count
from wardlight.session import broadcast_if_fits

WEIGHTS = (3.0, 1.0, 2.0)
RATE, LIMIT = 1.5, 2.0
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 21
SEED = 20_26


def targets(sources: DataFrame, rate: float = RATE, limit: float = LIMIT, weights=WEIGHTS) -> DataFrame:
    """``target`` for each row of (source, source_size): weights repeat over the sources in code point order.

    A target is ``min(limit * size, level * weight)``. Sorted by the size at
    which a source is full, the full ones come first; the level follows from
    running sums. One row per source is all this step sees.
    """
    every = Window.partitionBy(F.lit(0))
    named = every.orderBy(F.col("source").asc_nulls_last())
    full = every.orderBy("_full", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    at = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    out = (sources
           .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
           .withColumn("_cap", limit * F.col("source_size"))
           .withColumn("_full", F.col("_cap") / F.col("_weight"))
           .withColumn("_left", rate * F.sum("source_size").over(every)
                       - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
           .withColumn("_open", F.sum("_weight").over(every)
                       - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
           .withColumn("_level", F.col("_left") / F.col("_open"))
           .withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level")))
                       .over(every)))
    level = F.coalesce(F.col("_at._level"), F.lit(float("inf")))
    return out.withColumn("target", F.least(F.col("_cap"), level * F.col("_weight"))).drop(
        "_weight", "_cap", "_full", "_left", "_open", "_level", "_at")


def seats(parties: DataFrame, group: list[str], name: str, votes: str, total: str, out: str) -> DataFrame:
    """Sainte-Lague seats of each party of a group: the ``total`` highest quotients ``votes / (2k - 1)``.

    Two divisors bound every party's seats from below and above within about
    one seat per party; only the quotients between the bounds are ranked, so
    the work grows with the parties and not with the seats. Ties go to the
    first name.
    """
    within = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    rated = (parties
             .withColumn("_all", F.sum(votes).over(within))
             .withColumn("_n", F.count(F.lit(1)).over(within))
             .withColumn("_rate", F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0)))
             .withColumn("_lo", F.greatest(F.lit(0.0), F.floor(F.col("_rate") * (F.col(total) - F.col("_n") / 2)
                                                               + 0.5 - 1e-9)).cast("long"))
             .withColumn("_hi", F.when(F.col("_rate") > 0, F.floor(
                 F.col("_rate") * (F.col(total) + F.col("_n") / 2) + 0.5 + 1e-9) + 1).otherwise(F.lit(0)).cast("long"))
             .withColumn("_rest", F.col(total) - F.sum("_lo").over(within)))
    keys = [*group, name]
    ranked = (rated.where("_hi > _lo")
              .select(*keys, "_rest", F.col(votes).alias("_votes"),
                      F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k"))
              .withColumn("_rank", F.row_number().over(within.orderBy(
                  (F.col("_votes") / (2 * F.col("_k") - 1)).desc(), F.col(name).asc_nulls_last(), "_k")))
              .where("_rank <= _rest")
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("_more")))
    same = None
    for key in keys:
        test = F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
        same = test if same is None else same & test
    joined = rated.alias("a").join(ranked.alias("b"), same, "left")
    return joined.select(*[f"a.{c}" for c in parties.columns],
                         (F.col("a._lo") + F.coalesce(F.col("b._more"), F.lit(0))).alias(out))


def _chosen(blocks: Column) -> Column:
    """Of the first ``blocks`` blocks of a shard, how many the rest of the quota takes."""
    spaced = lambda x: F.floor((x + F.col("_start")) * F.col("_extra") / F.col("_blocks"))
    return F.when(F.col("_extra") > 0, spaced(blocks) - spaced(F.lit(0))).otherwise(F.lit(0)).cast("long")


def _words_before(words: Column, block_words: int) -> Column:
    """Words that the rest of the quota takes from the first ``words`` words of a shard."""
    block = F.floor(words / block_words).cast("long")
    return _chosen(block) * block_words + (_chosen(block + 1) - _chosen(block)) * (words - block * block_words)


def _shares(narrow: DataFrame, block_words: int, shard_words: int, seed: int, rate: float, limit: float,
            weights) -> tuple[DataFrame, DataFrame]:
    """One row for each source (size, target, seats, shards) and one for each shard (passes, extra, start, blocks).

    ``narrow`` has (source, size, _order).
    """
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = (targets(sources, rate, limit, weights)
              .withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
              .withColumn("_total", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words)
                          .cast("long")))
    wanted = seats(wanted, [], "source", "target", "_total", "_seats").drop("_total")
    shards = (_dealt(narrow, wanted).groupBy("source", "_shard", "_seats").agg(F.sum("size").alias("_size")))
    shards = (seats(shards, ["source"], "_shard", "_size", "_seats", "_quota")
              .withColumn("_blocks", F.ceil(F.col("_size") / block_words).cast("long"))
              .withColumn("_quota", F.least(F.col("_quota"), F.floor(limit * F.col("_blocks")).cast("long")))
              .withColumn("_passes", F.when(F.col("_blocks") > 0, F.floor(F.col("_quota") / F.col("_blocks")))
                          .otherwise(F.lit(0)).cast("long"))
              .withColumn("_extra", F.col("_quota") - F.col("_passes") * F.col("_blocks"))
              .withColumn("_start", F.when(F.col("_blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"),
                                                                        F.col("_blocks"))).otherwise(F.lit(0))))
    return wanted, shards


def _dealt(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return (rows.alias("d").join(wanted.alias("w"), F.col("d.source").eqNullSafe(F.col("w.source")))
            .select("d.*", "w.source_size", "w.target", "w._seats",
                    F.pmod(F.col("d._order"), F.col("w._shards")).alias("_shard")))


def _seeded(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def quotas(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
           rate: float = RATE, limit: float = LIMIT, weights=WEIGHTS) -> DataFrame:
    """Each document with its shard's quota: what ``mix`` selects by.

    ``docs`` has (doc_id, source, size) and whatever else shall be kept.
    """
    keep = docs.columns
    narrow = docs.select("source", "size", _seeded(seed).alias("_order"))
    wanted, shards = _shares(narrow, block_words, shard_words, seed, rate, limit, weights)
    stream = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    rows = _dealt(docs.withColumn("_order", _seeded(seed)), wanted)
    rows = rows.withColumn("_end", F.sum("size").over(stream)).drop("_seats")
    match = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._shard") == F.col("s._shard"))
    return rows.alias("r").join(shards.alias("s"), match).select(
        *[f"r.{c}" for c in keep], "r.source_size", "r.target", (F.col("r._end") - F.col("r.size")).alias("_from"),
        "s._passes", "s._extra", "s._start", "s._blocks")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many of each document's words the mix takes.

    ``docs`` has doc_id, text and source. No document gives more than
    ``limit`` times its words; a source's taken words miss its target by less
    than one block for each of its shards.
    """
    sized = docs.select("doc_id", "source", word_count(text_of()).alias("size"))
    dealt = quotas(sized, block_words, **options)
    end = F.col("_from") + F.col("size")
    taken = (F.col("_passes") * F.col("size") + _words_before(end, block_words)
             - _words_before(F.col("_from"), block_words))
    return dealt.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
                        taken.cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, block_words: int = 256, shard_words: int = SHARD_WORDS, seed: int = SEED,
                rate: float = RATE, limit: float = LIMIT, weights=WEIGHTS) -> DataFrame:
    """The mix as documents: whole passes over a text, then its chosen blocks, joined by line breaks.

    Returns the columns of ``docs``; documents of which nothing is taken go.
    The blocks of an excerpt keep their own white space.

    Sizes are counted once and written as narrow rows, from which sources and
    shards get their quotas. Both tables are small (a row for each source, and
    for each ``shard_words`` words) and join the rows by one key that is never
    null: whole rows move once, to the task that numbers their shard.
    """
    columns = docs.columns
    narrow = handed_over(docs.select("source", word_count(text_of()).alias("size"), _seeded(seed).alias("_order")), "sizes")
    wanted, shards = _shares(narrow, block_words, shard_words, seed, rate, limit, weights)
    wanted, shards = handed_over(wanted, "wanted"), handed_over(shards, "shards")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_source")
    rows = docs.select(F.struct(*columns).alias("_doc"), key, "doc_id", word_count(text_of()).alias("size"),
                       _seeded(seed).alias("_order"), F.xxhash64(text_of()).alias("_tie"))
    rows = (rows.join(broadcast_if_fits(wanted.select(key, "_shards")), "_source")
            .withColumn("_shard", F.pmod(F.col("_order"), F.col("_shards"))))
    stream = Window.partitionBy("_source", "_shard").orderBy("_order", "doc_id", "size", "_tie").rowsBetween(
        Window.unboundedPreceding, 0)
    dealt = (rows.withColumn("_from", F.sum("size").over(stream) - F.col("size"))
             .join(broadcast_if_fits(shards.select(key, "_shard", "_passes", "_extra", "_start", "_blocks")),
                   ["_source", "_shard"]))
    end = F.col("_from") + F.col("size")
    more = _words_before(end, block_words) - _words_before(F.col("_from"), block_words)
    text = text_of("_doc.text")
    parts = F.regexp_extract_all(text, F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))

    def in_block(_, i):
        block = F.floor((F.col("_from") + i) / block_words).cast("long")
        return (_chosen(block + 1) - _chosen(block)) == 1

    excerpt = F.when(more > 0, F.array_join(F.filter(parts, in_block), ""))
    whole = F.array_repeat(text, F.col("_passes").cast("int"))
    out = (dealt.where((F.col("_passes") * F.col("size") + more) > 0)
           .withColumn("text", F.array_join(F.concat(whole, F.when(excerpt.isNotNull(), F.array(excerpt)).otherwise(
               F.array().cast("array<string>"))), "\n")))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns])

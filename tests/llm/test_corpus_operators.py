"""Packing, licenses, mixing, near duplicates, quotations and the pipeline: against plain versions and on odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import LONG, NEAR, ROWS
from tests.oracle import connect, rows as normal
from wardlight.llm import apportion, jaccard, licenses, packing, quotes
from wardlight.llm.queries import ORACLE, QUERIES
from wardlight.llm.tokens import byte_level_path

import corpus_pipeline


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(byte_level_path())
    found.encode_special_tokens = True
    return found


def test_pieces_encode_as_whole_texts(tokenizer):
    encoder = packing.PieceEncoder(byte_level_path())

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("ab1é漢😀 \n\t\r.!'’sll  　\x1c\x0b|<>")), max_size=20),
                    max_size=5))
    def check(texts):
        assert [i.tolist() for i in encoder(pa.array(texts, pa.string()))] == [
            tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]

    check()


def check_packed(found, rows, tokenizer, length=1024):
    ids = {(i, t): tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    pieces = [(i, s, len(x[s:s + length]), zlib.crc32(np.array(x[s:s + length], "<u4").tobytes()), len(x))
              for (i, t) in rows for x in [ids[i, t]] for s in range(0, len(x), length)]
    got = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, pieces))
    at = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= length for n in at.values())
    return sum(at.values()) / (length * max(1, len(at)))


def test_packing(odd, none, docs, tokenizer):
    rows = [(i, t) for i, t, *_ in ROWS]
    check_packed(packing.pack(odd).collect(), rows, tokenizer)
    check_packed(packing.pack(odd.repartition(5), open_windows=1).collect(), rows, tokenizer)
    assert packing.pack(none).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_packed(packing.pack(docs).collect(), rows, tokenizer) > 0.95


def test_leftovers_merge_over_many_partitions(docs, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_packed(packing.pack(docs.repartition(7)).collect(), rows, tokenizer) > 0.95


def test_windows_place_best_fit_and_emit_the_fullest():
    closed = []
    windows = packing.Windows(2, closed.append, 10)
    for size, name in ((6, "a"), (7, "b"), (3, "c"), (5, "d"), (4, "e")):
        windows.place(size, [name])
    assert closed == [["b", "c"], ["a", "e"]] and windows.left() == [(5, ["d"])]
    windows.place(6, ["f"])
    windows.place(7, ["g"])  # fits nowhere: the fullest goes
    assert closed[2:] == [["f"]]


def base_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.LOW))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_license_phrases_on_odd_rows(spark, odd, none):
    more = ["mit license mit-license, MIT  LICENSE mitlicense license mit", "summit license", "general public license",
            "x general public license general public license", "É mit license", "apache license\nmit\nlicense", "license"]
    table = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string"))
    found = licenses.scan(table).collect()
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found]
    want = [(i, *base_licenses(t)) for i, t in [*[(i, t) for i, t, *_ in ROWS], *enumerate(more, 100)]]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for r in found:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(none).count() == 0


def test_license_suppression(spark):
    rules = [("word", 1, 0.5, "license", "license"), ("long", 2, 0.9, "mit", "the mit license"),
             ("inner", 2, 0.9, "mit", "mit license"), ("over", 1, 0.4, "license", "x the mit license y")]
    table = spark.createDataFrame([(1, "x the mit license y license")], "doc_id long, text string")
    spans = licenses.scan(table, rules).first()["spans"]
    # "over" is longer but of lower priority: it neither hides the others nor is hidden
    assert sorted((s["label"], s["start"], s["stop"]) for s in spans) == [("long", 2, 17), ("over", 0, 19), ("word", 20, 27)]


def test_every_license_rule_has_an_anchor_and_compiles():
    table = licenses.rule_table()
    assert len(table) > 200
    for _, priority, score, keyword, pattern in table:
        re.compile(pattern)
        assert keyword == keyword.lower() and 1 <= priority <= licenses.CLASSES and 0 < score <= 1
    assert len({pattern for *_, pattern in table}) == len(table)


def highest_quotients(votes, total):
    seats = [0] * len(votes)
    for _ in range(total):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[k] += 1
    return seats


@pytest.mark.parametrize(("votes", "total"), [([53, 24, 23], 7), ([10, 10, 10], 4), ([1000, 1, 1, 1, 0], 50), ([0, 0], 3),
                                              ([5], 9), ([97, 3] + [1] * 20, 11), ([60, 30, 10], 0)])
def test_seats_are_the_highest_quotients(spark, votes, total):
    parties = spark.createDataFrame([(f"p{i:02d}", float(v), total) for i, v in enumerate(votes)],
                                    "name string, votes double, total long")
    got = [r["seats"] for r in apportion.seats(parties, [], "name", "votes", "total", "seats").orderBy("name").collect()]
    assert got == (highest_quotients(votes, total) if sum(votes) else [0] * len(votes))


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_targets_and_taken(odd, none, docs):
    for table in (odd, docs):
        rows = [(r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in table.collect()]
        sizes = Counter()
        for _, s, n in rows:
            sizes[s] += n
        target = plain_targets(dict(sizes))
        found = apportion.mix(table).collect()
        assert sorted(map(str, ((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in found))) == sorted(
            map(str, ((i, n, sizes[s], round(float(target[s]), 6)) for i, s, n in rows)))
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
        by = Counter()
        for r in found:
            by[r["source_size"], round(r["target"], 6)] += r["taken"]
        shards = Counter((sizes[s], round(float(target[s]), 6)) for s in sizes)
        assert all(abs(n - key[1] * shards[key]) <= 2 * apportion.BLOCK_WORDS * shards[key] for key, n in by.items())
        assert sorted(map(str, found)) == sorted(map(str, apportion.mix(table.repartition(3)).collect()))
    assert apportion.mix(none).count() == 0


def test_mix_over_shards_and_as_texts(docs, odd):
    found = apportion.mix(docs, shard_words=500).collect()
    sizes = {r["source_size"]: r["target"] for r in found}
    taken = Counter()
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.1 * t + 32 for s, t in sizes.items())
    for table in (docs, odd):
        texts = apportion.mixed_texts(table, block_words=16)
        assert texts.schema.names == table.schema.names
        want = sorted(r["taken"] for r in apportion.mix(table, block_words=16).collect() if r["taken"])
        assert sorted(len(brute.words(r["text"])) for r in texts.collect()) == want


def check_classes(table, n, percent):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    sets, least = brute.classes(rows, n, percent)
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(
        table, n, percent).collect())))
    assert got == sorted(map(str, ((i, len(s), c if s else i) for (i, _), s, c in zip(rows, sets, least, strict=True))))


def near_family(spark, sizes, edits, seed=1):
    """Groups of near copies: each member has words of its group's text replaced."""
    dice = np.random.default_rng(seed)
    rows = []
    for g, size in enumerate(sizes):
        words = [f"g{g}w{i}" for i in range(120)]
        for k in range(size):
            mine = list(words)
            for at in dice.choice(120, dice.integers(0, edits + 1), replace=False):
                mine[at] = f"e{g}x{k}y{at}"
            rows.append((len(rows), " ".join(mine)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard_classes(odd, none, docs, spark):
    check_classes(odd, 3, 90)
    check_classes(docs, 3, 90)
    check_classes(docs, 5, 80)
    check_classes(near_family(spark, (30, 2, 1, 7), 4), 3, 90)
    assert jaccard.classes(none).count() == 0


def test_jaccard_in_blocks_and_without_pruning(spark, monkeypatch):
    table = near_family(spark, (25, 9), 5, 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    check_classes(table, 3, 90)
    monkeypatch.setattr(jaccard, "PRUNE_CELLS", 0)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    check_classes(table, 3, 80)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=12),
       st.sampled_from((50, 80, 90)))
def test_tree_walk_finds_every_link(sets, percent):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    got = {(i, int(j)) for i, found in jaccard.tree_links(arrays, arrays, percent) for j in found}
    assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
                   if 100 * len(a & b) >= percent * len(a | b)}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(-3, -2), (7, 7)], "a long, b long")
    found = {r["node"]: r["label"] for r in jaccard.components(chain).collect()}
    assert found == {i: 0 for i in range(61)} | {-3: -3, -2: -3}


def test_one_of_each_class(odd, none):
    kept = jaccard.one_of_each(odd)
    assert kept.schema.names == odd.schema.names
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # 8, 9, 9 and 10 are one class; rows without words stay
    assert ids == sorted(str(i) for i, *_ in ROWS if i not in (9, 10))
    assert jaccard.one_of_each(none).count() == 0


def test_quotation_links(spark):
    rows = [
        ("c", 0, "a", "First line here\nSecond line there"), ("c", 1, "b", "> First line here\n\nAn answer"),
        ("c", 2, "a", "On Monday b wrote:\n> > first   LINE here\n> An answer\nThanks\n>\n> nowhere said"),
        ("c", 3, None, None), ("c", 4, "b", ""), ("d", 0, "a", "First line here"), ("d", 0, "a", "First line here"),
        (None, 1, "a", "> First line here"), ("c", None, "a", "> An answer"), ("c", 5, "x", ">Thanks"),
    ]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id string, turn long, role string, text string, "
                                                                  "parent_turn string")
    found = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotations(table).collect()}
    place = lambda *k: tuple(found[k][c] for c in ("parent_turn", "root_turn", "depth", "n_quoted", "n_linked", "max_level"))
    assert place("c", 0) == (None, 0, 0, 0, 0, 0) and place("c", 1) == (0, 0, 1, 1, 1, 1)
    assert place("c", 2) == (1, 0, 2, 4, 2, 2) and found["c", 2]["text"] == "Thanks"
    assert place("c", 5) == (2, 0, 3, 1, 1, 1) and found["c", 3]["text"] == "" and found["c", 3]["message"] == "<||>\n"
    assert place(None, 1)[0] is None and place("c", None)[0] is None and place("d", 0) == (None, 0, 0, 0, 0, 0)
    assert quotes.link_quotations(table).count() == len(rows)
    assert quotes.link_quotations(table.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twins_on_the_larger_table(spark, sf, name):
    folder = sf.replace("0.001", "0.01")
    df, cur = QUERIES[name](spark, folder), connect(folder).execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, cur.fetchall())


def test_pipeline_stages(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf).cache()
    kept = {r["doc_id"] for r in good.collect()}
    bad = [i for i, q in labels.items() if not q]
    assert bad and sum(i in kept for i in bad) < len(bad)  # its decisions take effect
    assert good.exceptAll(docs).isEmpty()
    assert {i for i, q in labels.items() if q} <= {r["doc_id"] for r in good.collect()}
    read = stages["language"](spark, good, sf).cache()
    assert read.count() == good.where(F.rlike("text", F.lit(r"\p{L}"))).count()
    once = stages["near_duplicates"](spark, read, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in read.collect()]
    sets, least = brute.classes(rows, 5, 80)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(
        i for (i, _), s, c in zip(rows, sets, least, strict=True) if not s or c == i)
    mixed = stages["mixture"](spark, once, sf).cache()
    assert mixed.schema == docs.schema and good.schema == docs.schema and once.schema == docs.schema
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    found = stages["sequences"](spark, mixed, sf).collect()
    check_packed(found, [(r["doc_id"], r["text"]) for r in mixed.collect()], tokenizer)
    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]  # sequences depend on the partitions, pieces do not
    assert sorted(str([r[c] for c in pieces]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(
        str([r[c] for c in pieces]) for r in found)


def test_pipeline_on_odd_rows(spark, sf, tmp_path, tokenizer):
    """Null and repeated ids, null texts, repeated rows and columns of clashing names, among the given documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = docs.where("doc_id < 40")
    odd = few.limit(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(docs.schema, (
        None, "a text without an id, long enough to be read as words", None, None, 5), strict=True)])
    blank = few.limit(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(docs.schema, (
        3, None, "en", "a", None), strict=True)])
    table = docs.unionByName(few).unionByName(odd).unionByName(blank)
    table = table.select("*", *[F.lit(1).alias(c) for c in ("size", "node", "label", "seg", "_doc")])
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").unionByName(
        spark.read.parquet(f"{sf}/labels.parquet").limit(20)).write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    at = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert found and max(at.values()) <= 1024


def test_mixed_texts_of_equal_ids_do_not_depend_on_the_layout(spark):
    rows = [(i // 3, f"w{i} " * 40, "en", "s" if i % 2 else None, 0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once, again = (sorted(map(str, apportion.mixed_texts(d, block_words=16).collect())) for d in (docs, docs.repartition(7)))
    assert once == again


def test_pipeline_on_empty_documents(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_text_is_read_to_its_end(odd):
    found = {r["doc_id"]: r["n_words"] for r in licenses.scan(odd).collect()}
    assert found[7] == len(LONG.split()) and found[8] == len(NEAR.split())


def test_pipeline_hands_whole_texts_to_python_in_small_batches(spark, sf):
    """Ten thousand texts in a batch, Spark's default, take hundreds of megabytes outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    try:
        spark.conf.set(key, "10000")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        many = docs.crossJoin(spark.range(15)).drop("id").coalesce(1)
        for _, stage in corpus_pipeline.STAGES[1:2]:
            stage(spark, docs, sf)
        seen = many.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1).set_column(
            0, "doc_id", pa.array([b.num_rows], pa.int64())) for b in batches), "doc_id long").collect()
        assert sum(r[0] for r in seen) == 15 * docs.count() and max(r[0] for r in seen) <= 1000
    finally:
        spark.conf.set(key, before)

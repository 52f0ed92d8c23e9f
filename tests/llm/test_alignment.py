"""Alignment of tokenizers against a plain version."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import pytest

from wardlight.llm import alignment, tokens


def plain_tokens(text, a, b):
    """(start, stop, id) of both tokenizers, by their own libraries; None where bytes differ."""
    if not text:
        return None
    whole = b" " + text.encode()
    byte_of = tokens._byte_of()
    out = []
    ids = a.library.encode(" " + text, add_special_tokens=False).ids
    entries = [bytes(byte_of[c] for c in a.library.id_to_token(i)) for i in ids]
    out.append((ids, entries))
    ids = b.model.encode(text)
    pieces = [b.model.id_to_piece(i) for i in ids]
    out.append((ids, [bytes([int(p[3:5], 16)]) if b.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in zip(ids, pieces, strict=True)]))
    spans = []
    for ids, entries in out:
        if b"".join(entries) != whole:
            return None
        at, row = 0, []
        for i, e in zip(ids, entries, strict=True):
            row.append((at, at + len(e), i))
            at += len(e)
        spans.append(row)
    return spans


def plain(rows):
    a, b = tokens.ByteLevel(tokens.byte_level_path()), tokens.Pieces(tokens.piece_path())
    spans = [plain_tokens(t, a, b) for _, t in rows]
    links = []
    for s in spans:
        mine = []
        if s:
            j = 0
            for start, stop, i in s[0]:
                while s[1][j][1] <= start:
                    j += 1
                k = j
                while k < len(s[1]) and s[1][k][0] < stop:
                    mine.append((i, s[1][k][2]))
                    k += 1
        links.append(mine)
    count = Counter(x for mine in links for x in mine)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (doc_id, _), s, mine in zip(rows, spans, links, strict=True):
        groups = []
        if s:
            common = sorted({x[1] for x in s[0]} & {x[1] for x in s[1]})
            sides = [[[] for _ in common] for _ in s]
            for side, row in zip(sides, s, strict=True):
                for _, stop, i in row:
                    side[bisect.bisect_left(common, stop)].append(str(i))
            groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)]
        out.append((doc_id, len(s[0]) if s else 0, len(s[1]) if s else 0, len(groups), len(mine),
                    sum(count[x] == best[x[1]] for x in mine), sum(count[x] for x in mine),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if s else ""))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                       "groups_sha256").collect()), key=str)


TEXTS = ["<|endoftext|> is plain here", "a ▁ b", "tab\tand\n\n  two  blanks ", " ", "nul\x00byte", " wide spaces　",
         "<s>mark</s> <unk>", "😀😀 漢字 ñandú", "x" * 3000, "don't we'll they've"]


def test_alignment_of_odd_rows(spark, odd):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = plain(rows)
    assert sum(r[1] == 0 for r in expected) >= 3
    for block in (1, alignment.BLOCK_BYTES):  # one document a block, and one block a task
        assert as_rows(alignment.align(docs, block_bytes=block)) == expected


def test_alignment_of_given_documents(docs):
    assert as_rows(alignment.align(docs)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_alignment_of_no_rows(none):
    assert alignment.align(none).collect() == []


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64, 10_000])
def test_pieces_of_a_merge_give_the_same_links(work):
    rng = np.random.default_rng(work)
    a = np.unique(rng.integers(1, 900, 300))
    b = np.unique(rng.integers(1, 900, 120))
    a, b = np.append(a, 900), np.append(b, 900)
    expected, closes = [], []
    for e in np.union1d(a, b):
        expected.append((int((a < e).sum()), int((b < e).sum())))
        closes.append(e in a and e in b)
    left, right, both = alignment.overlaps(a, b, work)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == expected and both.tolist() == closes
    at_a, at_b = alignment.merge_cuts(a, b, work)
    assert (np.diff(at_a + at_b)[:-1] == work).all() and (np.diff(at_a) >= 0).all() and (np.diff(at_b) >= 0).all()


def test_links_of_lists_of_very_different_density():
    a, b = np.arange(1, 200_001), np.array([100_000, 200_000])
    left, right, both = alignment.overlaps(a, b, 1000)
    assert len(left) == 200_000 and both.sum() == 2 and right[99_999] == 0 and right[100_000] == 1


def test_long_texts_keep_their_tokens(spark):
    """A run of blanks beyond the pattern's stack, and a text of tens of megabytes."""
    blanks = " " * 4_000_000 + "x"
    a = tokens.ByteLevel(tokens.byte_level_path())
    assert a.bytes.joined(a(blanks)).tobytes() == blanks.encode()
    text = "some words of a long text, " * 800_000
    docs = spark.createDataFrame([(1, text), (2, "some words")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in alignment.align(docs).collect()}
    assert found[1]["n_links"] >= found[1]["n_groups"] > 4_000_000
    assert found[2]["n_best"] == found[2]["n_links"]

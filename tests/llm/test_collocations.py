"""Counting quotient filters and the phrases counted in them, against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from wardlight.llm import collocations
from wardlight.llm.quotient import Filter, permuted, restored


@pytest.mark.parametrize("k, bits", [(1, 9), (2, 5), (2, 16), (3, 20), (4, 17), (5, 13), (5, 27), (5, 33)])
def test_filters_lose_nothing(k, bits):
    """Packing, permuting, encoding, merging and cutting give every n-gram back with its exact count."""
    rng = np.random.default_rng(k * bits)
    words = [rng.integers(1, min(1 << bits, 40), 3000).astype(np.uint64) for _ in range(k)]
    words[0][:900] = 3
    for w in words:
        w[:700] = 7  # a counter longer than a byte
    assert all((a == b).all() for a, b in zip(words, restored(permuted(words, bits), bits), strict=True))
    parts = [Filter.decoded(Filter.of([w[a:b] for w in words], bits).encoded()) for a, b in ((0, 1000), (1000, 1001), (1001, 3000))]
    whole = Filter.merged(parts)
    shards = [f for _, c in whole.cut(0, 3) for _, f in Filter.decoded(c.encoded()).cut(3, 2)]
    found = Counter()
    for f in shards:
        for *gram, n in zip(*[w.tolist() for w in f.words()], f.counts.tolist(), strict=True):
            assert tuple(gram) not in found
            found[tuple(gram)] = n
    assert found == Counter(zip(*[w.tolist() for w in words], strict=True))
    assert len(whole.encoded()) < 9 * len(whole) * ((k * bits + 63) // 64) + 3000


def plain(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    often = {g: n for g, n in counts.items() if n >= least}
    held = Counter()
    for (lang, g), n in often.items():
        for i in range(len(g)):
            for j in range(i + 2, len(g) + 1):
                if j - i < len(g):
                    held[lang, g[i:j]] = max(held[lang, g[i:j]], n)
    out = {}
    for (lang, g), a in often.items():
        if len(g) > 1 and held[lang, g] < a:
            s, _, x, y = min((1000 * a * totals[lang] // (often[lang, g[:k]] * often[lang, g[k:]]), k, often[lang, g[:k]],
                              often[lang, g[k:]]) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-s, -a, " ".join(g).encode(), x, y))
    return sorted((lang, i, p.decode(), -a, x, y, totals[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def check(docs, least, top=2000, **options):
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    found = sorted(map(tuple, collocations.collocations(docs, least, top=top, **options).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    expected = plain(rows, least, 5, top)
    assert found == expected
    return len(found)


def test_phrases_of_odd_rows(odd, none):
    assert check(odd, 2) > 20
    assert check(odd.repartition(5), 1, top=50, block_bytes=100) > 50
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(odd, 10**6).collect() == []


def test_filters_merge_in_rounds(docs, monkeypatch):
    """Many small filters, merged four at a time by four ranges a round."""
    monkeypatch.setattr(collocations, "FAN_BITS", 2)
    monkeypatch.setattr(collocations, "FAN", 4)
    assert check(docs.limit(60).repartition(9), 3, entries=500, block_bytes=20_000) > 100


def test_phrases_of_given_documents(docs):
    assert check(docs, 20) > 100

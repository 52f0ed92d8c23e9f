"""No prefilter of the license scan drops a match: texts made from every rule's own expression."""

import random
import re
from itertools import product
from re import _constants as C
from re import _parser

from wardlight.llm import licenses

LIMIT = 4000


def texts_of(nodes):
    """Texts that an expression matches: every alternative, both ends of an optional part, every listed character."""
    parts = []
    for op, arg in nodes:
        if op is C.LITERAL:
            parts.append([chr(arg)])
        elif op is C.ANY:
            parts.append(["~"])
        elif op is C.IN:
            out = []
            for kind, v in arg:
                out += [chr(v)] if kind is C.LITERAL else [chr(v[0]), chr(v[1])] if kind is C.RANGE else [" ", "\n"]
            parts.append(out)
        elif op is C.BRANCH:
            parts.append([t for branch in arg[1] for t in texts_of(branch)])
        elif op is C.SUBPATTERN:
            parts.append(texts_of(arg[3]))
        elif op is C.MAX_REPEAT:
            low, _, inner = arg
            parts.append([t * n for t in texts_of(inner) for n in ((low, low + 1) if low else (0, 1))])
        else:
            assert op in (C.AT, C.ASSERT_NOT), op
    draw = random.Random(1)
    total = 1
    for p in parts:
        total *= len(p)
    if total <= LIMIT:
        return list(dict.fromkeys(map("".join, product(*parts))))
    # too many to list: every choice of every part at least once, the rest drawn
    rows = [[draw.choice(p) for p in parts] for _ in range(LIMIT // 4)]
    rows += [[*[draw.choice(q) for q in parts[:i]], v, *[draw.choice(q) for q in parts[i + 1:]]]
             for i, p in enumerate(parts) for v in p for _ in range(3)]
    return list(dict.fromkeys(map("".join, rows)))


def samples():
    for rule in licenses.rule_table():
        pattern = re.compile(rule[4], re.ASCII)
        found = [t for t in texts_of(_parser.parse(rule[4])) if pattern.fullmatch(t)]
        assert found, rule
        yield rule, found


def test_every_match_meets_its_rules_keywords():
    for rule, found in samples():
        for t in found:
            assert any(a in t for a in licenses.ANCHORS), (rule, t)
            assert all(any(w in t for w in words) for words in licenses.lists_of(rule[3])), (rule, t)


def test_every_rule_labels_its_matches(spark):
    draw, rows = random.Random(2), []
    for rule, found in samples():
        rows += [(len(rows) + i, f"x. {t} y", rule[0], rule[4]) for i, t in enumerate(draw.sample(found, min(6, len(found))))]
    said = {i: (t, label, e) for i, t, label, e in rows}
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8)
    lost = []
    for r in licenses.scan(table).collect():
        t, label, e = said[r["doc_id"]]
        at = next(m.span() for m in re.finditer(e, t, re.ASCII))
        # found under its label, or inside a kept interval of another rule that goes before it
        if not any((s["label"] == label and s["start"] < at[1] and at[0] < s["stop"])
                   or (s["start"] <= at[0] and at[1] <= s["stop"]) for s in r["spans"]):
            lost.append((label, t))
    assert not lost


def test_named_in_the_review(spark):
    texts = {
        "distributed under the GNU GPL version 3": "gpl", "released under the MIT/X11 terms": "mit",
        "Creative Commons Zero license": "cc0", "licensed under the Creative Commons Attribution License": "cc-by",
        "licensed under the Creative Commons Attribution-ShareAlike License": "cc-by-sa",
        "licensed under the Creative Commons Attribution NoDerivs License": "cc-by-nd",
        "released under the Unlicense": "unlicense", "the Unlicense license": "unlicense",
        "University of Illinois license": "ncsa", "see COPYING for details": "license-file",
        "accompanying materials are made available under the terms of the Eclipse": "epl", "the UN license": ""}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {list(texts)[r["doc_id"]]: r["labels"] for r in licenses.scan(table).collect()}
    assert got == texts

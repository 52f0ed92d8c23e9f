"""License scan by ordered signature rules, in DataFrame functions only.

A rule is a regular expression with a keyword, a label, a priority and a
score. A keyword says what every match of the expression holds: ``&`` joins
lists, ``|`` the alternatives of a list, and each list has one alternative that
stands in the match. Two prefilters keep the expressions away from most texts:
a document must hold an anchor (an alternative of some rule's first list), and
every list of a rule must be met. Neither drops a match. Every match of a rule
that is left becomes an interval of characters. An interval
that lies inside one of higher priority, or inside a longer one of the same
priority, is suppressed. Nothing is shuffled: a document's intervals are an
array in its row, scanned once in order of their start.

Defined results: null text is empty text; a text without a match has empty
labels, null word positions and score 0; extra columns are ignored; equal rows
give equal rows; an empty table gives an empty result. Only A-Z are lowered.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.textio import low, text_of

WORD6 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP6 = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values of the contract: phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Priorities: full grant texts over identifiers over named references over vague notices.
TEXT, IDENTIFIER, NAMED, NOTICE = 4, 3, 2, 1
CLASSES = 4

#: In every name of a Creative Commons attribution license.
BY = "cc by|cc-by|creative commons attribution"
#: label, name as a pattern, alternatives of which every such name holds one, SPDX identifier as a pattern.
FAMILIES = (
    ("mit", r"mit(?:/x11)?", "mit", r"mit(?:-0)?"),
    ("x11", r"x11", "x11", r"x11"),
    ("isc", r"isc", "isc", r"isc"),
    ("apache", r"apache(?: software)?", "apache", r"apache-[12]\.[01]"),
    ("bsd", r"(?:new |modified |simplified |revised )?bsd(?:[ -][0-4][ -]clause)?", "bsd", r"bsd-[0-4]-clause(?:-[a-z]+)*|0bsd"),
    ("gpl", r"gnu (?:gpl|general public)", "gnu", r"gpl-[123]\.0(?:-only|-or-later|\+)?"),
    ("lgpl", r"gnu (?:lgpl|lesser general public|library general public)", "gnu", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?"),
    ("agpl", r"gnu (?:agpl|affero general public)", "gnu", r"agpl-[13]\.0(?:-only|-or-later|\+)?"),
    ("fdl", r"gnu free documentation", "free documentation", r"gfdl-1\.[123](?:-only|-or-later)?"),
    ("mpl", r"mozilla(?: public)?", "mozilla", r"mpl-[12]\.[01]"),
    ("epl", r"eclipse(?: public)?", "eclipse", r"epl-[12]\.0"),
    ("edl", r"eclipse distribution", "eclipse distribution", r"edl-1\.0"),
    ("cddl", r"common development and distribution", "common development", r"cddl-1\.[01]"),
    ("cpl", r"common public", "common public", r"cpl-1\.0"),
    ("cpal", r"common public attribution", "public attribution", r"cpal-1\.0"),
    ("ipl", r"ibm public", "ibm public", r"ipl-1\.0"),
    ("eupl", r"european union public", "european union", r"eupl-1\.[0-2]"),
    ("artistic", r"artistic", "artistic", r"artistic-[12]\.0"),
    ("perl", r"perl artistic", "perl", r"artistic-1\.0-perl"),
    ("python", r"python(?: software foundation)?", "python", r"psf-2\.0|python-2\.0"),
    ("php", r"php", "php", r"php-3\.0[1]?"),
    ("ruby", r"ruby", "ruby", r"ruby"),
    ("zlib", r"zlib(?:/libpng)?", "zlib", r"zlib(?:-acknowledgement)?"),
    ("libpng", r"libpng", "libpng", r"libpng(?:-2\.0)?"),
    ("openssl", r"openssl", "openssl", r"openssl"),
    ("curl", r"curl", "curl", r"curl"),
    ("boost", r"boost(?: software)?", "boost", r"bsl-1\.0"),
    ("busl", r"business source", "business source", r"busl-1\.1"),
    ("sspl", r"server side public", "server side", r"sspl-1\.0"),
    ("elastic", r"elastic", "elastic", r"elastic-2\.0"),
    ("unlicense", r"unlicen[cs]e", "unlicen", r"unlicense"),
    ("wtfpl", r"do what the f[u*]ck you want to public", "do what the", r"wtfpl"),
    ("cc0", r"cc[- ]?0|creative commons zero", "cc0|cc-0|cc 0|creative commons zero", r"cc0-1\.0"),
    ("cc-by-nc-nd", r"cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]noncommercial[- ]noderiv(?:ative)?s", BY, r"cc-by-nc-nd-[1-4]\.[05]"),
    ("cc-by-nc-sa", r"cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]noncommercial[- ]sharealike", BY, r"cc-by-nc-sa-[1-4]\.[05]"),
    ("cc-by-nc", r"cc[- ]by[- ]nc(?![- ](?:nd|sa))|creative commons attribution[- ]noncommercial(?![- ](?:no|sh))", BY, r"cc-by-nc-[1-4]\.[05]"),
    ("cc-by-nd", r"cc[- ]by[- ]nd|creative commons attribution[- ]noderiv(?:ative)?s", BY, r"cc-by-nd-[1-4]\.[05]"),
    ("cc-by-sa", r"cc[- ]by[- ]sa|creative commons attribution[- ]sharealike", BY, r"cc-by-sa-[1-4]\.[05]"),
    ("cc-by", r"cc[- ]by(?![- ](?:nc|nd|sa))|creative commons attribution(?![- ](?:no|sh))", BY, r"cc-by-[1-4]\.[05]"),
    ("odbl", r"open (?:data commons open )?database", "database", r"odbl-1\.0"),
    ("odc-by", r"open data commons attribution", "open data commons", r"odc-by-1\.0"),
    ("pddl", r"public domain dedication and", "dedication", r"pddl-1\.0"),
    ("ofl", r"sil open font", "open font", r"ofl-1\.[01](?:-rfn|-no-rfn)?"),
    ("ncsa", r"university of illinois(?:/ncsa open source)?|ncsa", "university of illinois|ncsa", r"ncsa"),
    ("afl", r"academic free", "academic free", r"afl-[1-3]\.[0-2]"),
    ("osl", r"open software", "open software", r"osl-[1-3]\.[01]"),
    ("ms-pl", r"microsoft public", "microsoft public", r"ms-pl"),
    ("ms-rl", r"microsoft reciprocal", "microsoft reciprocal", r"ms-rl"),
    ("qpl", r"q public", "q public", r"qpl-1\.0"),
    ("apsl", r"apple public source", "apple public", r"apsl-[12]\.[0-2]"),
    ("cecill", r"cecill(?:-[bc])?", "cecill", r"cecill-(?:[12]\.[01]|[bc])"),
    ("mulan", r"mulan(?: permissive software)?", "mulan", r"mulanpsl-[12]\.0"),
    ("postgresql", r"postgresql", "postgresql", r"postgresql"),
    ("unicode", r"unicode", "unicode", r"unicode-(?:dfs-201[56]|3\.0)"),
    ("w3c", r"w3c(?: software)?", "w3c", r"w3c(?:-19980720|-20150513)?"),
    ("upl", r"universal permissive", "universal permissive", r"upl-1\.0"),
    ("vim", r"vim", "vim", r"vim"),
    ("tcl", r"tcl(?:/tk)?", "tcl", r"tcl"),
    ("icu", r"icu", "icu", r"icu"),
    ("zpl", r"zope public", "zope", r"zpl-[12]\.[01]"),
)
#: Ways in which a text names a license; ``{}`` is the name. Priority, score and keyword lists beside the name's with each.
WAYS = (
    (NAMED, 0.9, "licensed|released|distributed|available|published|provided|covered& under | by ", r"\b(?:licensed|released|distributed|available|published|provided|covered|made available)"
                 r"(?: [a-z]+){{0,2}} (?:under|by)(?: the)?(?: terms of)?(?: the)? (?:{})(?: licen[cs]e)?\b"
                 r"(?:,? (?:version )?v?[0-9](?:\.[0-9])*)?"),
    (NAMED, 0.7, " license| licence", r"\b(?:{}) licen[cs]e\b(?:,? (?:version )?v?[0-9](?:\.[0-9])*)?"),
    (NOTICE, 0.5, "license:|licence:", r"\blicen[cs]e: ?(?:{})\b"),
)
#: label, priority, score, keyword, expression: sentences that are typical of one license's own text.
SENTENCES = (
    ("mit", TEXT, 1.0, "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a\s+copy"),
    ("mit", TEXT, 0.9, "the above copyright notice and this permission", r"the above copyright notice and this permission notice\s+shall be included"),
    ("isc", TEXT, 1.0, "permission to use, copy, modify", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any\s+purpose"),
    ("bsd", TEXT, 1.0, "redistribution and use in source", r"redistribution and use in source and binary forms,? with or without\s+modification"),
    ("bsd", TEXT, 0.9, "redistributions of source code", r"redistributions of source code must retain the above\s+copyright"),
    ("bsd", TEXT, 0.9, "redistributions in binary form", r"redistributions in binary form must reproduce the above\s+copyright"),
    ("apache", TEXT, 1.0, "you may not use this file except", r"you may not use this file except in compliance with the\s+license"),
    ("apache", TEXT, 0.9, "apache.org/licenses", r"https?://(?:www\.)?apache\.org/licenses/[a-z0-9./-]*"),
    ("gpl", TEXT, 1.0, "under the terms of the gnu general", r"redistribute it and/or modify\s+it under the terms of the gnu general public\s+license"),
    ("gpl", TEXT, 0.9, "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl[a-z0-9./-]*"),
    ("lgpl", TEXT, 0.9, "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl[a-z0-9./-]*"),
    ("agpl", TEXT, 0.9, "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses/agpl[a-z0-9./-]*"),
    ("mpl", TEXT, 1.0, "source code form is subject to", r"this source code form is subject to the terms of the mozilla\s+public license"),
    ("epl", TEXT, 1.0, "accompanying materials are made available", r"accompanying materials are made available under the\s+terms of the eclipse"),
    ("zlib", TEXT, 1.0, "provided 'as-is', without any express", r"this software is provided 'as-is', without any express or implied\s+warranty"),
    ("unlicense", TEXT, 1.0, "free and unencumbered software", r"free and unencumbered software released into the\s+public domain"),
    ("boost", TEXT, 1.0, "boost software license", r"boost software license - version 1\.0"),
    ("wtfpl", TEXT, 1.0, "public license", r"do what the f[u*]ck you want to public license"),
    ("ofl", TEXT, 0.9, "scripts.sil.org", r"https?://scripts\.sil\.org/ofl\b.{0,40}licen[cs]e"),
    ("cc0", TEXT, 0.9, "creativecommons.org/publicdomain", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by", TEXT, 0.9, "creativecommons.org/licenses/by/", r"creativecommons\.org/licenses/by/[1-4]\.[05]"),
    ("cc-by-sa", TEXT, 0.9, "creativecommons.org/licenses/by-sa/", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]"),
    ("cc-by-nc", TEXT, 0.9, "creativecommons.org/licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]"),
    ("cc-by-nd", TEXT, 0.9, "creativecommons.org/licenses/by-nd/", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]"),
    ("mit", TEXT, 0.9, "opensource.org/licenses/mit", r"https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?"),
    ("cc-by-nc", NAMED, 0.9, "cc by-nc", r"\blicensed under cc by-nc [1-4]\.[05]"),
    ("public-domain", NAMED, 0.8, "public domain", r"\b(?:released|dedicated|placed|donated) (?:in)?to the public domain"),
    ("public-domain", NOTICE, 0.5, "public domain", r"\bthis (?:work|file|software|text) is in the public domain"),
    ("proprietary", NAMED, 0.8, "proprietary", r"\bproprietary and confidential\b.{0,80}(?:copyright|licen[cs]e|rights reserved)"),
    ("proprietary", NOTICE, 0.6, "all rights reserved", r"\ball rights reserved\b"),
    ("copyright", NOTICE, 0.3, "copyright", r"\bcopyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}\b"),
    ("copyright", NOTICE, 0.3, "(c)", r"\(c\) (?:copyright )?(?:19|20)[0-9]{2}\b"),
    ("warranty-disclaimer", NOTICE, 0.3, "without warrant", r"\bwithout warrant(?:y|ies) of any kind"),
    ("copyleft", NOTICE, 0.3, "copyleft", r"\bcopyleft\b"),
    ("license-file", NOTICE, 0.3, "for details|for the full license", r"\bsee (?:the )?(?:license|copying)(?:\.txt|\.md)? (?:file )?for (?:details|the full license)"),
)


def rule_table() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, score, keyword, expression) in order: the sentences, identifiers, then ways x families."""
    rules = list(SENTENCES)
    rules += [(label, IDENTIFIER, 1.0, "spdx-license-identifier", rf"\bspdx-license-identifier: ?\(?(?:{spdx})(?![a-z0-9.-])")
              for label, _, _, spdx in FAMILIES]
    rules += [(label, priority, score, f"{held}&{keyword}", way.format(name))
              for (priority, score, held, way), (label, name, keyword, _) in product(WAYS, FAMILIES)]
    return rules


def lists_of(keyword: str) -> list[list[str]]:
    return [part.split("|") for part in keyword.split("&")]


def anchors_of(rules) -> list[str]:
    """Alternatives of all first lists: a text that matches any rule holds one of them."""
    return sorted({word for _, _, _, keyword, _ in rules for word in lists_of(keyword)[0]})


ANCHORS = anchors_of(rule_table())


def _literals(rules) -> Column:
    """``rules`` are (id, rule, alternatives of its last keyword list)."""
    kind = "array<struct<id:int,label:string,priority:int,score:double,pattern:string,words:array<string>>>"
    return F.array(*[F.struct(
        F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(float(s)).alias("score"),
        F.lit(e).alias("pattern"), F.array(*map(F.lit, words)).alias("words"))
        for i, (label, p, s, _, e), words in rules]).cast(kind)


def _holds_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _hits(text: Column, rules) -> Column:
    """The rules whose keyword lists are all met. Lists that many rules begin with are looked up once for all of them."""
    groups = defaultdict(list)
    for i, rule in enumerate(rules):
        shared, _, own = rule[3].rpartition("&")
        groups[shared].append((i, rule, own.split("|")))
    out = []
    for shared, table in groups.items():
        met = F.filter(_literals(table), lambda r: F.exists(r["words"], lambda w: F.contains(text, w)))
        if shared:
            gate = reduce(lambda a, b: a & b, [_holds_any(text, words) for words in lists_of(shared)])
            met = F.when(gate, met).otherwise(F.slice(_literals(table[:1]), 1, 0))
        out.append(met)
    return F.concat(*out)


def _spans(text: Column, rule: Column) -> Column:
    """All matches of one rule as (start, end), by the lengths of what lies between the matches."""
    between = F.transform(F.split(text, rule["pattern"], -1), F.length)
    found = F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.length)
    sizes = F.arrays_zip(between.alias("a"), found.alias("b"))
    walk = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["a"] + F.coalesce(x["b"], F.lit(0))).alias("at"),
            F.when(x["b"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["a"]).alias("start"),
                (acc["at"] + x["a"] + x["b"]).alias("stop"))))).alias("out")))["out"]
    return F.transform(walk, lambda s: F.struct(
        s["start"].alias("start"), (-s["stop"]).alias("back"), (-rule["priority"]).alias("down"),
        rule["id"].alias("rule"), rule["label"].alias("label"), rule["score"].alias("score")))


def _unsuppressed(found: Column) -> Column:
    """Drop intervals that lie in one of higher priority, or in one of the same that comes first.

    In order of (start, -stop, -priority, rule) every interval that can hold
    another one comes before it, so the furthest stop seen so far, for each
    priority and above, decides.
    """
    none = F.array(*[F.lit(-1) for _ in range(CLASSES)])
    empty = F.expr("cast(array() as array<struct<start:int,back:int,down:int,rule:int,label:string,score:double>>)")
    return F.aggregate(
        F.array_sort(found), F.struct(none.alias("far"), empty.alias("out")),
        lambda acc, x: F.struct(
            F.transform(acc["far"], lambda far, i: F.when(i < -x["down"], F.greatest(far, -x["back"])).otherwise(far))
            .alias("far"),
            F.when(F.element_at(acc["far"], -x["down"]) >= -x["back"], acc["out"]).otherwise(
                F.concat(acc["out"], F.array(x))).alias("out")))["out"]


def detections(docs: DataFrame, rules=None) -> DataFrame:
    """``docs`` with ``low_text`` and ``found``: the intervals that stay, as (start, back = -stop, down = -priority, ...).

    ``far[i]`` holds the furthest stop among intervals of priority above i.
    An interval of lower priority that holds a higher one stays as well: both
    are reported.
    """
    rules = rules or rule_table()
    text = F.col("low_text")
    gate = _holds_any(text, anchors_of(rules))
    found = F.flatten(F.transform(_hits(text, rules), lambda r: _spans(text, r)))
    none = F.expr("cast(array() as array<struct<start:int,back:int,down:int,rule:int,label:string,score:double>>)")
    return docs.withColumn("found", F.when(gate, _unsuppressed(found)).otherwise(none))


def scan(docs: DataFrame, rules=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the kept intervals (``spans``)."""
    rows = docs.select("doc_id", low(text_of()).alias("low_text"))
    gate = F.contains("low_text", F.lit("license"))
    words = F.when(gate, F.concat(F.lit(" "), F.regexp_replace(
        F.concat(F.lit(" "), F.col("low_text"), F.lit(" ")), GAP6, "  "), F.lit(" ")))
    rows = detections(rows, rules).select(
        "doc_id", "found", F.regexp_count("low_text", F.lit(WORD6)).cast("long").alias("n_words"),
        words.alias("_words"))
    # every word stands between two blanks of its own: " a " + " b "; words before a place = its blanks / 2
    for phrase, label in PHRASES:
        parts = F.split(F.col("_words"), " " + phrase.replace(" ", "  ") + " ", -1)
        rows = rows.withColumn(f"_{label}", F.when(F.col("_words").isNotNull(), parts))
    blanks = lambda c: F.regexp_count(c, F.lit("[^ ]+"))
    counts, firsts, lasts, named = [], [], [], []
    for phrase, label in PHRASES:
        places = F.coalesce(F.size(f"_{label}") - 1, F.lit(0))
        places = F.when(places > 0, places).otherwise(F.lit(0))
        counts.append(places)
        firsts.append(F.when(places > 0, blanks(F.element_at(f"_{label}", 1))))
        lasts.append(F.when(places > 0, F.col("n_words") - blanks(F.element_at(f"_{label}", -1))
                            - len(phrase.split(" "))))
        named.append(F.when(places > 0, F.lit(label)))
    base = F.array_compact(F.array(*named))
    return rows.select(
        "doc_id", "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(
            base, F.transform("found", lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("found", lambda d: d["score"])), F.lit(0.0)),
                   F.when(F.size(base) > 0, F.lit(0.7)).otherwise(F.lit(0.0))).alias("score"),
        F.transform("found", lambda d: F.struct(
            d["label"].alias("label"), d["start"].alias("start"), (-d["back"]).alias("stop"),
            (-d["down"]).alias("priority"))).alias("spans"))

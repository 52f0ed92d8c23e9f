"""The registered query of every operator of this subpackage, the pipeline, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlight.llm import (alignment, apportion, collocations, jaccard, langid, licenses, mixing, nbsvm, packing, quotes, repeats, rules,
                           simhash)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_documents(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.screen(table(spark, sf_dir, "documents"))


def op4_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix(table(spark, sf_dir, "documents"))


def op8_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(quotes.as_mail(table(spark, sf_dir, "conversations")))


def op11_column_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op12_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # it stands at the top and imports this subpackage

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_context_mixing, op2_simhash, op3_rule_ledger, op4_nb_svm, op5_bounded_packing, op6_license_rules, op7_sainte_lague,
    op8_rank_order_profiles, op9_prefix_tree_join, op10_quotation_linking, op11_column_repeats,
    op12_quotient_collocations,
    op13_merge_path, pipeline)}

LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
words AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
near AS (
  SELECT id, i, word, lag(word) OVER o AS before, lead(word) OVER o AS next1, lead(word, 2) OVER o AS next2
  FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
triples AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, word, next1, next2) AS n FROM near WHERE next2 IS NOT NULL),
covered AS (SELECT DISTINCT id, i + k AS i FROM triples, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1),
repeated AS (SELECT id, count(*) AS n FROM covered GROUP BY id),
stutter AS (SELECT id, count(*) AS n FROM near WHERE word = before GROUP BY id),
lines AS (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
m AS (
  SELECT w.doc_id, len(words)::bigint AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
         coalesce(dups.n_dup, 0)::bigint AS n_dup_lines, coalesce(repeated.n, 0)::bigint AS n_repeat_words,
         coalesce(dups.n_lines, 0)::bigint AS n_lines, coalesce(stutter.n, 0)::bigint AS n_same_as_before,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint AS n_upper,
         length(regexp_replace(t, '[^a-z]', '', 'g'))::bigint AS n_lower,
         length(regexp_replace(t, '[^!]', '', 'g'))::bigint AS n_marks
  FROM w LEFT JOIN repeated USING (id) LEFT JOIN stutter USING (id) LEFT JOIN dups USING (id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_same_as_before > 30 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 50 * (n_upper + n_lower) THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_marks > 50 * n_words THEN 64 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 128 ELSE 0 END)::bigint AS failed FROM m)
SELECT *, failed = 0 AS kept, failed & 3 <> 0 AS base_failed FROM f
"""

QUOTES_SQL = r"""
WITH RECURSIVE firsts AS (
  SELECT conv_id, turn, min({'text': coalesce(text, ''), 'role': role}) AS m FROM conversations GROUP BY ALL),
source AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS text, a.m.text AS t1, a.m.role AS r1, b.m.text AS t2,
         b.m.role AS r2, c.turn % 3 = 2 AS third
  FROM conversations c LEFT JOIN firsts a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
  LEFT JOIN firsts b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
mail AS (
  SELECT conv_id, turn, role, CASE WHEN (CASE WHEN third THEN t2 ELSE t1 END) IS NULL THEN text ELSE
    'On an earlier turn ' || coalesce(CASE WHEN third THEN r2 ELSE r1 END, 'someone') || ' wrote:' || chr(10)
    || CASE WHEN third OR t2 IS NULL THEN '' ELSE '> > ' || replace(t2, chr(10), chr(10) || '> > ') || chr(10) END
    || '> ' || replace(CASE WHEN third THEN t2 ELSE t1 END, chr(10), chr(10) || '> ') || chr(10) || chr(10) || text
    END AS text, row_number() OVER () AS id
  FROM source),
lines AS (
  SELECT id, conv_id, turn, role, i, line,
         length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level,
         lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', ''), '[ \t-\r]+', ' ', 'g'))) AS norm
  FROM (SELECT id, conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM mail)),
own AS (SELECT * FROM lines WHERE level = 0 AND NOT regexp_matches(line, '(?i)^[ \t]*on .{0,200} wrote:[ \t]*$')),
written AS (
  SELECT conv_id, norm, min(turn) AS original FROM own WHERE regexp_matches(norm, '[\p{L}\p{N}]') GROUP BY ALL),
linked AS (
  SELECT l.conv_id, l.turn, l.level, w.original, count(*) AS n, sum(length(norm) - length(replace(norm, ' ', '')) + 1) AS words
  FROM lines l JOIN written w USING (conv_id, norm)
  WHERE l.level > 0 AND w.original < l.turn AND regexp_matches(norm, '[\p{L}\p{N}]') GROUP BY ALL),
parents AS (
  SELECT conv_id, turn, max({'words': words, 'original': original}).original AS parent_turn
  FROM linked WHERE level = 1 GROUP BY ALL),
up AS (
  SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM parents
  UNION ALL
  SELECT u.conv_id, u.turn, p.parent_turn, u.depth + 1 FROM up u JOIN parents p
  ON p.conv_id = u.conv_id AND p.turn = u.root_turn),
tops AS (SELECT conv_id, turn, max(depth) AS depth, min(root_turn) AS root_turn FROM up GROUP BY ALL),
texts AS (
  SELECT id, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS text
  FROM own GROUP BY id),
quoted AS (SELECT id, sum((level > 0)::int) AS n_quoted, max(level) AS max_level FROM lines GROUP BY id),
joined AS (SELECT conv_id, turn, sum(n) AS n_linked FROM linked GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, p.parent_turn, coalesce(t.root_turn, m.turn) AS root_turn,
       coalesce(t.depth, 0)::bigint AS depth, q.n_quoted::bigint AS n_quoted, coalesce(j.n_linked, 0)::bigint AS n_linked,
       q.max_level::bigint AS max_level, coalesce(x.text, '') AS text,
       '<|' || coalesce(m.role, '') || '|>' || chr(10) || coalesce(x.text, '') AS message
FROM mail m JOIN quoted q USING (id) LEFT JOIN texts x USING (id)
LEFT JOIN parents p ON p.conv_id = m.conv_id AND p.turn = m.turn
LEFT JOIN tops t ON t.conv_id = m.conv_id AND t.turn = m.turn
LEFT JOIN joined j ON j.conv_id = m.conv_id AND j.turn = m.turn
"""

COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT id, doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(generate_series(1, len(w) - 2),
    lambda i: array_to_string(w[i:i + 2], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM d),
one AS (SELECT min(id) AS node, min(doc_id) AS doc_id, grams, len(grams) AS n FROM s WHERE len(grams) > 0 GROUP BY grams),
flat AS (SELECT node, unnest(grams) AS gram FROM one),
shared AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM flat a JOIN flat b ON a.gram = b.gram AND a.node < b.node
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared o JOIN one x ON x.node = a JOIN one y ON y.node = b
  WHERE 100 * o.n >= 90 * (x.n + y.n - o.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM one UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
classes AS (SELECT r.a AS node, min(o.doc_id) AS component_id FROM reach r JOIN one o ON o.node = r.b GROUP BY r.a)
SELECT s.doc_id, len(s.grams)::bigint AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN one ON one.grams = s.grams LEFT JOIN classes c ON c.node = one.node
"""

COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT id, lang, unnest(parts) AS piece, generate_subscripts(parts, 1) AS p
  FROM (SELECT id, lang, regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+') AS parts FROM d)),
words AS (SELECT id, lang, p, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT id, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
near AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4,
  lead(word, 4) OVER o AS w5 FROM words WINDOW o AS (PARTITION BY id, p ORDER BY i)),
grams AS (
  SELECT lang, [w1] AS g FROM near UNION ALL SELECT lang, [w1, w2] FROM near WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3] FROM near WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4] FROM near WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM near WHERE w5 IS NOT NULL),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, g, f AS a, unnest(generate_series(1, len(g) - 1)) AS k FROM f WHERE len(g) > 1),
rated AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, t.n,
         ((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f))::bigint AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, g[:-2] AS g, f FROM f WHERE len(g) > 2
  UNION ALL SELECT lang, g[2:] AS g, f FROM f WHERE len(g) > 2) GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN held h USING (lang, g)
  WHERE h.f IS NULL OR 100 * h.f < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
       a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op3_rule_ledger": LEDGER_SQL, "op9_prefix_tree_join": COMPONENTS_SQL,
                          "op10_quotation_linking": QUOTES_SQL, "op12_quotient_collocations": COLLOCATIONS_SQL}

"""DuckDB SQL for the queries that SQL can express, written from their rules and not from the operators."""

from __future__ import annotations

from cohortlens.llm import licences, neardup, quality

WORDS = r"'[^\x20\x09-\x0D]+'"


def quality_rules() -> str:
    m, prior = quality.BUCKETS, quality.PRIOR
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM docs),
h AS (SELECT doc_id, pos, word, ('0x' || substr(md5(word), 1, 15))::BIGINT % {m} AS b,
             lead(('0x' || substr(md5(word), 1, 15))::BIGINT % {m}) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt,
             CASE WHEN lead(word, 4) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL THEN
               concat_ws(' ', word, lead(word, 1) OVER (PARTITION BY doc_id ORDER BY pos), lead(word, 2) OVER (PARTITION BY doc_id ORDER BY pos),
                         lead(word, 3) OVER (PARTITION BY doc_id ORDER BY pos), lead(word, 4) OVER (PARTITION BY doc_id ORDER BY pos)) END AS five
      FROM w),
twice AS (SELECT doc_id, pos FROM h WHERE five IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, {WORDS}) GROUP BY doc_id),
grams AS (SELECT doc_id, b AS bucket FROM h UNION ALL SELECT doc_id, (b * 31 + nxt) % {m} + {m} FROM h WHERE nxt IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
counts AS (SELECT bucket, count(*) AS r, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)) AS t FROM grams GROUP BY bucket),
e AS (SELECT sum(t)::DOUBLE / sum(r) AS e FROM counts),
ratios AS (SELECT bucket, CASE WHEN e = 0 THEN 0 ELSE round(1e6 * ln((t + {prior} * e) / (r + {prior}) / e)) END AS ratio FROM counts, e),
scores AS (SELECT doc_id, sum(ratio) / count(*) / 1e6 AS score FROM grams JOIN ratios USING (bucket) GROUP BY doc_id),
figures AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         round(coalesce(score, 0.0), 6) AS score
  FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN scores USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND score >= {quality.MIN_SCORE} AS kept, score
FROM figures"""


def near_duplicates() -> str:
    n, s = neardup.SHINGLE, neardup.SIMILARITY
    following = ", ".join(f"lead(word, {k}) OVER p" for k in range(1, n))
    return f"""
WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT first_id, unnest(words) AS word, unnest(range(len(words))) AS pos
      FROM (SELECT first_id, regexp_extract_all(text, {WORDS}) AS words FROM texts)),
shingles AS (SELECT first_id, CASE WHEN lead(word, {n - 1}) OVER p IS NOT NULL THEN concat_ws(' ', word, {following}) END AS s
             FROM w WINDOW p AS (PARTITION BY first_id ORDER BY pos)),
bags AS (SELECT first_id, s, count(*) AS c FROM shingles WHERE s IS NOT NULL GROUP BY ALL),
sizes AS (SELECT first_id, sum(c) AS n FROM bags GROUP BY first_id),
both_have AS (SELECT a.first_id AS a, b.first_id AS b, sum(least(a.c, b.c)) AS o FROM bags a JOIN bags b ON a.s = b.s AND a.first_id < b.first_id GROUP BY ALL),
links AS (SELECT a, b FROM both_have JOIN sizes x ON x.first_id = a JOIN sizes y ON y.first_id = b WHERE o >= {s} * (x.n + y.n - o)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS root FROM ways UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node WHERE reach.root < ways.b),
classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, coalesce(root, first_id, doc_id) AS class_id, doc_id = coalesce(root, first_id, doc_id) AS kept
FROM documents LEFT JOIN texts USING (text) LEFT JOIN classes ON node = first_id"""


def flat_graph() -> str:
    return """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS root FROM ways UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node WHERE reach.root < ways.b),
classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degrees AS (SELECT a AS node, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN classes ON classes.node = vec_id LEFT JOIN degrees ON degrees.node = vec_id"""


def fill_in_middle() -> str:
    return r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                      sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
             ('0x' || h[25:32])::BIGINT AS h4 FROM units),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                     WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules(), "op3_licence_scan": licences.oracle(), "op4_bag_minhash": near_duplicates(),
            "op7_flat_graph": flat_graph(), "op11_fill_in_middle": fill_in_middle()}

"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SYMBOLS = "'[#*$%&|<>]'"

OP9 = rf"""
WITH d AS (
  SELECT doc_id, coalesce('=' || lang, '~') AS lang_key, coalesce('=' || source, '~') AS source_key,
         coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM d, unnest(range(1, len(w) - 3)) AS u(i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + 5)) AS u(p) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, lang_key, source_key, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, {_SYMBOLS}))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)
), g AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // word_chars END AS m1,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS m2,
         CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_lines END AS m3
  FROM f
), v AS (
  SELECT lang_key, source_key, 'm1' AS m, m1 AS x FROM g WHERE NOT base_failed
  UNION ALL SELECT lang_key, source_key, 'm2', m2 FROM g WHERE NOT base_failed
  UNION ALL SELECT lang_key, source_key, 'm3', m3 FROM g WHERE NOT base_failed
), b AS (
  SELECT lang_key, source_key, m, x - x % (1::BIGINT << greatest(length(bin(x)) - 6, 0)::INT) AS bucket FROM v
), r AS (
  SELECT *,
    row_number() OVER (PARTITION BY lang_key, source_key, m ORDER BY bucket) AS k1, count(*) OVER (PARTITION BY lang_key, source_key, m) AS c1,
    row_number() OVER (PARTITION BY lang_key, m ORDER BY bucket) AS k2, count(*) OVER (PARTITION BY lang_key, m) AS c2,
    row_number() OVER (PARTITION BY m ORDER BY bucket) AS k3, count(*) OVER (PARTITION BY m) AS c3
  FROM b
), q1 AS (
  SELECT lang_key, source_key, m, max(c1) AS c, min(CASE WHEN 4 * k1 >= c1 THEN bucket END) AS a, min(CASE WHEN 4 * k1 >= 3 * c1 THEN bucket END) AS z
  FROM r GROUP BY ALL
), q2 AS (
  SELECT lang_key, m, max(c2) AS c, min(CASE WHEN 4 * k2 >= c2 THEN bucket END) AS a, min(CASE WHEN 4 * k2 >= 3 * c2 THEN bucket END) AS z
  FROM r GROUP BY ALL
), q3 AS (
  SELECT m, min(CASE WHEN 4 * k3 >= c3 THEN bucket END) AS a, min(CASE WHEN 4 * k3 >= 3 * c3 THEN bucket END) AS z
  FROM r GROUP BY ALL
), q AS (
  SELECT q1.lang_key, q1.source_key, q1.m,
         CASE WHEN q1.c >= 100 THEN q1.a WHEN q2.c >= 100 THEN q2.a ELSE q3.a END AS a,
         CASE WHEN q1.c >= 100 THEN q1.z WHEN q2.c >= 100 THEN q2.z ELSE q3.z END AS z
  FROM q1 JOIN q2 USING (lang_key, m) JOIN q3 USING (m)
), t AS (
  SELECT lang_key, source_key,
         max(CASE WHEN m = 'm1' THEN z + 3 * (z - a) + 20 END) AS high1,
         max(CASE WHEN m = 'm2' THEN z + 3 * (z - a) + 150 END) AS high2,
         max(CASE WHEN m = 'm2' THEN a - 3 * (z - a) - 150 END) AS low2,
         max(CASE WHEN m = 'm3' THEN z + 3 * (z - a) + 400 END) AS high3
  FROM q GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(m1 > high1, false) OR coalesce(m2 > high2, false)
            OR coalesce(m2 < low2, false) OR coalesce(m3 > high3, false)) AS kept
FROM g LEFT JOIN t USING (lang_key, source_key)
"""

#: Weights over time of 5 - 4t, 1 and 1 + 2t have the integrals 5t - 2t^2, t and t + t^2; positions invert them.
OP10 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS k, len({_WORDS})::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), s AS (
  SELECT source, k, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS schedule,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight,
         2.0::DOUBLE * source_size AS most
  FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY most / weight, source IS NULL, source) AS rank
  FROM w
), x AS (
  SELECT level FROM l WHERE level * weight <= most ORDER BY rank LIMIT 1
), t AS (
  SELECT k, source_size, schedule, least(most, coalesce((SELECT level FROM x) * weight, most)) AS target FROM w
), p AS (
  SELECT doc_id, size, source_size, target, schedule,
         coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM d JOIN t USING (k)
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - c)) + greatest(0, least(size, floor(target)::BIGINT - c - source_size)))::BIGINT AS taken,
       round(CASE WHEN target > 0 THEN CASE
         WHEN schedule = 0 AND c < target THEN 2 * (3 * (c / target)) / (5 + sqrt(25 - 8 * (3 * (c / target))))
         WHEN schedule = 2 AND c < target THEN 2 * (2 * (c / target)) / (1 + sqrt(1 + 4 * (2 * (c / target))))
         WHEN schedule = 0 THEN 1 + (c / target - 1) * 3 WHEN schedule = 2 THEN 1 + (c / target - 1) * 2 / 3
         ELSE c / target END END, 9) AS position
FROM p
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), {_SPACES}, '')) AS s FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY s) AS g
  FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, g AS group_size, place = 1 AS kept, s AS text_sha256 FROM k
"""

OP6 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS said,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS named
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(said + named + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), s AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang)
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o
) WHERE part = 'pair' OR rank <= 50
"""

OP12 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM d
), x AS (
  SELECT r, len(s) AS n, unnest(s) AS t FROM g
), l AS (
  SELECT a.r AS one, b.r AS other FROM x a JOIN x b ON a.t = b.t AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT one, other FROM l UNION ALL SELECT other, one FROM l
), reach AS (
  SELECT r AS a, r AS b FROM d
  UNION SELECT reach.a, e.other FROM reach JOIN e ON reach.b = e.one
)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, g.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM g JOIN reach ON reach.a = g.r JOIN g o ON o.r = reach.b GROUP BY g.r, g.doc_id, g.s
"""

SQL = {"op12_minhash_near_dedup": OP12, "op13_source_divergence": OP13, "op6_chat_formatting": OP6, "op5_exact_dedup": OP5, "op9_quality_rules": OP9, "op10_mixing": OP10}

"""DuckDB SQL for the queries that SQL can express on whole tables, built from the operators' own parameters."""

from gravelock.llm import mixing, quality

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS ws FROM d),
tok AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS three FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM win WHERE three IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r),
raw AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM d),
lines AS (SELECT r, source, line, nth, lower(regexp_replace(trim(line, {BLANKS}), '{SPACE}', ' ', 'g')) AS norm FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
page AS (SELECT r, md5(string_agg(norm, chr(10) ORDER BY nth)) AS doc FROM lines GROUP BY r),
freq AS (SELECT source, norm FROM lines JOIN page USING (r) GROUP BY source, norm HAVING count(DISTINCT doc) > {quality.LIMIT}),
gone AS (SELECT l.r, sum(len(string_split(l.norm, ' '))) AS n FROM lines l JOIN freq f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.r),
b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, n_words - least(n_removed, n_words) AS rest FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (n_removed > 0 AND (rest < {quality.LEAST_WORDS} OR rest < {quality.LEAST_SHARE}::DOUBLE * n_words))) AS kept, n_removed
FROM v
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
           coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS mark FROM documents),
k AS (SELECT *, CASE WHEN size > 0 THEN
        -ln((('0x' || substr(md5(mark || ':{mixing.SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE)
        / ((size::DOUBLE / (size::DOUBLE + 50)) / (1 + abs(length(text)::DOUBLE / size::DOUBLE - 6) / 6)) END AS key FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth, sum(source_size) OVER ()::DOUBLE AS total FROM s0),
s2 AS (SELECT *, ((nth - 1) % {mixing.WEIGHTS} + 1)::DOUBLE AS w, ({mixing.MAX_EPOCHS} * source_size)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY cap / w, nth) AS rank,
       (total - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, (SELECT min(rank) FROM s3 WHERE level * w <= cap) AS open_at FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN open_at IS NULL OR rank < open_at THEN cap ELSE (SELECT level FROM s3 WHERE rank = open_at) * w END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN least({mixing.MAX_EPOCHS}, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM s5),
p AS (SELECT k.*, s6.source_size, s6.target, s6.epochs, s6.target - s6.epochs * s6.source_size AS rest,
      coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN s6 ON k.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before + size < rest THEN 1 ELSE 0 END)
        + CASE WHEN size > 0 AND before < rest AND before + size >= rest THEN floor(size * ((rest - before) / size) + 1e-6::DOUBLE) ELSE 0 END)::BIGINT AS taken
FROM p
"""

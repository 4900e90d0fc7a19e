"""DuckDB SQL that gives the rows of the queries, where SQL can express them."""

SQL: dict[str, str] = {}

SQL["op1_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS ord
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, (n % 3 + 1)::BIGINT AS weight, 3 * source_size AS most FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS lev
  FROM w WINDOW before AS (ORDER BY most::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT arg_min(lev, most::DOUBLE / weight * 1e6 + n) AS open_level FROM l WHERE lev <= most::DOUBLE / weight),
t AS (
  SELECT source, source_size, CASE WHEN lev > most::DOUBLE / weight THEN most::DOUBLE ELSE least(most::DOUBLE, open_level * weight) END AS target
  FROM l, o),
c AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0
             ELSE goal // source_size * size + least(greatest(goal - goal // source_size * source_size - start, 0), size) END)::BIGINT AS taken
FROM c
"""

#: Measurements and failure bits of every document.
_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
q AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM p, range(0, 3) AS o(k) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '[A-Za-z]'))::BIGINT AS n_letters, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper
  FROM w LEFT JOIN q USING (r)),
l AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
         + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::BIGINT
         + 32 * (100 * n_upper > 60 * n_letters)::BIGINT)::BIGINT AS failed FROM m)
"""

SQL["op5_quality_rules"] = (
    _LEDGER
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper,
       failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept, failed, failed & 15 = 0 AS kept_v1, failed & 63 = 0 AS kept_v2
FROM l
"""
)

SQL["quality_ablations"] = (
    _LEDGER
    + """
, rules(bit, rule) AS (VALUES (1, 'few_words'), (2, 'repeated_words'), (4, 'symbols'), (8, 'repeated_lines'), (16, 'short_or_long_words'), (32, 'shouting')),
policies(policy, mask) AS (VALUES ('v1', 15), ('v2', 63))
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only
FROM policies JOIN rules ON mask & bit <> 0 CROSS JOIN l GROUP BY policy, rule
"""
)

SQL["op8_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
         list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT, 1) FOR k IN range(0, 32)], 'string_agg', '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""

SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM d, unnest(range(1, len(ws) - 18)) AS u(i)),
f AS (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w),
c AS (SELECT DISTINCT r, i + k AS i FROM f, range(0, 20) AS o(k) WHERE n > 1),
x AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT r, count(c.i)::BIGINT AS gone, string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY i) AS kept FROM x LEFT JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

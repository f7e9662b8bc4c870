"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[t:t + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT dw.r, dw.p, dw.m, bw.item FROM dw JOIN bw USING (m, win)),
covered AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

LINE_QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tri AS (
  SELECT r, i, array_to_string(w[i:i + 2], ' ') AS t
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, t FROM tri GROUP BY r, t HAVING count(*) > 1),
reps AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN twice USING (r, t)) GROUP BY r),
lines AS (
  SELECT r, doc_id, source, text,
    array_to_string(regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), ' ') AS line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
frequent AS (
  SELECT source, line, min(doc_id) AS keeper
  FROM lines WHERE n > 0 GROUP BY source, line HAVING count(DISTINCT text) > 20),
removed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_removed_words
  FROM lines JOIN frequent USING (source, line) WHERE doc_id <> keeper GROUP BY r),
base AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_removed_words, 0) AS n_removed_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM d) LEFT JOIN reps USING (r) LEFT JOIN removed USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
    OR (n_removed_words > 0 AND (n_words - n_removed_words < 50
      OR n_words - n_removed_words < 0.5 * n_words))) AS kept,
  n_removed_words
FROM base
"""

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
    "([A-Za-z0-9+/_.=-]+)"
)


def _spans(kind: str, rank: int, pattern: str, group: int, least: int, good: str = "TRUE") -> str:
    """Spans of one kind, one row each."""
    return f"""
  SELECT r, doc_id, source, {rank} AS rank, '{kind}' AS kind, start, start + length(match) AS stop, value
  FROM (
    SELECT r, doc_id, source, ms[i] AS match, vs[i] AS value,
      list_sum(list_transform(gs[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (
      SELECT r, doc_id, source, gs, ms, vs, unnest(range(1, len(ms) + 1)) AS i
      FROM (
        SELECT r, doc_id, source, string_split_regex(text, '{pattern}') AS gs,
          regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs
        FROM d WHERE regexp_matches(text, '{pattern}'))))
  WHERE length(value) >= {least} AND {good}"""


CREDENTIALS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS ({_spans("assign", 0, _ASSIGN, 2, 6)}
  UNION ALL {_spans("access", 1, "(AKIA[A-Z0-9]+)", 1, 20)}
  UNION ALL {_spans("hex", 2, "([0-9a-f]{24,})", 1, 24)}),
opaque AS (
  SELECT * FROM ({_spans("opaque", 3, "([A-Za-z0-9+/_-]{24,})", 1, 24,
      "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')")}) o
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = o.r AND b.start < o.stop AND o.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
held AS (
  SELECT value, coalesce('of ' || source, '') AS owner, coalesce(doc_id::VARCHAR, '') AS id FROM every),
owned AS (
  SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, id)) AS repositories
  FROM held GROUP BY value),
rated AS (
  SELECT e.*, owners, repositories, owners > 2 OR (owners > 1 AND repositories > 20) AS is_copied
  FROM every e JOIN owned USING (value)),
reported AS (SELECT * FROM rated WHERE kind <> 'opaque' OR NOT is_copied),
counted AS (
  SELECT r,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'opaque') AS base_list,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (NOT is_copied) AS n_live, count(*) FILTER (is_copied) AS n_copied,
    max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM reported GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_list, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN counted USING (r)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
numbered AS (
  SELECT lang, row_number() OVER () AS id,
         list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
words AS (SELECT lang, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM numbered),
places AS (
  SELECT lang, w, lead(w) OVER piece AS w2, lead(w, 2) OVER piece AS w3
  FROM words WINDOW piece AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w AS g, count(*)::HUGEINT AS f FROM places GROUP BY ALL
  UNION ALL
  SELECT lang, 2, w || ' ' || w2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(g, ' ') AS ws FROM grams WHERE k >= 2 AND f >= 10),
parted AS (
  SELECT lang, g, f, k, 1 AS cut, ws[1] AS head, array_to_string(list_slice(ws, 2, k), ' ') AS tail
  FROM candidates
  UNION ALL
  SELECT lang, g, f, k, 2, array_to_string(list_slice(ws, 1, 2), ' '), ws[3] FROM candidates WHERE k = 3),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, c.k AS size, cut, x.f AS l, y.f AS r,
         (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM parted c JOIN grams x ON x.lang = c.lang AND x.g = c.head
  JOIN grams y ON y.lang = c.lang AND y.g = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(ws, j, j + 1), ' ') AS g, max(f) AS longest
  FROM (SELECT *, unnest([1, 2]) AS j FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.g = l.g AND l.size = 2
  WHERE i.longest IS NULL OR 100 * i.longest < 50 * l.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT r.lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""

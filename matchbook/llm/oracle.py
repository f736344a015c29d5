"""The queries that SQL can express, as DuckDB runs them over the same tables."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": REPEATED_BYTES,
        "op3_line_dedup": LINE_DEDUP,
        "op10_substring_dedup": EARLIER_WINDOWS,
        "op11_phrases": COLLOCATIONS,
    }


#: Lines that ten documents or more have; chr(10) parts lines.
LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents
), numbered AS (
  SELECT doc_id, text, unnest(parts) AS line, unnest(range(len(parts))) AS nth FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM numbered
), frequent AS (
  SELECT line_key FROM (SELECT DISTINCT doc_id, text, line_key FROM keyed)
  WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(*) >= 10
), marked AS (
  SELECT doc_id, line, nth, line_key IN (SELECT line_key FROM frequent) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Bytes are pairs of hexadecimal digits; every string of 400 of them goes by its hash.
REPEATED_BYTES = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x,
         octet_length(encode(coalesce(text, ''))) AS n
  FROM documents
), hashed AS (
  SELECT r, list_transform(range(0, n - 399), lambda i: md5(substr(x, 2 * i + 1, 800))) AS hs FROM docs
), windows AS (
  SELECT r, unnest(hs) AS h, unnest(range(0, len(hs))) AS pos FROM hashed
), found AS (
  SELECT r, pos FROM windows JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) USING (h)
), runs AS (
  SELECT r, pos, sum(CASE WHEN pos <= earlier + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS run
  FROM (SELECT r, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS earlier FROM found)
), spans AS (
  SELECT r, min(pos) AS a, max(pos) + 400 AS b FROM runs GROUP BY r, run
), parts AS (
  SELECT r, sum(b - a) AS removed, count(*) AS spans,
         list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends
  FROM spans GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE array_to_string(list_transform(
         range(1, spans + 2),
         lambda i: substr(x, 2 * (CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END) + 1,
                     2 * ((CASE WHEN i > spans THEN n ELSE starts[i] END)
                          - (CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END)))), '') END)) AS kept_sha256
FROM docs LEFT JOIN parts USING (r)
"""

#: Windows of 50 words by their hash, and the smallest id that has each.
EARLIER_WINDOWS = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), hashed AS (
  SELECT doc_id, r, list_transform(range(1, len(w) - 48),
                                   lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS hs
  FROM docs
), windows AS (
  SELECT doc_id, r, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS pos FROM hashed
), first AS (
  SELECT h, min(doc_id) AS low FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT r, unnest(range(pos, pos + 50)) AS p
  FROM windows JOIN first USING (h) WHERE low < doc_id
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

#: Phrases of up to three words by counting all of them.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\n\x0b\f\r]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
                                        lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3]) AS k)
), counts AS (
  SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 10
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), longer AS (
  SELECT lang, n AS f, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS phrase
  FROM (SELECT lang, n, string_split(phrase, ' ') AS p FROM counts WHERE k = 3)
), kept AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS p FROM counts c
  WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.f >= 50 * c.n)
), cuts AS (
  SELECT lang, phrase, a, place, array_to_string(p[1:place], ' ') AS b, array_to_string(p[place + 1:k], ' ') AS e
  FROM (SELECT *, unnest(range(1, k)) AS place FROM kept)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, place, f.n AS l, g.n AS r,
         CAST((1000000::HUGEINT * a * a) // (f.n::HUGEINT * g.n) AS BIGINT) AS score
  FROM cuts JOIN counts f ON f.lang = cuts.lang AND f.phrase = b
       JOIN counts g ON g.lang = cuts.lang AND g.phrase = e
), weakest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

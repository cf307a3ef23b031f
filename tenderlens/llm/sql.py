"""DuckDB counterparts of the corpus queries that SQL can express, written from what they return and not from how."""

from __future__ import annotations

OP11 = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs
), worded AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), freq AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM places, range(1, 5) ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cand c, range(1, 4) js(j)
  JOIN freq h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:j], ' ')
  JOIN freq t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[j + 1:], ' ')
  WHERE j < c.k
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM weakest s WHERE NOT EXISTS (
    SELECT 1 FROM cand b WHERE b.lang = s.lang AND len(b.w) > len(string_split(s.phrase, ' '))
      AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * b.a >= 80::HUGEINT * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

# The polynomial of crc32 is a fixed value; each character is one xor and eight steps.
OP12 = r"""
WITH conv AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), own AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 9 AS h
  FROM conv
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), coalesce(c.s[c.h + 1:], [])) AS s
  FROM own c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 5
), member AS (
  SELECT conv_id, d, s[1:d] AS path, len(s) = d AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM built)
), node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY path, d
), childless AS (
  SELECT n.*, (SELECT count(*) FROM node c WHERE c.d = n.d + 1 AND c.path[1:n.d] = n.path) AS n_children FROM node n
), below AS (
  SELECT path[1:up] AS path, up AS d, (n_children = 0)::INT AS leaf,
         CASE WHEN d > 0 THEN (n_convs - 1) * strlen(path[d].text) ELSE 0 END AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM childless)
), sums AS (
  SELECT path, d, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY path, d
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM childless n JOIN sums s ON s.d = n.d AND s.path = n.path
LEFT JOIN node p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""

#: The other queries cannot be expressed in SQL without their method; tests/llm holds each against a brute-force version.
SQL: dict[str, str] = {"op11_phrase_collocations": OP11, "op12_conversation_prefix_trie": OP12}

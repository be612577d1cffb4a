"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t,
         min(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS place
  FROM n
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""


ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = (
    (0, "assign", ASSIGN, 2, "length(v[i]) >= 6"),
    (1, "access", "AKIA[A-Z0-9]+", 0, "length(v[i]) >= 20"),
    (2, "hex", "[0-9a-f]+", 0, "length(v[i]) >= 24"),
    (
        3,
        "token",
        "[A-Za-z0-9+_=-]+",
        0,
        "length(v[i]) >= 20 AND regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]')",
    ),
)
MATCHES = " UNION ALL ".join(
    f"""
  SELECT r, k, kind, value, start, start + width AS stop FROM (
    SELECT r, {k} AS k, '{kind}' AS kind, v[i] AS value, length(w[i]) AS width,
           list_sum(list_transform(g[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (
      SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {group}) AS v,
               string_split_regex(t, '{pattern}') AS g
        FROM d
      )
    ) WHERE {fits}
  )"""
    for k, kind, pattern, group, fits in KINDS
)
OP3 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), m AS ({MATCHES}
), c AS (
  SELECT * FROM m WHERE k < 3 OR NOT EXISTS (
    SELECT 1 FROM m AS b WHERE b.r = m.r AND b.k < 3 AND b.start < m.stop AND m.start < b.stop)
), o AS (
  SELECT value, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners,
         count(DISTINCT struct_pack(a := source, b := doc_id)) AS repositories
  FROM c JOIN d USING (r) GROUP BY value
), l AS (
  SELECT *, owners <= 2 AND repositories <= 10 AS live FROM o
), j AS (
  SELECT r, k, kind, start, stop, live, owners, repositories, concat(kind, ':', start, ':', stop) AS span
  FROM c JOIN l USING (value) WHERE k < 3 OR live
), s AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base,
         string_agg(span, ',' ORDER BY start, k) AS spans, count(*) FILTER (live) AS n_live,
         max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM j GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN s USING (r)
"""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times FROM (
    SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram
    FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
  )
), p AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(0, 5)) AS k FROM g WHERE times > 1) GROUP BY r
), m AS (
  SELECT r, doc_id, source, len(words) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN p USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM b GROUP BY source
), v AS (
  SELECT avg(failed / docs) AS mean, var_pop(failed / docs) AS variance, avg(1 / docs) AS chance FROM h
), e AS (
  SELECT mean, variance - mean * (1 - mean) * chance AS excess FROM v
), z AS (
  SELECT mean, CASE WHEN excess > 1e-12 THEN greatest(mean * (1 - mean) / excess - 1, 1.0) ELSE 1e6 END AS size FROM e
), k AS (
  SELECT source, (failed + mean * size) / (docs + size) <= 0.5 AS host_kept FROM h, z
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source
"""


CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))),
             4294967295)"""
OP12 = f"""
WITH t AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS m,
         row_number() OVER (
           PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
         ) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(m ORDER BY place) AS own, {CRC32.format(text="conv_id::VARCHAR")} % 6 AS h FROM t GROUP BY conv_id
), c AS (
  SELECT o.conv_id, coalesce(s.own[1:o.h], []) || o.own[o.h + 1:] AS seq
  FROM o LEFT JOIN o AS s ON s.conv_id = o.conv_id - o.conv_id % 100
), p AS (
  SELECT conv_id, seq[1:depth] AS node, depth, depth = len(seq) AS ends
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM c)
), n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY node, depth
), k AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), v AS (
  SELECT n.node, n.depth, coalesce(n_children, 0) AS n_children,
         CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.node[n.depth].text) ELSE 0 END AS saved
  FROM n LEFT JOIN k ON n.node = k.node
), s AS (
  SELECT node[1:d] AS node, sum(saved)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY ALL
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, v.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN v ON v.node = n.node JOIN s ON s.node = n.node
LEFT JOIN n AS u ON n.depth > 0 AND u.node = n.node[1:n.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op3_secrets": OP3, "op9_quality": OP9, "op12_prefix_trie": OP12}

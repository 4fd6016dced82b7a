"""DuckDB SQL that gives the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
              unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                                    lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' '))) AS g
       FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, k, s, item_id FROM dw JOIN iw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP5 = r"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
c AS (SELECT source, line, count(*) AS n
      FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM p)
      WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*') GROUP BY source, line),
b AS (SELECT c.source, list(line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE 10 * n > pages + 20 GROUP BY c.source),
r AS (SELECT doc_id, p.source, coalesce(len(lines), 0) AS n_lines,
             CASE WHEN bad IS NULL THEN text
                  ELSE array_to_string(list_filter(lines, lambda x: NOT list_contains(bad, x)), chr(10)) END AS text
      FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, n_lines::BIGINT AS n_lines,
       (CASE WHEN length(text) > 0 THEN len(string_split(text, chr(10))) ELSE 0 END)::BIGINT AS n_left,
       sha256(coalesce(text, '')) AS text_sha256
FROM r
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INTEGER AS wt FROM s),
o AS (SELECT *, sum(3 * ss) OVER q - 3 * ss AS below, sum(wt) OVER q - wt AS wbelow,
             sum(ss) OVER () AS total, sum(wt) OVER () AS weights
      FROM w WINDOW q AS (ORDER BY 3.0::DOUBLE * ss / wt, source ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, 3.0::DOUBLE * ss / wt < (total - below)::DOUBLE / (weights - wbelow) AS capped FROM o),
l AS (SELECT (max(total) - coalesce(sum(3 * ss) FILTER (WHERE capped), 0))::DOUBLE
             / (sum(wt) FILTER (WHERE NOT capped))::DOUBLE AS level FROM f),
t AS (SELECT source, ss, CASE WHEN capped THEN (3 * ss)::DOUBLE ELSE level * wt END AS target FROM f, l),
g AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END::BIGINT AS whole FROM t),
h AS (SELECT *, target - whole * ss AS rest,
             CASE WHEN ss > 0 THEN (target - whole * ss) / ss::DOUBLE ELSE 0 END AS rate FROM g),
u AS (SELECT doc_id, d.source, size, ss, target, whole, rest, least(rate, 1.0::DOUBLE) AS p,
             (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
v AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) * ((1.0::DOUBLE - p) / p) END AS q FROM u),
k AS (SELECT *, least(floor((q / (1.0::DOUBLE + q)) * 4096), 4095)::INTEGER AS bin FROM v),
b AS (SELECT source, rest, bin, sum(size) AS words FROM k WHERE bin IS NOT NULL GROUP BY ALL),
c AS (SELECT source, bin, rest, sum(words) OVER (PARTITION BY source ORDER BY bin) - words / 2.0::DOUBLE AS middle FROM b),
e AS (SELECT source, max(bin) AS cut FROM c WHERE middle <= rest GROUP BY source)
SELECT doc_id, size, ss AS source_size, target,
       whole + coalesce(bin <= coalesce(cut, -1), false)::BIGINT AS copies,
       size * (whole + coalesce(bin <= coalesce(cut, -1), false)::BIGINT) AS taken
FROM k LEFT JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""

# The crc32 of a decimal id, bit by bit; nodes are named by their turns' digests of 32 characters each.
OP12 = r"""
WITH t AS (SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
                  length(coalesce(text, '')) AS chars,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                     sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT) AS s FROM t),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, s), lambda a, b:
        list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 6 AS h FROM c),
r AS (SELECT h.conv_id, t.p, t.m, t.chars FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.p <= h.h
      UNION ALL SELECT h.conv_id, t.p + 1000000, t.m, t.chars FROM h JOIN t ON t.conv_id = h.conv_id AND t.p > h.h),
w AS (SELECT conv_id, chars, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY p) AS node,
             row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth,
             count(*) OVER (PARTITION BY conv_id) AS total FROM r),
a AS (SELECT conv_id, node, depth, chars, depth = total AS last FROM w
      UNION ALL SELECT h.conv_id, '', 0, 0, h.conv_id NOT IN (SELECT conv_id FROM w) FROM h),
n AS (SELECT node, depth, min(conv_id) AS conv_id, any_value(chars) AS chars, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
      FROM a GROUP BY node, depth),
k AS (SELECT n.node, n.depth, count(x.node) AS n_children FROM n LEFT JOIN n AS x
      ON x.depth = n.depth + 1 AND substring(x.node, 1, 32 * n.depth) = n.node GROUP BY ALL),
u AS (SELECT substring(n.node, 1, 32 * d) AS node, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
      FROM (SELECT n.*, k.n_children, unnest(range(0, n.depth + 1)) AS d FROM n JOIN k USING (node, depth)) AS n GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, x.conv_id AS parent_conv_id, n.n_convs, k.n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN k USING (node, depth) JOIN u USING (node)
LEFT JOIN n AS x ON x.depth = n.depth - 1 AND x.node = substring(n.node, 1, 32 * (n.depth - 1))
"""

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": OP3,
    "op5_line_dedup": OP5,
    "op9_mixing": OP9,
    "op12_conversation_trie": OP12,
}

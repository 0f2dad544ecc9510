"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

# Boilerplate: depth 3, similarity 0.5, ten documents, exact tokens below four.
LINES = """
lines AS (
  SELECT doc_id, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {source} WHERE text IS NOT NULL)
),
tokens AS (
  SELECT doc_id, line_no, list_filter(string_split(translate(line, chr(9) || chr(13), '  '), ' '), lambda t: t <> '') AS parts
  FROM lines
),
judged AS (
  SELECT doc_id, line_no, len(parts) AS size, shape[1:3] AS leaf, shape
  FROM (SELECT doc_id, line_no, parts,
               CASE WHEN len(parts) < 4 THEN parts
                    ELSE list_transform(parts, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) END AS shape
        FROM tokens WHERE len(parts) > 0)
),
shapes AS (SELECT size, leaf, shape FROM judged GROUP BY ALL),
spread AS (
  SELECT size, leaf, shape, unnest(range(4, len(shape) + 1)) AS place, unnest(shape[4:]) AS token FROM shapes WHERE size >= 4
),
sized AS (SELECT size, leaf, count(*) AS shapes FROM shapes WHERE size >= 4 GROUP BY ALL),
usual AS (
  SELECT s.size, s.leaf, s.place, s.token FROM spread s JOIN sized z ON s.size = z.size AND s.leaf = z.leaf
  WHERE z.shapes > 1 GROUP BY s.size, s.leaf, s.place, s.token, z.shapes HAVING count(*) * 2 > z.shapes
),
firsts AS (
  SELECT s.size, s.leaf, s.shape
  FROM spread s JOIN usual u ON s.size = u.size AND s.leaf = u.leaf AND s.place = u.place AND s.token = u.token
  GROUP BY s.size, s.leaf, s.shape
  HAVING count(*) >= (s.size - 3) * 0.5 AND count(*) FILTER (WHERE s.token <> '<*>') > 0
),
others AS (SELECT s.* FROM spread s ANTI JOIN firsts f ON s.size = f.size AND s.leaf = f.leaf AND s.shape = f.shape),
telling AS (
  SELECT o.* FROM others o
  ANTI JOIN usual u ON o.size = u.size AND o.leaf = u.leaf AND o.place = u.place AND o.token = u.token
  WHERE o.token <> '<*>'
),
choices AS (
  SELECT *, row_number() OVER (PARTITION BY size, leaf, shape ORDER BY n DESC, place) AS choice
  FROM (SELECT *, count(*) OVER (PARTITION BY size, leaf, place, token) AS n FROM telling)
  WHERE n > 1
),
grouped AS (
  SELECT size, leaf, shape, place AS spot, token AS word, count(*) OVER (PARTITION BY size, leaf, place, token) AS shapes
  FROM choices WHERE choice = 1
),
inside AS (
  SELECT s.*, g.spot, g.word, g.shapes FROM others s JOIN grouped g ON s.size = g.size AND s.leaf = g.leaf AND s.shape = g.shape
),
shares AS (
  SELECT *, shapes > 1 AND count(*) OVER (PARTITION BY size, leaf, spot, word, place, token) * 2 > shapes AS kept FROM inside
),
members AS (
  SELECT size, leaf, shape, 0 AS spot, '' AS word FROM firsts
  UNION ALL
  SELECT size, leaf, shape, spot, word FROM shares WHERE kept
  GROUP BY ALL HAVING count(*) >= (size - 3) * 0.5 AND count(*) FILTER (WHERE token <> '<*>') > 0
),
templates AS (
  SELECT s.size, s.leaf, s.shape,
         CASE WHEN m.word IS NULL THEN list_prepend('own', s.shape) ELSE ['group', CAST(m.spot AS VARCHAR), m.word] END AS template
  FROM shapes s LEFT JOIN members m ON s.size = m.size AND s.leaf = m.leaf AND s.shape = m.shape
),
placed AS (
  SELECT j.doc_id, j.line_no, t.size, t.leaf, t.template FROM judged j JOIN templates t ON j.shape = t.shape
),
recurring AS (
  SELECT size, leaf, template, min(doc_id) AS first
  FROM placed GROUP BY size, leaf, template HAVING count(DISTINCT doc_id) >= 10
),
gone AS (
  SELECT p.doc_id, p.line_no
  FROM placed p JOIN recurring r ON p.size = r.size AND p.leaf = r.leaf AND p.template = r.template
  WHERE p.doc_id <> r.first
)
"""

LINE_DEDUP = f"""
WITH {LINES.format(source="documents")}
SELECT d.doc_id, count(*) AS n_lines, count(g.line_no) AS n_dropped,
       md5(coalesce(string_agg(d.line, chr(10) ORDER BY d.line_no) FILTER (WHERE g.line_no IS NULL), '')) AS kept_md5
FROM lines d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.line_no = g.line_no
GROUP BY d.doc_id
"""


URL_LISTS = """
WITH urls AS (
  SELECT page_id, coalesce(url, '') AS url,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*/([^/?#]+)', 1) AS part
  FROM pages
),
entries AS (
  SELECT CASE WHEN page_id % 5 < 2 THEN array_to_string(string_split(host, '.')[-2:], '.')
              WHEN page_id % 5 < 4 THEN host ELSE host || '/' || part || '/' END AS pattern,
         DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS dated,
         page_id % 3 <> 0 AS listed
  FROM urls
),
daily AS (SELECT pattern, dated, bool_or(listed) AS listed FROM entries GROUP BY pattern, dated),
intervals AS (
  SELECT pattern, dated AS since, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS until, listed FROM daily
),
captures AS (
  SELECT page_id, url, host, DATE '2024-01-01' + CAST(page_id * 101 % 366 AS INTEGER) AS fetched,
         list_concat(
           list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
                          lambda i: array_to_string(string_split(host, '.')[i:], '.')),
           CASE WHEN part <> '' THEN [host || '/' || part || '/'] ELSE [] END) AS patterns
  FROM urls
),
keys AS (SELECT page_id, fetched, unnest(list_distinct(patterns)) AS pattern FROM captures WHERE host <> ''),
met AS (
  SELECT k.page_id, i.pattern, i.since,
         row_number() OVER (PARTITION BY k.page_id ORDER BY length(i.pattern) DESC, i.pattern DESC) AS place
  FROM keys k JOIN intervals i
    ON k.pattern = i.pattern AND i.listed AND k.fetched >= i.since AND (i.until IS NULL OR k.fetched < i.until)
)
SELECT c.page_id, c.host, m.page_id IS NOT NULL AS listed, m.pattern, CAST(m.since AS VARCHAR) AS since
FROM captures c LEFT JOIN met m ON c.page_id = m.page_id AND m.place = 1
"""

NEAREST = """
WITH codes AS (
  SELECT vec_id AS id,
         list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS low,
         list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 33] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS high
  FROM embeddings
),
pairs AS (
  SELECT q.id AS query_id, c.id, bit_count(xor(q.low, c.low)) + bit_count(xor(q.high, c.high)) AS distance
  FROM codes q, codes c WHERE q.id % 50 = 0 AND q.id <> c.id
)
SELECT query_id, place, id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM pairs)
WHERE place <= 10
"""

def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Whole-number product quantisation, one block of steps for each round."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"""sized AS (SELECT len(embedding) AS dims FROM embeddings WHERE len(embedding) > 0 AND {finite}
          GROUP BY 1 ORDER BY count(*) DESC, dims DESC LIMIT 1)""",
        f"""kept AS (
          SELECT row_number() OVER () AS row_no, vec_id, label,
                 list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS BIGINT)) AS ints
          FROM embeddings WHERE len(embedding) = (SELECT dims FROM sized) AND {finite})""",
        f"""cut AS (
          SELECT row_no, p, ints[p * len(ints) // {parts} + 1 : (p + 1) * len(ints) // {parts}] AS x
          FROM kept, range({parts}) AS r(p))""",
        f"""firsts AS (SELECT row_no, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS entry FROM kept
          QUALIFY entry < {entries})""",
        "books0 AS (SELECT p, entry, x FROM cut JOIN firsts USING (row_no))",
    ]
    for i in range(rounds + 1):
        apart = "list_sum(list_transform(range(1, len(c.x) + 1), lambda i: (c.x[i] - b.x[i]) * (c.x[i] - b.x[i])))"
        steps.append(
            f"""near{i} AS (
              SELECT c.row_no, c.p, min(({apart}::BIGINT, b.entry)) AS best
              FROM cut c JOIN books{i} b ON c.p = b.p GROUP BY c.row_no, c.p)"""
        )
        if i < rounds:
            steps.append(
                f"""moved{i} AS (
                  SELECT p, entry, list(mean ORDER BY place) AS x FROM (
                    SELECT p, entry, place, CAST(sum(v) - ((sum(v) % count(*)) + count(*)) % count(*) AS BIGINT) // count(*) AS mean
                    FROM (SELECT c.p, n.best[2] AS entry, unnest(range(1, len(c.x) + 1)) AS place, unnest(c.x) AS v
                          FROM cut c JOIN near{i} n ON c.row_no = n.row_no AND c.p = n.p)
                    GROUP BY p, entry, place)
                  GROUP BY p, entry)"""
            )
            steps.append(
                f"""books{i + 1} AS (
                  SELECT b.p, b.entry, coalesce(m.x, b.x) AS x
                  FROM books{i} b LEFT JOIN moved{i} m ON b.p = m.p AND b.entry = m.entry)"""
            )
    final = f"near{rounds}"
    return f"""
WITH {", ".join(steps)},
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM books{rounds}
),
coded AS (
  SELECT row_no, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM {final} GROUP BY row_no
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_no), digest
"""


# CRC-32 by bits: a byte goes in, then eight steps by the reflected polynomial (bit 0: the byte, 1 to 8: the steps).
PREFIX_TRIE = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
spelled AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS digits FROM turns),
crc AS (
  SELECT conv_id, digits, 0 AS done, 0 AS bit, 4294967295::BIGINT AS c FROM spelled
  UNION ALL
  SELECT conv_id, digits, CASE WHEN bit = 8 THEN done + 1 ELSE done END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
         CASE WHEN bit = 0 THEN xor(c, ascii(digits[done + 1])::BIGINT)
              ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) END
  FROM crc WHERE done < length(digits)
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, xor(c, 4294967295::BIGINT) % 6 AS h
  FROM crc WHERE done = length(digits)
),
rebuilt AS (
  SELECT c.conv_id, 1 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON c.head = t.conv_id AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 2, t.pos, t.role, t.text FROM convs c JOIN turns t ON c.conv_id = t.conv_id AND t.pos > c.h
),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
         sha256(length(role) || ':' || role || text) AS turn, length(text) AS n_chars
  FROM rebuilt
),
lists AS (SELECT conv_id, list(turn ORDER BY depth) AS turns FROM placed GROUP BY conv_id),
members AS (
  SELECT conv_id, 0 AS depth, CAST('' AS VARCHAR) AS prefix, CAST(NULL AS VARCHAR) AS above, 0 AS n_chars FROM convs
  UNION ALL
  SELECT p.conv_id, p.depth, array_to_string(l.turns[:p.depth], '/'), array_to_string(l.turns[:p.depth - 1], '/'), p.n_chars
  FROM placed p JOIN lists l USING (conv_id)
),
ends AS (
  SELECT prefix, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, prefix, depth, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM members)
  WHERE depth = deepest GROUP BY prefix
),
nodes AS (
  SELECT prefix, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(n_chars) AS saved
  FROM members GROUP BY prefix
),
kids AS (SELECT above, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
sums AS (
  -- A node's smallest member passes through all nodes above it.
  SELECT m.prefix, sum(CASE WHEN k.above IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
  LEFT JOIN kids k ON k.above = n.prefix
  GROUP BY m.prefix
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs,
       coalesce(k.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n
LEFT JOIN nodes u ON u.prefix = n.above
LEFT JOIN kids k ON k.above = n.prefix
LEFT JOIN ends e ON e.prefix = n.prefix
JOIN sums s ON s.prefix = n.prefix
"""

LARGEST_PRODUCTS = """
WITH checked AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
sized AS (SELECT len(v) AS dims FROM checked GROUP BY 1 ORDER BY count(*) DESC, dims DESC LIMIT 1),
kept AS (SELECT DISTINCT vec_id, v FROM checked WHERE len(v) = (SELECT dims FROM sized)),
scored AS (
  SELECT q.vec_id AS query_id, q.v AS query, c.vec_id,
         list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b, 0.0::DOUBLE) AS score
  FROM kept q JOIN kept c ON q.vec_id <> c.vec_id OR q.v <> c.v
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


def oracles() -> dict[str, str]:
    return {
        "op11_walsh_hadamard_codes": codes_sql(),
        "op12_conversation_prefix_trie": PREFIX_TRIE,
        "op13_vantage_point_search": LARGEST_PRODUCTS,
        "op3_temporal_url_lists": URL_LISTS,
        "op4_multi_index_hashing": NEAREST,
        "op8_template_line_dedup": LINE_DEDUP,
    }

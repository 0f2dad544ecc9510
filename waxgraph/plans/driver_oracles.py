"""The driver queries once more, in ANSI SQL for an independent engine.

Written from the meaning of the operators, not from their Spark plans: positions
are row numbers here where Spark computes them, and search scores nodes where
Spark scores texts.
"""

from __future__ import annotations

# Fixed values, written out once more so that a wrong one does not pass on both sides.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NON_SPACE = "[^" + SPACE[1:]
RESERVED = r'[+\-&|!(){}\[\]^"~*?:\\/]'
TOKEN = r"[\p{L}\p{N}]+"
PROFILE_REF = r"\[([aAlLrRmM])(?:([0-9]+)|=([^\[\]\n]{1,120}))\]"
HREF = r'href="([^"]*)"'
SITE = "https://catalogue.example"

NODES = """
nodes AS (
  SELECT 'entity' AS space, 'Artist' AS kind, CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS id_num,
         CAST(NULL AS VARCHAR) AS title, s_name AS name, CAST(NULL AS VARCHAR) AS realname,
         CAST(NULL AS VARCHAR) AS year,
         'Based in [l=' || n_name || '], works with [a' || (s_suppkey + 1) || '] and [A=' || lower(s_name)
         || '], heard on [r' || s_suppkey || '] and [m' || s_suppkey || '], [aged 79], [b]see[/b] [l='
         || n_name || ' Records]' AS profile
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 'entity', 'Group', CAST(1000000000 + c_custkey AS VARCHAR), 1000000000 + c_custkey, NULL, c_name,
         NULL, NULL,
         'Group of the ' || c_mktsegment || ' scene in [l' || (100 + c_nationkey) || '], see [a=' || c_name
         || '] or [r=' || lower(c_mktsegment) || ' Widget]'
  FROM customer
  UNION ALL
  SELECT 'release', 'Release', CAST(p_partkey AS VARCHAR), p_partkey, p_name, NULL, NULL, y.year, NULL
  FROM part LEFT JOIN (SELECT l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') AS year
                       FROM lineitem GROUP BY l_partkey) y ON l_partkey = p_partkey
  UNION ALL
  SELECT 'label', 'Label', CAST(r_regionkey AS VARCHAR), r_regionkey, NULL, r_name, NULL, NULL, NULL FROM region
  UNION ALL
  SELECT 'label', 'Label', CAST(100 + n_nationkey AS VARCHAR), 100 + n_nationkey, NULL, n_name, NULL, NULL, NULL
  FROM nation
)"""

EDGES = """
edges AS (
  SELECT 'CREDITED' AS type, 'entity' AS src_space, CAST(l_suppkey AS VARCHAR) AS src, 'release' AS dst_space,
         CAST(l_partkey AS VARCHAR) AS dst, l_orderkey * 100 + l_linenumber AS ordinal
  FROM lineitem
  UNION ALL
  SELECT DISTINCT 'RELEASED_ON', 'release', CAST(l_partkey AS VARCHAR), 'label',
         CAST(100 + s_nationkey AS VARCHAR), 0
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT DISTINCT 'MEMBER_OF', 'entity', CAST(s_suppkey AS VARCHAR), 'entity',
         CAST(1000000000 + c_custkey AS VARCHAR), 0
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey WHERE s_nationkey = c_nationkey
  UNION ALL
  SELECT 'SUBLABEL', 'label', CAST(100 + n_nationkey AS VARCHAR), 'label', CAST(n_regionkey AS VARCHAR), 0
  FROM nation
  UNION ALL
  SELECT 'ALIAS_OF', 'entity', CAST(a.s_suppkey AS VARCHAR), 'entity', CAST(b.s_suppkey AS VARCHAR), 0
  FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 OR b.s_suppkey = a.s_suppkey + 10
)"""

ENDS = """
ends AS (
  SELECT type, src, dst, ordinal, src_space AS space, src AS id, dst_space AS other_space, dst AS other FROM edges
  UNION ALL
  SELECT type, src, dst, ordinal, dst_space, dst, src_space, src FROM edges
  WHERE NOT (src_space = dst_space AND src = dst)
)"""

KINDS = "kinds AS (SELECT unnest(['Artist', 'Group', 'Release', 'Label']) AS kind)"
TYPES = """types AS (
  SELECT unnest(['MEMBER_OF', 'SUBLABEL', 'ALIAS_OF', 'RELEASED_ON', 'CREDITED']) AS type,
         unnest([0, 1, 2, 3, 4]) AS rank
)"""

ADJACENCY = """
adjacency AS (
  SELECT * FROM (
    SELECT e.*, row_number() OVER (
        PARTITION BY space, id
        ORDER BY rank, CAST(src AS BIGINT), CAST(dst AS BIGINT), ordinal) AS rk
    FROM ends e JOIN types USING (type)) WHERE rk <= 300
)"""

DEGREES = "degrees AS (SELECT space, id, count(*) AS degree FROM ends GROUP BY ALL)"

EMPTY_TEXTS = "coalesce(nullif(name, ''), nullif(title, ''), '(untitled)')"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _walk(seeds: str) -> list[str]:
    """CTEs from ``seeds`` (request_id, seed_no, space, id, lim) to walked, found, wedges."""
    return [
        f"seeds AS ({seeds})",
        """
hop1 AS (
  SELECT s.request_id, s.seed_no, s.lim, s.space, s.id, a.rk, a.type, a.src, a.dst, a.ordinal,
         a.other_space, a.other
  FROM seeds s LEFT JOIN adjacency a ON s.space = a.space AND s.id = a.id AND a.rk <= s.lim
)""",
        """
hop1_nodes AS (
  SELECT request_id, space, id, lim, row_number() OVER (PARTITION BY request_id ORDER BY seed_no, rk) AS place
  FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, space, id ORDER BY seed_no, rk) AS nth FROM (
      SELECT request_id, space, id, lim, seed_no, 0 AS rk FROM seeds
      UNION ALL
      SELECT request_id, other_space, other, lim, seed_no, rk FROM hop1 WHERE other IS NOT NULL))
  WHERE nth = 1
)""",
        """
hop2 AS (
  SELECT n.request_id, n.place, a.rk, a.type, a.src, a.dst, a.ordinal, a.other_space, a.other
  FROM hop1_nodes n JOIN adjacency a ON n.space = a.space AND n.id = a.id AND a.rk <= n.lim
)""",
        """
found AS (
  SELECT request_id, space, id, hop,
         row_number() OVER (PARTITION BY request_id ORDER BY hop, place, rk) AS position
  FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, space, id ORDER BY hop, place, rk) AS nth FROM (
      SELECT request_id, space, id, 1 AS hop, place, 0 AS rk FROM hop1_nodes
      UNION ALL
      SELECT request_id, other_space, other, 2, place, rk FROM hop2))
  WHERE nth = 1
)""",
        """
wedges AS (
  SELECT w.*, CASE type WHEN 'RELEASED_ON' THEN 'release' WHEN 'SUBLABEL' THEN 'label' ELSE 'entity' END
              AS src_space,
         CASE type WHEN 'RELEASED_ON' THEN 'label' WHEN 'SUBLABEL' THEN 'label' WHEN 'CREDITED' THEN 'release'
                   ELSE 'entity' END AS dst_space
  FROM (
    SELECT request_id, type, src, dst, ordinal, hop, place, rk FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id, type, src, dst, ordinal
                                   ORDER BY hop, place, rk) AS nth FROM (
        SELECT request_id, 1 AS hop, seed_no AS place, rk, type, src, dst, ordinal FROM hop1
        WHERE other IS NOT NULL
        UNION ALL
        SELECT request_id, 2, place, rk, type, src, dst, ordinal FROM hop2))
    WHERE nth = 1) w
)""",
        """
wdegree AS (
  SELECT request_id, space, id, count(*) AS degree FROM (
    SELECT request_id, src_space AS space, src AS id FROM wedges
    UNION ALL SELECT request_id, dst_space, dst FROM wedges)
  GROUP BY ALL
)""",
        "kept AS (SELECT * FROM found WHERE position <= 300)",
        """
kedges AS (
  SELECT e.* FROM wedges e
  WHERE EXISTS (SELECT 1 FROM kept k WHERE k.request_id = e.request_id AND k.space = e.src_space AND k.id = e.src)
    AND EXISTS (SELECT 1 FROM kept k WHERE k.request_id = e.request_id AND k.space = e.dst_space AND k.id = e.dst)
)""",
    ]


REQUEST_ID = """
  CAST(CASE kind WHEN 'Artist' THEN 0 WHEN 'Group' THEN 1 WHEN 'Label' THEN 2 ELSE 3 END AS BIGINT)
  * 288230376151711744 + id_num"""

EVERY_NODE = f"""
  SELECT {REQUEST_ID} AS request_id, 1 AS seed_no, space, id, 60 AS lim FROM nodes"""

SIMPLE = """
simple AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
        PARTITION BY request_id, least(src_space || ' ' || src, dst_space || ' ' || dst),
                     greatest(src_space || ' ' || src, dst_space || ' ' || dst)
        ORDER BY hop, place, rk) AS nth
    FROM kedges WHERE NOT (src_space = dst_space AND src = dst))
  WHERE nth = 1
)"""

SIMPLE_ENDS = """
simple_ends AS (
  SELECT request_id, src_space AS space, src AS id, type FROM simple
  UNION ALL SELECT request_id, dst_space, dst, type FROM simple
)"""

SIZE = "round(least(26.0, 4.0 + log2(degree + 1) * 19.8 / log2(11)), 6)"


def _cleaned(text: str, width: int = 120) -> str:
    reserved = RESERVED
    plain = f"regexp_replace(coalesce({text}, ''), '{reserved}', ' ', 'g')"
    return f"substring(trim(regexp_replace({plain}, '{SPACE}+', ' ', 'g')), 1, {width})"


def _driver_searches(limit: int) -> str:
    term = _cleaned("q")
    return f"""
searches AS (
  SELECT q AS query_id, {term} AS term, {term} AS said, {limit} AS lim FROM (
    SELECT p_name || ' / ' || n_name AS q FROM (
      SELECT p_name, min(s_nationkey) AS k FROM part JOIN lineitem ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_name) JOIN nation ON n_nationkey = k
    UNION ALL
    SELECT min(s_name) FROM supplier GROUP BY s_nationkey)
)"""


def _scoring(docs: str) -> list[str]:
    """CTEs from ``searches`` (query_id, term, lim) and document tokens to ``pool``."""
    return [
        docs,
        "doc_tf AS (SELECT space, kind, id, id_num, token, count(*) AS tf FROM doc_tokens GROUP BY ALL)",
        "doc_len AS (SELECT space, id, count(*) AS len FROM doc_tokens GROUP BY ALL)",
        "corpus AS (SELECT count(*) AS n, avg(len) AS mean FROM doc_len)",
        "doc_freq AS (SELECT token, count(*) AS df FROM doc_tf GROUP BY token)",
        f"""
asked AS (
  SELECT query_id, token, count(*) AS times FROM (
    SELECT query_id, unnest(regexp_extract_all(lower(term), '{TOKEN}')) AS token FROM searches)
  GROUP BY ALL
)""",
        """
scores AS (
  SELECT query_id, space, kind, id, id_num,
         round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                   / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
  FROM asked JOIN doc_freq USING (token) JOIN doc_tf USING (token) JOIN doc_len USING (space, id), corpus
  GROUP BY ALL
)""",
        """
pool AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id_num) AS nth FROM scores)
  WHERE nth <= 60
)""",
    ]


OWN_TOKENS = f"""
doc_tokens AS (
  SELECT space, kind, id, id_num,
         unnest(regexp_extract_all(lower(coalesce(nullif(name, ''), title)), '{TOKEN}')) AS token
  FROM nodes
)"""

WIDE_TOKENS = f"""
doc_tokens AS (
  SELECT space, kind, id, id_num, unnest(regexp_extract_all(lower(piece), '{TOKEN}')) AS token FROM (
    SELECT space, kind, id, id_num, coalesce(nullif(name, ''), title) AS piece FROM nodes
    UNION ALL
    SELECT r.space, r.kind, r.id, r.id_num, t.name FROM nodes r JOIN (
      SELECT DISTINCT e.dst AS id, a.name FROM edges e
      JOIN nodes a ON a.space = 'entity' AND a.id = e.src WHERE e.type = 'CREDITED') t
    ON r.space = 'release' AND r.id = t.id
    UNION ALL
    SELECT r.space, r.kind, r.id, r.id_num, t.name FROM nodes r JOIN (
      SELECT DISTINCT e.src AS id, a.name FROM edges e
      JOIN nodes a ON a.space = 'label' AND a.id = e.dst WHERE e.type = 'RELEASED_ON') t
    ON r.space = 'release' AND r.id = t.id)
)"""

TIED = """
tied AS (
  SELECT n.space, n.id, coalesce(a.names, []) AS artists, coalesce(l.names, []) AS labels
  FROM nodes n
  LEFT JOIN (SELECT id, list(name ORDER BY name)[1:3] AS names FROM (
      SELECT DISTINCT e.dst AS id, a.name FROM edges e JOIN nodes a ON a.space = 'entity' AND a.id = e.src
      WHERE e.type = 'CREDITED' AND a.name IS NOT NULL) GROUP BY id) a
    ON n.space = 'release' AND a.id = n.id
  LEFT JOIN (SELECT id, list(name ORDER BY name)[1:2] AS names FROM (
      SELECT DISTINCT e.src AS id, a.name FROM edges e JOIN nodes a ON a.space = 'label' AND a.id = e.dst
      WHERE e.type = 'RELEASED_ON' AND a.name IS NOT NULL) GROUP BY id) l
    ON n.space = 'release' AND l.id = n.id
)"""

RANKED = [
    TIED,
    f"""
boosted AS (
  SELECT p.query_id, p.space, p.kind, p.id, p.id_num, s.lim, t.artists, t.labels,
         {EMPTY_TEXTS} AS title, coalesce(n.year, '') AS year,
         substring(coalesce(n.profile, ''), 1, 200) AS profile,
         coalesce(d.degree, 0) AS degree,
         round(p.score + 6.0 * len(list_filter(
           list_filter(regexp_split_to_array(lower(s.said), '{SPACE}+'), lambda x: x <> ''),
           lambda x: NOT contains(lower({EMPTY_TEXTS}), x)
                     AND len(list_filter(list_concat(t.artists, t.labels),
                                         lambda y: contains(lower(y), x))) > 0)), 6) AS score
  FROM pool p JOIN searches s USING (query_id) JOIN nodes n USING (space, id) JOIN tied t USING (space, id)
  LEFT JOIN degrees d USING (space, id)
)""",
    """
ranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
                                 ORDER BY score DESC, degree DESC, kind, id_num) AS position
    FROM boosted) WHERE position <= lim
)""",
]

FOUND_SEEDS = """
  SELECT r.query_id AS request_id, r.position AS seed_no, r.space, r.id, 60 AS lim FROM ranked r"""

REFS = r"""
refs AS (
  SELECT space, kind, id, no, lower(regexp_extract(m, '%s', 1)) AS letter,
         CASE WHEN regexp_extract(m, '%s', 2) <> '' THEN 'id' ELSE 'text' END AS form,
         CASE WHEN regexp_extract(m, '%s', 2) <> '' THEN regexp_extract(m, '%s', 2)
              ELSE regexp_extract(m, '%s', 3) END AS ref
  FROM (SELECT space, kind, id, unnest(ms) AS m, CAST(unnest(range(len(ms))) AS INTEGER) AS no FROM (
          SELECT space, kind, id, regexp_extract_all(profile, '%s', 0) AS ms FROM nodes))
)""" % ((PROFILE_REF,) * 6)

RESOLVED_HEAD = """
keys AS (
  SELECT DISTINCT letter, substring(trim(ref), 1, 200) AS ref,
         CASE letter WHEN 'a' THEN 'entity' WHEN 'l' THEN 'label' WHEN 'r' THEN 'release' END AS space
  FROM refs WHERE letter <> 'm'
),
exact AS (
  SELECT letter, ref, method, kind, id FROM (
    SELECT k.letter, k.ref, 'id' AS method, n.kind, n.id,
           row_number() OVER (PARTITION BY k.letter, k.ref ORDER BY n.kind, n.id_num) AS nth
    FROM keys k JOIN nodes n ON n.space = k.space AND n.id = k.ref
    WHERE regexp_full_match(k.ref, '[0-9]+')
    UNION ALL
    SELECT k.letter, k.ref, 'name', n.kind, n.id,
           row_number() OVER (PARTITION BY k.letter, k.ref ORDER BY n.kind, n.id_num)
    FROM keys k JOIN nodes n ON n.space = k.space AND lower(coalesce(n.name, n.title)) = lower(k.ref)
    WHERE NOT regexp_full_match(k.ref, '[0-9]+'))
  WHERE nth = 1
),
open_refs AS (
  SELECT k.* FROM keys k WHERE NOT regexp_full_match(k.ref, '[0-9]+')
  AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.letter = k.letter AND e.ref = k.ref)
)"""

OPEN_SEARCHES = f"""
searches AS (SELECT DISTINCT ref AS query_id, {_cleaned('ref', 200)} AS term, ref AS said, 5 AS lim FROM open_refs)"""

RESOLVED = """
by_rank AS (
  SELECT letter, ref, kind, id FROM (
    SELECT o.letter, o.ref, r.kind, r.id,
           row_number() OVER (PARTITION BY o.letter, o.ref ORDER BY r.position) AS nth
    FROM open_refs o JOIN ranked r ON r.query_id = o.ref AND r.space = o.space)
  WHERE nth = 1
),
resolved AS (
  SELECT k.letter, k.ref,
         coalesce(e.method, CASE WHEN b.id IS NOT NULL THEN 'rank' END) AS method,
         coalesce(e.kind, b.kind) AS target_kind, coalesce(e.id, b.id) AS target_id
  FROM keys k LEFT JOIN exact e ON e.letter = k.letter AND e.ref = k.ref
  LEFT JOIN by_rank b ON b.letter = k.letter AND b.ref = k.ref
)"""


def _resolving() -> str:
    return _with(
        NODES, EDGES, ENDS, DEGREES, REFS, RESOLVED_HEAD, OPEN_SEARCHES, *_scoring(OWN_TOKENS), *RANKED, RESOLVED
    )


EVENT_STATE = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
  WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'done' END"""

LATEST = f"""
latest AS (
  SELECT n, "of", name, state, elapsed, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY n ORDER BY ts DESC, rank DESC, event_id DESC) AS nth FROM (
      SELECT *, CASE state WHEN 'pending' THEN 0 WHEN 'running' THEN 1 WHEN 'skipped' THEN 2
                           WHEN 'failed' THEN 3 ELSE 4 END AS rank FROM (
        SELECT user_id AS n, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) AS "of",
               'step ' || user_id AS name, {EVENT_STATE} AS state, CAST(floor(value) AS BIGINT) AS elapsed,
               strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_id
        FROM events)))
  WHERE nth = 1
)"""

MASTERS = """
wanted AS (
  SELECT DISTINCT o_custkey * 2 AS id FROM orders WHERE o_orderpriority <> '5-LOW'
)"""

REJECTS = """
screened AS (
  SELECT event_id, CASE
    WHEN event_type = 'view' AND value > 50 THEN 'malformed'
    WHEN event_type = 'error' THEN 'no id'
    WHEN event_type = 'signup' THEN 'id not a number'
    WHEN event_type = 'click' AND value < 10 THEN 'alias id not a number'
    WHEN event_type = 'purchase' AND value < 20 THEN 'member without id'
    ELSE 'accepted' END AS reason
  FROM events
)"""

SOLVENT = """
present AS (
  SELECT 'entity' AS space, CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_acctbal >= 0
  UNION ALL SELECT 'entity', CAST(1000000000 + c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'release', CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'label', CAST(r_regionkey AS VARCHAR) FROM region
  UNION ALL SELECT 'label', CAST(100 + n_nationkey AS VARCHAR) FROM nation
),
flagged AS (
  SELECT e.*,
    NOT EXISTS (SELECT 1 FROM present p WHERE p.space = src_space AND p.id = src) AS src_missing,
    NOT EXISTS (SELECT 1 FROM present p WHERE p.space = dst_space AND p.id = dst) AS dst_missing
  FROM edges e
)"""

DOCUMENT_NODES = r"""
named AS (
  SELECT CASE lang WHEN 'en' THEN 'Artist' WHEN 'fr' THEN 'Group' WHEN 'de' THEN 'Release' ELSE 'Label' END
           AS type,
         CAST(doc_id AS VARCHAR) AS id,
         CASE source WHEN 'src1' THEN e' \t\n' WHEN 'src2' THEN chr(160) || ' ' WHEN 'src3' THEN NULL
           ELSE text END AS name
  FROM documents
)"""

ALIAS_ENTRIES = """
entries AS (
  SELECT s_suppkey AS self, s_suppkey + step AS alias, s_suppkey AS record_no, item_no
  FROM supplier, (SELECT unnest([1, -1, 10, -10]) AS step, unnest([0, 1, 2, 3]) AS item_no)
  WHERE s_suppkey + step >= 0
),
pairs AS (
  SELECT a, b, self, alias FROM (
    SELECT *, least(self, alias) AS a, greatest(self, alias) AS b,
           row_number() OVER (PARTITION BY least(self, alias), greatest(self, alias)
                              ORDER BY record_no, item_no) AS nth
    FROM entries) WHERE nth = 1
),
matched AS (
  SELECT p.*, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = a)
          AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = b) AS ok
  FROM pairs p
)"""

RAW_LIMITS = """
raws AS (
  SELECT event_id, trim(CASE event_type
      WHEN 'error' THEN CAST(value AS VARCHAR)
      WHEN 'click' THEN ' ' || k
      WHEN 'view' THEN '-' || k
      WHEN 'purchase' THEN k || '0' END) AS raw
  FROM (SELECT *, regexp_extract(props, '"k": ?([0-9]+)', 1) AS k FROM events)
),
numbers AS (
  SELECT event_id, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN CAST(raw AS BIGINT) END AS v FROM raws
)"""

CONVERSATION_TERMS = f"cleaned AS (SELECT conv_id, turn, {_cleaned('text')} AS term FROM conversations)"


def oracles() -> dict[str, str]:
    graph = (NODES, EDGES, ENDS)
    expanded = _with(*graph, TYPES, ADJACENCY, *_walk(EVERY_NODE))
    simple = _with(*graph, TYPES, ADJACENCY, *_walk(EVERY_NODE), SIMPLE, SIMPLE_ENDS)
    ranked = lambda limit: _with(
        *graph, DEGREES, _driver_searches(limit), *_scoring(OWN_TOKENS), *RANKED
    )
    searched = _with(
        *graph, TYPES, ADJACENCY, DEGREES, _driver_searches(15), *_scoring(OWN_TOKENS), *RANKED,
        *_walk(FOUND_SEEDS),
    )
    node_rows = f"""
SELECT f.request_id, CAST(f.position AS INTEGER) AS position, n.kind, f.id, {EMPTY_TEXTS} AS title, coalesce(w.degree, 0) AS degree,
       f.hop = 1 AS expanded{{more}}
FROM kept f JOIN nodes n USING (space, id) LEFT JOIN wdegree w USING (request_id, space, id)"""
    edge_rows = "SELECT request_id, type, src, dst, ordinal FROM kedges"
    decades = """
decades AS (
  SELECT substr(y, 1, 3) || '0s' AS decade, count(*) AS n
  FROM (SELECT strftime({day}, '%Y-%m-%d') AS y FROM {table}) WHERE length(y) >= 4 GROUP BY 1
)"""
    found = {
        "node_counts": _with(NODES, KINDS)
        + "SELECT kind, count(id) AS n FROM kinds LEFT JOIN nodes USING (kind) GROUP BY kind",
        "edge_counts": _with(EDGES, TYPES)
        + "SELECT type, count(src) AS n FROM types LEFT JOIN edges USING (type) GROUP BY type",
        "graph_shares": _with(
            NODES,
            EDGES,
            "nc AS (SELECT kind AS key, count(*) AS n FROM nodes GROUP BY kind)",
            "ec AS (SELECT type AS key, count(*) AS n FROM edges GROUP BY type)",
        )
        + """
SELECT 'nodes' AS section, key, CAST(n AS DOUBLE) AS value, round(n * 100.0 / sum(n) OVER (), 6) AS share,
  CAST(row_number() OVER (ORDER BY n DESC, key) AS INTEGER) AS position FROM nc
UNION ALL SELECT 'nodes', 'total', CAST(sum(n) AS DOUBLE), NULL, NULL FROM nc
UNION ALL SELECT 'edges', key, CAST(n AS DOUBLE), round(n * 100.0 / sum(n) OVER (), 6),
  row_number() OVER (ORDER BY n DESC, key) FROM ec
UNION ALL SELECT 'edges', 'total', CAST(sum(n) AS DOUBLE), NULL, NULL FROM ec
UNION ALL SELECT 'ratios', 'edges per node',
  round((SELECT CAST(count(*) AS DOUBLE) FROM edges) / (SELECT count(*) FROM nodes), 6), NULL, NULL
UNION ALL SELECT 'ratios', 'credits per release',
  round((SELECT CAST(n AS DOUBLE) FROM ec WHERE key = 'CREDITED') / (SELECT n FROM nc WHERE key = 'Release'), 6), NULL, NULL
UNION ALL SELECT 'ratios', 'members per group',
  round((SELECT CAST(n AS DOUBLE) FROM ec WHERE key = 'MEMBER_OF') / (SELECT n FROM nc WHERE key = 'Group'), 6), NULL, NULL
""",
        "node_degrees": _with(*graph, DEGREES)
        + "SELECT kind, id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degrees USING (space, id)",
        "hubs_topk": _with(*graph, DEGREES)
        + f"""
SELECT kind, CAST(position AS INTEGER) AS position, id, title, degree FROM (
  SELECT kind, id, {EMPTY_TEXTS} AS title, coalesce(degree, 0) AS degree,
         row_number() OVER (PARTITION BY kind ORDER BY coalesce(degree, 0) DESC, id_num) AS position
  FROM nodes LEFT JOIN degrees USING (space, id)) WHERE position <= 10""",
        "orphans_by_kind": _with(NODES, EDGES)
        + """
SELECT kind, orphans, nodes, round(orphans * 100.0 / nodes, 6) AS share FROM (
  SELECT kind, count(*) AS nodes, count(*) FILTER (
    NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src_space = n.space AND e.src = n.id))
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE (e.dst_space = n.space AND e.dst = n.id))) AS orphans
  FROM nodes n GROUP BY kind)""",
        "releases_by_decade": _with(decades.format(day="o_orderdate", table="orders"))
        + "SELECT decade, n FROM decades",
        "decade_bars": _with(decades.format(day="l_shipdate", table="lineitem"))
        + "SELECT decade, n, CAST(floor(n / (SELECT max(n) FROM decades) * 32) AS INTEGER) AS bar FROM decades",
        "duplicate_ids": """
SELECT id, position FROM (
  SELECT user_id AS id, event_id AS position,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) WHERE nth > 1""",
        "duplicate_counts": """
WITH keyed AS (
  SELECT 'Artist' AS t, l_suppkey AS id FROM lineitem UNION ALL SELECT 'Group', o_custkey FROM orders
  UNION ALL SELECT 'Release', l_partkey FROM lineitem UNION ALL SELECT 'Label', event_id FROM events),
tables AS (
  SELECT t AS "table", id FROM keyed
  UNION ALL SELECT CASE t WHEN 'Release' THEN 'space:release' WHEN 'Label' THEN 'space:label'
                   ELSE 'space:entity' END, id FROM keyed)
SELECT "table", count(*) FILTER (times > 1) AS repeated FROM (
  SELECT "table", id, count(*) AS times FROM tables GROUP BY ALL) GROUP BY "table" """,
        "dangling_edges": _with(EDGES, SOLVENT) + "SELECT * FROM flagged WHERE src_missing OR dst_missing",
        "good_edges": _with(EDGES, SOLVENT)
        + """SELECT type, src_space, src, dst_space, dst, ordinal FROM flagged
WHERE NOT src_missing AND NOT dst_missing""",
        "wanted_count": _with(MASTERS) + "SELECT count(*) AS wanted FROM wanted",
        "canonical_releases": _with(MASTERS)
        + """SELECT CAST(p_partkey AS VARCHAR) AS _id, p_name AS title FROM part
WHERE p_partkey IN (SELECT id FROM wanted)""",
        "missing_wanted": _with(MASTERS)
        + "SELECT id FROM wanted WHERE id NOT IN (SELECT p_partkey FROM part)",
        "master_documents": _with(MASTERS)
        + """SELECT CAST(p_partkey AS VARCHAR) AS release, p_name AS title, p_type AS year,
       CAST(p_size AS VARCHAR) AS main_credit, CAST(p_size + 1 AS VARCHAR) AS extra_credit
FROM part WHERE p_partkey IN (SELECT id FROM wanted)""",
        "reject_reasons": _with(REJECTS) + "SELECT reason, count(*) AS n FROM screened GROUP BY reason",
        "load_counters": _with(REJECTS, MASTERS)
        + """SELECT count(*) AS scanned, count(*) FILTER (reason <> 'accepted') AS errors,
       round(count(*) FILTER (reason <> 'accepted') * 100.0 / count(*), 6) AS error_rate,
       (SELECT count(*) FROM wanted WHERE id IN (SELECT event_id FROM screened WHERE reason = 'accepted')) AS matched,
       (SELECT count(*) FROM wanted WHERE id NOT IN (SELECT event_id FROM screened WHERE reason = 'accepted')) AS missing
FROM screened""",
        "kind_split": """
SELECT CASE WHEN o_orderstatus IN ('F', 'P') THEN 'Group' ELSE 'Artist' END AS kind,
       CAST(o_orderkey AS VARCHAR) AS id, nullif(o_orderpriority, '5-LOW') AS name,
       CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN o_orderstatus END AS realname
FROM orders""",
        "member_links": """
SELECT 'MEMBER_OF' AS type, CAST(o_custkey + k AS VARCHAR) AS src, CAST(o_orderkey AS VARCHAR) AS dst, CAST(k AS BIGINT) AS ordinal
FROM orders, (SELECT unnest([0, 1]) AS k) WHERE o_orderstatus = 'F'""",
        "alias_links": """
SELECT CAST(o_orderkey AS VARCHAR) AS self, CAST(o_custkey AS VARCHAR) AS alias, 1 AS item_no
FROM orders WHERE o_orderstatus <> 'P'""",
        "placeholder_filter": """
WITH listed AS (
  SELECT l_orderkey || '-' || l_linenumber AS release, l_returnflag <> 'N' AS m, l_linestatus = 'O' AS x,
         CAST(l_suppkey AS VARCHAR) AS s, CAST(l_partkey AS VARCHAR) AS p FROM lineitem)
SELECT * FROM (
  SELECT release, s AS artist, 'main' AS role, 0 AS item_no FROM listed WHERE m
  UNION ALL SELECT release, s, 'extra', CASE WHEN m THEN 2 ELSE 0 END FROM listed WHERE x
  UNION ALL SELECT release, p, 'extra', CASE WHEN m THEN 5 ELSE 3 END FROM listed WHERE x)
WHERE artist NOT IN ('194', '355')""",
        "label_listings": """
SELECT l_orderkey || '-' || l_linenumber AS release, CAST(l_partkey AS VARCHAR) AS label,
       CASE WHEN k = 0 THEN l_returnflag END AS name, k AS item_no
FROM lineitem, (SELECT unnest([0, 2]) AS k)""",
        "sublabel_links": """
SELECT CAST(c_custkey AS VARCHAR) AS parent, CAST(c_nationkey AS VARCHAR) AS label, c_mktsegment AS name,
       0 AS item_no FROM customer""",
        "text_rule": """
SELECT doc_id, CASE WHEN lang NOT IN ('fr', 'de') THEN nullif(text, '') END AS node_value,
       CASE lang WHEN 'fr' THEN '' WHEN 'de' THEN NULL ELSE nullif(text, '') END AS csv_value
FROM documents""",
        "node_projection": _with(NODES)
        + f"""SELECT kind, id, {EMPTY_TEXTS} AS title, coalesce(year, '') AS year,
       coalesce(realname, '') AS realname, substring(coalesce(profile, ''), 1, 600) AS profile FROM nodes""",
        "label_merge": """
WITH sightings AS (
  SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 10 THEN p_type ELSE '' END AS profile,
         0 AS source, p_partkey AS place, 2147483647 AS item_no FROM part
  UNION ALL SELECT c_custkey, c_name, c_mktsegment, 0, c_custkey, 0 FROM customer
  UNION ALL SELECT l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_orderkey ELSE '' END, '',
         1, l_orderkey * 10 + l_linenumber, l_suppkey FROM lineitem),
last_name AS (
  SELECT id, name FROM (SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY source DESC, place DESC, item_no DESC) AS nth FROM sightings) WHERE nth = 1),
last_profile AS (
  SELECT id, profile FROM (SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY source DESC, place DESC, item_no DESC) AS nth
    FROM sightings WHERE profile <> '') WHERE nth = 1)
SELECT CAST(id AS VARCHAR) AS id, name, coalesce(profile, '') AS profile
FROM last_name LEFT JOIN last_profile USING (id)""",
        "last_write_wins": """
SELECT id, content FROM (
  SELECT l_partkey AS id, l_orderkey || '|' || l_linenumber || '|' || l_suppkey AS content,
         row_number() OVER (PARTITION BY l_partkey
           ORDER BY l_returnflag || l_linestatus DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS nth
  FROM lineitem) WHERE nth = 1""",
        "part_rows": """
SELECT l_returnflag || l_linestatus AS part, count(*) AS n FROM lineitem GROUP BY 1
UNION ALL SELECT 'all', count(*) FROM lineitem""",
        "alias_pairs": _with(ALIAS_ENTRIES)
        + """SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(self AS VARCHAR) AS first_self,
       CAST(alias AS VARCHAR) AS first_alias FROM pairs""",
        "alias_stats": _with(ALIAS_ENTRIES)
        + """SELECT (SELECT count(*) FROM entries) AS declared, count(*) AS pairs,
       count(*) FILTER (ok) AS matched, count(*) FILTER (NOT ok) AS unmatched,
       round(count(*) FILTER (NOT ok) * 100.0 / count(*), 6) AS unmatched_pct FROM matched""",
        "alias_merge": _with(ALIAS_ENTRIES)
        + """
SELECT CAST(b.s_suppkey AS VARCHAR) AS src, CAST(a.s_suppkey AS VARCHAR) AS dst, 'held' AS origin
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
UNION ALL
SELECT CAST(a AS VARCHAR), CAST(b AS VARCHAR), 'new' FROM matched WHERE ok AND b - a <> 1""",
        "entity_nodes": _with(NODES)
        + "SELECT space, kind, id, id_num, title, name, realname, year, profile FROM nodes",
        "search_export": _with(DOCUMENT_NODES)
        + f"SELECT type, id, name FROM named WHERE regexp_matches(name, '{NON_SPACE}')",
        "export_skipped": _with(DOCUMENT_NODES)
        + f"""SELECT type, count(*) FILTER (NOT coalesce(regexp_matches(name, '{NON_SPACE}'), false))
       AS skipped FROM named GROUP BY type""",
        "name_shards": _with(NODES)
        + """SELECT kind AS type, id, coalesce(name, title) AS name,
       lower(substring(coalesce(name, title), 1, 2)) AS prefix FROM nodes""",
        "trimmed_shards": _with(*graph, DEGREES)
        + """SELECT kind AS type, id, name, lower(substring(name, 1, 3)) AS prefix
FROM nodes JOIN degrees USING (space, id) WHERE kind <> 'Release' AND degree >= 2""",
        "neighbours_budget": _with(*graph, TYPES, ADJACENCY)
        + f"""SELECT {REQUEST_ID} AS request_id, CAST(a.rk AS INTEGER) AS rk, a.type, a.src, a.dst, a.ordinal
FROM nodes n LEFT JOIN adjacency a ON n.space = a.space AND n.id = a.id AND a.rk <= 60""",
        "expand_two_hop_nodes": expanded
        + node_rows.format(
            more=""", coalesce(n.year, '') AS year, coalesce(n.realname, '') AS realname,
       substring(coalesce(n.profile, ''), 1, 600) AS profile"""
        ).replace("n.year", "CAST(NULL AS VARCHAR)"),
        "expand_two_hop_edges": expanded + edge_rows,
        "simple_graph": simple + "SELECT request_id, type, src, dst, ordinal FROM simple",
        "node_size": simple
        + f"""SELECT request_id, space, id, degree, {SIZE} AS size FROM (
  SELECT request_id, space, id, count(*) AS degree FROM simple_ends GROUP BY ALL)""",
        "panel_counts": simple
        + """SELECT request_id, space, id, count(*) AS neighbours,
       count(*) FILTER (type = 'MEMBER_OF') AS member_of, count(*) FILTER (type = 'SUBLABEL') AS sublabel,
       count(*) FILTER (type = 'ALIAS_OF') AS alias_of, count(*) FILTER (type = 'RELEASED_ON') AS released_on,
       count(*) FILTER (type = 'CREDITED') AS credited
FROM simple_ends GROUP BY request_id, space, id""",
        "panel_artists": simple
        + f"""SELECT request_id, s.dst AS id, string_agg({EMPTY_TEXTS}, ', ' ORDER BY hop, place, rk) AS artists
FROM simple s JOIN nodes n ON n.space = s.src_space AND n.id = s.src
WHERE s.type = 'CREDITED' GROUP BY request_id, s.dst""",
        "accumulated_sizes": expanded
        + f"""SELECT session, space, id, degree, {SIZE} AS size FROM (
  SELECT session, space, id, count(*) AS degree FROM (
    SELECT DISTINCT request_id // 288230376151711744 AS session, src_space AS space, src AS id,
           dst_space AS other_space, dst AS other FROM kedges WHERE NOT (src_space = dst_space AND src = dst)
    UNION
    SELECT DISTINCT request_id // 288230376151711744, dst_space, dst, src_space, src FROM kedges
    WHERE NOT (src_space = dst_space AND src = dst)) GROUP BY ALL)""",
        "clean_terms": _with(CONVERSATION_TERMS) + "SELECT conv_id, turn, term FROM cleaned",
        "query_terms": _with(CONVERSATION_TERMS)
        + f"""
SELECT conv_id, turn, CAST(unnest(range(len(ts))) AS INTEGER) AS no, unnest(ts) AS term FROM (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(term), '{SPACE}+'), lambda x: x <> '') AS ts
  FROM cleaned)""",
        "clamp_limits": _with(RAW_LIMITS)
        + """SELECT event_id, CAST(greatest(1, least(300, coalesce(v, 60))) AS INTEGER) AS expand_limit,
       CAST(greatest(1, least(20, coalesce(v, 10))) AS INTEGER) AS suggest_limit,
       CAST(greatest(1, greatest(1, least(300, coalesce(v, 60))) // 4) AS INTEGER) AS seeds FROM numbers""",
        "postings": _with(NODES, OWN_TOKENS)
        + """SELECT kind, id, token, CAST(count(*) AS INTEGER) AS tf, CAST(len AS INTEGER) AS length FROM doc_tokens
JOIN (SELECT space, id, count(*) AS len FROM doc_tokens GROUP BY ALL) USING (space, id) GROUP BY kind, id, token, len""",
        "search_scores": _with(NODES, _driver_searches(10), *_scoring(OWN_TOKENS))
        + "SELECT query_id, kind, id, score FROM pool",
        "search_rank": ranked(60) + "SELECT query_id, CAST(position AS INTEGER) AS position, kind, id, score, degree FROM ranked",
        "suggest": ranked(10)
        + """SELECT query_id, CAST(position AS INTEGER) AS position, kind, id, title, year, profile,
       array_to_string(artists, ', ') AS artists, array_to_string(labels, ', ') AS labels,
       CASE WHEN kind = 'Release' THEN coalesce(nullif(concat_ws(' · ', nullif(array_to_string(artists, ', '), ''),
              nullif(array_to_string(labels, ', '), ''), nullif(year, '')), ''), kind)
            ELSE coalesce(nullif(profile, ''), kind) END AS subtitle FROM ranked""",
        "tied_names": _with(NODES, EDGES, TIED)
        + """SELECT id, array_to_string(artists, ', ') AS artists, array_to_string(labels, ', ') AS labels
FROM tied WHERE space = 'release'""",
        "search_graph": searched + node_rows.format(more=""),
        "search_graph_edges": searched + edge_rows,
        "search_denormalized": _with(NODES, EDGES, _driver_searches(60), *_scoring(WIDE_TOKENS))
        + "SELECT query_id, CAST(nth AS INTEGER) AS position, kind, id, score FROM pool",
        "profile_refs": _with(NODES, REFS) + "SELECT kind, id, no, letter, form, ref FROM refs",
        "ref_usage": _with(NODES, REFS) + "SELECT letter, form, count(*) AS n FROM refs GROUP BY ALL",
        "resolve_refs": _resolving() + "SELECT letter, ref, method, target_kind, target_id FROM resolved",
        "mentions": _resolving()
        + """SELECT r.kind, r.id, s.target_kind, s.target_id, count(*) AS times
FROM refs r JOIN resolved s ON s.letter = r.letter AND s.ref = substring(trim(r.ref), 1, 200)
WHERE s.method IS NOT NULL GROUP BY ALL""",
        "ref_links": _with(NODES, REFS)
        + f"""SELECT kind, id, no, CASE WHEN regexp_full_match(ref, '[0-9]+') THEN '{SITE}/' ||
  CASE letter WHEN 'a' THEN 'artist' WHEN 'l' THEN 'label' WHEN 'r' THEN 'release' ELSE 'master' END
  || '/' || ref END AS link FROM refs""",
        "node_links": _with(NODES)
        + f"""SELECT kind, id, '{SITE}/' || CASE kind WHEN 'Label' THEN 'label' WHEN 'Release' THEN 'release'
  ELSE 'artist' END || '/' || id AS link FROM nodes""",
        "page_links": f"""
SELECT page_id, CAST(unnest(range(len(hs))) AS INTEGER) AS no, unnest(hs) AS href FROM (
  SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS hs FROM pages)""",
        "step_latest": _with(LATEST) + 'SELECT n, "of", name, state, elapsed, ts FROM latest',
        "build_progress": _with(LATEST)
        + """SELECT (SELECT "of" FROM latest ORDER BY n LIMIT 1) AS total,
  count(*) FILTER (state IN ('done', 'skipped')) AS done, bool_or(state = 'failed') AS failed,
  (SELECT name FROM latest WHERE state = 'running' ORDER BY n LIMIT 1) AS running,
  CAST(coalesce(sum(elapsed) FILTER (state = 'done'), 0) AS BIGINT) AS elapsed,
  (SELECT "of" FROM latest ORDER BY n LIMIT 1) > 0
    AND count(*) FILTER (state IN ('done', 'skipped')) >= (SELECT "of" FROM latest ORDER BY n LIMIT 1)
    AND NOT bool_or(state = 'failed') AS finished FROM latest""",
        "ingest_audit": "SELECT 'lineitem.parquet' AS file, count(*) AS rows, CAST(NULL AS VARCHAR) AS dump_date FROM lineitem",
        "dump_round_trip": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS profile,
  c_custkey % 2 = 0 AS has_members FROM customer""",
        "label_dump": """SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name,
  CAST(n_nationkey + 100 AS VARCHAR) AS sub_id, n_name AS sub_name
FROM nation""",
        "graph_csv_round_trip": _with(NODES, EDGES)
        + """SELECT 'node' AS section, kind, id AS a, coalesce(nullif(name, ''), title) AS b FROM nodes
UNION ALL SELECT 'edge', type, src, dst FROM edges""",
        "label_export": _with(NODES) + "SELECT id, name FROM nodes WHERE kind = 'Label'",
        "stored_graph": _with(NODES, EDGES)
        + """SELECT kind, count(*) AS n, true AS refused FROM nodes GROUP BY kind
UNION ALL SELECT type, count(*), true FROM edges GROUP BY type""",
        "step_log_stream": _with(LATEST) + 'SELECT n, "of", name, state, elapsed, ts FROM latest',
        "graph_build": """
WITH kept AS (SELECT * FROM part WHERE p_size <= 25),
credited AS (SELECT p_partkey FROM kept WHERE p_size + 1 IN (SELECT c_custkey FROM customer))
SELECT 'Artist' AS kind, count(*) AS n FROM customer WHERE c_custkey % 2 <> 0 HAVING count(*) > 0
UNION ALL SELECT 'Group', count(*) FROM customer WHERE c_custkey % 2 = 0 HAVING count(*) > 0
UNION ALL SELECT 'Release', count(*) FROM kept HAVING count(*) > 0
UNION ALL SELECT 'Label', count(*) FROM (
  SELECT n_nationkey AS id FROM nation UNION SELECT n_nationkey + 100 FROM nation UNION SELECT p_size % 25 FROM kept)
UNION ALL SELECT 'MEMBER_OF', count(*) FROM customer
  WHERE c_custkey % 2 = 0 AND c_nationkey IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
UNION ALL SELECT 'CREDITED', count(*) FROM credited HAVING count(*) > 0
UNION ALL SELECT 'RELEASED_ON', count(*) FROM kept HAVING count(*) > 0
UNION ALL SELECT 'SUBLABEL', count(*) FROM nation HAVING count(*) > 0""",
    }
    found["graph_report"] = found["graph_shares"]
    found["stored_search_rank"] = found["updated_search"] = found["search_rank"]
    found["stored_suggest"] = found["suggest"]
    found["stored_search_graph"] = found["search_graph"]
    found["stored_resolve_refs"] = found["resolve_refs"]
    found["canonical_by_bitmap"] = found["canonical_releases"]
    found["duplicate_places"] = """
WITH placed AS (
  SELECT l_partkey AS id, CAST(l_partkey % 7 AS INTEGER) AS part, l_orderkey, l_linenumber,
         row_number() OVER (PARTITION BY l_partkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS place,
         row_number() OVER (ORDER BY l_partkey % 7, l_orderkey, l_linenumber, l_partkey) - 1 AS position
  FROM lineitem),
firsts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS nth FROM placed)
SELECT id, part, place, position FROM firsts WHERE nth > 1"""
    label = lambda key, content: f"""'<label id="' || ({key}) || '" note="a > b">' || {content} || '</label>'"""
    inner = label("s_suppkey + 1", "'one' || CASE WHEN s_suppkey % 3 = 0 THEN " + label("s_suppkey + 2", "'two'") + " ELSE '' END")
    nested = "CASE WHEN s_suppkey % 2 = 0 THEN '<sublabels>' || " + inner + " || '<label id=''x''/></sublabels>' ELSE '' END"
    whole = label("s_suppkey", f"'<name>' || s_name || '</name>' || {nested}")
    found["nested_labels"] = f"""
SELECT CAST(s_suppkey AS VARCHAR) AS id, md5({whole}) AS content_md5,
       CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS nth FROM supplier"""
    found["store_update"] = found["last_write_wins"]
    found["footer_counts"] = found["stored_graph"].replace(", true AS refused", "").replace(", true FROM", " FROM")
    sharded = _with(
        NODES,
        "exported AS (SELECT kind AS type, id, coalesce(name, title) AS name FROM nodes WHERE coalesce(name, title) <> '')",
        "keyed AS (SELECT *, lower(name) AS key FROM exported)",
        """spread AS (
  SELECT key, d, left(key, d) AS prefix FROM (SELECT key, unnest(range(1, length(key) + 1)) AS d FROM (SELECT DISTINCT key FROM keyed)))""",
        """sizes AS (
  SELECT prefix, sum(n) AS n FROM spread JOIN (SELECT key, count(*) AS n FROM keyed GROUP BY key) USING (key) GROUP BY prefix)""",
        """leaves AS (
  SELECT s.key, min(s.d) FILTER (WHERE z.n <= 40) AS d FROM spread s JOIN sizes z ON z.prefix = s.prefix GROUP BY s.key)""",
        """shards AS (
  SELECT k.type, k.id, k.name, k.key, coalesce(left(k.key, l.d), k.key) AS prefix, l.d IS NULL AS exact,
         CASE WHEN l.d IS NULL THEN (row_number() OVER (PARTITION BY k.key ORDER BY k.type, k.id) - 1) // 40 ELSE 0 END AS part
  FROM keyed k JOIN leaves l ON l.key = k.key)""",
    )
    found["adaptive_shards"] = sharded + "SELECT type, id, name, prefix, exact, part FROM shards"
    found["shard_lookup"] = sharded + "SELECT name AS q, prefix, exact, max(part) + 1 AS parts FROM shards GROUP BY ALL"
    found["bucketed_degrees"] = found["node_degrees"]
    found["bucketed_dangling"] = (
        _with(EDGES, SOLVENT)
        + "SELECT DISTINCT type, src, dst, ordinal, src_missing, dst_missing FROM flagged WHERE src_missing OR dst_missing"
    )
    found["step_changes_stream"] = found["step_log_stream"]
    found["updated_degrees"] = found["node_degrees"]
    found["updated_neighbours"] = found["neighbours_budget"]
    return found

"""DuckDB oracle SQL for the registered queries.

Each statement reads the driver tables (registered as views by the checker)
and computes the same result as the Spark query of the same name, with the
same column names. Counts are cast to BIGINT, doubles rounded alike.
"""

from __future__ import annotations

import unicodedata as _u

from hemicycle.functions.text import (ENGLISH_STOP_WORDS, FRENCH_STOP_WORDS, LATIN1_TO_ASCII,
                                       REFINED_SOUNDEX_CODES)

# The oracle's own patterns, written for RE2 and kept apart from the engine's. Only the published
# fixed tables (stop words, Latin-1 table, Soundex codes) are shared.
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’._][\p{L}\p{M}\p{N}]+)*"
SPLIT_AT = r"\{[0-9]+\}|[\s\x21-\x2F\x3A-\x40\x5B-\x60\x7C\x7E]+"
HONORIFIC_NAME = r"(?:MM\.|M\.|Mme[s]*)?\s*([^(]+)\s*(?:\(.*\))?"
ANCHOR_HREF = r"""(?i)<a\s(?:[^>]*?)href\s*=\s*["']?([^"'\s>]*)"""
META_TAG, HEAD_PART = r"(?i)<meta\s[^>]*>", r"(?is)<head[^>]*>(.*?)</head>"
STOPS = {"french": FRENCH_STOP_WORDS, "english": ENGLISH_STOP_WORDS}
# folding by canonical and compatibility decomposition, with the letters that have none named one by one
_STROKED = dict(zip("øØđĐłŁħĦŧŦıſðÐ", "oOdDlLhHtTisdD"))
_WIDE = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ẞ": "SS", "þ": "th", "Þ": "TH", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}
_NARROW = {chr(c): d[0] for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)) for c in range(lo, hi)
           if (d := _u.normalize("NFKD", chr(c)))[0].isascii() and all(_u.combining(x) for x in d[1:])} | _STROKED

ORACLE: dict[str, str] = {}

# ballots as SQL: lineitem with the flag mapping of hemicycle.sources.tables
BALLOTS_SQL = """
  SELECT l_orderkey AS scrutiny_uuid,
         CASE l_returnflag WHEN 'A' THEN 'yea' WHEN 'R' THEN 'nay' WHEN 'N' THEN 'abs' END AS vote,
         l_suppkey AS voter_uuid, l_linenumber AS ord
  FROM lineitem WHERE l_returnflag IN ('A', 'R', 'N')
"""

DEPUTIES_SQL = """
  SELECT s_suppkey AS uuid, s_name AS name, n_name AS party, r_name AS jurisdiction
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
                LEFT JOIN region ON n_regionkey = r_regionkey
"""

TALLY_COLS = """
  CAST(count(*) FILTER (WHERE vote = 'yea') AS BIGINT) AS yea,
  CAST(count(*) FILTER (WHERE vote = 'nay') AS BIGINT) AS nay,
  CAST(count(*) FILTER (WHERE vote = 'abs') AS BIGINT) AS abs
"""

ORACLE["rollcall_tallies"] = f"""
WITH b AS ({BALLOTS_SQL}),
t AS (SELECT scrutiny_uuid, {TALLY_COLS} FROM b GROUP BY scrutiny_uuid)
SELECT *, CASE WHEN yea >= nay THEN 'Adopté' ELSE 'Rejeté' END AS outcome FROM t
"""

ORACLE["rollcall_latest"] = f"""
WITH b AS ({BALLOTS_SQL}),
t AS (SELECT scrutiny_uuid, {TALLY_COLS} FROM b GROUP BY scrutiny_uuid)
SELECT t.scrutiny_uuid, strftime(o_orderdate, '%d/%m/%Y') AS date_display, yea, nay, abs,
       CASE WHEN yea >= nay THEN 'Adopté' ELSE 'Rejeté' END AS outcome
FROM t JOIN orders ON o_orderkey = t.scrutiny_uuid
ORDER BY o_orderdate DESC NULLS LAST, t.scrutiny_uuid LIMIT 1000
"""

ORACLE["rollcall_group_stance"] = f"""
WITH b AS ({BALLOTS_SQL}), d AS ({DEPUTIES_SQL}),
g AS (SELECT scrutiny_uuid, d.party AS group_name, {TALLY_COLS}
      FROM b LEFT JOIN d ON b.voter_uuid = d.uuid GROUP BY scrutiny_uuid, d.party)
SELECT *,
  CASE WHEN yea > nay THEN 'Pour' WHEN nay = 0 AND abs > 0 THEN 'Abstenu' ELSE 'Contre' END AS stance,
  upper(substr(group_name, 1, 1)) || lower(substr(group_name, 2)) AS group_label
FROM g
"""

ORACLE["voter_history_topk"] = f"""
WITH b AS ({BALLOTS_SQL}),
t AS (SELECT scrutiny_uuid, {TALLY_COLS} FROM b GROUP BY scrutiny_uuid),
docs AS (SELECT DISTINCT voter_uuid, vote, scrutiny_uuid FROM b WHERE voter_uuid IS NOT NULL),
r AS (SELECT docs.*, o_orderdate AS date,
        row_number() OVER (PARTITION BY voter_uuid, vote
                           ORDER BY o_orderdate DESC NULLS LAST, scrutiny_uuid) AS rn
      FROM docs LEFT JOIN orders ON o_orderkey = docs.scrutiny_uuid)
SELECT r.voter_uuid, r.vote, r.scrutiny_uuid, strftime(r.date, '%d/%m/%Y') AS date_display,
       CAST(rn AS BIGINT) AS rn, yea, nay, abs,
       CASE WHEN yea >= nay THEN 'Adopté' ELSE 'Rejeté' END AS outcome
FROM r LEFT JOIN t USING (scrutiny_uuid) WHERE rn <= 1000
"""

ORACLE["voter_totals"] = f"""
WITH b AS ({BALLOTS_SQL})
SELECT voter_uuid, vote, CAST(count(DISTINCT scrutiny_uuid) AS BIGINT) AS n_scrutinies,
       CASE vote WHEN 'yea' THEN 'Pour' WHEN 'nay' THEN 'Contre' WHEN 'abs' THEN 'Abstenu' END AS vote_label
FROM b WHERE voter_uuid IS NOT NULL GROUP BY voter_uuid, vote
"""

ORACLE["votes_nested_roundtrip"] = f"""
WITH b AS ({BALLOTS_SQL}), d AS ({DEPUTIES_SQL})
SELECT scrutiny_uuid, d.party AS group_name, vote, CAST(count(*) AS BIGINT) AS n_ballots,
       CAST(count(voter_uuid) AS BIGINT) AS n_resolved
FROM b LEFT JOIN d ON b.voter_uuid = d.uuid GROUP BY scrutiny_uuid, d.party, vote
"""

ORACLE["nested_tallies"] = ORACLE["rollcall_tallies"]

ORACLE["term_filter_nested"] = f"""
WITH b AS ({BALLOTS_SQL})
SELECT DISTINCT voter_uuid, vote, scrutiny_uuid FROM b
WHERE voter_uuid IN (SELECT s_suppkey FROM supplier)
"""


# ---------------------------------------------------------------- hierarchy

TREE_ADJ_SQL = """
  SELECT 1::BIGINT AS id, 0::BIGINT AS parent_id, 0::BIGINT AS position, 'ROOT' AS title, 'root' AS type
  UNION ALL
  SELECT (r_regionkey + 2)::BIGINT, 1::BIGINT, (row_number() OVER (ORDER BY r_regionkey) - 1)::BIGINT,
         r_name, 'region' FROM region
  UNION ALL
  SELECT (n_nationkey + 10)::BIGINT, (n_regionkey + 2)::BIGINT,
         (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::BIGINT, n_name, 'nation'
  FROM nation
  UNION ALL
  SELECT (c_custkey + 100)::BIGINT, (c_nationkey + 10)::BIGINT,
         (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::BIGINT, c_name, 'customer'
  FROM customer
"""


def numbering_ctes(adj: str, out: str) -> str:
    """CTEs numbering adjacency view ``adj`` into nested-set view ``out`` (needs WITH RECURSIVE)."""
    return f"""
{out}_walk(id, depth, path, anc) AS (
  SELECT id, 0, [{{'p': position, 'i': id}}], [id] FROM {adj} WHERE parent_id = 0
  UNION ALL
  SELECT a.id, w.depth + 1, list_append(w.path, {{'p': a.position, 'i': a.id}}), list_append(w.anc, a.id)
  FROM {adj} a JOIN {out}_walk w ON a.parent_id = w.id),
{out}_rank AS (SELECT id, depth, row_number() OVER (ORDER BY path) AS r FROM {out}_walk),
{out}_size AS (SELECT u.a AS id, count(*) AS n FROM (SELECT unnest(anc) AS a FROM {out}_walk) u GROUP BY u.a),
{out} AS (
  SELECT t.id, t.parent_id, t.position, (2 * r - 1 - depth)::BIGINT AS lft,
         (2 * r - 1 - depth + 2 * n - 1)::BIGINT AS rgt, depth::BIGINT AS level, t.title, t.type
  FROM {adj} t JOIN {out}_rank USING (id) JOIN {out}_size USING (id))
"""


TREE_BASE = f"WITH RECURSIVE adj0 AS ({TREE_ADJ_SQL}),{numbering_ctes('adj0', 'tree0')}"

ORACLE["tree_numbering"] = TREE_BASE + "SELECT * FROM tree0"

ORACLE["tree_descendants"] = TREE_BASE + """
SELECT a.id AS ancestor_id, d.id AS id, (d.level - a.level)::BIGINT AS distance
FROM tree0 a JOIN tree0 d ON d.lft >= a.lft AND d.rgt <= a.rgt
"""

ORACLE["tree_path"] = TREE_BASE + """
SELECT d.id, d.level,
       string_agg(a.id::VARCHAR, '/' ORDER BY a.level) AS path_ids,
       string_agg(a.title, '/' ORDER BY a.level) AS path_titles
FROM tree0 a JOIN tree0 d ON d.lft >= a.lft AND d.rgt <= a.rgt
GROUP BY d.id, d.level
"""

ORACLE["tree_search"] = TREE_BASE + """
, hits AS (SELECT lft, rgt FROM tree0 WHERE contains(lower(strip_accents(title)), 'customer#00000012'))
SELECT DISTINCT t.id, t.title FROM tree0 t JOIN hits h ON t.lft < h.lft AND t.rgt > h.rgt
"""

ORACLE["tree_analyze"] = TREE_BASE + """
, s AS (SELECT count(*) FILTER (WHERE parent_id = 0) AS roots,
               min(lft) FILTER (WHERE parent_id = 0) AS root_lft, max(rgt) AS max_rgt, count(*) AS n FROM tree0),
m AS (SELECT count(*) AS missing FROM tree0 c WHERE parent_id <> 0
      AND NOT EXISTS (SELECT 1 FROM tree0 p WHERE p.id = c.parent_id)),
ns AS (SELECT a.id, count(*) AS ns FROM tree0 a JOIN tree0 d
       ON d.lft > a.lft AND d.rgt < a.rgt AND d.level = a.level + 1 GROUP BY a.id),
aj AS (SELECT parent_id AS id, count(*) AS aj FROM tree0 GROUP BY parent_id),
mm AS (SELECT count(*) AS mismatch FROM tree0 t LEFT JOIN ns USING (id) LEFT JOIN aj USING (id)
       WHERE coalesce(ns, 0) <> coalesce(aj, 0))
SELECT * FROM (
  SELECT 1 AS check_no, CASE WHEN roots = 1 THEN 'OK' ELSE 'FAIL' END AS status,
         CASE WHEN roots = 0 THEN 'No root node.' WHEN roots > 1 THEN 'More than one root node.'
              ELSE 'Just one root node.' END AS message FROM s
  UNION ALL SELECT 2, CASE WHEN coalesce(root_lft = 1, false) THEN 'OK' ELSE 'FAIL' END,
         CASE WHEN coalesce(root_lft = 1, false) THEN 'Root node''s left index is 1.'
              ELSE 'Root node''s left index is not 1.' END FROM s
  UNION ALL SELECT 3, CASE WHEN missing > 0 THEN 'FAIL' ELSE 'OK' END,
         CASE WHEN missing > 0 THEN 'Missing parents.' ELSE 'No missing parents.' END FROM m
  UNION ALL SELECT 4, CASE WHEN max_rgt / 2 = n THEN 'OK' ELSE 'FAIL' END,
         CASE WHEN max_rgt / 2 = n THEN 'Right index matches count.'
              ELSE 'Right index does not match node count.' END FROM s
  UNION ALL SELECT 5, CASE WHEN mismatch > 0 THEN 'FAIL' ELSE 'OK' END,
         CASE WHEN mismatch > 0 THEN 'Adjacency and nested set do not match.' ELSE 'NS and AJ match' END FROM mm)
"""


def _reseat_sql(adj: str, node: int, ref: int, position: int, old_parent: str) -> str:
    """Adjacency after making ``node`` the ``position``-th child of ``ref`` (compacting siblings)."""
    return f"""
  SELECT * FROM (
    SELECT id, parent_id,
           CASE WHEN touched THEN (idx + CASE WHEN parent_id = {ref} AND idx >= p THEN 1 ELSE 0 END)::BIGINT
                ELSE position END AS position, title, type
    FROM (SELECT x.*, parent_id IN ({ref}, {old_parent}) AS touched,
                 row_number() OVER (PARTITION BY parent_id IN ({ref}, {old_parent}), parent_id
                                    ORDER BY position, id) - 1 AS idx,
                 (SELECT least({position}, count(*)) FROM {adj}
                  WHERE parent_id = {ref} AND id <> {node}) AS p
          FROM {adj} x WHERE id <> {node})
    UNION ALL
    SELECT id, {ref}::BIGINT, (SELECT least({position}, count(*)) FROM {adj}
                              WHERE parent_id = {ref} AND id <> {node})::BIGINT, title, type
    FROM {adj} WHERE id = {node})
"""


ORACLE["tree_remove"] = TREE_BASE + """,
gone AS (SELECT d.id FROM tree0 n JOIN tree0 d ON n.id = 2 AND d.lft >= n.lft AND d.rgt <= n.rgt),
kept AS (SELECT * FROM tree0 WHERE id NOT IN (SELECT id FROM gone)),
adj1 AS (SELECT id, parent_id,
                CASE WHEN parent_id = (SELECT parent_id FROM tree0 WHERE id = 2)
                     THEN (row_number() OVER (PARTITION BY parent_id ORDER BY position, id) - 1)::BIGINT
                     ELSE position END AS position, title, type FROM kept),
""" + numbering_ctes("adj1", "tree1") + "SELECT * FROM tree1"

ORACLE["tree_remove_many"] = TREE_BASE + """,
listed AS (SELECT * FROM tree0 WHERE id IN (3, 12, 17)),
gone AS (SELECT DISTINCT d.id FROM listed n JOIN tree0 d ON d.lft >= n.lft AND d.rgt <= n.rgt),
kept AS (SELECT * FROM tree0 WHERE id NOT IN (SELECT id FROM gone)),
adj1 AS (SELECT id, parent_id,
                CASE WHEN parent_id IN (SELECT parent_id FROM listed)
                     THEN (row_number() OVER (PARTITION BY parent_id ORDER BY position, id) - 1)::BIGINT
                     ELSE position END AS position, title, type FROM kept),
""" + numbering_ctes("adj1", "tree1") + "SELECT * FROM tree1"

ORACLE["tree_move"] = TREE_BASE + """,
adj1 AS (""" + _reseat_sql("(SELECT id, parent_id, position, title, type FROM tree0)", 10, 5, 1,
                           "(SELECT parent_id FROM tree0 WHERE id = 10)") + "),\n" + \
    numbering_ctes("adj1", "tree1") + "SELECT * FROM tree1"

ORACLE["tree_copy"] = TREE_BASE + """,
src AS (SELECT d.*, row_number() OVER (ORDER BY d.level, d.id) AS r
        FROM tree0 n JOIN tree0 d ON n.id = 11 AND d.lft >= n.lft AND d.rgt <= n.rgt),
mx AS (SELECT max(id) AS m FROM tree0),
copies AS (SELECT (mx.m + s.r)::BIGINT AS id,
                  CASE WHEN s.id = 11 THEN 2::BIGINT ELSE (mx.m + p.r)::BIGINT END AS parent_id,
                  s.position, s.title, s.type
           FROM src s CROSS JOIN mx LEFT JOIN src p ON p.id = s.parent_id),
adj_c AS (SELECT id, parent_id, position, title, type FROM tree0 UNION ALL SELECT * FROM copies),
adj1 AS (""" + _reseat_sql("adj_c", "(SELECT m + 1 FROM mx)", 2, 0, "-1") + "),\n" + \
    numbering_ctes("adj1", "tree1") + "SELECT * FROM tree1"

ORACLE["tree_rules"] = TREE_BASE + """,
rules(type, max_children, max_depth, valid_children) AS (VALUES
  ('root', 5, -1, ['region']), ('region', 4, 1, ['nation']),
  ('nation', -1, -1, ['customer']), ('customer', 0, 0, ['none'])),
nc AS (SELECT parent_id AS id, count(*) AS nc FROM tree0 GROUP BY parent_id),
ht AS (SELECT a.id, max(d.level - a.level) AS h FROM tree0 a JOIN tree0 d
       ON d.lft >= a.lft AND d.rgt <= a.rgt GROUP BY a.id),
base AS (SELECT t.id, r.*, coalesce(nc, 0) AS nc, coalesce(h, 0) AS h
         FROM tree0 t JOIN rules r USING (type) LEFT JOIN nc USING (id) LEFT JOIN ht USING (id))
SELECT id, 'max_children' AS rule, nc::BIGINT AS value, max_children::BIGINT AS "limit"
FROM base WHERE max_children >= 0 AND nc > max_children
UNION ALL
SELECT id, 'max_depth', h::BIGINT, max_depth::BIGINT FROM base WHERE max_depth >= 0 AND h > max_depth
UNION ALL
SELECT k.parent_id, 'valid_children', k.id, NULL::BIGINT
FROM tree0 k JOIN tree0 p ON k.parent_id = p.id JOIN rules r ON r.type = p.type
WHERE NOT (r.valid_children IS NULL OR list_contains(r.valid_children, 'all')
           OR (NOT list_contains(r.valid_children, 'none') AND list_contains(r.valid_children, k.type)))
"""

ORACLE["tree_dupes"] = TREE_BASE + """
SELECT parent_id, title_key, id, count(*) OVER (PARTITION BY parent_id, title_key)::BIGINT AS n
FROM (SELECT parent_id, lower(title) AS title_key, id FROM tree0) t
QUALIFY count(*) OVER (PARTITION BY parent_id, title_key) > 1
"""

CATALOG_ADJ_SQL = """
  WITH ty AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS t FROM (SELECT DISTINCT p_type FROM part)),
  br AS (SELECT p_type, p_brand, row_number() OVER (ORDER BY p_type, p_brand) AS b
         FROM (SELECT DISTINCT p_type, p_brand FROM part)),
  nt AS (SELECT count(*) AS n FROM ty), nb AS (SELECT count(*) AS n FROM br)
  SELECT 1::BIGINT AS id, 0::BIGINT AS parent_id, 0::BIGINT AS position, 'CATALOG' AS title, 'root' AS type
  UNION ALL
  SELECT (t + 1)::BIGINT, 1::BIGINT, (t - 1)::BIGINT, p_type, 'type' FROM ty
  UNION ALL
  SELECT (b + 1 + nt.n)::BIGINT, (t + 1)::BIGINT,
         (row_number() OVER (PARTITION BY br.p_type ORDER BY p_brand) - 1)::BIGINT, p_brand, 'brand'
  FROM br JOIN ty USING (p_type) CROSS JOIN nt
  UNION ALL
  SELECT (p_partkey + 2 + nt.n + nb.n)::BIGINT, (b + 1 + nt.n)::BIGINT,
         (row_number() OVER (PARTITION BY b ORDER BY p_partkey) - 1)::BIGINT, p_name, 'item'
  FROM part JOIN br USING (p_type, p_brand) CROSS JOIN nt CROSS JOIN nb
"""

ORACLE["catalog_dupes"] = f"""
WITH c AS ({CATALOG_ADJ_SQL})
SELECT parent_id, title_key, id, count(*) OVER (PARTITION BY parent_id, title_key)::BIGINT AS n
FROM (SELECT parent_id, lower(title) AS title_key, id FROM c) t
QUALIFY count(*) OVER (PARTITION BY parent_id, title_key) > 1
"""

ORACLE["catalog_numbering"] = (f"WITH RECURSIVE adjc AS ({CATALOG_ADJ_SQL}),"
                               + numbering_ctes("adjc", "cat") + "SELECT * FROM cat")

ORACLE["tree_rollup"] = TREE_BASE + """,
leaves AS (SELECT t.id, coalesce(c.c_acctbal > 0, false) AS c FROM tree0 t
           LEFT JOIN customer c ON c.c_custkey + 100 = t.id WHERE t.rgt - t.lft = 1),
agg AS (SELECT a.id, bool_and(l.c) AS al, bool_or(l.c) AS an FROM tree0 a
        JOIN tree0 d ON d.lft >= a.lft AND d.rgt <= a.rgt JOIN leaves l ON l.id = d.id GROUP BY a.id),
st AS (SELECT t.id, t.parent_id, CASE WHEN al THEN 'checked' WHEN an THEN 'undetermined'
                                      ELSE 'unchecked' END AS state
       FROM tree0 t LEFT JOIN agg USING (id))
SELECT s.id, s.state, (s.state = 'checked' AND coalesce(p.state <> 'checked', true)) AS top_checked
FROM st s LEFT JOIN st p ON p.id = s.parent_id
"""

ORACLE["tree_sorted"] = TREE_BASE + """,
adj1 AS (SELECT id, parent_id,
                (row_number() OVER (PARTITION BY parent_id ORDER BY title, id) - 1)::BIGINT AS position,
                title, type FROM tree0),
""" + numbering_ctes("adj1", "tree1") + "SELECT * FROM tree1"

ORACLE["tree_sorted_by"] = TREE_BASE + """,
adj1 AS (SELECT id, parent_id,
                (row_number() OVER (PARTITION BY parent_id ORDER BY length(title) DESC, id) - 1)::BIGINT AS position,
                title, type FROM tree0),
""" + numbering_ctes("adj1", "tree1") + "SELECT * FROM tree1"

ORACLE["tree_json"] = TREE_BASE + """
SELECT id, parent_id,
       to_json({'attr': {'id': 'node_' || id::VARCHAR, 'rel': type}, 'data': title,
                'state': CASE WHEN rgt - lft > 1 THEN 'closed' ELSE '' END})::VARCHAR AS json
FROM tree0
"""


# ---------------------------------------------------------------- text analysis


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(e: str) -> str:
    for k, v in _WIDE.items():
        e = f"replace({e}, {_q(k)}, {_q(v)})"
    return f"translate({e}, {_q(''.join(_NARROW))}, {_q(''.join(_NARROW.values()))})"


def latin1_sql(e: str) -> str:
    one = {chr(k): v for k, v in LATIN1_TO_ASCII.items() if len(v) == 1}
    for k, v in LATIN1_TO_ASCII.items():
        if len(v) > 1:
            e = f"replace({e}, {_q(chr(k))}, {_q(v)})"
    e = f"translate({e}, {_q(''.join(one))}, {_q(''.join(one.values()))})"
    return f"regexp_replace({e}, '[^\\x00-\\x7F]', '', 'g')"


def soundex_sql(e: str) -> str:
    u = f"upper(regexp_replace({e}, '[^A-Za-z]', '', 'g'))"
    c = f"translate({u}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{REFINED_SOUNDEX_CODES}')"
    for d in "0123456789":
        c = f"regexp_replace({c}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN length({u}) > 0 THEN left({u}, 1) || {c} END"


def _stops(name: str) -> str:
    return ", ".join(_q(w) for w in STOPS.get(name, ()))


def norm_tokens_sql(source: str, analyzer: str) -> str:
    """SQL twin of analysis.normalized_tokens over ``source(doc_id, text)``."""
    tok, elide, stops, _, _ = {
        "french": ("standard", True, "french", None, None),
        "english": ("standard", False, "english", None, None),
        "general": ("standard", False, None, None, None),
        "timestamped_french": ("timestamp", True, "french", None, None),
        "timestamped_english": ("timestamp", False, "english", None, None),
    }[analyzer]
    if tok == "standard":
        toks = f"regexp_extract_all(text, {_q(WORD)})"
    else:
        toks = f"list_filter(string_split_regex(text, {_q(SPLIT_AT)}), lambda t: t <> '')"
    term = "lower(tok)"
    if elide:
        term = f"regexp_replace({term}, '^(l|m|t|qu|n|s|j)[''’]', '')"
    where = f"WHERE term NOT IN ({_stops(stops)})" if stops else ""
    return f"""
  SELECT doc_id, {fold_sql('term')} AS term FROM (
    SELECT doc_id, {term} AS term FROM (SELECT doc_id, unnest({toks}) AS tok FROM {source}) x) y
  {where}
"""


def _tf_sql(source: str, analyzer: str) -> str:
    return f"""
WITH t AS ({norm_tokens_sql(source, analyzer)})
SELECT doc_id, term, count(*)::BIGINT AS tf FROM t WHERE term <> '' GROUP BY doc_id, term
"""


ORACLE["tokens_fr"] = _tf_sql("(SELECT doc_id, text FROM documents WHERE lang = 'fr')", "french")
ORACLE["tokens_en"] = _tf_sql("(SELECT doc_id, text FROM documents WHERE lang = 'en')", "english")
ORACLE["tokens_timestamped"] = _tf_sql(
    "(SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS doc_id, text FROM conversations)",
    "timestamped_french")

ORACLE["doc_phonetic"] = f"""
WITH t AS ({norm_tokens_sql("(SELECT doc_id, text FROM documents)", "general")}),
k AS (SELECT doc_id, term, 'term' AS kind FROM t WHERE term <> ''
      UNION ALL
      SELECT doc_id, {soundex_sql('term')} AS term, 'phon' AS kind FROM t WHERE term <> '')
SELECT doc_id, term, kind, count(*)::BIGINT AS tf FROM k WHERE term IS NOT NULL GROUP BY doc_id, term, kind
"""

ORACLE["keyword_topk"] = f"""
WITH t AS ({norm_tokens_sql("(SELECT doc_id, text FROM documents)", "french")}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY doc_id, term),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t WHERE term <> ''),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.doc_id, tf.term, tf.tf, round(tf.tf * ln(n.n / df.df), 6) AS score
      FROM tf JOIN df USING (term) CROSS JOIN n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s)
SELECT doc_id, rank::BIGINT AS rank, term, tf::BIGINT AS tf, score FROM r WHERE rank <= 20
"""

ORACLE["trend_keywords"] = """
WITH k AS (SELECT DISTINCT doc_id, lower(x) AS keyword
           FROM (SELECT doc_id, unnest([source, lang, upper(lang)]) AS x FROM documents))
SELECT keyword, count(*)::BIGINT AS n_docs FROM k GROUP BY keyword
"""

ORACLE["fold_ascii"] = f"""
SELECT doc_id, length({latin1_sql('text')})::BIGINT AS x1_len, md5({latin1_sql('text')}) AS x1_md5,
       length({fold_sql('text')})::BIGINT AS t9_len, md5({fold_sql('text')}) AS t9_md5
FROM documents
"""


# ---------------------------------------------------------------- names


def norm_pos_sql(source: str, analyzer: str) -> str:
    """(doc_id, pos, term) after tokenizer .. folding, pos = 0-based token index."""
    elide = analyzer == "french"
    term = "lower(tok)"
    if elide:
        term = f"regexp_replace({term}, '^(l|m|t|qu|n|s|j)[''’]', '')"
    return f"""
  SELECT doc_id, pos, {fold_sql('term')} AS term FROM (
    SELECT doc_id, pos, {term} AS term FROM (
      SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, {_q(WORD)}) AS toks FROM {source}) s) x) y
  WHERE term NOT IN ({_stops(analyzer)})
"""


def analyzed_sql(source: str) -> str:
    """french analyzer without the stemmer: terms plus refined-Soundex codes."""
    return f"""
  SELECT doc_id, pos, term FROM ({norm_pos_sql(source, 'french')}) a WHERE term <> ''
  UNION ALL
  SELECT doc_id, pos, {soundex_sql('term')} FROM ({norm_pos_sql(source, 'french')}) b
  WHERE term <> '' AND {soundex_sql('term')} IS NOT NULL
"""


NAME_LISTS_SQL = """
  SELECT p_partkey,
         CASE WHEN p_size % 2 = 0 THEN 'M. ' ELSE 'MM. ' END || p_name || ' (' || p_brand || '), Mme '
         || replace(p_name, 'o', 'au') || ' et M. ' || lower(p_type) || '.' AS names_text
  FROM part
"""

CLEAN_NAMES_SQL = f"""
  SELECT p_partkey, ord, name FROM (
    SELECT p_partkey, ord,
           regexp_replace(regexp_replace(regexp_extract(raw, {_q(HONORIFIC_NAME)}, 1),
                                         '^\\s+|\\s+$', '', 'g'), '\\.$', '') AS name
    FROM (SELECT p_partkey, unnest(l) AS raw, generate_subscripts(l, 1) AS ord
          FROM (SELECT p_partkey, string_split_regex(replace(replace(names_text, chr(160), ' '), ' et ', ', '),
                                                     ',\\s*') AS l FROM ({NAME_LISTS_SQL}) n) s) t) u
  WHERE name <> ''
"""

ORACLE["clean_names"] = CLEAN_NAMES_SQL

DIRECTORY_SQL = "(SELECT p_partkey AS doc_id, p_name AS text FROM part)"

def resolution_sql(mentions: str) -> str:
    """CTEs and result of J1 for a query of distinct mentions."""
    return f"""
WITH m AS ({mentions}),
mq AS (SELECT DISTINCT doc_id AS mention, pos, term FROM ({analyzed_sql('(SELECT mention AS doc_id, mention AS text FROM m)')}) a),
npos AS (SELECT mention, count(DISTINCT pos) AS npos FROM mq GROUP BY mention),
dt AS (SELECT DISTINCT doc_id AS uuid, pos, term FROM ({analyzed_sql(DIRECTORY_SQL)}) b),
n AS (SELECT count(DISTINCT p_partkey) AS n FROM part),
df AS (SELECT term, 1 + ln(n.n / (count(DISTINCT uuid) + 1)) AS idf FROM dt CROSS JOIN n GROUP BY term, n.n),
len AS (SELECT doc_id AS uuid, count(DISTINCT pos) AS len FROM ({norm_pos_sql(DIRECTORY_SQL, 'french')}) c
        WHERE term <> '' GROUP BY doc_id),
mt AS (SELECT DISTINCT mq.mention, dt.uuid, mq.pos, mq.term FROM mq JOIN dt ON mq.term = dt.term),
s AS (SELECT mt.mention, mt.uuid, count(DISTINCT mt.pos) AS hit, sum(idf * idf / sqrt(len)) AS s
      FROM mt JOIN df USING (term) JOIN len USING (uuid) GROUP BY mt.mention, mt.uuid),
b AS (SELECT s.mention, uuid, round(s, 9) AS score,
             row_number() OVER (PARTITION BY s.mention ORDER BY round(s, 9) DESC, uuid) AS rn
      FROM s JOIN npos USING (mention) WHERE hit = npos)
SELECT m.mention, b.uuid, round(b.score, 6) AS score FROM m LEFT JOIN b ON b.mention = m.mention AND b.rn = 1
"""


ORACLE["name_resolution"] = resolution_sql(f"SELECT DISTINCT name AS mention FROM ({CLEAN_NAMES_SQL}) c")

def search_sql(head: str) -> str:
    """Search for ``head`` (may be empty after analysis) and the prefix ``wi``."""
    score = "(w + 1.0) / sqrt(len)" if head else "1.0 / sqrt(len)"
    hits = "hs" if head else "(SELECT uuid, 0 AS w FROM pre)"
    return f"""
WITH dt AS (SELECT DISTINCT doc_id AS uuid, pos, term FROM ({analyzed_sql(DIRECTORY_SQL)}) b),
n AS (SELECT count(DISTINCT p_partkey) AS n FROM part),
df AS (SELECT term, 1 + ln(n.n / (count(DISTINCT uuid) + 1)) AS idf FROM dt CROSS JOIN n GROUP BY term, n.n),
len AS (SELECT doc_id AS uuid, count(DISTINCT pos) AS len FROM ({norm_pos_sql(DIRECTORY_SQL, 'french')}) c
        WHERE term <> '' GROUP BY doc_id),
hq AS (SELECT DISTINCT pos, term FROM ({analyzed_sql(f"(SELECT 0 AS doc_id, '{head}' AS text)")}) q),
pre AS (SELECT DISTINCT uuid FROM dt WHERE starts_with(term, 'wi')),
mt AS (SELECT DISTINCT dt.uuid, dt.term, hq.pos FROM dt JOIN hq ON dt.term = hq.term
       WHERE dt.uuid IN (SELECT uuid FROM pre)),
hs AS (SELECT mt.uuid, sum(idf * idf) AS w FROM (SELECT DISTINCT uuid, term, pos FROM mt) mt JOIN df USING (term)
       GROUP BY mt.uuid HAVING count(DISTINCT pos) = (SELECT count(DISTINCT pos) FROM hq)),
hits AS (SELECT hs.uuid, p.p_name AS name, round({score}, 6) AS score
         FROM {hits} hs JOIN len USING (uuid) JOIN part p ON p.p_partkey = hs.uuid
         ORDER BY score DESC, uuid LIMIT 1000),
nt AS (SELECT doc_id AS uuid, pos, term, {soundex_sql('term')} AS code
       FROM ({norm_pos_sql('(SELECT uuid AS doc_id, name AS text FROM hits)', 'french')}) x WHERE term <> ''),
fl AS (SELECT nt.uuid, nt.pos,
              starts_with(nt.term, 'wi') OR coalesce(starts_with(nt.code, 'wi'), false)
              OR EXISTS (SELECT 1 FROM mt WHERE mt.uuid = nt.uuid AND (mt.term = nt.term OR mt.term = nt.code)) AS f
       FROM nt),
tk AS (SELECT h.uuid, h.name, h.score, regexp_extract_all(h.name, {_q(WORD)}) AS toks,
              string_split_regex(h.name, {_q(WORD)}) AS seps FROM hits h),
parts AS (SELECT z.uuid, z.i, CASE WHEN coalesce(fl.f, false) THEN '<strong>' || toks[i] || '</strong>'
                               ELSE toks[i] END || seps[i + 1] AS piece
          FROM (SELECT uuid, toks, seps, unnest(range(1, len(toks) + 1)) AS i FROM tk) z
          LEFT JOIN fl ON fl.uuid = z.uuid AND fl.pos = z.i - 1)
SELECT tk.uuid, tk.name, tk.seps[1] || coalesce((SELECT string_agg(piece, '' ORDER BY i) FROM parts
                                                 WHERE parts.uuid = tk.uuid), '') AS name_highlight,
       tk.score, row_number() OVER (ORDER BY tk.score DESC, tk.uuid)::BIGINT AS rank
FROM tk
"""


ORACLE["prefix_search_highlight"] = search_sql("red")
ORACLE["search_stop_word_head"] = (f"SELECT *, 'stop word' AS q FROM ({search_sql('')}) x "
                                   f"UNION ALL SELECT *, 'stop word and term' AS q FROM ({search_sql('red')}) y")

ORACLE["typeahead_rank"] = """
WITH items AS (SELECT p_name AS item, min(p_partkey) AS input_order FROM part GROUP BY p_name),
f AS (SELECT *, CASE WHEN starts_with(lower(item), 'ld') THEN 0 WHEN contains(item, 'ld') THEN 1 ELSE 2 END AS bucket
      FROM items WHERE contains(lower(item), 'ld')),
t AS (SELECT * FROM f ORDER BY bucket, input_order LIMIT 8)
SELECT row_number() OVER (ORDER BY bucket, input_order)::BIGINT AS rank, item,
       regexp_replace(item, '(?i)(ld)', '<strong>\\1</strong>', 'g') AS highlighted
FROM t
"""


ORACLE["typeahead_hooks"] = """
WITH items AS (SELECT p_name AS item, min(p_partkey) AS input_order FROM part GROUP BY p_name),
t AS (SELECT *, length(item) AS bucket FROM items WHERE ends_with(item, 'e') ORDER BY length(item), input_order LIMIT 8)
SELECT row_number() OVER (ORDER BY bucket, input_order)::BIGINT AS rank, item, item[1:-2] || '[e]' AS highlighted FROM t
"""

# ---------------------------------------------------------------- keyed tables

ORACLE["upsert_latest"] = """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC,
                               event_type DESC, value DESC, props DESC) AS rn FROM events) e
WHERE rn = 1
"""
ORACLE["upsert_stream"] = ORACLE["upsert_latest"]

ORACLE["rebuild_snapshot"] = f"""
SELECT uuid, name, party, jurisdiction, 'img/thumbs/' || uuid::VARCHAR || '.jpg' AS image,
       replace(lower(name), ' ', '-') AS slug
FROM ({DEPUTIES_SQL}) d
"""


# ---------------------------------------------------------------- pages


def _url_join_sql(base: str, href: str) -> str:
    """RFC 3986 5.2 over lists: the merged path's segments, each ``..`` taking the last one kept with it."""
    absolute = "'^[A-Za-z][A-Za-z0-9+.-]*:'"
    origin = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
    whole = f"string_split({base}, '#')[1]"
    path = f"regexp_extract(substr({whole}, length({origin}) + 1), '^[^?]*')"
    folder = f"coalesce(nullif(regexp_extract({path}, '^.*/'), ''), '/')"
    own = f"regexp_extract({href}, '^[^?#]*')"
    merged = f"CASE WHEN starts_with({href}, '/') THEN {own} ELSE {folder} || {own} END"
    segments = f"string_split({merged}, '/')[2:]"
    kept = (f"list_reduce(list_prepend([]::VARCHAR[], list_transform({segments}, lambda x: [x])), "
            "lambda acc, x: CASE x[1] WHEN '.' THEN acc WHEN '..' THEN acc[:-2] ELSE list_concat(acc, x) END)")
    end = f"CASE WHEN {segments}[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END"
    return (f"CASE WHEN regexp_matches({href}, {absolute}) THEN {href} "
            f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, {absolute}) || {href} "
            f"WHEN {href} = '' THEN {whole} "
            f"WHEN starts_with({href}, '?') THEN {origin} || {path} || {href} "
            f"WHEN starts_with({href}, '#') THEN {whole} || {href} "
            f"ELSE {origin} || '/' || array_to_string({kept}, '/') || {end} || substr({href}, length({own}) + 1) END")


ORACLE["page_links"] = f"""
WITH ex AS (
  SELECT page_id, url, replace(unnest(l), '&amp;', '&') AS href, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, {_q(ANCHOR_HREF)}, 1) AS l FROM pages) p),
j AS (SELECT page_id, pos, href, {_url_join_sql('url', 'href')} AS abs_url FROM ex),
k AS (SELECT *, lower(regexp_extract(abs_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)) AS host,
             string_split(regexp_extract(abs_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/') AS segs
      FROM j)
SELECT page_id, pos::BIGINT AS pos, href, abs_url, host,
       (host = 'example.com' OR ends_with(host, '.example.com')) AS on_site,
       segs[2] AS seg1, segs[-1] AS last_seg, split_part(segs[-1], '.', 1) AS stem
FROM k
"""

ORACLE["page_frontier"] = f"""
WITH RECURSIVE p AS (SELECT DISTINCT regexp_replace(url, '#.*$', '', 's') AS url, html FROM pages WHERE url IS NOT NULL),
ex AS (SELECT url, replace(unnest(regexp_extract_all(html, {_q(ANCHOR_HREF)}, 1)), '&amp;', '&') AS href FROM p),
raw AS (SELECT DISTINCT url AS src, regexp_replace({_url_join_sql('url', 'href')}, '#.*$', '', 's') AS url FROM ex),
host AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)) AS h FROM raw),
e AS (SELECT src, url FROM host WHERE h = 'example.com' OR ends_with(h, '.example.com')),
s AS (SELECT DISTINCT url FROM p
      WHERE regexp_matches(url, '^[a-z]+://([^/?#]*[.])?example[.]com/(de|en)($|[/?])')),
r(url, depth) AS (SELECT url, 0::BIGINT FROM s UNION SELECT e.url, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 30)
SELECT r.url, min(depth) AS depth, bool_or(p.url IS NOT NULL) AS stored FROM r LEFT JOIN (SELECT DISTINCT url FROM p) p ON p.url = r.url GROUP BY r.url
"""

ORACLE["rollcall_frontier"] = f"""
WITH s AS (SELECT DISTINCT scrutiny_uuid AS k FROM ({BALLOTS_SQL}) b JOIN ({DEPUTIES_SQL}) d ON d.uuid = b.voter_uuid
           JOIN orders ON o_orderkey = scrutiny_uuid),
i AS (SELECT DISTINCT k // 40 AS part FROM s)
SELECT 'http://www.example.org/13/documents/index' || part::VARCHAR || '.asp' AS url, 0::BIGINT AS depth, true AS stored FROM i
UNION ALL SELECT 'http://www.example.org/13/documents/index' || part::VARCHAR || '.asp?copie', 0, true FROM i WHERE (part * 10) % 3 = 0
UNION ALL SELECT 'http://www.example.org/13/scrutins/jo' || k::VARCHAR || '.asp', 1, true FROM s
UNION ALL SELECT 'http://www.example.org/13/dossiers/f' || k::VARCHAR || '.asp', 1, true FROM s
"""

ORACLE["page_meta"] = f"""
WITH h AS (SELECT page_id, regexp_extract(html, {_q(HEAD_PART)}, 1) AS head FROM pages),
ex AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS pos
       FROM (SELECT page_id, regexp_extract_all(head, {_q(META_TAG)}) AS l FROM h) x),
kv AS (SELECT page_id, pos, regexp_extract(tag, '(?i)\\bname\\s*=\\s*"([^"]*)"', 1) AS name,
              regexp_extract(tag, '(?i)\\bcontent\\s*=\\s*"([^"]*)"', 1) AS content FROM ex),
last AS (SELECT page_id, name, arg_max(content, pos) AS content FROM kv WHERE name <> '' GROUP BY page_id, name),
per AS (SELECT page_id, to_json(map_from_entries(list({{'k': name, 'v': content}} ORDER BY name)))::VARCHAR AS m,
               count(*) AS n FROM last GROUP BY page_id)
SELECT p.page_id, coalesce(per.m, '{{}}') AS meta_json, coalesce(per.n, 0)::BIGINT AS n_meta
FROM pages p LEFT JOIN per USING (page_id)
"""

ORACLE["tree_xml_roundtrip"] = ORACLE["tree_numbering"]

ORACLE["random_pick"] = f"""
SELECT uuid, name, party, jurisdiction, 'img/thumbs/' || uuid::VARCHAR || '.jpg' AS image
FROM ({DEPUTIES_SQL}) d ORDER BY md5(uuid::VARCHAR || ':20'), uuid LIMIT 1
"""


def _adj_of(tree: str) -> str:
    return f"(SELECT id, parent_id, position, title, type FROM {tree})"


# The edit log of queries.TREE_EDITS, step by step (each structural step renumbers).
ORACLE["tree_edits"] = TREE_BASE + """,
mx0 AS (SELECT max(id) AS m FROM tree0),
adj_n AS (SELECT id, parent_id, position, title, type FROM tree0
          UNION ALL SELECT m + 1, 3, 0, 'new node', 'nation' FROM mx0),
adj1 AS (""" + _reseat_sql("adj_n", "(SELECT m + 1 FROM mx0)", 3, 0, "-1") + """),
adj2 AS (SELECT id, parent_id, position, CASE WHEN id = 10 THEN 'Renamed' ELSE title END AS title, type
         FROM adj1),
adj3 AS (""" + _reseat_sql("adj2", 12, 2, 99, "(SELECT parent_id FROM adj2 WHERE id = 12)") + "),\n" + \
    numbering_ctes("adj3", "tree3") + """,
src AS (SELECT d.*, row_number() OVER (ORDER BY d.level, d.id) AS r
        FROM tree3 n JOIN tree3 d ON n.id = 13 AND d.lft >= n.lft AND d.rgt <= n.rgt),
mx3 AS (SELECT max(id) AS m FROM tree3),
copies AS (SELECT (mx3.m + s.r)::BIGINT AS id,
                  CASE WHEN s.id = 13 THEN 4::BIGINT ELSE (mx3.m + p.r)::BIGINT END AS parent_id,
                  s.position, s.title, s.type
           FROM src s CROSS JOIN mx3 LEFT JOIN src p ON p.id = s.parent_id),
adj_c AS (SELECT id, parent_id, position, title, type FROM tree3 UNION ALL SELECT * FROM copies),
adj4 AS (""" + _reseat_sql("adj_c", "(SELECT m + 1 FROM mx3)", 4, 1, "-1") + "),\n" + \
    numbering_ctes("adj4", "tree4") + """,
gone AS (SELECT d.id FROM tree4 n JOIN tree4 d ON n.id = 14 AND d.lft >= n.lft AND d.rgt <= n.rgt),
kept AS (SELECT * FROM tree4 WHERE id NOT IN (SELECT id FROM gone)),
adj5 AS (SELECT id, parent_id,
                CASE WHEN parent_id = (SELECT parent_id FROM tree4 WHERE id = 14)
                     THEN (row_number() OVER (PARTITION BY parent_id ORDER BY position, id) - 1)::BIGINT
                     ELSE position END AS position, title, type FROM kept),
""" + numbering_ctes("adj5", "tree5") + "SELECT * FROM tree5"

ORACLE["tree_descendants_nested_set"] = ORACLE["tree_descendants"]


# ---------------------------------------------------------------- further reads and sinks

ORACLE["voter_history_top5"] = ORACLE["voter_history_topk"].replace("rn <= 1000", "rn <= 5")

ORACLE["deputy_page"] = f"""
SELECT h.*, d.name, d.party, d.jurisdiction, 'img/thumbs/' || d.uuid::VARCHAR || '.jpg' AS image
FROM ({ORACLE["voter_history_topk"]}) h JOIN ({DEPUTIES_SQL}) d ON d.uuid = h.voter_uuid WHERE d.uuid = 7
"""

ORACLE["term_filter_one"] = f"SELECT DISTINCT scrutiny_uuid FROM ({BALLOTS_SQL}) b WHERE voter_uuid = 7 AND vote = 'nay'"

ORACLE["scrutiny_documents"] = f"""
SELECT scrutiny_uuid, d.party AS group_name, vote,
       (row_number() OVER (PARTITION BY scrutiny_uuid, d.party, vote ORDER BY ord, voter_uuid NULLS LAST) - 1)::BIGINT AS list_pos,
       voter_uuid, strftime(o_orderdate, '%d/%m/%Y') AS date_display
FROM ({BALLOTS_SQL}) b LEFT JOIN ({DEPUTIES_SQL}) d ON d.uuid = b.voter_uuid JOIN orders ON o_orderkey = scrutiny_uuid
WHERE vote = 'yea' OR scrutiny_uuid % 2 = 0
"""

ORACLE["rollcall_pages_roundtrip"] = f"""
SELECT '13-' || scrutiny_uuid::VARCHAR AS scrutiny_uuid, 'Vote sur le texte ' || scrutiny_uuid::VARCHAR || ' - finances' AS title,
       strftime(o_orderdate, '%d/%m/%Y') AS date_display, 'Texte ' || scrutiny_uuid::VARCHAR AS info, CASE WHEN d.party = 'FRANCE' AND scrutiny_uuid % 2 = 1 THEN 'indep' ELSE lower(d.party) END AS group_key, vote,
       (row_number() OVER (PARTITION BY scrutiny_uuid, d.party, vote ORDER BY ord, d.name) - 1)::BIGINT AS ord, d.name AS voter_name
FROM ({BALLOTS_SQL}) b JOIN ({DEPUTIES_SQL}) d ON d.uuid = b.voter_uuid JOIN orders ON o_orderkey = scrutiny_uuid
"""

ORACLE["rollcall_pages_streamed"] = ORACLE["rollcall_pages_roundtrip"]

ORACLE["rollcall_scrutinies"] = f"""
WITH s AS (SELECT DISTINCT scrutiny_uuid AS k, scrutiny_uuid::VARCHAR AS n FROM ({BALLOTS_SQL}) b JOIN ({DEPUTIES_SQL}) d ON d.uuid = b.voter_uuid)
SELECT '13-' || n AS uuid, '13' AS leg, n AS num, 'Vote sur le texte ' || n || ' - finances' AS title,
       strftime(o_orderdate, '%d/%m/%Y') AS date_display, 'http://www.example.org/13/scrutins/jo' || n || '.asp' AS url,
       'Texte ' || n AS info, 'Compte rendu' AS summary,
       CASE WHEN k % 4 = 0 THEN 'Loi ' || n ELSE '' END AS law_title,
       CASE WHEN k % 4 = 0 THEN 'http://law.example/' || n ELSE '' END AS law_href,
       CASE WHEN k % 8 = 0 THEN 'http://www.example.org/13/textes/t' || n || '.asp'
            ELSE 'http://www.example.org/13/dossiers/f' || n || '.asp' END AS file_href,
       CASE WHEN k % 8 = 0 THEN 'http://www.example.org/13/textes/t' || n || '.asp' END AS strict_file_href
FROM s JOIN orders ON o_orderkey = k
"""

ORACLE["rollcall_rejects"] = f"""
WITH s AS (SELECT DISTINCT scrutiny_uuid AS k FROM ({BALLOTS_SQL}) b JOIN ({DEPUTIES_SQL}) d ON d.uuid = b.voter_uuid
           JOIN orders ON o_orderkey = scrutiny_uuid),
v AS (SELECT k, k * 10 + 2 + CASE WHEN (k * 10 + 2) % 7 = 0 THEN 1 ELSE 0 END AS page_id FROM s),
i AS (SELECT k // 40 AS part, count(*) FILTER (k % 17 = 0) AS n FROM s GROUP BY k // 40 HAVING n > 0)
SELECT page_id, 'http://www.example.org/13/scrutins/jo' || k::VARCHAR || '.asp' AS url, 'no valid date' AS reason, 1::BIGINT AS n
FROM v WHERE k % 9 = 0
UNION ALL
SELECT page_id, 'http://www.example.org/13/scrutins/jo' || k::VARCHAR || '.asp', 'heading without a group', 1
FROM v WHERE k % 13 = 0 AND k % 2 = 0
UNION ALL
SELECT part * 10, 'http://www.example.org/13/documents/index' || part::VARCHAR || '.asp', 'index row without title or link', n FROM i
UNION ALL
SELECT part * 10 + 1, 'http://www.example.org/13/documents/index' || part::VARCHAR || '.asp?copie', 'index row without title or link', n
FROM i WHERE (part * 10) % 3 = 0
"""

ORACLE["rollcall_legislatures"] = f"""
WITH s AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS leg, o_orderdate FROM orders),
l AS (SELECT leg, min(o_orderdate) AS first_day, count(*)::BIGINT AS n_scrutinies FROM s GROUP BY leg)
SELECT leg, n_scrutinies, vote, count(*)::BIGINT AS n_ballots
FROM ({BALLOTS_SQL}) b JOIN s ON o_orderkey = scrutiny_uuid JOIN l USING (leg)
WHERE first_day < TIMESTAMP '1997-06-01' GROUP BY leg, n_scrutinies, vote
"""

ORACLE["rollcall_resolved"] = f"""
WITH named AS (
  SELECT l_orderkey AS scrutiny_uuid, CASE l_returnflag WHEN 'A' THEN 'yea' WHEN 'R' THEN 'nay' ELSE 'abs' END AS vote,
         CASE WHEN l_linenumber % 5 = 0 THEN 'Nobody Zzyzx' ELSE p_name END AS voter_name
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R', 'N')),
r AS ({resolution_sql("SELECT DISTINCT p_name AS mention FROM part UNION SELECT 'Nobody Zzyzx'")})
SELECT r.uuid AS voter_uuid, vote, count(*)::BIGINT AS n_ballots, count(DISTINCT scrutiny_uuid)::BIGINT AS n_scrutinies
FROM named LEFT JOIN r ON r.mention = named.voter_name GROUP BY r.uuid, vote
"""

ORACLE["tree_children"] = TREE_BASE + """
SELECT t.id, t.position, t.title, (SELECT count(*) FROM tree0 k WHERE k.parent_id = t.id)::BIGINT AS n_children
FROM tree0 t WHERE t.parent_id = 3
"""

ORACLE["tree_subtree_sizes"] = TREE_BASE + """
SELECT a.id, count(*)::BIGINT AS n_nodes, count(*) = 1 AS leaf
FROM tree0 a JOIN tree0 d ON d.lft >= a.lft AND d.rgt <= a.rgt GROUP BY a.id
"""

ORACLE["tree_dump"] = TREE_BASE + """
SELECT lft, id, repeat('  ', level::INTEGER) || id::VARCHAR || ' (' || concat_ws(',', lft, rgt, level, parent_id, position) || ')' AS line
FROM tree0
"""

ORACLE["tree_search_with_parents"] = TREE_BASE + """
, hits AS (SELECT * FROM tree0 WHERE contains(lower(title), 'customer#00000012'))
SELECT DISTINCT t.id, t.title FROM tree0 t JOIN hits h ON t.lft <= h.lft AND t.rgt >= h.rgt
"""

ORACLE["tree_subtree"] = f"SELECT * FROM ({ORACLE['tree_descendants']}) p WHERE ancestor_id IN (2, 11)"

ORACLE["tree_localized"] = f"SELECT id, CASE WHEN id % 3 = 0 THEN 'Le ' || lower(title) ELSE title END AS title FROM ({TREE_ADJ_SQL}) a"

ORACLE["tree_edits_checked"] = TREE_BASE + """,
mx0 AS (SELECT max(id) AS m FROM tree0),
adj_n AS (SELECT id, parent_id, position, title, type FROM tree0
          UNION ALL SELECT m + 1, 3, 0, 'new node', 'nation' FROM mx0),
adj1 AS (""" + _reseat_sql("adj_n", "(SELECT m + 1 FROM mx0)", 3, 0, "-1") + """),
adj2 AS (SELECT id, parent_id, position, CASE WHEN id = 10 THEN 'Renamed' ELSE title END AS title, type FROM adj1),
adj3 AS (""" + _reseat_sql("adj2", 12, 2, 99, "(SELECT parent_id FROM adj2 WHERE id = 12)") + "),\n" + \
    numbering_ctes("adj3", "tree3") + "SELECT * FROM tree3"

ORACLE["tokens_timestamped_en"] = _tf_sql("(SELECT doc_id, text FROM documents)", "timestamped_english")

ORACLE["index_fields"] = f"""
WITH t AS (SELECT 'text' AS field, * FROM ({norm_tokens_sql("(SELECT doc_id, text FROM documents)", "general")}) a
           UNION ALL SELECT 'source' AS field, * FROM ({norm_tokens_sql("(SELECT doc_id, source AS text FROM documents)", "general")}) b),
k AS (SELECT field, doc_id, term, 'term' AS kind FROM t WHERE term <> ''
      UNION ALL SELECT field, doc_id, {soundex_sql('term')} AS term, 'phon' AS kind FROM t WHERE term <> '')
SELECT doc_id, field, term, kind, count(*)::BIGINT AS tf FROM k WHERE term IS NOT NULL GROUP BY ALL
"""

ORACLE["keyed_replace"] = """
WITH latest AS (SELECT *, event_type = 'purchase' AS late,
                       row_number() OVER (PARTITION BY user_id, event_type = 'purchase'
                                          ORDER BY ts DESC, event_id DESC, event_type DESC, value DESC, props DESC) AS rn
                FROM events WHERE event_type IN ('view', 'click', 'purchase'))
SELECT event_id, ts, user_id, event_type, value, props FROM latest l
WHERE rn = 1 AND (late OR NOT EXISTS (SELECT 1 FROM latest m WHERE m.late AND m.user_id = l.user_id))
"""

ORACLE["record_routing"] = """
SELECT CASE record_type WHEN 'page' THEN 'other' ELSE record_type END AS branch, record_type, count(*)::BIGINT AS n, sum(key)::BIGINT AS key_sum
FROM (SELECT 'deputy' AS record_type, s_suppkey AS key FROM supplier UNION ALL SELECT 'scrutiny', o_orderkey FROM orders
      UNION ALL SELECT 'page', p_partkey FROM part) r GROUP BY ALL
"""

ORACLE["result_page_json"] = f"""
SELECT to_json({{'uuid': uuid, 'name': name, 'party': party}})::VARCHAR AS value
FROM (SELECT * FROM ({DEPUTIES_SQL}) d ORDER BY name DESC, uuid LIMIT 15 OFFSET 20) p
"""


def _positions_sql(field: str, where: str) -> str:
    """(doc_id, pos, term) of the general analyzer, positions counted over all tokens."""
    return f"""SELECT doc_id, pos, {fold_sql('lower(tok)')} AS term FROM (
      SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM (
        SELECT doc_id, regexp_extract_all({field}, {_q(WORD)}) AS l FROM documents WHERE {where}) x) y"""


ORACLE["index_upserts"] = f"""
WITH t AS (SELECT 'text' AS field, * FROM ({_positions_sql('text', 'doc_id % 10 <> 1')}) a
           UNION ALL SELECT 'source', * FROM ({_positions_sql('source', 'doc_id % 10 <> 1')}) b)
SELECT field, term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS occurrences FROM t WHERE term <> '' GROUP BY field, term
"""

ORACLE["index_phrase"] = f"""
WITH t AS (SELECT * FROM ({_positions_sql('text', 'doc_id % 10 <> 1')}) a WHERE term IN ('de', 'la')),
n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 10 <> 1),
hits AS (SELECT a.doc_id, count(*)::BIGINT AS hits FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
         WHERE a.term = 'de' AND b.term = 'la' GROUP BY a.doc_id),
dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term)
SELECT doc_id AS uuid, hits, round(sum(tf * ln(n.n / df)), 6) AS score
FROM hits JOIN tf USING (doc_id) JOIN dfs USING (term), n GROUP BY doc_id, hits
"""

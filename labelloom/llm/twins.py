"""The operators that SQL can express, as SQL of their own for the check."""

from __future__ import annotations

from labelloom.llm import manifest, topk, turns

TOP_K_SQL = f"""
WITH known AS (
  SELECT vec_id, row_number() OVER () AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scaled AS (SELECT vec_id, n, list_transform(v, lambda x: floor({topk.SCALE} * x)) AS v FROM known),
scored AS (
  SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.n <> c.n WHERE q.vec_id % {topk.EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY n ORDER BY score DESC, vec_id) QUALIFY rank <= {topk.K}
"""

# The CRC-32 of a text of ASCII characters: a table of all bytes, eight steps each, then a fold.
CRC_REMAINDERS = 3988292384  # fixed value: the polynomial of CRC-32, reversed
CRC_ONES = 4294967295
_STEPS = "\n".join(
    f", crc{i + 1} AS (SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC_REMAINDERS}) ELSE c >> 1 END AS c FROM crc{i})" for i in range(8)
)
SQL_CRC = f"crc0 AS (SELECT range AS b, range AS c FROM range(256)){_STEPS}, crc AS (SELECT list(c ORDER BY b) AS remainders FROM crc8)"


def sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII text, beside the one row of ``crc``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT))"
    step = "xor(acc >> 8, remainders[CAST((xor(acc, code) & 255) + 1 AS INTEGER)])"
    return f"xor(list_reduce(list_prepend(CAST({CRC_ONES} AS BIGINT), {codes}), lambda acc, code: {step}), {CRC_ONES})"


#: Levels that the SQL twin unfolds: FANOUT ** 6 documents a source, and as many sources.
LEVELS = 6


def _sql_field(name: str, value: str | None = None) -> str:
    text = f"CAST({value or name} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _sql_tree(name: str, by: str) -> str:
    """Levels ``name``0.. over (by, i, digest), with the siblings of each node; ``by`` names one tree."""
    out = []
    for k in range(LEVELS):
        part = f"(PARTITION BY {by}, i // {manifest.FANOUT} ORDER BY i ROWS BETWEEN {{}} AND {{}})"
        before, after = part.format("UNBOUNDED PRECEDING", "1 PRECEDING"), part.format("1 FOLLOWING", "UNBOUNDED FOLLOWING")
        out.append(
            f"""{name}{k}s AS (
  SELECT {by}, i, digest, n, coalesce(string_agg(digest, '') OVER {before}, '') AS l, coalesce(string_agg(digest, '') OVER {after}, '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {name}{k}))"""
        )
        if k + 1 < LEVELS:
            out.append(
                f"""{name}{k + 1} AS (
  SELECT {by}, i // {manifest.FANOUT} AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM {name}{k}s WHERE n > 1 GROUP BY ALL)"""
            )
    return ",\n".join(out)


def _sql_top(name: str, by: str) -> str:
    return " UNION ALL ".join(f"SELECT {by}, digest FROM {name}{k}s WHERE n = 1" for k in range(LEVELS))


def _sql_fold(rows: str, name: str, by: str, at: str) -> str:
    """Columns proof and folded of ``rows`` carried up the tree ``name``."""
    for k in range(LEVELS):
        rows = f"""(SELECT x.* EXCLUDE (proof, folded), proof || coalesce(t.l || t.r, '') AS proof,
  CASE WHEN t.i IS NULL THEN folded ELSE sha256(t.l || folded || t.r) END AS folded
  FROM {rows} x LEFT JOIN {name}{k}s t ON t.{by} = x.{by} AND t.i = x.{at} // {manifest.FANOUT**k} AND t.n > 1)"""
    return rows


_LEAF = " || ".join(map(_sql_field, manifest.FIELDS))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NOW = " || ".join(_sql_field(f, _LOWERED if f == "text" else None) for f in manifest.FIELDS)
MANIFEST_SQL = f"""
WITH {SQL_CRC},
hashed AS (
  SELECT doc_id, source, sha256({_LEAF}) AS digest,
         CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({_NOW}) END AS now
  FROM documents, crc),
named AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS i FROM hashed),
low0 AS (SELECT s, i, digest FROM named),
{_sql_tree("low", "s")},
subroots AS ({_sql_top("low", "s")}),
high0 AS (SELECT 0 AS whole, s AS i, digest FROM subroots),
{_sql_tree("high", "whole")},
top AS ({_sql_top("high", "whole")}),
leaves AS (SELECT doc_id, digest AS leaf, s, i, 0 AS whole, coalesce(now, digest) AS folded, '' AS proof FROM named),
audited AS (SELECT * FROM {_sql_fold(_sql_fold("leaves", "low", "s", "i"), "high", "whole", "s")})
SELECT doc_id, leaf, subroots.digest AS subroot, top.digest AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = top.digest AS verified
FROM audited JOIN subroots USING (s) JOIN top USING (whole)
"""

TRIE_SQL = f"""
WITH {SQL_CRC},
lines AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
marked AS (SELECT conv_id, turn, md5(strlen(role) || ':' || role || text) AS h, strlen(text) AS n FROM lines),
own AS (SELECT conv_id, list({{'h': h, 'n': n}} ORDER BY turn NULLS FIRST, h) AS turns FROM marked GROUP BY conv_id),
cut AS (SELECT *, conv_id - conv_id % {turns.SIBLINGS} AS base, {sql_crc32("CAST(conv_id AS VARCHAR)")} % {turns.MOST_SHARED + 1} AS h FROM own, crc),
built AS (
  SELECT cut.conv_id, list_concat(coalesce(list_slice(heads.turns, 1, cut.h), []), list_slice(cut.turns, cut.h + 1, len(cut.turns))) AS turns
  FROM cut LEFT JOIN own heads ON heads.conv_id = cut.base),
prefixes AS (SELECT conv_id, len(turns) AS size, turns, unnest(range(len(turns) + 1)) AS depth FROM built),
members AS (SELECT conv_id, size, depth, list_slice(turns, 1, depth) AS key FROM prefixes),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN nodes.depth > 0 THEN (n_convs - 1) * nodes.key[-1].n ELSE 0 END AS saved
  FROM nodes LEFT JOIN children ON children.depth = nodes.depth AND children.key = nodes.key),
spread AS (SELECT key AS whole, n_children, saved, unnest(range(depth + 1)) AS depth FROM counted),
below AS (
  SELECT depth, list_slice(whole, 1, depth) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM spread GROUP BY ALL)
SELECT counted.conv_id, counted.depth, up.conv_id AS parent_conv_id, counted.n_convs, counted.n_children, n_leaves, saved_tokens, counted.ends_sha256
FROM counted JOIN below ON below.depth = counted.depth AND below.key = counted.key
LEFT JOIN nodes up ON counted.depth > 0 AND up.depth = counted.depth - 1 AND up.key = list_slice(counted.key, 1, counted.depth - 1)
"""

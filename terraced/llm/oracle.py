"""The queries' results in SQL, where SQL can express them."""

from __future__ import annotations

from terraced.llm.url_rules import HOST_RULES, PATTERNS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_rules() -> str:
    hosts = ", ".join(f"({_quoted(r.name)}, {_quoted(r.verdict)}, {_quoted(r.pattern)})" for r in HOST_RULES)
    general = ", ".join(f"({_quoted(r.name)}, {_quoted(r.verdict)}, {_quoted(r.pattern)})" for r in PATTERNS)
    return f"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r, row_number() OVER () AS seat
  FROM pages
), parts AS (
  SELECT page_id, url, seat,
    translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), hosts AS (
  SELECT seat, arg_max(name, length(name)) AS name, arg_max(verdict, length(name)) AS verdict
  FROM parts JOIN (VALUES {hosts}) AS r(name, verdict, pattern) ON regexp_matches(host || path, pattern)
  GROUP BY seat
), general AS (
  SELECT seat, min(verdict || ' ' || name) AS best
  FROM parts JOIN (VALUES {general}) AS r(name, verdict, pattern)
    ON regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern)
  GROUP BY seat
)
SELECT page_id, host, path, hosts.name AS rule,
  coalesce(hosts.verdict, split_part(best, ' ', 1), 'allow') AS verdict,
  CASE WHEN hosts.name IS NULL THEN split_part(best, ' ', 2) END AS pattern
FROM parts LEFT JOIN hosts USING (seat) LEFT JOIN general USING (seat)
"""


def _codes(rounds: int = 6) -> str:
    """Lloyd rounds one by one. Sums stay far below 2^53 on the given vectors, so doubles floor exactly."""

    def assigned(books: str) -> str:
        return f"""
  SELECT vec_id, label, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
    SELECT p.vec_id, p.label, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS far
    FROM pieces p JOIN {books} b ON p.part = b.part AND p.place = b.place GROUP BY ALL
  ) GROUP BY ALL"""

    steps = ""
    for turn in range(rounds):
        steps += f""", a{turn} AS MATERIALIZED ({assigned(f"b{turn}")}
), b{turn + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM b{turn} b LEFT JOIN (
    SELECT a.part, a.entry, p.place, CAST(floor(sum(p.x) / count(*)) AS BIGINT) AS x
    FROM a{turn} a JOIN pieces p ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY ALL
  ) m USING (part, entry, place)
)"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbers AS (
  SELECT vec_id, label, CAST(len(embedding) / 8 AS BIGINT) AS width, CAST(floor(4096 * unnest(embedding)::DOUBLE) AS BIGINT) AS x,
    generate_subscripts(embedding, 1) - 1 AS seat FROM kept
), pieces AS MATERIALIZED (
  SELECT vec_id, label, CAST(floor(seat / width) AS BIGINT) AS part, seat % width AS place, x FROM numbers
), b0 AS MATERIALIZED (
  SELECT part, place, x, f.entry FROM pieces JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16
  ) f USING (vec_id)
){steps}, last AS MATERIALIZED ({assigned(f"b{rounds}")}
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM last GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""


def _trie() -> str:
    """Prefixes as lists; the checksum bit by bit, since DuckDB has no crc32."""
    byte_steps = "list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0])))"
    step = "lambda s, x: xor(xor(s, x) >> 1, CASE WHEN xor(s, x) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), told AS (
  SELECT c, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS said FROM turns GROUP BY c
), checks AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(CAST({byte_steps} AS BIGINT[]), {step}), 4294967295) % 4 AS h FROM told
), whole AS MATERIALIZED (
  SELECT k.c, list_concat(coalesce(b.said[1:k.h], []), o.said[k.h + 1:]) AS path
  FROM checks k JOIN told o ON o.c = k.c LEFT JOIN told b ON b.c = k.base
), members AS (
  SELECT c, unnest(range(0, len(path) + 1)) AS depth, path FROM whole
), nodes AS MATERIALIZED (
  SELECT depth, path[1:depth] AS prefix, min(c) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN len(path) = depth THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
  FROM members GROUP BY 1, 2
), counted AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].t, '[^\x20\x09-\x0D]+')) END AS own
  FROM nodes
), children AS (
  SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), each AS (
  SELECT n.*, coalesce(k.n, 0) AS kids FROM counted n LEFT JOIN children k ON n.depth = k.depth AND n.prefix = k.prefix
), below AS (
  SELECT unnest(range(0, depth + 1)) AS depth, prefix, own, kids FROM each
), sums AS (
  SELECT depth, prefix[1:depth] AS prefix, sum(own) AS saved, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves FROM below GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM each n JOIN sums s ON s.depth = n.depth AND s.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""


ORACLE = {"op5_url_rules": _url_rules(), "op11_dual_tree_codes": _codes(), "op13_prefix_trie": _trie()}

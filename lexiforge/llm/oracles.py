"""SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import secrets, urlfilter
from .common import WORD

MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, source IS NULL, source) AS place, (budget - (sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS UNBOUNDED PRECEDING) - cap)) / (sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS UNBOUNDED PRECEDING) + weight) AS here FROM r),
g AS (SELECT arg_min(here, place) FILTER (here <= ratio) AS level FROM l),
t AS (SELECT source, source_size, budget, CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE level * weight END AS target FROM l, g),
o AS (SELECT d.doc_id, d.size, md5('7:' || d.doc_id) AS h, t.source_size, t.target, t.budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('7:' || d.doc_id), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY (cum + pass * source_size) / target, h, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS spent FROM o, (VALUES (0), (1)) p(pass) WHERE size > 0 AND target > 0),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM i WHERE spent <= budget GROUP BY doc_id)
SELECT o.doc_id, o.size, o.source_size, o.target, coalesce(k.taken, 0) AS taken FROM o LEFT JOIN k USING (doc_id)
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS x FROM d)),
g AS (SELECT doc_id, pos, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM f) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS x FROM d)),
m AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth, array_to_string(regexp_extract_all(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{WORD}'), ' ') AS norm FROM l),
dup AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n FROM m WHERE words > 0 GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT text) AS n_host FROM d GROUP BY source),
c AS (SELECT m.source, norm FROM m JOIN h ON h.source IS NOT DISTINCT FROM m.source WHERE words > 0 GROUP BY m.source, norm, n_host HAVING count(DISTINCT m.text) > 1000 OR (count(DISTINCT m.text) > 3 AND count(DISTINCT m.text) > n_host * 0.1)),
gone AS (SELECT doc_id, sum(words)::BIGINT AS n_words, count(*) AS n_lines FROM m JOIN c ON c.norm = m.norm AND c.source IS NOT DISTINCT FROM m.source WHERE words > 0 GROUP BY doc_id),
b AS (SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
a AS (SELECT b.*, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n_words, 0) AS n_common_words, coalesce(gone.n_lines, 0) AS n_common_lines FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_common_words >= n_words * 0.5 AS kept FROM a
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.least, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""


def _found(kind: str, rank: int, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, m[i] AS value, v[i] AS part, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}', {group}) AS v FROM d WHERE regexp_matches(text, '{p}')))"""


def _entropy(value: str, window: int) -> str:
    counted = f"list_transform(list_distinct(string_split(substring({value}, i, {window}), '')), lambda c: length(substring({value}, i, {window})) - length(replace(substring({value}, i, {window}), c, '')))"
    return f"list_min(list_transform(range(1, length({value}) - {window - 2}), lambda i: list_sum(list_transform({counted}, lambda n: n * log2(n)))))"


def _secrets() -> str:
    import math

    (hex_kind, hex_whole, _, hex_window, hex_least), (any_kind, _, _, any_window, any_least) = secrets.CLASSES
    limit = lambda window, least: (math.log2(window) - least) * window + 1e-9
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_found("assign", 0, secrets.ASSIGN, 2)} UNION ALL {_found("access", 1, secrets.ACCESS)} UNION ALL {_found("hex", 2, secrets.HEX)}),
b AS (SELECT doc_id, kind, rank, start, start + length(value) AS stop FROM base WHERE kind <> 'assign' OR length(part) >= {secrets.ASSIGN_LEAST}),
c AS ({_found("candidate", 3, secrets.CANDIDATE)}),
f AS (SELECT *, regexp_matches(value, '{hex_whole}') AS hex FROM c WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{secrets.ALLOW}')
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.start < c.start + length(c.value) AND c.start < b.stop)),
e AS (SELECT doc_id, CASE WHEN hex THEN '{hex_kind}' ELSE '{any_kind}' END AS kind, CASE WHEN hex THEN 3 ELSE 4 END AS rank, start, start + length(value) AS stop FROM f
      WHERE CASE WHEN hex THEN {_entropy("lower(value)", hex_window)} <= {limit(hex_window, hex_least)} ELSE {_entropy("value", any_window)} <= {limit(any_window, any_least)} END),
n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM b GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)
"""


SECRETS = _secrets()


def _field(x: str) -> str:
    return f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')"


_HEAD = " || ".join(_field(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"))
#: Lowest bit of crc32 of the id: eight shifts for each byte of its decimal form.
_EVEN = "(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) & 1) = 1"

MERKLE = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {_EVEN} THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents),
h AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_HEAD} || {_field("text")}) AS leaf, sha256({_HEAD} || {_field("tampered")}) AS found FROM d),
leaf AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM h),
node(tree, n, lvl, idx, digest) AS (SELECT tree, n, 0, idx, leaf FROM leaf UNION ALL SELECT tree, (n + 2) // 3, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY tree, n, lvl, idx // 3),
sub AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
top(n, lvl, idx, digest) AS (SELECT n, 0, idx, digest FROM sub UNION ALL SELECT (n + 2) // 3, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY n, lvl, idx // 3),
every AS (SELECT tree, lvl, idx, digest FROM node WHERE n > 1 UNION ALL SELECT sub.tree, 1000 + top.lvl, top.idx, top.digest FROM top, sub WHERE top.n > 1),
path AS (SELECT r, tree, lvl, idx // (3 ** lvl)::BIGINT AS idx FROM leaf JOIN (SELECT DISTINCT tree, lvl FROM node WHERE n > 1) USING (tree)
  UNION ALL SELECT r, tree, 1000 + t.lvl, sub.idx // (3 ** t.lvl)::BIGINT FROM leaf JOIN sub USING (tree), (SELECT DISTINCT lvl FROM top WHERE n > 1) t),
sib AS (SELECT p.r, p.lvl, coalesce(string_agg(e.digest, '' ORDER BY e.idx) FILTER (e.idx < p.idx), '') AS lo, coalesce(string_agg(e.digest, '' ORDER BY e.idx) FILTER (e.idx > p.idx), '') AS hi
  FROM path p JOIN every e ON e.tree = p.tree AND e.lvl = p.lvl AND e.idx // 3 = p.idx // 3 GROUP BY p.r, p.lvl),
step AS (SELECT r, list(lo || '|' || hi ORDER BY lvl) AS steps, string_agg(lo || hi, '' ORDER BY lvl) AS proof FROM sib GROUP BY r),
f AS (SELECT doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce(list_prepend(found, coalesce(steps, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root FROM leaf JOIN sub USING (tree) LEFT JOIN step USING (r))
SELECT *, folded_root = root AS verified FROM f
"""

_TERMS = {k: "[" + ", ".join(f"'{t}'" for t in terms) + "]" for k, terms in (("strict", urlfilter.STRICT), ("soft", urlfilter.SOFT))}
_HITS = {k: f"len(list_filter({terms}, lambda t: contains(words, ' ' || t || ' ')))" for k, terms in _TERMS.items()}
_LOWER = f"'{urlfilter.UPPER}', '{urlfilter.LOWER}'"

URL_FILTER = rf"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, translate(coalesce(url, ''), {_LOWER}) AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
w AS (SELECT *, ' ' || regexp_replace(u, '[^\p{{L}}\p{{N}}]', ' ', 'g') || ' ' AS words FROM p),
h AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {_HITS["strict"]} AS n_strict, {_HITS["soft"]} AS n_soft FROM w),
rules(v, rh, rp) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urlfilter.RULES)}),
best AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN n_strict > 0 OR n_soft > 1 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM h LEFT JOIN best USING (r)
"""

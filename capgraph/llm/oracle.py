"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, CAST(score AS BIGINT) AS score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""

_WORDS = r"""
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)"""

SUBSTRINGS = f"""
WITH {_WORDS},
win AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 19], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, CAST(len(words) AS BIGINT) - 18)) AS pos FROM w WHERE len(words) >= 20)),
rep AS (SELECT doc_id, pos FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM rep),
g AS (SELECT doc_id, list(pos) AS gone_at FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone_at), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone_at IS NULL THEN array_to_string(words, ' ')
                   ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone_at, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)"""

NEAR = f"""
WITH RECURSIVE {_WORDS},
sh AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + least(5, len(words)) - 1], ' ') AS s
       FROM (SELECT doc_id, words, unnest(range(1, CAST(greatest(len(words) - 4, 1) AS BIGINT) + 1)) AS pos
             FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b USING (s)
         WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
         WHERE 10 * k >= 8 * (a.n + b.n - k)
         UNION ALL SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.doc_id <> b.doc_id
         WHERE len(a.words) = 0 AND len(b.words) = 0),
reach(doc_id, label) AS (SELECT doc_id, doc_id FROM w
                         UNION SELECT y, label FROM reach JOIN link ON x = reach.doc_id WHERE label < y)
SELECT w.doc_id, (SELECT min(label) FROM reach r WHERE r.doc_id = w.doc_id) AS class_id,
       (SELECT count(*) FROM link WHERE x = w.doc_id) AS n_links
FROM w"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: Levels go up one at a time; a node's path is kept as its run's others, level by level.
MERKLE = f"""
WITH RECURSIVE crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
leaves AS (SELECT d.doc_id, lang, {_leaf('text')} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents d LEFT JOIN crc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
level(lang, h, pos, node, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed
  UNION ALL
  SELECT DISTINCT lang, h + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos) OVER run), (n + 7) // 8 FROM level WHERE n > 1
  WINDOW run AS (PARTITION BY lang, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM level WHERE n = 1),
top(h, pos, node, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT DISTINCT h + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos) OVER run), (n + 7) // 8 FROM top WHERE n > 1
  WINDOW run AS (PARTITION BY pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
lower_others AS (SELECT a.lang, a.h, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos), '') AS others,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM level a LEFT JOIN level b ON a.lang IS NOT DISTINCT FROM b.lang AND a.h = b.h AND a.pos // 8 = b.pos // 8 AND a.pos <> b.pos WHERE a.n > 1 GROUP BY ALL),
upper_others AS (SELECT a.h, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos), '') AS others,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM top a LEFT JOIN top b ON a.h = b.h AND a.pos // 8 = b.pos // 8 AND a.pos <> b.pos WHERE a.n > 1 GROUP BY ALL),
up(doc_id, lang, leaf, h, pos, folded, proof) AS (
  SELECT doc_id, lang, leaf, 0, pos, coalesce(changed, leaf), '' FROM placed
  UNION ALL
  SELECT doc_id, u.lang, leaf, u.h + 1, u.pos // 8, sha256(before || folded || after), proof || others
  FROM up u JOIN lower_others o ON u.lang IS NOT DISTINCT FROM o.lang AND u.h = o.h AND u.pos = o.pos),
sub AS (SELECT u.doc_id, u.leaf, u.folded, u.proof, s.subroot, s.pos FROM up u JOIN level l ON u.lang IS NOT DISTINCT FROM l.lang AND u.h = l.h AND u.pos = l.pos AND l.n = 1
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM u.lang),
above(doc_id, leaf, subroot, h, pos, folded, proof) AS (
  SELECT doc_id, leaf, subroot, 0, pos, folded, proof FROM sub
  UNION ALL
  SELECT doc_id, leaf, subroot, u.h + 1, u.pos // 8, sha256(before || folded || after), proof || others
  FROM above u JOIN upper_others o ON u.h = o.h AND u.pos = o.pos)
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM above u JOIN top t ON t.n = 1 AND u.h = t.h"""

RANKED = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS row FROM documents),
n AS (SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n FROM w WHERE len(words) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
post AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM w) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post, total GROUP BY term, docs),
items AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM items JOIN weight USING (term) JOIN post USING (term) JOIN n USING (row), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER best <= 20"""

#: A key as 30 hexadecimal digits; cells are its beginnings of 2, 4, ... digits.
SHARDS = """
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, encode(coalesce(text, '')) AS body,
    substr(md5(coalesce(text, '')), 1, 14) || CASE WHEN doc_id IS NULL THEN '0000000000000000'
      WHEN doc_id >= 0 THEN printf('%x', 8 + doc_id // 1152921504606846976) || printf('%015x', doc_id % 1152921504606846976) END AS k FROM documents),
target AS (SELECT s, CAST(s * total // 8 AS BIGINT) AS target, CAST(floor(0.001 * total / 8) AS BIGINT) AS allowed
  FROM (SELECT CAST(sum(size) AS BIGINT) AS total FROM d), range(1, 8) t(s)),
cells AS (SELECT r, substr(k, 1, CAST(2 * r AS BIGINT)) AS cell, sum(size) AS bytes, count(*) AS n FROM d, range(1, 16) t(r) GROUP BY ALL),
edges AS (SELECT *, sum(bytes) OVER (PARTITION BY r ORDER BY cell) - bytes AS below FROM cells),
met AS (SELECT s, r, cell, target - below <= below + bytes - target AS at_start FROM target JOIN edges ON below <= target AND target < below + bytes
  WHERE least(target - below, below + bytes - target) <= allowed OR n = 1 OR r = 15),
cut AS (SELECT s, arg_min(cell, r) AS cell, arg_min(at_start, r) AS at_start FROM met GROUP BY s),
placed AS (SELECT d.*, (SELECT count(*) FROM cut WHERE CASE WHEN at_start THEN k >= cell ELSE substr(k, 1, len(cell)) > cell END) AS shard FROM d),
step AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, -1, -1, -1, -1, -1, -1, -1, -1],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) b(i))),
crc AS (SELECT body, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, CAST(octet_length(body) AS BIGINT) + 1),
    lambda i: CAST('0x' || substr(hex(body), 2 * i - 1, 2) AS BIGINT))), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS crc
  FROM (SELECT DISTINCT body FROM d), step)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY k) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN crc USING (body)"""

"""DuckDB SQL for the registered queries that SQL can express."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_LINKED = """
reach(id, other) AS (
  SELECT a, a FROM ids
  UNION
  SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.other = l.a
),
parts AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
ids AS (SELECT doc_id AS a FROM documents),
{_LINKED}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, component = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN parts p ON p.id = d.doc_id
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

BENCHMARK_OVERLAP = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)
),
hits AS (SELECT doc_id, i, x.n, item FROM grams x JOIN windows y ON x.n = y.n AND x.g = y.g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

MAXIMAL_CHATS = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM turns
),
prefixes AS (
  SELECT *, string_agg(to_json({'r': role, 't': text}), '') OVER (PARTITION BY conv_id ORDER BY pos) AS sofar FROM placed
),
ends AS (SELECT sofar, n, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE pos = n GROUP BY sofar, n),
kept AS (SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.sofar = e.sofar AND p.pos = e.n AND p.pos < p.n))
SELECT p.conv_id, CAST((p.pos - 1) // 256 AS BIGINT) AS part, CAST(ceil(p.n / 256) AS BIGINT) AS n_parts, p.n AS n_turns, k.copies,
       string_agg(p.line, '' ORDER BY p.pos) AS text
FROM placed p JOIN kept k ON p.conv_id = k.conv_id GROUP BY p.conv_id, (p.pos - 1) // 256, p.n, k.copies
"""

NEAR_VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9
),
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
ids AS (SELECT vec_id AS a FROM embeddings),
{_LINKED}
SELECT v.vec_id, coalesce(n, 0) AS n_links, component AS component_id, component = v.vec_id AS kept
FROM embeddings v LEFT JOIN counts c ON c.id = v.vec_id JOIN parts p ON p.id = v.vec_id
"""

#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(
  list_transform(string_split({key}, ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda crc, byte: list_reduce(range(8), lambda bits, i: CASE WHEN bits & 1 = 1 THEN xor(bits >> 1, 3988292384) ELSE bits >> 1 END, xor(crc, byte)),
  CAST(4294967295 AS BIGINT)
), 4294967295)"""

REPAIRED_CHATS = f"""
WITH RECURSIVE faults AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format(key="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations
),
rows AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM faults, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM rows
),
faulty AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed
),
inserts(state, letters, lines, reached) AS (
  VALUES (0, '', '', 0), (1, '', '', 1), (2, '', '', 2), (3, '', '', 3), (0, 'I', 'u', 2), (1, 'I', 'u', 2), (2, 'I', 'a', 3), (3, 'I', 'u', 2),
         (0, 'II', 'ua', 3), (1, 'II', 'ua', 3), (2, 'II', 'au', 2), (3, 'II', 'ua', 3)
),
steps(initial, state, reached) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edits AS (
  SELECT f.conv_id, f.i, s.state, s.reached AS state_after, 2 * len(s.letters) + 3 AS cost, s.letters || 'D' AS letters, s.lines, NULL AS line
  FROM faulty f, inserts s
  UNION ALL
  SELECT f.conv_id, f.i, s.state, p.reached, 2 * len(s.letters) + (f.fault = 'truncated')::INT, s.letters || 'K', s.lines, f.role || ':' || f.text
  FROM faulty f, inserts s JOIN steps p ON p.state = s.reached WHERE left(f.role, 1) = p.initial AND f.fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.conv_id, f.i, s.state, p.reached, 2 * len(s.letters) + 2 + (f.fault = 'truncated')::INT, s.letters || 'R', s.lines,
         CASE p.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text
  FROM faulty f, inserts s JOIN steps p ON p.state = s.reached AND p.initial <> 's' WHERE f.fault NOT IN ('blank', 'duplicate')
),
edges AS (
  SELECT conv_id, i, state, state_after, cost, letters,
         list_concat(list_transform(string_split(lines, ''), lambda c: CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END),
                     CASE WHEN line IS NULL THEN [] ELSE [line] END) AS lines
  FROM (SELECT * REPLACE (CASE lines WHEN '' THEN NULL ELSE lines END AS lines) FROM edits)
),
paths(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} FROM rows
  UNION ALL
  SELECT p.conv_id, p.i + 1, e.state_after, min({{
    'cost': CAST(p.best.cost + e.cost AS BIGINT), 'audit': p.best.audit || e.letters, 'lines': list_concat(p.best.lines, coalesce(e.lines, []))
  }})
  FROM paths p JOIN edges e ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = p.i + 1 AND e.state = p.state GROUP BY ALL
),
sizes AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
ends AS (
  SELECT p.conv_id, min({{
    'cost': CAST(p.best.cost + 2 * len(s.letters) AS BIGINT), 'audit': p.best.audit || s.letters,
    'lines': list_concat(p.best.lines, CASE s.lines WHEN '' THEN [] WHEN 'a' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END)
  }}) AS best
  FROM paths p JOIN sizes z ON p.conv_id IS NOT DISTINCT FROM z.conv_id AND p.i = z.n JOIN inserts s ON p.state = s.state
  WHERE s.reached = 3 OR (s.reached = 0 AND p.state = 0) GROUP BY p.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sizes z ON c.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

TOP_VECTORS = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(256 * c) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, q.place, v.vec_id, v.place AS other,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i])), 0) AS BIGINT) AS score
  FROM vectors q JOIN vectors v ON q.place <> v.place AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST, other) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST, other) <= 5
"""

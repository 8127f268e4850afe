"""SQL that gives the rows of training-data queries, where SQL can express them."""

CODE_ROUND = """near{k} AS MATERIALIZED (SELECT s.p, s.vec_id, s.label, s.x, min(list_sum(list_transform(range(1, len(s.x) + 1), lambda i: (s.x[i] - b.x[i]) * (s.x[i] - b.x[i])))::BIGINT * 64 + b.e) AS m
 FROM parts s JOIN books{k} b ON s.p = b.p GROUP BY ALL)"""
CODE_BOOKS = """sums{k} AS (SELECT p, m % 64 AS e, i, sum(x[i])::BIGINT AS t, count(*) AS n FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY ALL),
 means{k} AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS x FROM sums{k} GROUP BY ALL),
 books{next} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM books{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)"""

VECTOR_CODES = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) AS x FROM kept, range(16) g(p)),
 books0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
 {CODE_ROUND.format(k=0)}, {CODE_BOOKS.format(k=0, next=1)}, {CODE_ROUND.format(k=1)}, {CODE_BOOKS.format(k=1, next=2)}, {CODE_ROUND.format(k=2)},
 codes AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM near2 GROUP BY ALL),
 digest AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(x)::VARCHAR AS c, generate_subscripts(x, 1) AS i FROM books2))
 SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes, digest"""

# crc32 by its polynomial, bit by bit; a path's rows as a list of lines; up to two inserted rows before each edit and at the end
CONVERSATION_REPAIR = r"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS kind FROM conversations),
 hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, range(2) g(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
 bare AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS tail, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt),
 marked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM bare),
 faults AS MATERIALIZED (SELECT * EXCLUDE (tail, again), CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM marked),
 counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
 inserts(a, b, more, edits, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']),
  (2, 3, 2, 'I', ['assistant:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
 moves(edit, a, b, initial, named, more) AS (VALUES ('D', 0, 0, NULL, NULL, 3), ('D', 1, 1, NULL, NULL, 3), ('D', 2, 2, NULL, NULL, 3), ('D', 3, 3, NULL, NULL, 3), ('K', 0, 1, 's', NULL, 0), ('K', 0, 2, 'u', NULL, 0), ('K', 1, 2, 'u', NULL, 0),
  ('K', 2, 3, 'a', NULL, 0), ('K', 3, 2, 'u', NULL, 0), ('K', 0, 0, '', NULL, 0), ('K', 1, 1, '', NULL, 0), ('K', 2, 2, '', NULL, 0), ('K', 3, 3, '', NULL, 0),
  ('R', 0, 2, NULL, 'user', 2), ('R', 1, 2, NULL, 'user', 2), ('R', 3, 2, NULL, 'user', 2), ('R', 2, 3, NULL, 'assistant', 2)),
 paths AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, p.pos + 1, m.b, min({'cost': p.best.cost + i.more + m.more + CASE WHEN m.edit <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': p.best.audit || i.edits || m.edit,
    'lines': p.best.lines || i.lines || CASE m.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [m.named || ':' || f.text] END})
  FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1 JOIN inserts i ON i.a = p.state JOIN moves m ON m.a = i.b AND (m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
   AND (m.initial IS NULL OR m.initial = left(f.role, 1)) GROUP BY p.conv_id, p.pos, m.b),
 done AS (SELECT p.conv_id, min({'cost': p.best.cost + i.more, 'audit': p.best.audit || i.edits, 'lines': p.best.lines || i.lines}) AS best
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.pos JOIN inserts i ON i.a = p.state AND i.b IN (0, 3) GROUP BY p.conv_id)
 SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id"""

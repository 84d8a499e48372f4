"""The checking SQL of the queries that SQL can express."""

OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, least(len(w), 13) AS n,
         array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT DISTINCT row, i, g.n, item FROM grams g JOIN windows x ON g.n = x.n AND g.phrase = x.phrase),
hits AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM found) GROUP BY row),
items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS drawn
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM r),
o AS (
  SELECT *, row_number() OVER filling AS nth,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM w
  WINDOW filling AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST),
         before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size * weight_left <= words_left * weight AS is_full FROM o),
rate AS (SELECT words_left AS rw, weight_left AS rl FROM f WHERE NOT is_full ORDER BY nth LIMIT 1),
t AS (
  SELECT f.*, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE (weight * rw)::DOUBLE / rl::DOUBLE END AS target
  FROM f LEFT JOIN rate ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY drawn, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT p.doc_id, p.size, e.source_size::BIGINT AS source_size, e.target,
       (p.size * (e.epochs + CASE WHEN p.upto - p.size / 2.0 < e.target - e.epochs * e.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *,
    4 * (length(text) - length(replace(text, '&', '')))
    + 3 * ((length(text) - length(replace(text, '<s>', ''))) / 3
           + (length(text) - length(replace(text, '</s>', ''))) / 4
           + (length(text) - length(replace(text, '<sep>', ''))) / 5)
    + 4 * ((length(text) - length(replace(text, '[INST]', ''))) / 6
           + (length(text) - length(replace(text, '[/INST]', ''))) / 7) AS added,
    lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (
  SELECT *,
    length(text) + added
    + CASE WHEN before IS NOT DISTINCT FROM role THEN 7 ELSE 4 + length(role) + CASE WHEN role = 'user' THEN 7 ELSE 0 END END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 5 + CASE WHEN role = 'user' THEN 8 ELSE 0 END END AS chars
  FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
w AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS winner FROM p),
five AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::INTEGER) AS v FROM w)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda x:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM five
"""

OP11 = r"""
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec, row_number() OVER () AS row
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(range(1, least(len(a.vec), len(b.vec)) + 1), lambda i: a.vec[i] * b.vec[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST) AS nth FROM s WHERE same)
  WHERE nth <= 5),
n AS (
  SELECT p.anchor, p.nth, p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.other_id NULLS LAST)::INTEGER AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

OP12 = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
drawn AS (
  SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS d
  FROM raw, tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, range(2) AS twice(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS n
  FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id),
rows AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY n) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'sound' END AS fault
  FROM placed),
counts AS (
  SELECT c, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY c),
-- States of the pattern: 0 nothing, 1 after s, 2 after u, 3 after a; inserting leads from one to the next.
inserts AS (
  SELECT * FROM (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
                        (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')) AS x(f, t, extra, put)),
edits AS (
  SELECT * FROM (VALUES ('D', 0, '', 0, 4), ('D', 1, '', 1, 4), ('D', 2, '', 2, 4), ('D', 3, '', 3, 4),
                        ('R', 0, '', 2, 3), ('R', 1, '', 2, 3), ('R', 2, '', 3, 3), ('R', 3, '', 2, 3),
                        ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0)) AS x(edit, f, needs, t, pays)),
best AS (
  SELECT c, 0::BIGINT AS n, 0 AS state, '000000000' AS way FROM convs
  UNION ALL
  SELECT b.c, r.n, e.t AS state,
         min(lpad((substr(b.way, 1, 9)::INT + i.extra + e.pays + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END)::VARCHAR, 9, '0')
             || substr(b.way, 10) || i.put || e.edit) AS way
  FROM best b JOIN rows r ON r.c = b.c AND r.n = b.n + 1 JOIN inserts i ON i.f = b.state JOIN edits e ON e.f = i.t
  WHERE (e.edit <> 'K' OR e.needs = r.initial) AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.c, r.n, e.t),
ended AS (
  SELECT b.c, min(lpad((substr(b.way, 1, 9)::INT + i.extra)::VARCHAR, 9, '0') || substr(b.way, 10) || i.put) AS way
  FROM best b LEFT JOIN counts k ON b.c = k.c JOIN inserts i ON i.f = b.state
  WHERE b.n = coalesce(k.rows, 0) AND i.t IN (0, 3) GROUP BY b.c),
answers AS (SELECT c, substr(way, 1, 9)::BIGINT AS cost, substr(way, 10) AS audit FROM ended),
steps AS (
  SELECT c, edit, sum((edit <> 'I')::INT) OVER w AS n, sum((edit <> 'D')::INT) OVER w AS place
  FROM (SELECT c, unnest(range(1, length(audit) + 1)) AS j, substr(audit, j::INT, 1) AS edit FROM answers)
  WINDOW w AS (PARTITION BY c ORDER BY j)),
kept AS (
  SELECT s.*, r.role, r.text, max((s.place = 1 AND s.edit = 'K' AND r.initial = 's')::INT) OVER (PARTITION BY s.c) AS led
  FROM steps s LEFT JOIN rows r ON s.edit <> 'I' AND r.c = s.c AND r.n = s.n WHERE s.edit <> 'D'),
texts AS (
  SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                       || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS repaired
  FROM kept GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM convs LEFT JOIN counts USING (c) LEFT JOIN texts USING (c) JOIN answers USING (c)
"""

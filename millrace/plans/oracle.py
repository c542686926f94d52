"""SQL for DuckDB beside the registered queries. One chain of common table expressions restates rendering and parsing from the rules."""

from __future__ import annotations

_RENDER = r"""
part_lines AS (
  SELECT k, p_name, p_brand, p_type, p_size, r, slot, printf('doc%02d', d) AS doc_id,
    CAST((r * 5 + slot) // 37 AS INT) AS page, CAST((r * 5 + slot) % 37 AS INT) AS line
  FROM (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_partkey % docs AS d,
          row_number() OVER (PARTITION BY p_partkey % docs ORDER BY p_partkey) - 1 AS r FROM part, (SELECT greatest(20, count(*) // 100) AS docs FROM part)),
       (SELECT unnest(range(5)) AS slot)
), pages AS (
  SELECT DISTINCT doc_id, page, 540.0::DOUBLE AS width, 560.0::DOUBLE AS height FROM part_lines
), body_facts AS (
  SELECT *, CASE WHEN r % 13 = 12 THEN 3 WHEN r % 4 = 0 THEN 1 WHEN r % 4 = 2 THEN 3 ELSE 2 END AS depth,
    (['North Coast Com', 'McMaster- Carr', 'OMEGA', 'NCC', 'Bestlink', 'Allen Bradley', 'US Sensor', 'Acme, Inc'])[k % 8 + 1] AS supplier,
    CASE WHEN k % 23 = 0 THEN -80 ELSE 0 END AS shift,
    replace(p_brand, '#', '') || '-' || p_size AS mpn
  FROM part_lines
), body_raw AS (
  SELECT doc_id, page, line, slot, k, list_filter(CASE slot
    WHEN 0 THEN [{'t': CASE WHEN depth = 1 THEN printf('UA%06d', k) WHEN k % 9 = 0 THEN printf('M%06d', k) ELSE printf('LB%06d', k) END, 'a': 22, 'b': 70, 'dy': 0}]
    WHEN 1 THEN list_concat(list_concat(
      [{'t': repeat('.', depth - 1) || depth, 'a': 20, 'b': 28, 'dy': 0}],
      list_transform(string_split(p_name, ' '), lambda w, i: {'t': w, 'a': CAST(82 + 28 * i AS INT), 'b': CAST(106 + 28 * i AS INT), 'dy': 0})),
      [CASE WHEN k % 19 = 0 THEN {'t': '15', 'a': 200, 'b': 208, 'dy': 0} END,
       CASE WHEN k % 2 = 0 THEN {'t': '4/18/2024', 'a': 300, 'b': 330, 'dy': 0} END,
       CASE WHEN k % 17 <> 0 THEN {'t': printf('%.6f', p_size::DOUBLE), 'a': 352, 'b': 388, 'dy': 1} END,
       {'t': 'U', 'a': 405, 'b': 409, 'dy': 0},
       CASE WHEN k % 6 <> 0 THEN {'t': 'EA', 'a': 411, 'b': 421, 'dy': 0} END])
    WHEN 2 THEN [{'t': p_brand, 'a': 110, 'b': 150, 'dy': 0},
       CASE WHEN k % 5 = 0 THEN {'t': 'HD', 'a': 155, 'b': 163, 'dy': 0} END,
       {'t': upper(string_split(p_type, ' ')[1]), 'a': 445, 'b': 485, 'dy': 0}]
    WHEN 3 THEN list_concat(
      list_transform(string_split(supplier, ' '), lambda w, i: {'t': w, 'a': CAST(166 + shift + 24 * i AS INT), 'b': CAST(188 + shift + 24 * i AS INT), 'dy': 0}),
      [{'t': CASE WHEN k % 31 = 0 THEN '2024-04-18' WHEN k % 37 = 0 THEN lower(mpn) ELSE mpn END, 'a': 275, 'b': 300, 'dy': 0},
       CASE WHEN k % 7 = 0 THEN {'t': 'X', 'a': 304, 'b': 310, 'dy': 0} END,
       CASE WHEN k % 7 = 0 THEN {'t': 'far', 'a': 345, 'b': 360, 'dy': 0} END,
       CASE WHEN k % 29 = 0 THEN {'t': '2.000000', 'a': 362, 'b': 388, 'dy': 0} END])
    ELSE CASE WHEN k % 3 = 0 THEN [{'t': 'Schneider', 'a': 190, 'b': 216, 'dy': 0}, {'t': 'Electric', 'a': 218, 'b': 240, 'dy': 0}, {'t': 'SE-' || k, 'a': 275, 'b': 300, 'dy': 0}]
      WHEN k % 3 = 1 THEN [{'t': 'see', 'a': 110, 'b': 124, 'dy': 0}, {'t': 'note', 'a': 126, 'b': 144, 'dy': 0}, {'t': '5', 'a': 146, 'b': 150, 'dy': 0}] END
    END, lambda w: w IS NOT NULL) AS ws
  FROM body_facts
), body AS (
  SELECT doc_id, page, w.t AS text, w.a::DOUBLE AS x0, w.b::DOUBLE AS x1,
    (60 + 12 * line + w.dy + CASE WHEN page % 10 = 9 AND slot = 1 THEN 3 * least(i, 4) ELSE 0 END)::DOUBLE AS top
  FROM (SELECT doc_id, page, line, slot, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM body_raw)
), furniture AS (
  SELECT doc_id, page, h.t AS text, (h.a + 3 * (page % 2))::DOUBLE AS x0, (h.b + 3 * (page % 2))::DOUBLE AS x1, 40.0::DOUBLE AS top FROM pages,
    (VALUES (1, 'Part', 20, 50), (2, 'Identifier', 52, 84), (3, 'Description', 110, 160), (4, 'Mfg', 190, 212), (5, 'Name', 214, 240),
            (6, 'Mfg', 270, 292), (7, 'Part', 294, 320), (8, 'Quantity', 350, 390), (9, 'UM', 410, 422), (10, 'Commodity', 440, 490)) AS h(n, t, a, b)
  WHERE NOT (doc_id = 'doc07' AND page = 1 AND h.n IN (6, 7))
  UNION ALL
  SELECT doc_id, page, h.t, (100 + 40 * h.n)::DOUBLE, (136 + 40 * h.n)::DOUBLE, 10.0::DOUBLE FROM pages,
    (VALUES (0, 'Multi-Level'), (1, 'Explosion'), (2, 'By'), (3, 'Parent'), (4, 'Part'), (5, 'Identifier')) AS h(n, t)
  UNION ALL SELECT doc_id, page, 'Page', 250.0, 270.0, 516.0 FROM pages
  UNION ALL SELECT doc_id, page, page::VARCHAR, 274.0, 280.0, 516.0 FROM pages
), words AS (
  SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0, text) AS INT) AS word_id, text, x0, x1, top, top + 9 AS bottom
  FROM (SELECT * FROM body UNION ALL SELECT * FROM furniture)
)
"""

_LINES = r"""
tolerance AS (
  SELECT p.doc_id, p.page, coalesce(median(d) FILTER (d > 0.5) * 0.4::DOUBLE, 3.0::DOUBLE) AS tol FROM pages p LEFT JOIN (
    SELECT doc_id, page, t - lag(t) OVER (PARTITION BY doc_id, page ORDER BY t) AS d FROM (SELECT DISTINCT doc_id, page, round(top, 2) AS t FROM words)
  ) g USING (doc_id, page) GROUP BY ALL
), tops AS (
  SELECT doc_id, page, top, row_number() OVER (PARTITION BY doc_id, page ORDER BY top) AS i FROM (SELECT DISTINCT doc_id, page, top FROM words)
), fold AS (
  SELECT doc_id, page, i, top, top AS anchor, 0 AS line_no FROM tops WHERE i = 1
  UNION ALL
  SELECT t.doc_id, t.page, t.i, t.top, CASE WHEN t.top - f.anchor > s.tol THEN t.top ELSE f.anchor END, f.line_no + CASE WHEN t.top - f.anchor > s.tol THEN 1 ELSE 0 END
  FROM fold f JOIN tops t ON t.doc_id = f.doc_id AND t.page = f.page AND t.i = f.i + 1 JOIN tolerance s ON s.doc_id = f.doc_id AND s.page = f.page
), placed AS (
  SELECT w.*, f.line_no, CAST(row_number() OVER (PARTITION BY w.doc_id, w.page, f.line_no ORDER BY w.x0, w.top, w.word_id) - 1 AS INT) AS pos
  FROM words w JOIN fold f ON f.doc_id = w.doc_id AND f.page = w.page AND f.top = w.top
), lines AS (
  SELECT doc_id, page, line_no, min(top) AS y_top, max(bottom) AS y_bottom, count(*)::INT AS n_words FROM placed GROUP BY ALL
)
"""

_SYNONYMS = r"""
synonyms(col, col_idx, phrase_idx, phrase) AS (VALUES
  ('part_identifier', 0, 0, 'Part Identifier'), ('part_identifier', 0, 1, 'Part No'), ('part_identifier', 0, 2, 'Part Number'), ('part_identifier', 0, 3, 'Item No'), ('part_identifier', 0, 4, 'Item Number'), ('part_identifier', 0, 5, 'Component'),
  ('description', 1, 0, 'Description'), ('description', 1, 1, 'Desc'), ('description', 1, 2, 'Item Description'),
  ('quantity', 2, 0, 'Quantity'), ('quantity', 2, 1, 'Qty'), ('quantity', 2, 2, 'QTY'), ('quantity', 2, 3, 'Qty Req'),
  ('uom', 3, 0, 'UM'), ('uom', 3, 1, 'U/M'), ('uom', 3, 2, 'UoM'), ('uom', 3, 3, 'Unit'),
  ('mfg_name', 4, 0, 'Mfg Name'), ('mfg_name', 4, 1, 'Manufacturer'), ('mfg_name', 4, 2, 'Vendor'), ('mfg_name', 4, 3, 'Supplier'),
  ('mfg_part', 5, 0, 'Mfg Part'), ('mfg_part', 5, 1, 'Manufacturer P/N'), ('mfg_part', 5, 2, 'Vendor PN'), ('mfg_part', 5, 3, 'Vendor P/N'), ('mfg_part', 5, 4, 'Supplier PN'), ('mfg_part', 5, 5, 'Supplier P/N'), ('mfg_part', 5, 6, 'MPN'),
  ('commodity', 6, 0, 'Commodity'), ('commodity', 6, 1, 'Category'), ('commodity', 6, 2, 'Class'))
"""

_LAYOUT = r"""
line_tokens AS (
  SELECT doc_id, page, line_no, list(lower(trim(text)) ORDER BY pos) AS ts, list(x0 ORDER BY pos) AS a, list(x1 ORDER BY pos) AS b FROM placed GROUP BY ALL
), places AS (
  SELECT t.*, s.col, s.col_idx, s.phrase_idx, len(string_split(s.phrase, ' ')) AS n,
    list_filter(range(1, len(ts) + 1), lambda i: ts[i:i + len(string_split(s.phrase, ' ')) - 1] = string_split(lower(s.phrase), ' '))[1] AS found
  FROM line_tokens t, synonyms s
), hits AS (
  SELECT doc_id, page, line_no, col, col_idx, phrase_idx, n::INT AS n_words, CAST(found - 1 AS INT) AS start, a[found] AS x0, b[found + n - 1] AS x1 FROM places WHERE found IS NOT NULL
), row_breaks AS (
  SELECT doc_id, page, CASE WHEN count(*) < 3 OR median(gap) FILTER (gap > 0) IS NULL THEN 12.0::DOUBLE ELSE greatest(median(gap) FILTER (gap > 0) * 1.5::DOUBLE, 6.0::DOUBLE) END AS threshold
  FROM (SELECT *, lead(y_top) OVER (PARTITION BY doc_id, page ORDER BY line_no) - y_bottom AS gap FROM lines) GROUP BY ALL
), flagged AS (
  SELECT l.*, h.n_hit IS NOT NULL AS hit, threshold FROM lines l LEFT JOIN (SELECT doc_id, page, line_no, count(*) AS n_hit FROM hits GROUP BY ALL) h USING (doc_id, page, line_no) JOIN row_breaks USING (doc_id, page)
), run_lines AS (
  SELECT *, sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS run FROM (
    SELECT *, NOT (hit AND coalesce(lag(hit) OVER w, false) AND coalesce(y_top - lag(y_bottom) OVER w <= threshold, false)) AS breaks FROM flagged WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no))
), runs AS (
  SELECT r.doc_id, r.page, min(r.line_no) AS first_line, max(r.line_no) AS last_line, count(DISTINCT h.col)::INT AS n_columns FROM run_lines r JOIN hits h USING (doc_id, page, line_no) WHERE r.hit GROUP BY r.doc_id, r.page, r.run
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n_columns DESC, last_line - first_line, first_line) = 1
), matched AS (
  SELECT h.doc_id, h.page, h.col, h.n_words, h.x0, h.x1 FROM hits h JOIN best b ON b.doc_id = h.doc_id AND b.page = h.page AND h.line_no BETWEEN b.first_line AND b.last_line
  QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.page, h.col ORDER BY h.n_words DESC, h.line_no, h.col_idx, h.phrase_idx) = 1
), missing AS (
  SELECT p.doc_id, p.page, c.col FROM pages p, (VALUES ('part_identifier'), ('description'), ('mfg_name'), ('mfg_part')) c(col)
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = p.doc_id AND m.page = p.page AND m.col = c.col)
), good AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM missing m WHERE m.doc_id = b.doc_id AND m.page = b.page)
), header AS (
  SELECT g.doc_id, g.page, f.y_top AS hdr_top, l.y_bottom AS body_y_top FROM good g
  JOIN lines f ON f.doc_id = g.doc_id AND f.page = g.page AND f.line_no = g.first_line JOIN lines l ON l.doc_id = g.doc_id AND l.page = g.page AND l.line_no = g.last_line
), layouts AS (
  SELECT h.*, coalesce((SELECT max(bottom) FROM words w WHERE w.doc_id = h.doc_id AND w.page = h.page AND w.top >= h.body_y_top), p.height) AS body_y_bottom, p.width FROM header h JOIN pages p USING (doc_id, page)
), bands AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY x_min) - 1 AS INT) AS rnk FROM (
    SELECT m.doc_id, m.page, m.col, coalesce((lag(m.x1) OVER w + m.x0) / 2, 0.0::DOUBLE) AS x_min, coalesce((m.x1 + lead(m.x0) OVER w) / 2, l.width) AS x_max
    FROM matched m JOIN layouts l USING (doc_id, page) WINDOW w AS (PARTITION BY m.doc_id, m.page ORDER BY (m.x0 + m.x1) / 2))
)
"""

_PATTERN = r"""
id_tokens AS (
  SELECT w.doc_id, w.page, w.word_id, w.text AS token, w.page::BIGINT * 1000000 + w.word_id AS seq FROM words w JOIN layouts l USING (doc_id, page)
  JOIN bands b ON b.doc_id = w.doc_id AND b.page = w.page AND b.col = 'part_identifier'
  WHERE (w.x0 + w.x1) / 2 >= b.x_min AND (w.x0 + w.x1) / 2 <= b.x_max AND w.top >= l.body_y_top
), cands AS (
  SELECT doc_id, seq, trim(token) AS token FROM id_tokens
  WHERE regexp_matches(trim(token), '^[\p{L}\p{N}]{3,}$') AND regexp_matches(token, '\p{L}') AND regexp_matches(token, '\p{N}')
), shapes AS (
  SELECT doc_id, shape, n, first_seq FROM (SELECT doc_id, shape, count(*) AS n, min(seq) AS first_seq, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(token, '\p{L}', 'L', 'g'), '\p{N}', 'D', 'g'), '[^LD]', 'X', 'g') AS shape FROM cands) GROUP BY doc_id, shape)
  WHERE n / total >= 0.05
), made AS (
  SELECT doc_id, '^(' || string_agg(branch, '|' ORDER BY n DESC, first_seq) || ')$' AS pattern, string_agg(shape, '|' ORDER BY n DESC, first_seq) AS shapes FROM (
    SELECT *, array_to_string(list_transform(regexp_extract_all(shape, 'L+|D+|X+'), lambda x: CASE x[1] WHEN 'L' THEN '[A-Z]' WHEN 'D' THEN '\d' ELSE '[^A-Za-z0-9]' END || CASE WHEN len(x) > 1 THEN '{' || len(x) || '}' ELSE '' END), '') AS branch FROM shapes) GROUP BY doc_id
), rates AS (
  SELECT doc_id, sum(CASE WHEN regexp_matches(token, pattern) THEN 1 ELSE 0 END) / count(*) AS rate FROM cands JOIN made USING (doc_id) GROUP BY doc_id
), patterns AS (
  SELECT d.doc_id, CASE WHEN coalesce(rate >= 0.8, false) THEN pattern ELSE '^[A-Z]{1,4}\d{3,8}$' END AS pattern, coalesce(rate, 0) AS match_rate, NOT coalesce(rate >= 0.8, false) AS fallback
  FROM (SELECT DISTINCT doc_id FROM pages) d LEFT JOIN made USING (doc_id) LEFT JOIN rates USING (doc_id)
)
"""

_RECORDS = r"""
body_lines AS (SELECT l.* FROM lines l JOIN layouts y USING (doc_id, page) WHERE l.y_top >= y.body_y_top),
wide AS (
  SELECT doc_id, page, max(x_min) FILTER (col = 'part_identifier') AS id_a, max(x_max) FILTER (col = 'part_identifier') AS id_b,
    max(x_min) FILTER (col = 'mfg_name') AS name_a, max(x_max) FILTER (col = 'mfg_name') AS name_b, max(x_min) FILTER (col = 'mfg_part') AS part_a, max(x_max) FILTER (col = 'mfg_part') AS part_b,
    max(x_min) FILTER (col = 'quantity') AS q_a, max(x_max) FILTER (col = 'quantity') AS q_b, max(x_min) FILTER (col = 'uom') AS u_a, max(x_max) FILTER (col = 'uom') AS u_b,
    max(x_min) FILTER (col = 'commodity') AS c_a, max(x_max) FILTER (col = 'commodity') AS c_b FROM bands GROUP BY ALL
), bw AS (
  SELECT p.*, b.y_top, w.* EXCLUDE (doc_id, page), regexp_matches(p.text, '^\d+\.\d*0{3,}$') AS is_q, regexp_matches(p.text, '^\d{1,2}/\d{1,2}/\d{2,4}$') AS is_date, regexp_matches(p.text, '^\.{0,9}\d{1,2}$') AS is_depth
  FROM placed p JOIN body_lines b USING (doc_id, page, line_no) JOIN wide w ON w.doc_id = p.doc_id AND w.page = p.page
), left_parts AS (
  SELECT doc_id, page, line_no, x0 AS part_x0, text AS part FROM bw
  WHERE x1 > part_a AND x0 < part_b AND regexp_matches(text, '^[A-Za-z0-9][A-Za-z0-9._/#"''-]{2,30}$') AND NOT is_q AND NOT is_date
  QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY x0, pos) = 1
), facts AS (
  SELECT w.doc_id, w.page, w.line_no, any_value(w.y_top) AS y_top, count(*) AS n, bool_or(regexp_matches(w.text, p.pattern) AND (w.id_a IS NULL OR (w.x1 > w.id_a AND w.x0 < w.id_b))) AS is_id,
    bool_or(is_q) AS has_q, any_value(l.part_x0) AS part_x0, arg_min(w.is_depth, w.pos) FILTER (w.x0 < l.part_x0) AS depth_first, min(w.x0) FILTER (w.x0 < l.part_x0) AS name_x0,
    coalesce(bool_or(regexp_matches(w.text, '[,"?*;:]')) FILTER (w.x0 < l.part_x0), false) AS bad, any_value(w.name_a) AS name_a, any_value(w.name_b) AS name_b
  FROM bw w JOIN patterns p USING (doc_id) LEFT JOIN left_parts l ON l.doc_id = w.doc_id AND l.page = w.page AND l.line_no = w.line_no GROUP BY w.doc_id, w.page, w.line_no
), kinds AS (
  SELECT doc_id, page, line_no, y_top, CASE WHEN n = 1 AND is_id THEN 'record_start'
    WHEN part_x0 IS NOT NULL AND name_x0 IS NOT NULL AND NOT depth_first AND NOT has_q AND coalesce(name_x0 + 0.5::DOUBLE * (name_b - name_a) >= name_a, true) AND NOT bad THEN 'supplier_row' ELSE 'continuation' END AS kind FROM facts
), assigned AS (
  SELECT * FROM (SELECT *, sum(CASE WHEN kind = 'record_start' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, line_no)::INT AS record_seq FROM kinds) WHERE record_seq > 0
), rw AS (
  SELECT w.*, a.record_seq, a.kind FROM bw w JOIN assigned a USING (doc_id, page, line_no)
), starts AS (
  SELECT doc_id, record_seq, text AS internal_part, page, y_top AS line_y FROM rw WHERE kind = 'record_start'
), cont AS (
  SELECT r.doc_id, r.record_seq, r.page, r.line_no, r.pos, r.word_id, r.text, r.x0, r.x1, r.is_q, r.is_date, r.is_depth, s.page AS start_page, w.q_a, w.q_b, w.u_a, w.u_b, w.c_a, w.c_b,
    row_number() OVER (PARTITION BY r.doc_id, r.record_seq ORDER BY r.page, r.line_no, r.pos) AS o
  FROM rw r JOIN starts s ON s.doc_id = r.doc_id AND s.record_seq = r.record_seq JOIN wide w ON w.doc_id = r.doc_id AND w.page = s.page WHERE r.kind = 'continuation'
), depths AS (
  SELECT doc_id, record_seq, arg_min(regexp_extract(text, '(\d{1,2})$', 1)::INT, o) AS depth FROM cont WHERE pos = 0 AND is_depth GROUP BY ALL
), descriptions AS (
  SELECT doc_id, record_seq, string_agg(text, ' ' ORDER BY o) AS description FROM (
    SELECT *, bool_or(NOT is_depth) OVER (PARTITION BY doc_id, record_seq ORDER BY o) AS begun FROM cont WHERE NOT is_q AND NOT is_date) WHERE begun GROUP BY ALL
), quantities AS (
  SELECT doc_id, record_seq, arg_min(text::DOUBLE, o) AS quantity FROM cont WHERE is_q AND (q_a IS NULL OR (x1 > q_a AND x0 < q_b)) GROUP BY ALL
), units AS (
  SELECT doc_id, record_seq, arg_min(text, (CASE WHEN len(text) = 1 THEN 1 ELSE 0 END) * 1000000 + o) AS uom FROM cont
  WHERE text IN ('U', 'EA', 'FT', 'LB', 'KG', 'M', 'MM', 'CM', 'IN', 'PC', 'RL', 'BX', 'BG') AND (u_a IS NULL OR (x1 > u_a AND x0 < u_b)) GROUP BY ALL
), commodities AS (
  SELECT doc_id, record_seq, text AS commodity FROM cont WHERE regexp_matches(text, '^\p{Lu}{3,}$') AND x1 > c_a AND x0 < c_b
  QUALIFY row_number() OVER (PARTITION BY doc_id, record_seq ORDER BY x1 DESC, o) = 1
), flat AS (
  SELECT s.doc_id, s.record_seq, internal_part, coalesce(description, '') AS description, quantity, uom, commodity, coalesce(depth, 0) AS depth, page, line_y FROM starts s
  LEFT JOIN descriptions USING (doc_id, record_seq) LEFT JOIN quantities USING (doc_id, record_seq) LEFT JOIN units USING (doc_id, record_seq) LEFT JOIN commodities USING (doc_id, record_seq) LEFT JOIN depths USING (doc_id, record_seq)
), records AS (
  SELECT f.*, (SELECT arg_max(e.internal_part, e.record_seq) FROM flat e WHERE e.doc_id = f.doc_id AND e.record_seq < f.record_seq AND e.depth < f.depth) AS parent FROM flat f
), sup_words AS (
  SELECT r.*, l.part_x0 FROM rw r JOIN left_parts l USING (doc_id, page, line_no) WHERE r.kind = 'supplier_row'
), sup_right AS (
  SELECT *, sum(CASE WHEN gap > 0.3::DOUBLE * (part_b - part_a) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_no ORDER BY pos) AS gaps FROM (
    SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page, line_no ORDER BY pos) AS gap FROM sup_words WHERE x0 >= part_x0)
), supplier_rows AS (
  SELECT n.doc_id, n.record_seq, CAST(row_number() OVER (PARTITION BY n.doc_id, n.record_seq ORDER BY n.page, n.line_no) - 1 AS INT) AS row_pos, name_text, part_text, n.page, n.line_y FROM
    (SELECT doc_id, record_seq, page, line_no, any_value(y_top) AS line_y, string_agg(text, ' ' ORDER BY pos) AS name_text FROM sup_words WHERE x0 < part_x0 GROUP BY ALL) n JOIN
    (SELECT doc_id, page, line_no, string_agg(text, ' ' ORDER BY pos) AS part_text FROM sup_right WHERE gaps = 0 GROUP BY ALL) p USING (doc_id, page, line_no)
), keyed AS (
  SELECT *, lower(cleaned) AS key FROM (SELECT *, array_to_string(list_filter(string_split(description, ' '), lambda t: NOT regexp_matches(t, '^([A-Z]{1,2}|\d)$') AND t <> coalesce(commodity, '')), ' ') AS cleaned FROM records) WHERE cleaned <> ''
)
"""

_TOKENS = r"""
score_tokens AS (
  SELECT p_partkey AS seq, coalesce((['12/5/2019', '1998-1-30', '37.5000', '', '   ', '88 K 140', 'TRV 90-Q-7-B-20-2-PLC-', '410077.3105', 'gasket', 'QR,ST', 'K,L;M', 'W4V', '18"', '9-foot hose, 3yard', '  rsTUv  '])[p_partkey % 20 + 1],
    CASE p_partkey % 20 WHEN 15 THEN 'KV' || lpad(p_partkey::VARCHAR, 6, '0') WHEN 16 THEN '731-' || p_partkey WHEN 17 THEN 'worn label, ' || p_partkey WHEN 18 THEN p_name || '?' ELSE replace(p_brand, '#', '-') END) AS token FROM part
), pieces AS (
  SELECT seq, token, trim(token) AS t, list_filter(string_split_regex(trim(token), '\s+'), lambda p: true) AS ps FROM score_tokens
), scores AS (
  SELECT seq, token, t, CASE WHEN t = '' THEN 'empty_token' WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{2,4}$') OR regexp_matches(t, '^\d{4}-\d{1,2}-\d{1,2}$') THEN 'date_shaped' WHEN regexp_matches(t, '^\d+\.\d*0{3,}$') THEN 'quantity_shaped' END AS hard,
    len(list_filter(ps, lambda p: regexp_matches(p, '^[\p{L}\p{N}_/.#"''-]+$') AND NOT (regexp_matches(p, '\p{Ll}') AND NOT regexp_matches(p, '\p{Lu}')))) / len(ps) AS ratio FROM pieces
), conf AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN len(t) BETWEEN 4 AND 32 THEN 0.5::DOUBLE ELSE -0.4::DOUBLE END
    + CASE WHEN len(regexp_extract_all(t, '\s')) > 0 AND ratio < 0.8 THEN -0.1::DOUBLE * len(regexp_extract_all(t, '\s')) ELSE 0.0::DOUBLE END
    + CASE WHEN regexp_matches(t, '\p{Ll}') THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END
    + -0.2::DOUBLE * len(regexp_extract_all(t, '[,?*;:]'))
    + CASE WHEN regexp_matches(t, '^[A-Za-z0-9]') AND regexp_matches(t, '[A-Za-z0-9]$') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)) AS raw FROM scores
), scored AS (
  SELECT *, CASE WHEN hard IS NULL THEN round(raw, 6) ELSE 0.0::DOUBLE END AS confidence, coalesce(hard, CASE WHEN raw < 0.35 THEN 'below_min_confidence' END) AS reason, t <> '' AND regexp_matches(t, '^[A-Z]{1,4}\d{3,8}$') AS is_internal FROM conf
)
"""

_NAMES = r"""
raw_names AS (
  SELECT s_nationkey::VARCHAR AS doc_id, s_suppkey AS seq, coalesce((['mcmaster-carr ', 'NORTH  COAST', 'Modicon:', 'ncc;', 'Larkspur Valves', 'HD Motion', '12/40', 'Café Müller', 'OE', 'usS', 'quill', 'SE', 'LARCO', 'US   Sensor', 'Omega!', 'Škoda Ŵerke', 'LV'])[s_suppkey % 20 + 1], s_name) AS raw_name FROM supplier
), named AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(trim(strip_accents(raw_name))), '\s+', ' ', 'g'), '[.,;:!?]+$', '')) AS key FROM raw_names
), known(canonical, canon_idx, alias) AS (VALUES
  ('North Coast Components', 0, 'North Coast Components'), ('North Coast Components', 0, 'North Coast Com'), ('North Coast Components', 0, 'North Coast'), ('North Coast Components', 0, 'NCC'),
  ('McMaster-Carr', 1, 'McMaster-Carr'), ('McMaster-Carr', 1, 'McMaster'), ('McMaster-Carr', 1, 'Mcmaster'), ('McMaster-Carr', 1, 'McMaster- Carr'), ('McMaster-Carr', 1, 'Mcmaster- Carr'), ('McMaster-Carr', 1, 'Mcmaster-Carr'),
  ('Schneider Electric', 2, 'Schneider Electric'), ('Schneider Electric', 2, 'Modicon'), ('OMEGA Engineering', 3, 'OMEGA Engineering'), ('OMEGA Engineering', 3, 'OMEGA'), ('OMEGA Engineering', 3, 'Omega'),
  ('U.S. Sensor', 4, 'U.S. Sensor'), ('U.S. Sensor', 4, 'U.S. Sensor'), ('U.S. Sensor', 4, 'US Sensor'), ('U.S. Sensor', 4, 'USS')),
known_keys AS (SELECT DISTINCT regexp_replace(lower(alias), '[.,;:!?]+$', '') AS key, canonical FROM known),
spelled(letters, canonical) AS (VALUES ('NCC', 'North Coast Components'), ('M', 'McMaster-Carr'), ('SE', 'Schneider Electric'), ('OE', 'OMEGA Engineering'), ('US', 'U.S. Sensor'))
"""

_ORDERS = r"""
recs AS (
  SELECT l_orderkey::VARCHAR AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS record_seq, printf('LB%06d', l_partkey) AS internal_part,
    CASE WHEN l_linenumber % 2 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE p_name END || ' HD 5 ' || upper(string_split(p_type, ' ')[1]) AS description,
    CASE WHEN l_linenumber <> 3 THEN l_quantity::DOUBLE END AS quantity, CASE WHEN l_linenumber <> 1 THEN 'EA' END AS uom, CASE WHEN l_linenumber % 3 <> 1 THEN upper(string_split(p_type, ' ')[1]) END AS commodity,
    l_suppkey, l_linenumber, p_size
  FROM lineitem JOIN part ON p_partkey = l_partkey
), ks AS (
  SELECT *, lower(cleaned) AS key FROM (SELECT *, array_to_string(list_filter(string_split(description, ' '), lambda t: NOT regexp_matches(t, '^([A-Z]{1,2}|\d)$') AND t <> coalesce(commodity, '')), ' ') AS cleaned FROM recs) WHERE cleaned <> ''
), grouped AS (
  SELECT doc_id, key, min(record_seq) AS first_seq, arg_min(cleaned, record_seq) AS description, sum(coalesce(quantity, 0)::DECIMAL(38, 6))::DOUBLE AS total_quantity, count(*) AS n_occurrences,
    arg_min(uom, record_seq) FILTER (uom IS NOT NULL) AS uom, arg_min(commodity, record_seq) FILTER (commodity IS NOT NULL) AS commodity FROM ks GROUP BY ALL
), offers AS (
  SELECT k.doc_id, k.key, k.record_seq, s_name AS canonical, CASE WHEN l_linenumber = 4 THEN '2024-04-18' WHEN l_linenumber = 5 THEN 'no,;' ELSE 'MPN-' || p_size END AS part_text, g.first_seq AS group_seq,
    CASE WHEN l_linenumber = 4 THEN 'date_shaped' WHEN l_linenumber = 5 THEN 'below_min_confidence' END AS reason
  FROM ks k JOIN grouped g USING (doc_id, key) JOIN supplier ON s_suppkey = l_suppkey
), unique_offers AS (
  SELECT * FROM offers WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id, key, canonical, part_text ORDER BY group_seq, record_seq) = 1
)
"""

_PARSE = [_RENDER, _LINES, _SYNONYMS, _LAYOUT, _PATTERN, _RECORDS]


def _sql(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts) + " " + select


def _render(select):
    return _sql(_PARSE[:1], select)


def _line(select):
    return _sql(_PARSE[:2], select)


def _lay(select):
    return _sql(_PARSE[:4], select)


def _pat(select):
    return _sql(_PARSE[:5], select)


def _rec(select):
    return _sql(_PARSE, select)


def _tok(select):
    return _sql([_TOKENS], select)


def _nam(select):
    return _sql([_NAMES], select)


def _ord(select):
    return _sql([_ORDERS], select)


_PART_ROWS = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_seq) - 1 AS INT) AS nth, description, total_quantity, uom, commodity, internal_parts, occurrences, coalesce(suppliers, '') AS suppliers
FROM (SELECT doc_id, key, min(record_seq) AS first_seq, arg_min(cleaned, record_seq) AS description, sum(coalesce(quantity, 0)::DECIMAL(38, 6))::DOUBLE AS total_quantity, arg_min(uom, record_seq) FILTER (uom <> '') AS uom, arg_min(commodity, record_seq) FILTER (commodity <> '') AS commodity,
    string_agg(internal_part || ':' || printf('%.2f', coalesce(quantity, 0)::DOUBLE) || ':' || coalesce(parent, ''), '|' ORDER BY record_seq) AS occurrences FROM keyed GROUP BY doc_id, key)
JOIN (SELECT doc_id, key, string_agg(internal_part, '|' ORDER BY seq) AS internal_parts FROM (SELECT doc_id, key, internal_part, min(record_seq) AS seq FROM keyed GROUP BY ALL) GROUP BY ALL) USING (doc_id, key)
LEFT JOIN (SELECT doc_id, key, string_agg(canonical || ' ' || part_text, '|' ORDER BY seq) AS suppliers FROM (SELECT doc_id, key, canonical, part_text, min(seq) AS seq FROM accepted_rows GROUP BY ALL) GROUP BY ALL) USING (doc_id, key)"""
_NEW_NAMES = "SELECT doc_id, canonical, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(seq)) - 1 AS INT) AS nth FROM accepted_rows WHERE canonical NOT IN ('North Coast Components', 'McMaster-Carr', 'Schneider Electric', 'OMEGA Engineering', 'U.S. Sensor') GROUP BY doc_id, canonical"
_DOCUMENT_ROWS = f"""SELECT doc_id, page_count, pattern, coalesce(new_suppliers, '') AS new_suppliers, CAST(coalesce(n_rejected, 0) AS INT) AS n_rejected, CAST(coalesce(n_parts, 0) AS INT) AS n_parts
FROM (SELECT doc_id, count(*) AS page_count FROM pages GROUP BY ALL) JOIN patterns USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(canonical, '|' ORDER BY nth) AS new_suppliers FROM ({_NEW_NAMES}) GROUP BY ALL) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_rejected FROM supplier_places WHERE dated GROUP BY ALL) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(DISTINCT key) AS n_parts FROM keyed GROUP BY ALL) USING (doc_id)"""
#: What names the rendering's suppliers resolve to: by alias, or as new names of their own.
_ACCEPTED = r"""
supplier_places AS (
  SELECT k.doc_id, k.key, s.name_text, s.part_text, regexp_matches(s.part_text, '^\d{4}-\d{1,2}-\d{1,2}$') AS dated, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.group_seq, s.record_seq, s.row_pos) AS seq
  FROM supplier_rows s JOIN (SELECT *, min(record_seq) OVER (PARTITION BY doc_id, key) AS group_seq FROM keyed) k USING (doc_id, record_seq)
), accepted_rows AS (
  SELECT s.doc_id, s.key, s.seq, s.part_text, CASE s.name_text WHEN 'North Coast' THEN 'North Coast Components' WHEN 'North Coast Com' THEN 'North Coast Components' WHEN 'NCC' THEN 'North Coast Components' WHEN 'McMaster- Carr' THEN 'McMaster-Carr'
    WHEN 'OMEGA' THEN 'OMEGA Engineering' WHEN 'US Sensor' THEN 'U.S. Sensor' ELSE s.name_text END AS canonical
  FROM supplier_places s WHERE NOT s.dated
)
"""

SQL = {
    "flagship_parts_rollup": _ord("SELECT key AS description, sum(coalesce(quantity, 0)::DECIMAL(38, 6))::DOUBLE AS total_quantity, count(*) AS n_occurrences, count(DISTINCT l_suppkey) AS n_suppliers FROM ks GROUP BY key"),
    "a3_word_projection": _render("SELECT doc_id, page, word_id, text, x0, x1, top, bottom FROM words"),
    "a4_doc_metadata": "SELECT s_suppkey::VARCHAR AS doc_id, CASE WHEN s_suppkey % 3 <> 0 THEN trim(s_name) END AS title, NULL::VARCHAR AS creator, 'pdf' AS producer FROM supplier",
    "a5_sparse_page_warning": _render("SELECT p.doc_id, p.page, count(w.text) AS n_words FROM pages p LEFT JOIN words w USING (doc_id, page) GROUP BY ALL HAVING count(w.text) < 90"),
    "a7_load_synonyms": _sql([_SYNONYMS], 'SELECT col AS "column", phrase_idx, phrase FROM synonyms'),
    "a8_load_weights": "SELECT 4 AS length_min, 32 AS length_max, 0.5::DOUBLE AS length_in_range_reward, -0.4::DOUBLE AS length_out_of_range_penalty, -0.1::DOUBLE AS whitespace_penalty_per_char, 0.8::DOUBLE AS whitespace_clean_token_ratio_threshold, -0.1::DOUBLE AS lowercase_penalty, -0.2::DOUBLE AS bad_punct_penalty_per_char, 0.1::DOUBLE AS boundary_alnum_reward, 0.35::DOUBLE AS min_confidence",
    "a9_load_aliases": _nam("SELECT canonical, canon_idx, alias FROM known"),
    "a10_read_result_json": _sql([*_PARSE, _ACCEPTED], _PART_ROWS),
    "a1_scan_words": _render("SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, word_id) - 1 AS INT) AS word_id, text, x0, x1, top, bottom FROM words"),
    "a6_list_sources": _render("SELECT DISTINCT doc_id, true AS filled FROM pages"),
    "b1_write_document": _sql([*_PARSE, _ACCEPTED], f"SELECT * FROM ({_PART_ROWS}) WHERE doc_id = 'doc03'"),
    "b2_batch_write": _sql([*_PARSE, _ACCEPTED], f"SELECT doc_id, page_count, pattern, new_suppliers, n_rejected, n_parts FROM ({_DOCUMENT_ROWS})"),
    "b5_golden_writer": _sql([*_PARSE, _ACCEPTED], f"SELECT doc_id, page_count, pattern, n_parts, total, true AS timeless FROM ({_DOCUMENT_ROWS}) LEFT JOIN (SELECT doc_id, round(sum(coalesce(quantity, 0)), 2)::DOUBLE AS total FROM keyed GROUP BY ALL) USING (doc_id)"),
    "j8_new_supplier_candidates": _sql([*_PARSE, _ACCEPTED], _NEW_NAMES),
    "k13_metadata": _sql([*_PARSE, _ACCEPTED], _DOCUMENT_ROWS),
    "b3_inspect": _pat("SELECT doc_id, n.page_count, w.n_words, pattern, round(match_rate, 6) AS match_rate, columns FROM (SELECT doc_id, count(*) AS page_count FROM pages GROUP BY ALL) n JOIN (SELECT doc_id, count(*) AS n_words FROM words GROUP BY ALL) w USING (doc_id) JOIN patterns USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(col, ',' ORDER BY rnk) AS columns FROM bands WHERE page = 0 GROUP BY ALL) USING (doc_id)"),
    "c1_bbox_measures": _render("SELECT doc_id, page, word_id, x1 - x0 AS width, bottom - top AS height, (x0 + x1) / 2 AS x_center FROM words"),
    "c2_span_contains": _lay('SELECT w.doc_id, w.page, b.col AS "column", count(*) AS n FROM words w JOIN bands b ON b.doc_id = w.doc_id AND b.page = w.page AND (w.x0 + w.x1) / 2 >= b.x_min AND (w.x0 + w.x1) / 2 <= b.x_max GROUP BY ALL'),
    "c3_span_overlaps": _lay('SELECT w.doc_id, w.page, b.col AS "column", count(*) AS n FROM words w JOIN bands b ON b.doc_id = w.doc_id AND b.page = w.page AND w.x1 > b.x_min AND w.x0 < b.x_max GROUP BY ALL'),
    "c4_span_width": _lay("SELECT doc_id, page, col AS \"column\", x_max - x_min AS width, CASE col WHEN 'part_identifier' THEN 0 WHEN 'description' THEN 1 WHEN 'quantity' THEN 2 WHEN 'uom' THEN 3 WHEN 'mfg_name' THEN 4 WHEN 'mfg_part' THEN 5 ELSE 6 END::BIGINT AS place, NULL::BIGINT AS nowhere FROM bands"),
    "c4_line_center": _line("SELECT doc_id, page, line_no, (y_top + y_bottom) / 2 AS y_center FROM lines"),
    "d1_y_tolerance": _line("SELECT doc_id, page, round(tol, 6) AS tol FROM tolerance"),
    "d2_line_grouping": _line("SELECT doc_id, page, top, line_no FROM fold"),
    "d3_line_finalize": _line("SELECT * FROM lines"),
    "e1_token_norm": _render("SELECT lower(trim(text)) AS token, count(*) AS n FROM words GROUP BY ALL"),
    "e2_phrase_match": _lay('SELECT doc_id, page, line_no, col AS "column", phrase_idx, n_words, start, x0, x1 FROM hits'),
    "e3_row_break_threshold": _lay("SELECT doc_id, page, round(threshold, 6) AS threshold FROM row_breaks"),
    "e4_header_runs": _lay("SELECT * FROM runs"),
    "e5_best_run": _lay("SELECT * FROM best"),
    "e6_best_match_per_column": _lay('SELECT doc_id, page, col AS "column", n_words, x0, x1 FROM matched'),
    "e7_required_columns_check": _lay('SELECT doc_id, page, col AS "column" FROM missing'),
    "e8_suspected_words": _lay("SELECT doc_id, page, missing, words FROM (SELECT doc_id, page, string_agg(col, ',' ORDER BY col) AS missing FROM missing GROUP BY ALL) LEFT JOIN (SELECT p.doc_id, p.page, string_agg(p.text, ' ' ORDER BY p.line_no, p.pos) AS words FROM placed p LEFT JOIN best b USING (doc_id, page) WHERE p.line_no BETWEEN coalesce(b.first_line, 0) AND coalesce(b.last_line, 0) GROUP BY ALL) USING (doc_id, page)"),
    "e9_header_y_band": _lay("SELECT doc_id, page, hdr_top, body_y_top, body_y_bottom FROM layouts"),
    "e10_column_bands": _lay('SELECT doc_id, page, col AS "column", x_min, x_max FROM bands'),
    "e11_column_order": _lay('SELECT doc_id, page, col AS "column", rnk AS "rank" FROM bands'),
    "e12_adjacency_warning": _lay("SELECT doc_id, page, 'non_adjacent_supplier_columns' AS code, distance FROM (SELECT doc_id, page, abs(max(rnk) FILTER (col = 'mfg_name') - max(rnk) FILTER (col = CASE WHEN page % 2 = 0 THEN 'part_identifier' ELSE 'mfg_part' END)) AS distance FROM bands GROUP BY ALL) WHERE distance > 1"),
    "e13_detect_page_layout": _lay('SELECT b.doc_id, b.page, b.col AS "column", b.x_min, b.x_max, b.rnk AS "rank", l.body_y_top FROM bands b JOIN layouts l USING (doc_id, page)'),
    "f1_pool_id_tokens": _pat("SELECT doc_id, page, word_id, token FROM id_tokens"),
    "f2_candidate_filter": _pat("SELECT doc_id, seq, token FROM cands"),
    "f3_token_shape": _pat("SELECT token, count(*) AS n, regexp_replace(regexp_replace(regexp_replace(token, '\\p{L}', 'L', 'g'), '\\p{N}', 'D', 'g'), '[^LD]', 'X', 'g') AS shape FROM id_tokens GROUP BY token"),
    "f4_shape_frequency": _pat("SELECT * FROM shapes"),
    "f5_pattern_synthesis": _pat("SELECT * FROM made"),
    "f6_match_rate": _pat("SELECT doc_id, round(match_rate, 6) AS match_rate FROM patterns"),
    "f7_fallback_pattern": "SELECT doc_id, CASE WHEN doc_id::INT % 3 = 1 THEN '^([A-Z]{2}\\d{6})$' ELSE '^[A-Z]{1,4}\\d{3,8}$' END AS pattern, CASE WHEN doc_id::INT % 3 = 1 THEN 'LLDDDDDD' ELSE '' END AS shapes, CASE WHEN doc_id::INT % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS match_rate, doc_id::INT % 3 <> 1 AS fallback FROM (SELECT DISTINCT s_nationkey::VARCHAR AS doc_id FROM supplier)",
    "g1_body_lines": _rec("SELECT doc_id, page, line_no, y_top FROM body_lines"),
    "g2_record_start": _rec("SELECT doc_id, page, line_no FROM kinds WHERE kind = 'record_start'"),
    "g3_leftmost_part_word": _rec("SELECT doc_id, page, line_no, part_x0, part FROM left_parts"),
    "g4_supplier_row_test": _rec("SELECT doc_id, page, line_no FROM kinds WHERE kind = 'supplier_row'"),
    "g5_classify_line": _rec("SELECT doc_id, page, line_no, kind FROM kinds"),
    "g6_record_assignment": _rec("SELECT doc_id, page, line_no, record_seq FROM assigned"),
    "g7_per_record_layout": _rec("SELECT doc_id, record_seq, page, word_id, start_page, q_a AS quantity_min, q_b AS quantity_max FROM cont"),
    "g8_depth": _rec("SELECT * FROM depths"),
    "g9_parent": _rec("SELECT doc_id, record_seq, internal_part, depth, parent FROM records"),
    "g10_description": _rec("SELECT * FROM descriptions"),
    "g11_quantity": _rec("SELECT * FROM quantities"),
    "g12_uom": _rec("SELECT * FROM units"),
    "g13_commodity": _rec("SELECT * FROM commodities"),
    "g14_finalize_record": _rec("SELECT * FROM records"),
    "g15_can_assemble": _lay("SELECT doc_id, page, bool_or(col = 'part_identifier') AND bool_or(col = 'mfg_part') AS ok FROM bands GROUP BY ALL"),
    "h1_supplier_name": _rec("SELECT doc_id, record_seq, row_pos, name_text FROM supplier_rows"),
    "h2_part_text": _rec("SELECT doc_id, record_seq, row_pos, part_text, page, line_y FROM supplier_rows"),
    "i1_hard_reject": _tok("SELECT seq, hard AS reason FROM scored"),
    "i2_weighted_confidence": _tok("SELECT seq, round(raw, 6) AS confidence FROM conf WHERE t <> ''"),
    "i3_clean_token_ratio": _tok("SELECT seq, round(ratio, 6) AS ratio FROM scores WHERE t <> ''"),
    "i4_min_confidence": _tok("SELECT seq, confidence, reason FROM scored"),
    "i5_is_internal_flag": _tok("SELECT seq, is_internal FROM scored"),
    "i6_is_accepted": _tok("SELECT seq, token FROM scored WHERE reason IS NULL"),
    "j1_pre_normalize": _nam("SELECT seq, key FROM named"),
    "j2_alias_lookup": _nam("SELECT seq, key, canonical FROM named LEFT JOIN known_keys USING (key)"),
    "j3_acronym_match": _nam("SELECT seq, canonical AS by_initials FROM named LEFT JOIN spelled ON letters = trim(raw_name) AND regexp_matches(trim(raw_name), '^[A-Z]{2,4}$')"),
    "j5_mint_canonical": _nam("SELECT seq, CASE WHEN len(trim(raw_name)) <= 4 AND regexp_matches(raw_name, '\\p{Lu}') AND NOT regexp_matches(raw_name, '\\p{Ll}') THEN trim(raw_name) ELSE array_to_string(list_transform(list_filter(string_split_regex(trim(raw_name), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w[2:], '\\p{Ll}') AND regexp_matches(w, '\\p{Lu}') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS minted FROM named"),
    "j6_memoisation": _nam("SELECT doc_id, raw_name, min(seq) AS first_seq FROM raw_names GROUP BY ALL"),
    "k1_clean_description": _ord("SELECT doc_id, record_seq, array_to_string(list_filter(string_split(description, ' '), lambda t: NOT regexp_matches(t, '^([A-Z]{1,2}|\\d)$') AND t <> coalesce(commodity, '')), ' ') AS cleaned FROM recs"),
    "k2_description_key": _ord("SELECT doc_id, record_seq, lower(description) || ' x' AS key FROM recs"),
    "k3_drop_empty_key": _ord("SELECT doc_id, record_seq, key FROM ks WHERE record_seq % 4 <> 0"),
    "k4_group_by_description": _ord("SELECT doc_id, key, first_seq, description FROM grouped"),
    "k5_total_quantity": _ord("SELECT doc_id, key, total_quantity, n_occurrences FROM grouped"),
    "k6_first_uom": _ord("SELECT doc_id, key, uom, commodity FROM grouped"),
    "k7_internal_parts": _ord("SELECT doc_id, key, string_agg(internal_part, '|' ORDER BY seq) AS parts FROM (SELECT doc_id, key, internal_part, min(record_seq) AS seq FROM ks GROUP BY ALL) GROUP BY ALL"),
    "k8_occurrences": _ord("SELECT doc_id, key, string_agg(internal_part || ':' || printf('%.2f', coalesce(quantity, 0)::DOUBLE), '|' ORDER BY record_seq) AS occurrences FROM ks GROUP BY ALL"),
    "k9_score_and_filter_suppliers": _ord("SELECT doc_id, key, record_seq, part_text, 0.6::DOUBLE AS confidence FROM offers WHERE reason IS NULL"),
    "k10_dedupe_suppliers": _ord("SELECT doc_id, key, canonical, part_text, record_seq FROM unique_offers"),
    "k11_hard_rejected": _ord("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY group_seq, record_seq) - 1 AS INT) AS nth, part_text AS token, reason, 0 AS page, 0 AS \"row\" FROM offers WHERE reason = 'date_shaped'"),
    "k12_dedupe_warnings": _pat("SELECT doc_id, code, page FROM (SELECT p.doc_id, 0 AS k, p.page, 'ocr_fallback_used' AS code FROM pages p LEFT JOIN words w USING (doc_id, page) GROUP BY ALL HAVING count(w.text) < 90 UNION ALL SELECT doc_id, 2, NULL, 'low_confidence_internal_pattern' FROM patterns WHERE fallback) QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY k, page NULLS FIRST) = 1"),
    "k14_assemble_document": _sql([*_PARSE, _ACCEPTED], _PART_ROWS),
    "k15_contract_validation": _rec("SELECT doc_id, arg_min(cleaned, record_seq) AS description, 'total_quantity' AS rule FROM keyed GROUP BY doc_id, key HAVING min(record_seq) % 7 = 0"),
    "l1_occurrence_lines": _ord("SELECT k.doc_id, g.first_seq, CAST(row_number() OVER (PARTITION BY k.doc_id, k.key ORDER BY k.record_seq) - 1 AS INT) AS occ_idx, k.internal_part || '  |  ' || CASE WHEN len(g.description) > 24 THEN g.description[1:21] || '...' ELSE g.description END || '  |  ' || coalesce(s.names, '(none)') AS line FROM ks k JOIN grouped g USING (doc_id, key) LEFT JOIN (SELECT doc_id, key, string_agg(canonical || ' ' || part_text, '; ' ORDER BY group_seq, record_seq) AS names FROM unique_offers GROUP BY ALL) s USING (doc_id, key)"),
    "l2_inspect_counts": _render("SELECT doc_id, page_count, n_words FROM (SELECT doc_id, count(*) AS page_count FROM pages GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS n_words FROM words GROUP BY ALL) USING (doc_id)"),
}
SQL["b4_write_summary"] = f"SELECT line AS value, count(*) AS n FROM ({SQL['l1_occurrence_lines']}) GROUP BY line"

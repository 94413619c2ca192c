"""SQL that gives the same rows as the registered queries."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 3 * source_size AS most,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM sources
), leveled AS (
  SELECT *, row_number() OVER room AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (room ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM weighed
  WINDOW room AS (ORDER BY CAST(most AS DOUBLE) / weight, source ASC NULLS LAST)
), aimed AS (
  SELECT source, source_size,
         least(CAST(most AS DOUBLE),
               (SELECT arg_min(lvl, place) FROM leveled WHERE NOT CAST(most AS DOUBLE) / weight < lvl) * weight) AS target
  FROM leveled
), ranked AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5(coalesce('s' || s.source, 'n') || ':0'), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(CAST(s.doc_id AS VARCHAR))) AS k
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(u + rate * k) - floor(u + rate * (k - 1)), 3) AS BIGINT) * size AS taken
FROM ranked
"""

ORACLES["op2_lines"] = r"""
WITH parts AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS shown FROM parts
), spread AS (
  SELECT shown, min(struct_pack(d := doc_id, p := place)) AS origin
  FROM keyed WHERE shown <> '' GROUP BY shown HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 10
), marked AS (
  SELECT k.*, s.shown IS NOT NULL AND (s.origin.d <> k.doc_id OR s.origin.p <> k.place) AS gone
  FROM keyed k LEFT JOIN spread s ON k.shown = s.shown
), kept AS (
  SELECT doc_id, CAST(count(*) FILTER (shown <> '') AS BIGINT) AS n_lines,
         CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLES["op13_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM docs GROUP BY text
), flagged AS (
  SELECT d.doc_id, d.part,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text))::INT
         + 8 * regexp_matches(d.text, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > f.least, false)::INT AS bits
  FROM docs d JOIN firsts f ON d.text = f.text
), judged AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
  FROM labels GROUP BY doc_id
), combos AS (
  SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flagged f LEFT JOIN judged j ON f.doc_id = j.doc_id GROUP BY part, bits
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS own,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, CAST(i AS INT), 1)) - 1))), 0)::BIGINT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
)
SELECT part, filter_order, CAST(step AS INT) AS step,
       CAST(coalesce(sum(n) FILTER ((bits & own) = 0 AND (bits & before) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER ((bits & own) <> 0 AND (bits & before) = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER ((bits & own) <> 0 AND (bits & before) <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (bits = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER ((bits & own) <> 0 AND (bits & before) = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER ((bits & own) <> 0 AND (bits & before) = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(sum(n) FILTER ((bits & own) <> 0 AND (bits & before) = 0), 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM combos, steps
GROUP BY part, filter_order, step, own
"""

ORACLES["op11_merkle"] = r"""
WITH RECURSIVE coded AS (
  SELECT doc_id, source, lang, n_chars, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
         coalesce(strlen(text) || ':' || text, '-') AS after,
         -- CRC-32 of the decimal id, a bit at a time: 256 stands for the end of a byte's eight shifts
         list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [ascii(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
           lambda crc, x: CASE WHEN x < 256 THEN xor(crc, x)
                               WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(before || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || after) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0
              THEN sha256(before || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || after)
         END AS tampered
  FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), nodes AS (
  SELECT lang, 0 AS k, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, k + 1, pos // 2, sha256(node || coalesce(other, '')), (n + 1) // 2
  FROM (SELECT *, lead(node) OVER (PARTITION BY lang, k ORDER BY pos) AS other FROM nodes WHERE n > 1)
  WHERE pos % 2 = 0
), subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS k, pos, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT k + 1, pos // 2, sha256(node || coalesce(other, '')), (n + 1) // 2
  FROM (SELECT *, lead(node) OVER (PARTITION BY k ORDER BY pos) AS other FROM tops WHERE n > 1)
  WHERE pos % 2 = 0
), walked AS (
  SELECT p.lang, p.pos AS leaf_pos, s.k, xor(p.pos >> s.k, 1) AS side, (p.pos >> s.k) % 2 AS odd
  FROM placed p JOIN (SELECT DISTINCT lang, k FROM nodes WHERE n > 1) s ON p.lang IS NOT DISTINCT FROM s.lang
), proofs AS (
  SELECT w.lang, w.leaf_pos, list(CASE WHEN odd = 1 THEN '<' ELSE '>' END || coalesce(o.node, '') ORDER BY w.k) AS steps
  FROM walked w LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM w.lang AND o.k = w.k AND o.pos = w.side
  GROUP BY w.lang, w.leaf_pos
), top_proofs AS (
  SELECT s.lang, list(CASE WHEN (s.pos >> t.k) % 2 = 1 THEN '<' ELSE '>' END || coalesce(o.node, '') ORDER BY t.k) AS steps
  FROM subroots s, (SELECT DISTINCT k FROM tops WHERE n > 1) t
  LEFT JOIN tops o ON o.k = t.k AND o.pos = xor(s.pos >> t.k, 1)
  GROUP BY s.lang
), proven AS (
  SELECT p.doc_id, p.leaf, p.tampered, s.subroot, (SELECT node FROM tops WHERE n = 1) AS root,
         list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM placed p
  JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN proofs a ON a.lang IS NOT DISTINCT FROM p.lang AND a.leaf_pos = p.pos
  LEFT JOIN top_proofs b ON b.lang IS NOT DISTINCT FROM p.lang
), folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(tampered, leaf), steps),
                        lambda own, s: sha256(CASE WHEN s[1] = '<' THEN s[2:] || own ELSE own || s[2:] END)) AS folded_root
  FROM proven
)
SELECT doc_id, leaf, subroot, root,
       sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

"""DuckDB statements of the operators that SQL can express, written from the contracts alone."""

STOP = (
    "'the','of','and','to','in','a','is','that','for','on','with','as','was','are','by','be','this','at','or','from','it','an','have','not',"
    "'de','la','le','les','et','des','en','un','une','du','que','qui','dans','pour','par','sur','au','aux','il','elle','est','pas','avec','ce',"
    "'der','die','das','und','von','zu','den','mit','ist','im','dem','ein','eine','nicht','für','auf','sich','als','auch','es','werden',"
    "'el','los','las','y','del','se','por','una','con','para','no','su','al','lo','como','más',"
    "'di','che','non','per','sono','della',"
    "'os','não','uma','com','foi','mais',"
    "'het','een','van','dat','niet','zijn',"
    "'och','att','det','som','är','på',"
    "'og','er','ikke','til','af','av',"
    "'ja','ei','että','oli','mutta',"
    "'na','nie','się','że','jest','do',"
    "'je','že','jsem','tak','ako',"
    "'és','hogy','nem','egy','az','volt',"
    "'și','în','nu','cu','care','este',"
    "'ve','bir','bu','için','ile','da',"
    "'yang','dan','ini','itu','dengan','untuk',"
    "'và','của','là','có','không','được',"
    "'ya','wa','kwa','ni','katika',"
    "'koji','kako','ki',"
    "'ir','kad','yra','ar'"
)

OP2 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i
  FROM d
), g AS (
  SELECT rid, i, w, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g,
         lead(w, 4) OVER o IS NOT NULL AS whole
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE whole) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid
), agg AS (
  SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars,
         sum((lower(rtrim(w, '.,;:!?')) IN ({STOP}))::INT) AS n_stop,
         sum((upper(w) = w AND lower(w) <> w AND length(w) > 1)::INT) AS n_upper, sum((w = before)::INT) AS n_adjacent
  FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY rid ORDER BY i), '') AS before FROM w) GROUP BY rid
), l AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d
), ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), x AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, octet_length(encode(t)) AS n_bytes, length(t) AS n_chars, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, coalesce(n_upper, 0) AS n_upper, coalesce(n_adjacent, 0) AS n_adjacent,
         coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN agg USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN covered c USING (rid)
), y AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND coalesce(2 * n_bytes >= 3 * n_chars OR word_chars::DOUBLE / nullif(n_words, 0) BETWEEN 2.0 AND 14.0, true)
       AND coalesce(n_symbols::DOUBLE / nullif(n_words, 0) <= 0.25, true)
       AND (n_words < 40 OR 2 * n_bytes >= 3 * n_chars OR n_stop::DOUBLE / n_words >= 0.02)
       AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0) <= 0.6, true)
       AND coalesce(n_adjacent::DOUBLE / nullif(n_words, 0) <= 0.3, true)
       AND (n_words < 20 OR n_upper::DOUBLE / n_words <= 0.6) AS kept
FROM y
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, coalesce(k.doc_id <> hot.last, false) AS gone FROM k LEFT JOIN hot USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

OP4 = r"""
WITH low AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM item WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), dg AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM low, sizes WHERE len(ws) >= n)
), hit AS (
  SELECT rid, item_id, i, dg.n FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g
), w AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN w USING (rid) LEFT JOIN its USING (rid)
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), p(kind, ord, pat, grp, least) AS (
  VALUES ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
         ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24), ('word', 3, '[A-Za-z0-9+/_=-]{20,}', 0, 20)
), m AS (
  SELECT rid, 0 AS ord, 'assign' AS kind, regexp_extract_all(t, (SELECT pat FROM p WHERE ord = 0), 0) AS ms, regexp_extract_all(t, (SELECT pat FROM p WHERE ord = 0), 2) AS gs, string_split_regex(t, (SELECT pat FROM p WHERE ord = 0)) AS gaps FROM d
  UNION ALL
  SELECT rid, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT rid, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL
  SELECT rid, 3, 'entropy', regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}') FROM d
), x AS (
  SELECT rid, ord, kind, unnest(ms) AS w, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS k FROM m
), y AS (
  SELECT rid, ord, kind, w, g, sum(length(gap) + length(w)) OVER (PARTITION BY rid, ord ORDER BY k) - length(w) AS s FROM x
), base AS (
  SELECT rid, ord, kind, s::INT AS s, (s + length(w))::INT AS e FROM y WHERE length(g) >= (CASE ord WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 END)
), cand AS (
  SELECT * FROM (
    SELECT rid, w, s::INT AS s, CASE
      WHEN regexp_full_match(w, '[0-9]+') THEN 2.9
      WHEN regexp_full_match(w, '[0-9a-fA-F]+') AND regexp_matches(w, '[0-9]') THEN 2.9
      WHEN regexp_full_match(w, '[A-Za-z]+') AND lower(w) <> w AND upper(w) <> w THEN 3.95
      WHEN regexp_full_match(w, '[A-Za-z0-9]+') AND (lower(w) = w OR upper(w) = w) THEN 3.5
      WHEN regexp_full_match(w, '[A-Za-z0-9]+') THEN 3.7
      WHEN regexp_matches(w, '[0-9]') THEN 3.7 END AS bits
    FROM y WHERE ord = 3 AND NOT regexp_matches(w, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AND NOT regexp_matches(w, '(?i)^(sha1|sha256|sha384|sha512|md5)[-=]')
      AND NOT regexp_matches(w, '^[/_=-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})([/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[/_=-]*$') AND NOT regexp_full_match(w, '([a-z]{2,})?([A-Z][a-z]{2,})*')
  ) WHERE bits IS NOT NULL
), win AS (
  SELECT rid, w, s, bits, unnest(range(0, length(w) - 19)) AS i FROM cand
), ch AS (
  SELECT rid, s, i, bits, c, count(*) AS n FROM (SELECT rid, s, i, bits, unnest(string_split(substr(w, i + 1, 20), '')) AS c FROM win) GROUP BY ALL
), ent AS (
  SELECT rid, s, i FROM ch GROUP BY rid, s, i, bits HAVING -sum(n / 20 * log2(n / 20)) >= bits
), extra AS (
  SELECT rid, 3 AS ord, 'entropy' AS kind, (s + a)::INT AS s, (s + b)::INT AS e
  FROM (SELECT rid, s, min(i) AS a, max(i) + 20 AS b FROM ent GROUP BY rid, s) JOIN cand USING (rid, s)
  WHERE NOT regexp_matches(substr(w, a + 1, b - a), '(?i)example|changeme|placeholder|your_|xxxx|dummy')
), spans AS (
  SELECT * FROM base
  UNION ALL
  SELECT * FROM extra AS x WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.rid = x.rid AND b.s < x.e AND x.s < b.e)
), a AS (
  SELECT rid, count_if(ord = 0) AS na, count_if(ord = 1) AS nk, count_if(ord = 2) AS nh,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS x
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nk, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""

OP5 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), f AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest, min(page_id) OVER (PARTITION BY b) AS first FROM p
), r AS (
  SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r
"""

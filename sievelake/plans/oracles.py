"""The catalogue's queries in plain SQL (DuckDB), written from their definitions, not from the plans."""

from __future__ import annotations

from sievelake.functions.severity import EMOJI
from sievelake.plans import carriers, catalogue


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def pick(key: str, values) -> str:
    """values[key % n] as a CASE; line breaks by chr(), as a literal would do too."""
    return f"(CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values)) + " END)"


ITEMS = """items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS ord FROM lineitem
)"""
FINDINGS = f"""{ITEMS}, findings AS (
  SELECT 'f' || l_orderkey || '.py' AS file, ord, 'RULE-00' || (l_partkey % 6 + 1) AS check_id,
         {pick("l_suppkey", ("cloud_llm", "local_llm", "rules", "rules", "rules"))} AS tier, {pick("l_suppkey", ("house", "ruff", "eslint", "semgrep"))} AS source,
         CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'low' WHEN 'RF' THEN 'medium' WHEN 'AF' THEN 'high' WHEN 'NF' THEN 'critical' ELSE 'info' END AS severity,
         {pick("l_partkey", carriers.TITLES)} AS title, l_linenumber::INT AS line_start,
         CASE l_suppkey % 3 WHEN 1 THEN l_linenumber WHEN 2 THEN l_linenumber + 1 END::INT AS line_end, l_orderkey
  FROM items
), ranked AS (
  SELECT *, CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS rank FROM findings
)"""
CHANGED = "CASE {0} % 3 WHEN 1 THEN []::INT[] WHEN 2 THEN range(1, 42, 2)::INT[] END"
SEVERITIES = ("info", "low", "medium", "high", "critical")


def snippets(parts, suffix: str, only: int | None = None) -> str:
    """CTEs: lines before each snippet of a file, and the findings that the snippets have, in scope."""
    sizes = ", ".join(f"({k}, {s.count(chr(10))})" for k, (s, _) in enumerate(parts))
    hits = ", ".join(f"({k}, {r}, {a}, {e}, '{level}', {s.count(chr(10)) if r == 18 else 1})" for k, (s, found) in enumerate(parts) for r, a, e, level in found if only in (None, r))
    return f"""WITH {ITEMS}, sizes(t, n) AS (VALUES {sizes}), hits(t, rule, a, e, severity, span) AS (VALUES {hits}), placed AS (
  SELECT l_orderkey, t, sum(n) OVER (PARTITION BY l_orderkey ORDER BY ord) - n AS before FROM items JOIN sizes ON t = (l_partkey + l_suppkey) % {len(parts)}
), found AS (
  SELECT 'f' || l_orderkey || '{suffix}' AS file, rule, 'RULE-' || lpad(rule::VARCHAR, 3, '0') AS check_id, severity, (before + a)::INT AS line_start, (before + e)::INT AS line_end, {CHANGED.format("l_orderkey")} AS changed, span
  FROM placed JOIN hits USING (t)
), scoped AS (
  SELECT * FROM found WHERE changed IS NULL OR len(list_filter(changed, lambda x: x BETWEEN line_start AND line_start + span - 1)) > 0
)"""


def call_lines() -> str:
    rows = ", ".join(f"({k}, {i + 1}, {f == 'c'}, {f == 'h'})" for k, (_, flags) in enumerate(carriers.CALLS) for i, f in enumerate(flags))
    return f"""WITH {ITEMS}, snippet(t, i, is_call, handled) AS (VALUES {rows}), lines AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord, i) AS n, is_call, handled FROM items JOIN snippet ON t = (l_partkey + l_suppkey) % {len(carriers.CALLS)}
), w AS (
  SELECT *, bool_or(handled) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS safe,
         count(*) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS size, {CHANGED.format("l_orderkey")} AS changed FROM lines
)
SELECT 'f' || l_orderkey || '.js' AS file, 'RULE-015' AS check_id, n::INT AS line_start FROM w
WHERE is_call AND NOT safe AND (changed IS NULL OR len(list_filter(changed, lambda x: x BETWEEN n AND n + size - 1)) > 0)"""


SECRET = r"""(?i)(?:api_?key|secret|passw(?:or)?d|passwd|token|private_?key)["'']?\s*[:=]\s*["'']([^"''\s]{6,})["'']"""
PLACEHOLDER = r"(?i)^(change_?me|example.*|your[_-].*|placeholder|dummy|x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|none|null|test)$"

#: The diffs of the customers, block by block.
BLOCKS = f"""blocks AS (
  SELECT o_custkey AS diff_id, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k,
         replace({pick("o_orderkey", ("app/m%d.py", "tests/test_m%d.py", "web/x%d.tsx", "café%d.py", "w x/c%d.js", "lib/contest%d.js"))}, '%d', o_orderkey::VARCHAR) AS path,
         CASE o_orderkey % 5 WHEN 0 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'modified' END AS status,
         o_orderkey % 9 = 8 AS unread, o_orderkey % 7 + (o_orderkey % 11 = 0)::INT + (o_orderkey % 4 = 1)::INT AS added,
         o_orderkey % 11 = 0 AS marked, o_orderkey % 4 = 1 AS stub
  FROM orders
)"""
PRIOR = """p AS (
  SELECT o_orderkey AS o, CASE WHEN o_orderkey % 13 = 0 THEN 'a: b/' || o_orderkey ELSE 'f' || o_orderkey || '.py' END AS path FROM orders
), done AS (
  SELECT path, o FROM p WHERE o % 3 <> 0 AND o % 5 <> 0 AND NOT (o % 7 = 0 AND o % 2 = 0)
)"""


def unquote_values() -> str:
    made = ("café.py", 'weird"name\\.py', "plain/path.py", "tab\there", r'"bad\377"', r'"open', "", r"a\qb", "AB")
    return f"SELECT n_nationkey, {pick('n_nationkey', catalogue.QUOTED_PATHS)} AS raw, {pick('n_nationkey', made)} AS path FROM nation"


def greedy_merge() -> str:
    """Each finding of a file joins the first one before it that it duplicates: a fold over the file's findings, a list of one struct each."""
    fields = ("ord", "check_id", "tier", "source", "rank", "title", "line_start", "line_end", "also", "tp", "last", "ev")
    same = lambda o: f"""CASE WHEN {o}.check_id = x[1].check_id AND {o}.source = x[1].source THEN {o}.line_start = x[1].line_start AND {o}.last = x[1].last
      ELSE x[1].line_start - 2 <= {o}.last AND {o}.line_start - 2 <= x[1].last AND ({o}.title = x[1].title OR ({o}.ev AND x[1].ev)) END"""  # noqa: E731
    special = lambda a, b: {"ord": "o.ord", "rank": "greatest(o.rank, x[1].rank)", "also": f"{a}.also || [{b}.source || ':' || {b}.check_id]"}
    pair = lambda a, b: "{" + ", ".join(f"'{k}': {special(a, b).get(k, f'{a}.{k}')}" for k in fields) + "}"
    own = "{" + ", ".join(f"'{k}': {'[]::VARCHAR[]' if k == 'also' else k}" for k in fields) + "}"
    return f"""WITH {FINDINGS}, s AS (
  SELECT *, CASE tier WHEN 'cloud_llm' THEN 3 WHEN 'local_llm' THEN 2 ELSE 1 END AS tp, coalesce(nullif(line_end, 0), line_start) AS last, title LIKE '%eval()%' AS ev FROM ranked
), l AS (
  SELECT file, list([{own}] ORDER BY ord) AS xs FROM s GROUP BY file
), m AS (
  SELECT file, unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: {same("o")})) = 0 THEN acc || x ELSE
    list_transform(acc, lambda o, i: CASE WHEN i = list_position(list_transform(acc, lambda p: {same("p")}), true) THEN CASE WHEN x[1].tp > o.tp THEN {pair("x[1]", "o")} ELSE {pair("o", "x[1]")} END ELSE o END) END)) AS y FROM l
)
SELECT file, y.ord AS ord, y.check_id AS check_id, y.tier AS tier, y.source AS source, ({list(SEVERITIES)})[y.rank + 1] AS severity, y.title AS title, y.line_start AS line_start, y.line_end AS line_end,
       CASE WHEN len(y.also) > 0 THEN y.also END AS also_flagged_by FROM m"""


ORACLE_SQL: dict[str, str] = {
    "merge_fuzzy": greedy_merge(),
    "credential_lines": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS lineno FROM documents)
SELECT doc_id, lineno, 'RULE-009' AS check_id FROM l WHERE len(list_filter(regexp_extract_all(line, '{SECRET}', 1), lambda x: NOT regexp_matches(x, '{PLACEHOLDER}'))) > 0""",
    "audit_manifest": "SELECT path, 'scanned' AS status FROM (SELECT 'f' || o_orderkey || '.py' AS path FROM orders UNION SELECT 'f' || l_orderkey || '.py' FROM lineitem) ORDER BY path",
    "text_line_explode": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS lineno, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> '')
SELECT doc_id, lineno, line FROM l WHERE lineno < n OR line <> ''""",
    "file_hashes": "SELECT 'documents/' || doc_id AS path, sha256(coalesce(text, '')) AS sha256 FROM documents UNION ALL SELECT 'pages/' || page_id, sha256(coalesce(html, '')) FROM pages",
    "size_cap_split": """
WITH d AS (SELECT 'doc/' || doc_id AS path, text, len(string_split(text, chr(10))) AS n FROM documents)
SELECT path, text IS NOT NULL AND n <= 6 AS kept, CASE WHEN text IS NULL THEN 'cloud_llm: ' || path || ': could not read file' WHEN n > 6 THEN 'cloud_llm: ' || path || ': file too large (' || n || ' lines > 6)' END AS entry FROM d""",
    "admission_cap": """
WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F')
SELECT cap::INT AS cap, forced, CASE WHEN NOT forced AND n > cap THEN n END AS n_over FROM n, (VALUES (50), (1000), (1000000000)) AS c(cap), (VALUES (true), (false)) AS f(forced)""",
    "suffix_filter": """
WITH t AS (SELECT 'src/f' || o_orderkey || (CASE o_orderkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.tsx' WHEN 3 THEN '.md' ELSE '.PY' END) AS path, o_orderkey % 5 AS k FROM orders WHERE o_orderstatus <> 'F')
SELECT path, runner FROM t JOIN (VALUES (0, 'ruff'), (1, 'eslint'), (2, 'eslint'), (0, 'house'), (1, 'house')) AS r(k, runner) USING (k)""",
    "js_line_rules": f"{snippets(carriers.SCRIPT, '.js')} SELECT file, check_id, severity, line_start FROM scoped",
    "call_guard_window": call_lines(),
    "py_ast_rules": f"{snippets(carriers.PYTHON, '.py')} SELECT file, check_id, severity, line_start, line_end FROM scoped",
    "permission_reachability": f"{snippets(carriers.GUARDS, '.py', 3)} SELECT file, check_id, severity, line_start FROM scoped",
    "severity_parse": f"""
WITH s AS (SELECT o_orderkey, {pick("o_orderkey", ("high", "medium", "low", "medium", "medium", "critical", "medium", "info"))} AS severity FROM orders)
SELECT o_orderkey, severity, (list_position({list(SEVERITIES)}, severity) - 1)::INT AS severity_rank FROM s""",
    "severity_maps": f"""
SELECT p_partkey, {pick("p_partkey", ("high", "high", "high", "medium", "medium", "low", "high", "low"))} AS ruff, {pick("p_partkey", ("high", "medium", "low", "medium", "medium"))} AS semgrep,
       CASE WHEN p_partkey % 3 = 2 THEN 'medium' ELSE 'low' END AS eslint, (CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END)::INT AS tier_priority FROM part""",
    "line_scope_exact": f"WITH {FINDINGS} SELECT file, ord, line_start FROM findings WHERE l_orderkey % 3 = 0 OR (l_orderkey % 3 = 2 AND line_start % 2 = 1)",
    "line_scope_range": f"WITH {FINDINGS} SELECT file, ord, line_start, line_end FROM findings WHERE l_orderkey % 3 = 0 OR (l_orderkey % 3 = 2 AND (line_start % 2 = 1 OR coalesce(line_end, line_start) > line_start))",
    "line_scope_tolerance": f"""WITH {FINDINGS} SELECT file, ord, (line_start * 5 + 30)::INT AS line FROM findings
WHERE l_orderkey % 3 = 0 OR (l_orderkey % 3 = 2 AND len(list_filter(range(1, 42, 2), lambda x: x >= line_start * 5 + 28 AND x <= line_start * 5 + 32 + (line_end IS NOT NULL)::INT)) > 0)""",
    "linter_join": f"""WITH {FINDINGS}, s AS (
  SELECT f.* FROM findings AS f JOIN orders ON f.l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND (l_orderkey % 3 = 0 OR (l_orderkey % 3 = 2 AND line_start % 2 = 1))
)
SELECT file, 'RUFF-' || {pick("l_orderkey", ("S101", "E501", "F401"))} AS check_id, 'ruff' AS source, {pick("l_orderkey", ("high", "low", "medium"))} AS severity, {pick("l_orderkey", ("S101", "E501", "F401"))} || ': ' || title AS title, line_start, line_end FROM s WHERE l_orderkey % 3 = 0
UNION ALL
SELECT file, 'ESLINT-' || r, 'eslint', CASE WHEN ord % 3 = 2 THEN 'medium' ELSE 'low' END, r || ': ' || title, line_start, line_end FROM (SELECT *, coalesce(nullif(check_id, 'RULE-001'), 'unknown') AS r FROM s) WHERE l_orderkey % 3 = 1
UNION ALL
SELECT file, 'SEMGREP-' || check_id, 'semgrep', {pick("ord", ("high", "medium", "low", "medium"))}, title, line_start, line_end FROM s WHERE l_orderkey % 3 = 2""",
    "hunk_lines": f"""WITH {ITEMS}, l AS (
  SELECT l_orderkey AS o, ord, l_partkey % 7 AS kind, CASE WHEN ord >= 4 THEN 1 ELSE 0 END AS hunk, CASE WHEN ord >= 4 THEN 20 ELSE l_orderkey % 4 END AS first FROM items
), n AS (
  SELECT *, first + coalesce(sum(CASE WHEN kind = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY o, hunk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM l
)
SELECT o, list_sort(list(DISTINCT line::INT)) AS lines FROM n WHERE first > 0 AND kind IN (0, 1, 6) GROUP BY o""",
    "diff_split_header": f"""WITH {BLOCKS}
SELECT diff_id, path, status, CASE WHEN status = 'renamed' THEN path END AS old_path, (added + CASE WHEN stub THEN 0 ELSE 1 END)::INT AS n_changed FROM blocks WHERE NOT unread""",
    "added_line_count": f"WITH {BLOCKS} SELECT diff_id, count(*) AS n_blocks, sum(added)::BIGINT AS n_added FROM blocks GROUP BY diff_id",
    "test_coverage_gate": f"""WITH {BLOCKS}, t AS (
  SELECT *, o % 6 = 1 AS is_test, status <> 'deleted' AS alive FROM blocks WHERE NOT unread
), r AS (
  SELECT *, is_test AND alive AND (CASE WHEN marked THEN true WHEN stub AND added < 15 THEN false WHEN added > 15 THEN true ELSE status = 'modified' AND added > 0 END) AS real FROM t
)
SELECT diff_id, arg_max(path, added * 1000000 - k) FILTER (alive AND NOT is_test) AS file, sum(added) FILTER (alive AND NOT is_test)::BIGINT AS n_added, count(*) FILTER (alive AND NOT is_test) AS n_files
FROM r GROUP BY diff_id HAVING sum(added) FILTER (alive AND NOT is_test) >= 5 AND NOT bool_or(real)""",
    "git_unquote": unquote_values(),
    "counts_by_severity": f"""WITH {FINDINGS}
SELECT severity, k::INT AS severity_rank, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('info', 0), ('low', 1), ('medium', 2), ('high', 3), ('critical', 4)) AS s(severity, k) LEFT JOIN (SELECT severity, count(*) AS n FROM findings WHERE severity <> 'info' GROUP BY severity) USING (severity)""",
    "findings_by_file": f"WITH {FINDINGS} SELECT file, count(*) AS n, count(DISTINCT check_id) AS n_checks, ({list(SEVERITIES)})[max(rank) + 1] AS worst FROM ranked GROUP BY file",
    "merge_exact_duplicates": f"""WITH {FINDINGS}
SELECT file, check_id, source, line_start, ({list(SEVERITIES)})[max(rank) + 1] AS severity, (count(*) - 1)::INT AS n_also FROM ranked GROUP BY file, check_id, source, line_start, coalesce(line_end, line_start)""",
    "title_similarity": f"""
WITH t AS (SELECT p_partkey, {pick("p_partkey", carriers.TITLES)} AS a, {pick(f"(p_partkey // {len(carriers.TITLES)})", carriers.TITLES)} AS b FROM part)
SELECT p_partkey, a, b, a = b OR (a LIKE '%eval()%' AND b LIKE '%eval()%') AS similar FROM t""",
    "final_sort": f"WITH {FINDINGS} SELECT row_number() OVER (ORDER BY rank DESC, file, line_start, ord) AS place, file, ord, severity, line_start FROM ranked",
    "fail_gate": f"WITH {FINDINGS}, l AS (SELECT unnest({list(SEVERITIES)}) AS level, unnest(range({len(SEVERITIES)})) AS k) SELECT file, level, count(*) AS n FROM ranked JOIN l ON rank >= k GROUP BY file, level",
    "exit_codes": f"""WITH {FINDINGS}, l AS (SELECT unnest({list(SEVERITIES)}) AS level, unnest(range({len(SEVERITIES)})) AS k), w AS (SELECT source, max(rank) AS worst FROM ranked WHERE severity <> 'critical' OR source <> 'ruff' GROUP BY source)
SELECT source, level, (worst >= k)::INT AS code FROM w, l""",
    "report_totals": f"WITH {FINDINGS} SELECT count(*) AS n_findings, count(DISTINCT file) AS n_files FROM findings",
    "report_summary": f"WITH {FINDINGS} SELECT severity, rank::INT AS severity_rank, count(*) AS n FROM ranked WHERE severity <> 'low' GROUP BY ALL",
    "report_json": f"""WITH {FINDINGS}
SELECT row_number() OVER (ORDER BY rank DESC, file, line_start, ord) AS place, json_object('check_id', check_id, 'tier', tier, 'source', source, 'severity', severity, 'title', title, 'explanation', 'say "' || title || '"' || chr(10),
  'file', file, 'line_start', line_start, 'line_end', line_end, 'suggestion', NULL, 'raw', CASE WHEN ord % 2 = 0 THEN json_object('ord', ord) END, 'also_flagged_by', NULL)::VARCHAR AS json FROM ranked""",
    "console_text": r"""
SELECT conv_id, turn, replace(regexp_replace(regexp_replace('[red]' || coalesce(text, '') || chr(27) || '[0m', '[\r\n\t]+', ' ', 'g'), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g'), '[', '\[') AS text FROM conversations""",
    "item_statuses": "SELECT CASE WHEN l_returnflag = 'R' THEN 'renamed' WHEN l_linestatus = 'O' THEN 'added' WHEN l_returnflag = 'A' THEN 'deleted' ELSE 'modified' END AS status, count(*) AS n FROM lineitem GROUP BY 1",
    "touching_ranges": f"""WITH {FINDINGS}, p AS (SELECT file, ord, line_start AS s, coalesce(line_end, line_start) AS e, lag(line_start) OVER o AS a, lag(coalesce(line_end, line_start)) OVER o AS b FROM findings WINDOW o AS (PARTITION BY file ORDER BY ord))
SELECT file, ord, s - 2 <= b AND a - 2 <= e AS touches FROM p WHERE a IS NOT NULL""",
    "merged_raw": f"WITH {FINDINGS} SELECT file, check_id, source, line_start, check_id AS raw_check, (count(*) - 1)::INT AS n_also FROM findings GROUP BY file, check_id, source, line_start, coalesce(line_end, line_start)",
    "analyser_targets": """
WITH t AS (SELECT o_orderkey % 4 AS k FROM orders WHERE o_orderstatus <> 'F')
SELECT 'ruff' AS tool, count(*) FILTER (k = 0) AS n FROM t UNION ALL SELECT 'eslint', count(*) FILTER (k IN (1, 2)) FROM t UNION ALL SELECT 'semgrep', count(*) FROM t""",
    "model_requests": """
WITH d AS (SELECT 'doc/' || doc_id AS path, len(string_split(text, chr(10))) AS lines, text, length('File: doc/' || doc_id || 'Status: scannedFull file content:``````' || 'No diff included — this is a full-file audit, not a diff review. Review the entire file.') + 8 + length(text) AS n FROM documents)
SELECT path, CASE WHEN text IS NULL THEN 'skipped: could not read file' WHEN lines > 6 THEN 'skipped: file too large (' || lines || ' lines > 6)' WHEN n % 5 = 0 THEN 'skipped: API request failed: HTTP status 503' WHEN n % 3 = 0 THEN '0 findings' ELSE '1 finding' END AS outcome,
       CASE WHEN lines <= 6 AND n % 5 <> 0 AND n % 3 <> 0 THEN n || ' characters' END AS title, CASE WHEN lines <= 6 AND n % 5 <> 0 AND n % 3 <> 0 THEN n % 7 END::INT AS line_start FROM d""",
    "stream_review": """
WITH f AS (SELECT DISTINCT 'u' || user_id || '.js' AS file, event_id % 3 AS k FROM events)
SELECT file, check_id, severity, line_start::INT AS line_start FROM f JOIN (VALUES (0, 'RULE-012', 'low', 1), (2, 'RULE-013', 'high', 1), (2, 'RULE-012', 'low', 2)) AS h(k, check_id, severity, line_start) USING (k)""",
    "resume_done": f"WITH {PRIOR} SELECT path FROM done",
    "resume_remaining": f"WITH {PRIOR} SELECT path, o AS o_orderkey FROM p WHERE o NOT IN (SELECT o FROM done)",
    "resume_union": f"""WITH {PRIOR}, {FINDINGS}, c AS (SELECT * FROM findings WHERE tier = 'cloud_llm')
SELECT 0::INT AS part, count(*) AS n, sum(ord)::BIGINT AS sum_ord, count(DISTINCT file) AS n_files FROM c WHERE file IN (SELECT path FROM done) HAVING count(*) > 0
UNION ALL
SELECT 1, count(*), sum(ord + 100)::BIGINT, count(DISTINCT file) FROM c WHERE file IN (SELECT path FROM p WHERE o NOT IN (SELECT o FROM done)) HAVING count(*) > 0""",
    "sequential_ids": f"""WITH {FINDINGS}, n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, ord) AS n FROM findings WHERE tier = 'cloud_llm')
SELECT 'CLOUD-' || (CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END) AS check_id, file, ord FROM n WHERE l_orderkey % 3 = 0 OR l_orderkey % 3 = 2""",
    "model_json_extract": """
WITH e AS (SELECT 'e' || event_id AS file, event_id % 4 AS way, (props::JSON ->> '$.k')::INT AS k FROM events)
SELECT file, CASE WHEN way < 3 THEN 'high' END AS severity, CASE WHEN way < 3 THEN 't' || k END AS title, CASE WHEN way < 3 THEN k + 1 END AS line_start,
       CASE WHEN way < 3 AND k % 2 = 0 THEN k END AS line_end, CASE WHEN way = 3 THEN 'no choices in response' END AS reason FROM e""",
    "safe_int": f"SELECT n_nationkey, {pick('n_nationkey', catalogue.NUMBERS)} AS raw, (CASE n_nationkey % 10 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 4 THEN 2 WHEN 7 THEN 12 WHEN 9 THEN -3 ELSE 1 END)::BIGINT AS value FROM nation",
    "retry_schedule": """
WITH r AS (SELECT n_nationkey, i::INT AS attempt, least(2.0::DOUBLE * pow(2, i), 60.0::DOUBLE) AS delay, (CASE n_nationkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 999999.0 WHEN 3 THEN 0.0 WHEN 5 THEN 0.0 WHEN 6 THEN 2.5 END)::DOUBLE AS asked FROM nation, range(7) AS t(i))
SELECT n_nationkey, attempt, delay, asked, least(coalesce(nullif(asked, 0), delay), 60.0::DOUBLE) AS wait FROM r""",
    "user_message": """
WITH m AS (SELECT doc_id, 'File: doc/' || doc_id || chr(10) || 'Status: modified' || chr(10) || chr(10) || 'Full file content:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) ||
  CASE WHEN doc_id % 2 = 0 THEN 'Unified diff of the change:' || chr(10) || '```diff' || chr(10) || '+' || text || chr(10) || '```' ELSE 'No diff included — this is a full-file audit, not a diff review. Review the entire file.' END AS m FROM documents)
SELECT doc_id, length(m)::BIGINT AS n_chars, sha256(m) AS sha256 FROM m""",
    "markdown_rows": f"""WITH {FINDINGS}, r AS (
  SELECT file, rank, line_start, ord, '| ' || line_start || ' | ' || (CASE severity {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EMOJI.items())} END) || ' ' || severity || ' | `' || check_id || '` (' || source || ') | ' ||
    replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(title, '<', '&lt;'), '>', '&gt;'), '`', '\\`'), '_', '\\_'), '[', '\\['), ']', '\\]'), '(', '\\('), ')', '\\)'), '|', '\\|'), '*', '\\*') || ' |' AS t FROM ranked
)
SELECT file, '## `' || file || '`' || chr(10) || chr(10) || '| Line | Severity | Check | Title |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(t, chr(10) ORDER BY rank DESC, line_start, ord) || chr(10) AS markdown FROM r GROUP BY file""",
    "report_basename": """
SELECT o_orderkey, (CASE o_orderkey % 6 WHEN 0 THEN 'org_repo' WHEN 1 THEN 'org_repo' WHEN 2 THEN 'sandbox-' || (o_orderkey % 3) WHEN 3 THEN 'xy_répo' WHEN 4 THEN 'single' ELSE 'repo' END) || '_' ||
       (CASE WHEN o_orderkey % 2 = 0 THEN 'pr' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'audit' ELSE 'diff' END) || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS basename FROM orders""",
    "pr_url_parse": f"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {pick("page_id // 2", catalogue.URLS)} ELSE url END AS u, page_id % 6 AS e, CASE WHEN page_id % 2 = 0 THEN (page_id // 2) % 10 ELSE -1 END AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'https://github.com/o/r' WHEN 1 THEN 'https://host/o/r' WHEN 2 THEN 'https://github.com/o/r' END AS repo_url, (CASE k WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 2 THEN 3 END)::BIGINT AS number,
       coalesce(k NOT IN (5, 6, 8) AND u <> '', false) AS cloneable, e IN (0, 1, 2, 4) AS auth_error FROM p""",
    "model_placement": """
WITH s AS (SELECT s_suppkey AS k, 'm' || s_suppkey AS model, s_suppkey % 2 = 0 AS remote, s_suppkey % 3 = 0 AND s_suppkey % 9 <> 0 AS here FROM supplier), w AS (
  SELECT *, CASE WHEN remote AND here THEN 'ambiguous' WHEN remote THEN 'remote' WHEN here THEN 'local' ELSE 'undetermined' END AS placement, CASE WHEN k % 4 = 0 AND right(model, 1) IN ('0', '4') THEN 'box1' END AS wished FROM s
)
SELECT model, placement, (CASE WHEN k % 4 = 0 THEN 2 WHEN remote THEN 1 ELSE 0 END)::INT AS n_devices, wished, CASE WHEN placement = 'remote' THEN 'proceed' WHEN placement = 'ambiguous' AND wished IS NOT NULL THEN 'choose' ELSE 'skip' END AS action FROM w""",
    "rollup_report": f"WITH {FINDINGS} SELECT source, severity, count(*) AS n, count(DISTINCT file) AS n_files, grouping_id(source, severity)::BIGINT AS level FROM findings GROUP BY ROLLUP (source, severity)",
    "nearby_findings": f"WITH {FINDINGS} SELECT file, ord, count(*) OVER (PARTITION BY file ORDER BY line_start RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) - 1 AS n_near FROM findings",
}

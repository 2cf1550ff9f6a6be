"""One query for each operator, over the test tables; plans/oracles.py has the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.functions import jsonx, retry, severity, similarity, text
from sievelake.functions.numbering import numbered
from sievelake.functions.storage import cut, shared_dir
from sievelake.operators import coverage, js_rules, merge, placement, py_rules, report, resume, scope
from sievelake.plans import carriers as C
from sievelake.plans import render
from sievelake.sources import analysers, config, diffs, linters, models, responses, trees, urls
from sievelake.streaming import incremental

c = F.col


def file_name(key: str, suffix: str = ".py"):
    return F.concat(F.lit("f"), c(key).cast("string"), F.lit(suffix))


def credential_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.explode_lines(C.read(spark, sf_dir, "documents"), "text", "doc_id")
    return lines.where(js_rules.credential(c("line"))).select("doc_id", "lineno", F.lit("RULE-009").alias("check_id"))


def audit_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = C.read(spark, sf_dir, "orders"), C.read(spark, sf_dir, "lineitem")
    return trees.manifest(orders.select(file_name("o_orderkey").alias("path")), lines.select(file_name("l_orderkey").alias("path"))).select("path", "status").orderBy("path")


def text_line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.explode_lines(C.read(spark, sf_dir, "documents"), "text", "doc_id")


def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t, i, x: C.read(spark, sf_dir, t).select(F.concat(F.lit(f"{t}/"), c(i).cast("string")).alias("path"), text.content_hash(F.coalesce(text.decoded(c(x)), F.lit(""))).alias("sha256"))
    return of("documents", "doc_id", "text").unionByName(of("pages", "page_id", "html"))


def size_cap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = C.read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), c("doc_id").cast("string")).alias("path"), c("text").alias("content")).withColumn("n_lines", text.line_count(c("content")))
    kept, skips = scope.readable(files, "cloud_llm", 6)
    return kept.select("path", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("entry")).unionByName(skips.select("path", F.lit(False).alias("kept"), "entry"))


def admission_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cap, forced, n_over: what a run over all orders is told."""
    targets = C.read(spark, sf_dir, "orders").select(F.when(c("o_orderstatus") == "F", "deleted").otherwise("modified").alias("status"))
    rows = [(cap, force, scope.over_cap(targets, cap, force)) for cap in (scope.FILE_CAP, 1_000, 1_000_000_000) for force in (False, True)]
    return spark.createDataFrame(rows, "cap int, forced boolean, n_over bigint")


def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = C.read(spark, sf_dir, "orders").select(F.concat(F.lit("src/f"), c("o_orderkey").cast("string"), C.choice(c("o_orderkey"), (".py", ".js", ".tsx", ".md", ".PY"))).alias("path"), F.when(c("o_orderstatus") == "F", "deleted").otherwise("modified").alias("status"))
    runs = [scope.with_suffix(targets, s).select("path", F.lit(k).alias("runner")) for k, s in linters.SUFFIXES.items()]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def js_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return js_rules.line_rules(C.code(spark, sf_dir, C.SCRIPT, ".js")).select(c("path").alias("file"), "check_id", "severity", "line_start")


def call_guard_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return js_rules.call_rule(C.code(spark, sf_dir, C.CALLS, ".js")).select(c("path").alias("file"), "check_id", "line_start")


def py_ast_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return py_rules.rules(py_rules.nodes(C.code(spark, sf_dir, C.PYTHON, ".py"))).select(c("path").alias("file"), "check_id", "severity", "line_start", "line_end")


def permission_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return py_rules.rules(py_rules.nodes(C.code(spark, sf_dir, C.GUARDS, ".py"))).where("rule_ord = 3").select(c("path").alias("file"), "check_id", "severity", "line_start")


def severity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C.choice(c("o_orderkey"), ("High", "MEDIUM", " low ", "urgent", "", "\tCritical\n", None, "info"))
    return C.read(spark, sf_dir, "orders").select("o_orderkey", severity.parse(raw).alias("severity")).withColumn("severity_rank", severity.rank(c("severity")))


def severity_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    return C.read(spark, sf_dir, "part").select(
        "p_partkey", severity.ruff(C.choice(k, ("S101", "E999", "F821", "F401", "B006", "W605", "SIM102", "E501"))).alias("ruff"),
        severity.semgrep(C.choice(k, ("ERROR", "WARNING", "INFO", None, "OTHER"))).alias("semgrep"), severity.eslint((k % 3).cast("int")).alias("eslint"),
        severity.tier_priority(C.choice(k, ("cloud_llm", "local_llm", "rules", "x"))).alias("tier_priority"),
    )


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.findings(spark, sf_dir).withColumn("changed", C.changed(c("l_orderkey")))


def line_scope_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).where(scope.in_scope(c("changed"), c("line_start"))).select("file", "ord", "line_start")


def line_scope_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).where(scope.in_scope_range(c("changed"), c("line_start"), scope.end_line(c("line_start"), c("line_end")))).select("file", "ord", "line_start", "line_end")


def line_scope_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = (c("line_start") * 5 + 30).cast("int")
    return _scoped(spark, sf_dir).where(scope.in_scope_near(c("changed"), far, F.when(c("line_end").isNotNull(), far + 1))).select("file", "ord", far.alias("line"))


def linter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding goes through one of the three readers; those of deleted orders have no target."""
    rows = C.findings(spark, sf_dir)
    targets = scope.live(C.read(spark, sf_dir, "orders").select(file_name("o_orderkey").alias("path"), C.changed(c("o_orderkey")).alias("changed_lines"), F.when(c("o_orderstatus") == "F", "deleted").otherwise("modified").alias("status")))
    path, message = F.concat(F.lit("/repo/"), c("file")), F.concat(c("title"), F.lit("\nmore"))
    code, line, end = C.choice(c("l_orderkey"), ("S101", "E501", "F401")), c("line_start"), c("line_end")
    ruff = F.to_json(F.collect_list(F.struct(path.alias("filename"), code.alias("code"), message.alias("message"), F.struct(line.alias("row")).alias("location"), F.struct(end.alias("row")).alias("end_location"))))
    entry = F.struct(F.nullif(c("check_id"), F.lit("RULE-001")).alias("ruleId"), c("title").alias("message"), line.alias("line"), end.alias("endLine"), (c("ord") % 3).cast("int").alias("severity"))
    eslint = F.to_json(F.array(F.struct(F.first(path).alias("filePath"), F.collect_list(entry).alias("messages"))))
    result = F.struct(F.concat(F.lit("python.lang."), c("check_id")).alias("check_id"), path.alias("path"), F.struct(line.alias("line")).alias("start"), F.struct(end.alias("line")).alias("end"), F.struct(message.alias("message"), C.choice(c("ord"), ("ERROR", "WARNING", "INFO", None)).alias("severity")).alias("extra"))
    semgrep = F.to_json(F.struct(F.collect_list(result).alias("results")))
    out = None
    for k, (tool, payload) in enumerate((("ruff", ruff), ("eslint", eslint), ("semgrep", semgrep))):
        found = linters.TOOLS[tool](rows.where(c("l_orderkey") % 3 == k).groupBy("file").agg(payload.alias("payload")).select("payload"), "/repo")
        found = linters.scoped(found, targets).select("file", "check_id", "source", "severity", "title", "line_start", "line_end")
        out = found if out is None else out.unionByName(found)
    return out


#: Beginnings of the diff lines that items become.
DIFF_LINES = ("+a", "-b", " c", "+++x", "---y", "\\ No newline at end of file", "+d")


def _hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o (order), body: a hunk for each order, with a second one after its third line."""
    line = C.choice(c("l_partkey"), DIFF_LINES)
    line = F.when(c("ord") == 4, F.concat(F.lit("@@ -9,2 +20 @@ def f():\n"), line)).otherwise(line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("s")))), lambda x: x["s"])
    rows = C.items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(lines, "\n").alias("b"))
    return rows.select(c("l_orderkey").alias("o"), F.concat(F.lit("before\n+before\n@@ -1,3 +"), (c("l_orderkey") % 4).cast("string"), F.lit(",4 @@\n"), "b", F.lit("\n")).alias("body"))


def hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as a generator, so that lines are counted once and not again in a filter
    return _hunks(spark, sf_dir).select("o", F.explode(F.filter(F.array(diffs.changed_lines(c("body"))), lambda x: F.size(x) > 0)).alias("lines"))


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diff_id (customer), text: a file for each of the customer's orders; every ninth header can't be read."""
    o = c("o_orderkey")
    name = C.choice(o, ("app/m%d.py", "tests/test_m%d.py", "web/x%d.tsx", "caf\\303\\251%d.py", "w x/c%d.js", "lib/contest%d.js"))
    name = F.replace(name, F.lit("%d"), o.cast("string"))
    quote = lambda side: F.when(o % 6 == 3, F.concat(F.lit(f'"{side}/'), name, F.lit('"'))).otherwise(F.concat(F.lit(f"{side}/"), name))
    head = F.when(o % 9 == 8, F.lit("diff --git nothing")).otherwise(F.concat(F.lit("diff --git "), quote("a"), F.lit(" "), quote("b")))
    mark = C.choice(o, ("new file mode 100644\n", "index 1..2\n", "deleted file mode 100644\n", "rename from x\nrename to y\n", "index 3..4\n"))
    body = F.concat(F.lit("@@ -1,2 +1,9 @@\n"), F.repeat(F.lit("+added\n"), (o % 7).cast("int")), F.when(o % 11 == 0, F.lit("+def test_x():\n")).otherwise(F.lit("")), F.when(o % 4 == 1, F.lit("+    pass\n")).otherwise(F.lit(" c\n-gone\n")))
    block = F.concat(head, F.lit("\n"), mark, body)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"])
    return C.read(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("diff_id")).agg(F.array_join(parts, "").alias("text"))


def diff_split_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.targets(_diffs(spark, sf_dir), "diff_id", "text").select("diff_id", "path", "status", "old_path", F.size("changed_lines").alias("n_changed"))


def added_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = diffs.blocks(_diffs(spark, sf_dir), "diff_id", "text")
    return parts.groupBy("diff_id").agg(F.count("*").alias("n_blocks"), F.sum(text.added_lines(c("diff_text"))).alias("n_added"))


def test_coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.untested(diffs.targets(_diffs(spark, sf_dir), "diff_id", "text"))


#: Quoted paths.
QUOTED_PATHS = (r'"caf\303\251.py"', r'"weird\"name\\.py"', "plain/path.py", r'"tab\there"', r'"bad\377"', r'"open', '""', r'"a\qb"', r'"\101\102"')


def git_unquote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.read(spark, sf_dir, "nation").select("n_nationkey", C.choice(c("n_nationkey"), QUOTED_PATHS).alias("raw"))
    return rows.withColumn("path", text.unquoted(c("raw")))


def counts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by_severity(C.findings(spark, sf_dir).where("severity <> 'info'"))


def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_file(C.findings(spark, sf_dir))


def merge_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.findings(spark, sf_dir).withColumns({"title": F.md5(F.concat("check_id", "source").cast("binary")), "tier": F.when(c("source") == "semgrep", "cloud_llm").when(c("source") == "eslint", "local_llm").otherwise("rules")})
    return merge.merged(rows.drop("l_orderkey")).select("file", "check_id", "source", "line_start", "severity", F.coalesce(F.size("also_flagged_by"), F.lit(0)).alias("n_also"))


def merge_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(C.findings(spark, sf_dir).drop("l_orderkey"))


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    pairs = C.read(spark, sf_dir, "part").select(k, C.choice(k, C.TITLES).alias("a"), C.choice(F.floor(k / len(C.TITLES)), C.TITLES).alias("b"))
    return pairs.select("p_partkey", "a", "b", (similarity.title_ratio("a", "b") >= similarity.SIMILAR).alias("similar"))


def final_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked(C.findings(spark, sf_dir)).select("place", "file", "ord", "severity", "line_start")


def fail_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each level and file whether a finding is at it or above."""
    rows = C.findings(spark, sf_dir)
    hit = None
    for level in severity.SEVERITIES:
        here = report.at_or_above(rows, level).groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit(level).alias("level"), "n")
        hit = here if hit is None else hit.unionByName(here)
    return hit


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of a review of each source's findings at each level."""
    rows = C.findings(spark, sf_dir).where("severity <> 'critical' or source <> 'ruff'")
    sources = [r.source for r in rows.select("source").distinct().orderBy("source").collect()]
    codes = [(s, level, report.exit_code(rows.where(c("source") == s), level)) for s in sources for level in severity.SEVERITIES]
    return spark.createDataFrame(codes, "source string, level string, code int")


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(C.findings(spark, sf_dir))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(C.findings(spark, sf_dir).where("severity <> 'low'"))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's findings as JSON objects, in the report's order."""
    rows = C.findings(spark, sf_dir).withColumns({"explanation": F.concat(F.lit('say "'), c("title"), F.lit('"\n')), "suggestion": F.lit(None).cast("string"), "raw": F.when(c("ord") % 2 == 0, F.to_json(F.struct("ord"))), "also_flagged_by": F.lit(None).cast("array<string>")})
    return render.json_lines(rows)


def console_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as a terminal gets them, through the same rule as reports."""
    rows = C.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("[red]"), c("text"), F.lit("\u001b[0m")).alias("text"))
    return rows.select("conv_id", "turn", render.inert_column(c("text")).alias("text"))


def item_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of diff entries that have flags, those of line items."""
    status = diffs.item_status(c("l_returnflag") == "R", c("l_linestatus") == "O", c("l_returnflag") == "A")
    return C.read(spark, sf_dir, "lineitem").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def touching_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a finding's range touches that of the one before it in its file."""
    before = Window.partitionBy("file").orderBy("ord")
    rows = C.findings(spark, sf_dir).withColumns({"a": F.lag("line_start").over(before), "b": F.lag("line_end").over(before)}).where("a is not null")
    return rows.select("file", "ord", merge.ranges_touch(c("line_start"), c("line_end"), c("a"), c("b")).alias("touches"))


def merged_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw objects of merged findings list: exact duplicates, so that the order decides nothing but the list's."""
    rows = C.findings(spark, sf_dir).withColumns({"title": F.md5(F.concat("check_id", "source").cast("binary")), "tier": F.lit("rules"), "raw": F.to_json(F.struct("check_id"))})
    return merge.merged(rows.drop("l_orderkey")).select("file", "check_id", "source", "line_start", F.get_json_object("raw", "$.check_id").alias("raw_check"), F.coalesce(F.json_array_length(F.get_json_object("raw", "$.also_flagged_by")), F.lit(0)).alias("n_also"))


def analyser_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files each analyser would be given, by tool."""
    targets = C.read(spark, sf_dir, "orders").select(F.concat(F.lit("src/f"), c("o_orderkey").cast("string"), C.choice(c("o_orderkey"), (".py", ".jsx", ".ts", ".md"))).alias("path"), F.when(c("o_orderstatus") == "F", "deleted").otherwise("modified").alias("status"))
    out = None
    for tool in analysers.ANALYSERS:
        suffixes = linters.SUFFIXES.get(tool.name)
        here = (scope.with_suffix(targets, suffixes) if suffixes else scope.live(targets)).agg(F.lit(tool.name).alias("tool"), F.count("*").alias("n"))
        out = here if out is None else out.unionByName(here)
    return out


def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model tier end to end over all documents, against a stand-in that answers by the message: outcome and findings of each file."""
    files = C.read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), c("doc_id").cast("string")).alias("path"), F.lit("scanned").alias("status"), F.lit("").alias("diff_text"), F.lit(None).cast("array<int>").alias("changed_lines"), c("text").alias("content"))
    tier = models.local(config.Local(enabled=True, model="m", max_file_lines=6))
    done = models.run(tier, files, "audit", None, _stand_in)
    return done.outcomes.join(done.findings.select(c("file").alias("path"), "title", "line_start"), "path", "left")


def _stand_in():
    """Answers with one finding of the message's length, none for every third length, and fails for every fifth."""
    import json

    def ask(message: str) -> tuple[str | None, str | None]:
        n = len(message)
        if n % 5 == 0:
            return None, "API request failed: HTTP status 503"
        found = [] if n % 3 == 0 else [{"severity": "low", "title": f"{n} characters", "explanation": "e", "line_start": n % 7}]
        return json.dumps({"choices": [{"message": {"content": json.dumps({"findings": found})}}]}), None

    return ask


def stream_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental review of a stream of scripts, one for each event: each content of a file is reviewed once."""
    import uuid

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrived = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream can't have one file for its base
    snippet = C.choice(c("event_id"), ("console.log(1);\n", "let a = 1;\n", "debugger;\nconsole.debug(2);\n"))
    files = arrived.select(F.concat(F.lit("u"), c("user_id").cast("string"), F.lit(".js")).alias("path"), snippet.alias("content"), c("ts").cast("timestamp").alias("seen"))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    incremental.review(files, f"{folder}/out", f"{folder}/at", delay="36500 days").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(c("path").alias("file"), "check_id", "severity", "line_start")


def _prior(spark: SparkSession, sf_dir: str):
    """Current files with hashes, the earlier run's files, and its skip entries."""
    o = C.read(spark, sf_dir, "orders")
    path = F.when(c("o_orderkey") % 13 == 0, F.concat(F.lit("a: b/"), c("o_orderkey").cast("string"))).otherwise(file_name("o_orderkey"))
    digest = lambda salt: F.sha2(F.concat(c("o_orderkey").cast("string"), F.lit(salt)), 256)
    current = o.select(path.alias("path"), digest("v1").alias("hash"), "o_orderkey")
    files = o.where("o_orderkey % 3 <> 0").select(path.alias("path"), F.when(c("o_orderkey") % 5 == 0, digest("v0")).otherwise(digest("v1")).alias("hash"))
    tier = F.when(c("o_orderkey") % 2 == 0, "cloud_llm").otherwise("local_llm")
    entries = o.where("o_orderkey % 7 = 0").select(F.concat_ws(": ", tier, path, F.lit("API request failed: 429")).alias("entry"))
    return current, files, entries


def resume_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.succeeded(*_prior(spark, sf_dir), "cloud_llm")


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, files, entries = _prior(spark, sf_dir)
    return resume.remaining(current, resume.succeeded(current, files, entries, "cloud_llm")).select("path", "o_orderkey")


def resume_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, files, entries = _prior(spark, sf_dir)
    done, found = resume.succeeded(current, files, entries, "cloud_llm"), C.findings(spark, sf_dir).where("tier = 'cloud_llm'")
    old = resume.reused(found, done)
    new = found.join(resume.remaining(current, done).select(c("path").alias("file")), "file", "left_semi").withColumn("ord", c("ord") + 100)
    return resume.resumed(old, new).groupBy("part").agg(F.count("*").alias("n"), F.sum("ord").alias("sum_ord"), F.count_distinct("file").alias("n_files"))


def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.findings(spark, sf_dir).where("tier = 'cloud_llm'").withColumn("changed", C.changed(c("l_orderkey")))
    rows = numbered(rows, [c("l_orderkey"), c("ord")], "n").withColumn("check_id", F.format_string("CLOUD-%03d", "n"))
    return rows.where(scope.in_scope_near(c("changed"), c("line_start"), c("line_end"))).select("check_id", "file", "ord")


def model_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of well-formed responses of both protocols, made of events."""
    e = C.read(spark, sf_dir, "events").select("event_id", "props", F.get_json_object("props", "$.k").cast("int").alias("k"))
    item = F.to_json(F.struct(F.lit("High").alias("severity"), F.concat(F.lit("t"), c("k").cast("string")).alias("title"), F.lit("e").alias("explanation"), F.when(c("k") % 2 == 0, c("k").cast("string")).alias("line_end"), (c("k") + 1).alias("line_start")))
    found = F.concat(F.lit('{"findings": ['), item, F.lit("]}"))
    chat = F.concat(F.lit('{"choices": [{"message": {"tool_calls": [{"function": {"name": "report_findings", "arguments": '), F.to_json(F.array(found)), F.lit("}}]}}]}"))
    chat = F.regexp_replace(F.regexp_replace(chat, r'"arguments": \[', '"arguments": '), r'\]\}\}\]\}\}\]\}$', "}}]}}]}")
    content = F.concat(F.lit('{"choices": [{"message": {"content": '), F.regexp_replace(F.to_json(F.array(found)), r"^\[|\]$", ""), F.lit("}}]}"))
    blocks = F.concat(F.lit('{"content": [{"type": "text"}, {"type": "tool_use", "name": "report_findings", "input": '), found, F.lit("}]}"))
    made = e.select("event_id", (c("event_id") % 4).alias("way"), F.when(c("event_id") % 4 == 0, chat).when(c("event_id") % 4 == 1, content).when(c("event_id") % 4 == 2, blocks).otherwise(c("props")).alias("response"),
                    F.concat(F.lit("e"), c("event_id").cast("string")).alias("path"), c("event_id").alias("file_ord"), F.lit(None).cast("array<int>").alias("changed_lines"))
    # stored, as a model tier stores them: findings are sorted and numbered, and what was skipped is read again
    rows = cut(responses.parsed(made.where("way <> 2"), "chat").unionByName(responses.parsed(made.where("way = 2"), "blocks")).drop("response"))
    found = responses.findings(rows, "cloud_llm", "cloud", "CLOUD").select("file", "severity", "title", "line_start", "line_end", F.lit(None).cast("string").alias("reason"))
    return found.unionByName(responses.skips(rows, "cloud_llm").select(c("path").alias("file"), *[F.lit(None).cast(t).alias(n) for n, t in (("severity", "string"), ("title", "string"), ("line_start", "int"), ("line_end", "int"))], "reason"))


#: JSON texts of line numbers.
NUMBERS = ('"5"', "5", '"line five"', "null", "2.7", '"2.7"', "true", '" 12 "', "[1]", "-3")


def safe_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.read(spark, sf_dir, "nation").select("n_nationkey", C.choice(c("n_nationkey"), NUMBERS).alias("raw"))
    return rows.withColumn("value", jsonx.safe_int(F.parse_json("raw"), 1))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = C.choice(c("n_nationkey"), ("1", "999999", None, "0", "Wed, 21 Oct 2015 07:28:00 GMT", "-5", " 2.5 "))
    rows = C.read(spark, sf_dir, "nation").select("n_nationkey", header.alias("header"), F.posexplode(retry.schedule(7)).alias("attempt", "delay"))
    return rows.select("n_nationkey", "attempt", "delay", retry.retry_after(c("header")).alias("asked")).withColumn("wait", retry.wait(c("asked"), c("delay")))


def user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = F.when(c("doc_id") % 2 == 0, F.concat(F.lit("+"), c("text"))).otherwise("")
    message = responses.user_message(F.concat(F.lit("doc/"), c("doc_id").cast("string")), F.lit("modified"), c("text"), diff)
    return C.read(spark, sf_dir, "documents").select("doc_id", F.length(message).cast("bigint").alias("n_chars"), F.sha2(message, 256).alias("sha256"))


def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown_files(C.findings(spark, sf_dir))


def report_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = c("o_orderkey")
    url = C.choice(o, ("https://github.com/org/repo.git", "git@github.com:org/repo.git", "", "https://host/x y/ré.po/", "single", "/"))
    label = text.repo_label(url, F.concat(F.lit("sand box-"), (o % 3).cast("string")))
    name = text.report_basename(label, F.when(o % 2 == 0, o), F.when(o % 3 == 0, F.lit("audit")).otherwise("diff"), c("o_orderdate"))
    return C.read(spark, sf_dir, "orders").select("o_orderkey", name.alias("basename"))


#: URLs and error texts.
URLS = ("https://github.com/o/r/pull/12", " https://host/o/r.git/pull/7/files ", "https://github.com/o/r/pull/3/", "https://github.com/o/r/issues/3", "12", "-oProxyCommand=x", "ext::sh -c x", "https://[::1]/repo", "", "https://github.com/o/r/pull/x")
ERRORS = ("fatal: Authentication failed for x", "remote: Repository not found.", "Permission denied (publickey).", "error: pathspec", "HTTP 403", "timeout")


def pr_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(c("page_id") % 2 == 0, C.choice(F.floor(c("page_id") / 2), URLS)).otherwise(c("url"))
    rows = C.read(spark, sf_dir, "pages").select("page_id", url.alias("u"), C.choice(c("page_id"), ERRORS).alias("e"))
    pull = urls.pull_request(c("u"))
    return rows.select("page_id", pull["repo_url"].alias("repo_url"), pull["number"].alias("number"), urls.cloneable(c("u")).alias("cloneable"), urls.auth_error(c("e")).alias("auth_error"))


def model_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("m"), c("s_suppkey").cast("string")).alias("model"))
    status = s.where("s_suppkey % 2 = 0").select(F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(f"box{k}").alias("device"), F.lit(f"id{k}").alias("device_id")) for k in (1, 0)])).alias("p"), "model", "s_suppkey").where("p.ord = 0 or s_suppkey % 4 = 0").select("p.*", "model")
    loaded = s.where("s_suppkey % 3 = 0").select(F.when(c("s_suppkey") % 6 == 0, c("model")).alias("identifier"), c("model").alias("model_key"), F.when(c("s_suppkey") % 9 == 0, "id0").alias("device_id"))
    where = placement.located(s.select("model"), status, loaded)
    wish = F.when(F.substr("model", F.lit(-1), F.lit(1)).isin("0", "4"), " BOX1 ").otherwise("local")
    candidates = status.select("model", "ord", c("device").alias("label"))
    picked = placement.chosen(candidates, where.select("model", wish.alias("device")), "model")
    rows = where.join(picked, "model")
    return rows.select("model", "placement", F.size("devices").alias("n_devices"), c("label").alias("wished"), placement.gate(c("placement"), F.lit("lm_studio"), c("model"), F.lit(False), c("label")).alias("action"))


def rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts by source and severity with subtotals."""
    return report.rollup(C.findings(spark, sf_dir))


def nearby_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with others of their file within two lines: what the merge has to look at, by a range window."""
    near = Window.partitionBy("file").orderBy("line_start").rangeBetween(-merge.NEAR, merge.NEAR)
    return C.findings(spark, sf_dir).select("file", "ord", (F.count("*").over(near) - 1).alias("n_near"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        credential_lines, audit_manifest, text_line_explode, file_hashes, size_cap_split, admission_cap, suffix_filter, js_line_rules, call_guard_window, py_ast_rules,
        permission_reachability, severity_parse, severity_maps, line_scope_exact, line_scope_range, line_scope_tolerance, linter_join, hunk_lines, diff_split_header, git_unquote,
        added_line_count, test_coverage_gate, counts_by_severity, findings_by_file, merge_exact_duplicates, merge_fuzzy, title_similarity, final_sort, fail_gate, resume_done,
        resume_remaining, resume_union, sequential_ids, model_json_extract, safe_int, retry_schedule, user_message, markdown_rows, report_basename, pr_url_parse, model_placement,
        rollup_report, nearby_findings, exit_codes, report_totals, report_summary, report_json, console_text, item_statuses, touching_ranges, merged_raw, analyser_targets, model_requests, stream_review,
    )
}

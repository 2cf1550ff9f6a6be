"""The command line end to end, analysers by stand-ins on the PATH, model tiers by injected clients."""

import json
import os
import subprocess
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pytest

from sievelake import __main__ as cli
from sievelake.plans import render, review
from sievelake.sources import analysers, config, git, models

TARGET = "path string, status string, diff_text string, changed_lines array<int>, content string"


@pytest.fixture
def repo(tmp_path):
    top = tmp_path / "shop"
    top.mkdir()

    def run(*args):
        subprocess.run(["git", "-C", str(top), "-c", "user.name=t", "-c", "user.email=t@localhost", *args], check=True, capture_output=True)

    subprocess.run(["git", "init", "-q", "-b", "main", str(top)], check=True)
    (top / "stock.py").write_text('def count(name):\n    return frappe.db.sql(f"select qty from tabBin where item = {name}")\n')
    (top / "page.js").write_text("let a = 1;\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    return top, run


def command(spark, *args, **options):
    said = []
    code = cli.run(spark, [str(a) for a in args], say=said.append, **options)
    return code, "\n".join(said)


def reports_in(folder):
    return sorted(Path(folder).iterdir())


def test_audit_from_end_to_end(spark, repo, tmp_path):
    top, _ = repo
    code, said = command(spark, "audit", "--repo-path", top, "--output-dir", tmp_path / "out")
    assert code == 1 and "RULE-002 (house)" in said
    files = reports_in(tmp_path / "out")
    assert [f.suffix for f in files] == [".docx", ".json", ".md"] and all(f.name.startswith("shop_audit_") for f in files)
    data = json.loads(files[1].read_text())
    assert data["mode"] == "audit" and set(data["file_hashes"]) == {"stock.py", "page.js"} == set(data["files_reviewed"]) and data["tiers_run"] == ["rules"]
    assert data["counts_by_severity"] == {"info": 0, "low": 0, "medium": 0, "high": 1, "critical": 0} and data["findings"][0]["line_start"] == 2
    assert any(x.startswith("rules: eslint: no eslint config") for x in data["skipped"])
    with zipfile.ZipFile(files[0]) as z:
        words = "".join(ElementTree.fromstring(z.read("word/document.xml")).itertext())
        assert {"[Content_Types].xml", "_rels/.rels", "word/styles.xml"} <= set(z.namelist())
    assert "Review Report" in words and "stock.py" in words and "RULE-002 (house)" in words and "Skipped" in words


def test_diff_from_end_to_end(spark, repo, tmp_path):
    top, run = repo
    run("checkout", "-qb", "change")
    (top / "days.py").write_text("days = 7\n")
    run("add", "-A")
    code, said = command(spark, "diff", "--staged", "--repo-path", top, "--output-dir", tmp_path / "a")
    assert code == 0 and "0 finding(s)" in said
    run("commit", "-qm", "two")
    (top / "settings.yaml").write_text("thresholds:\n  fail_on_severity: low\n")
    (top / "log.py").write_text("print(days)\n")
    run("add", "log.py")
    run("commit", "-qm", "three")
    code, _ = command(spark, "diff", "--repo-path", top, "--config", top / "settings.yaml", "--output-dir", tmp_path / "b")
    data = json.loads(next(f for f in reports_in(tmp_path / "b") if f.suffix == ".json").read_text())
    assert code == 1 and (data["base_ref"], data["head_ref"], data["mode"]) == ("main", "HEAD", "diff") and [f["check_id"] for f in data["findings"]] == ["RULE-007"]
    assert command(spark, "diff", "--base-ref", "HEAD", "--repo-path", top) == (0, "No changed files found.")


@pytest.mark.parametrize(("args", "why"), [
    (["diff", "--staged", "--pr", "3"], "exclude"), (["diff", "--pr", "soon"], "number or"), (["diff", "--repo-url", "https://host/o/a", "--pr", "https://host/o/b/pull/4"], "aren't the same"),
    (["audit", "--repo-url", "ext::x"], "transport"), (["diff", "--base-ref", "no-such-branch"], "no-such-branch"),
])
def test_what_can_not_be_reviewed(spark, repo, args, why):
    code, said = command(spark, *args, "--repo-path", repo[0])
    assert code == 2 and why in said


def test_unknown_commands(spark):
    assert command(spark, "inspect")[0] == 2 and command(spark, "audit", "--help")[0] == 0


def test_many_files_are_not_sent_to_the_cloud(spark, repo, tmp_path):
    top, run = repo
    for k in range(60):
        (top / f"m{k}.py").write_text("days = 7\n")
    code, said = command(spark, "audit", "--cloud", "--repo-path", top, "--output-dir", tmp_path / "out")
    assert code == 2 and "62 files" in said and not (tmp_path / "out").exists()
    asked = lambda: lambda m: (json.dumps({"content": [{"type": "tool_use", "name": "report_findings", "input": {"findings": []}}]}), None)
    code, said = command(spark, "audit", "--cloud", "--force-cloud", "--repo-path", top, "--output-dir", tmp_path / "out", clients={"cloud_llm": asked})
    assert code == 1 and "(62/62) stock.py: 0 findings" in said


def test_analysers_on_the_path(spark, repo, tmp_path, monkeypatch):
    top, _ = repo
    tools = tmp_path / "bin"
    tools.mkdir()

    def stand_in(name, body):
        (tools / name).write_text(f"#!/bin/sh\n{body}\n")
        (tools / name).chmod(0o755)

    ruff = json.dumps([{"filename": str(top / "stock.py"), "code": c, "message": "m", "location": {"row": 1}, "end_location": {"row": 1}} for c in ("F403", "F402", "F401")])
    stand_in("ruff", f"cat <<'X'\n{ruff}\nX\nexit 1")
    stand_in("eslint", "echo '[{\"filePath\": \"page.js\", \"messages\": [{\"line\": 1, \"message\": \"'\"$#\"'\", \"severity\": 2}]}]'; exit 2")
    stand_in("semgrep", "echo oops")
    monkeypatch.setenv("PATH", f"{tools}:{os.environ['PATH']}")
    files = spark.createDataFrame([("stock.py", "scanned", "", None, "x = 1\n"), ("page.js", "scanned", "", None, "let a;\n"), ("old.py", "deleted", "", None, None)], TARGET)
    out, skips = analysers.outputs(files, str(top), {})
    assert set(out) == {"ruff", "semgrep"} and skips == ["rules: eslint: no eslint config found in repo"]
    (top / "eslint.config.js").write_text("")
    done = review.run(files, "audit", config.Config(), str(top))
    got = sorted((f.check_id, f.file, f.severity) for f in done.findings.collect())
    assert [g[0] for g in got if g[0].startswith("ESLINT")] == ["ESLINT-unknown"] and any(g[0].startswith("RUFF") for g in got)
    stand_in("ruff", "echo '[]'; exit 2")  # a failure's output doesn't count
    assert review.run(files, "audit", config.Config(rules=config.Rules(eslint=False)), str(top)).findings.count() == 0
    monkeypatch.setenv("PATH", "/usr/bin:/bin")
    assert analysers.ANALYSERS[0].missing(str(top)) == "ruff not found on PATH" and analysers.ANALYSERS[1].missing(str(top)) == "eslint binary not found on PATH"


def test_findings_of_one_line_keep_the_payload_order(spark):
    """Three findings of one tool on one line merge in the order of its output, however rows are dealt."""
    for codes in (["F401", "F402", "F403"], ["F403", "F402", "F401"]):
        payload = json.dumps([{"filename": "a.py", "code": c, "message": "same words here", "location": {"row": 4}, "end_location": {"row": 4}} for c in codes])
        files = spark.createDataFrame([("a.py", "scanned", "", None, "x = 1\n")], TARGET)
        rows = spark.createDataFrame([(payload,)], "payload string").repartition(5)
        got = review.review(files, "audit", {"ruff": rows}).findings.collect()
        assert [(f.check_id, f.also_flagged_by) for f in got] == [(f"RUFF-{codes[0]}", [f"ruff:RUFF-{c}" for c in codes[1:]])]
        assert json.loads(got[0].raw)["code"] == codes[0] and json.loads(got[0].raw)["also_flagged_by"] == got[0].also_flagged_by


FOUND = {"severity": "low", "title": "odd", "explanation": "e", "line_start": 1}


def answer(*items):
    return json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"name": "report_findings", "arguments": json.dumps({"findings": list(items)})}}]}}]})


def test_a_model_tier_and_its_resumption(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "scanned", "", None, "a = 1\n"), ("b.py", "scanned", "", None, "b = 1\n"), ("c.py", "scanned", "", None, "c\n" * 30), ("d.py", "deleted", "", None, None), ("e.py", "scanned", "", None, None)], TARGET)
    tier = models.cloud(config.Cloud(enabled=True, provider="groq", max_file_lines=20))
    log = tmp_path / "asked"

    def client(fails):
        def start():
            def ask(message):
                with open(log, "a") as f:
                    f.write(message.split("\n")[0] + "\n")
                return (None, "API request failed: HTTP status 429 for u") if fails in message else (answer(FOUND), None)

            return ask

        return start

    first = models.run(tier, files, "audit", None, client("b.py"))
    assert {r.path: r.outcome for r in first.outcomes.collect()} == {"a.py": "1 finding", "b.py": "skipped: API request failed: HTTP status 429 for u", "c.py": "skipped: file too large (31 lines > 20)", "e.py": "skipped: could not read file"}
    done = review.review(files, "audit", models=[first.findings], skips=first.skips)
    done.tiers = ["rules", "cloud_llm"]
    prior = "".join(render.as_json(done, "/r", models.hashes(files).withColumnRenamed("hash", "sha256")))
    (tmp_path / "prior.json").write_text(prior)
    from sievelake.sources import reports

    log.unlink()
    again = models.run(tier, files, "audit", reports.load(spark, str(tmp_path / "prior.json")), client("none"))
    assert log.read_text().split() == ["File:", "b.py"] and again.reused == 1
    assert sorted((f.file, f.check_id, f.title) for f in again.findings.collect()) == [("a.py", "CLOUD-001", "odd"), ("b.py", "CLOUD-001", "odd")]
    assert review.review(files, "audit", models=[again.findings]).findings.where("tier = 'cloud_llm'").count() == 2


def test_waits_and_errors():
    tier = models.local(config.Local(enabled=True, model="m"))
    slept, calls = [], []

    def server(*replies):
        left = list(replies)

        def send(url, headers, body, timeout):
            calls.append(json.loads(body))
            reply = left.pop(0)
            if isinstance(reply, Exception):
                raise reply
            return reply

        return models.asker(tier, send, slept.append, 3)

    assert server((429, {"retry-after": "7"}, ""), (429, {}, ""), (429, {"retry-after": "9999"}, ""), (200, {}, "fine"))("m") == ("fine", None) and slept == [7, 4, 60]
    slept.clear()
    assert server(*[(429, {"retry-after": "soon"}, "slow down")] * 4)("m") == (None, f"API request failed: HTTP status 429 for {tier.url} — slow down") and slept == [2, 4, 8]
    said = server((400, {}, " bad " * 300))("m")[1]
    assert said == f"API request failed: HTTP status 400 for {tier.url} — {(' bad ' * 300).strip()[:500]}" and len(calls) == 9
    assert server(OSError("no route"))("m") == (None, "API request failed: no route")
    assert calls[0]["tool_choice"] == "required" and calls[0]["max_tokens"] == 4096 and calls[0]["messages"][1] == {"role": "user", "content": "m"}


def test_tiers_by_settings():
    cloud = models.cloud(config.Cloud(enabled=True))
    assert cloud.protocol == "blocks" and cloud.missing({}) == "ANTHROPIC_API_KEY env var not set" and cloud.missing({"ANTHROPIC_API_KEY": "k"}) is None
    assert cloud.sent_headers({"ANTHROPIC_API_KEY": "k"})["x-api-key"] == "k" and cloud.body("m")["tool_choice"] == {"type": "tool", "name": "report_findings"}
    groq = models.cloud(config.Cloud(enabled=True, provider="groq"))
    assert groq.url == config.PRESETS["groq"] and groq.key == "GROQ_API_KEY" and groq.sent_headers({"GROQ_API_KEY": "k"})["authorization"] == "Bearer k"
    assert "no base_url" in models.cloud(config.Cloud(enabled=True, provider="other")).missing({}) and models.cloud(config.Cloud()).missing({}) == "cloud tier disabled"
    assert "no base_url" in models.cloud(config.Cloud(enabled=True, provider="ollama")).missing({})
    assert "local.model not set" in models.local(config.Local(enabled=True)).missing({}) and models.local(config.Local(enabled=True, model="m", provider="ollama")).missing({}) is None
    assert models.local(config.Local()).missing({}) == "local LLM tier disabled"


def test_a_local_model_on_this_machine_needs_consent(spark):
    local = config.Local(enabled=True, model="m")
    status = json.dumps({"deviceIdentifier": "me", "peers": [{"deviceName": "Studio", "deviceIdentifier": "s", "loadedModels": ["m"]}]})
    used = []

    def tool(loaded, linked):
        def run(*args):
            used.append(args)
            return {"ps": json.dumps(loaded), "link": linked}.get(args[0]) if args[:2] != ("link", "set-preferred-device") else ""
        return run

    here, nothing = tool([{"identifier": "m"}], json.dumps({"peers": []})), lambda *a: None
    assert "--force-local" in cli.local_gate(spark, local, False, None, here) and cli.local_gate(spark, local, True, None, here) is None
    assert "undetermined" in cli.local_gate(spark, local, False, None, nothing)
    assert cli.local_gate(spark, local, False, None, tool([], status)) is None
    both = tool([{"identifier": "m"}], status)
    assert "ambiguous" in cli.local_gate(spark, local, False, None, both) and cli.local_gate(spark, local, False, "local", both) is None
    assert cli.local_gate(spark, local, False, "studio", both) is None and used[-1] == ("link", "set-preferred-device", "Studio")
    assert "no device answers" in cli.local_gate(spark, local, False, "attic", both)
    assert cli.local_gate(spark, config.Local(enabled=True, model="m", provider="ollama"), False, None, nothing) is None


def test_credentials_are_asked_for_after_a_failed_sign_in():
    seen, asked = [], []

    def attempt(good):
        def run(env):
            seen.append(env and env["SIEVELAKE_TOKEN"])
            if env and env["SIEVELAKE_TOKEN"] == good:
                said = subprocess.run([env["GIT_ASKPASS"], "Password for x"], env=env, capture_output=True, text=True, check=True).stdout
                return said == good, ""
            return False, "fatal: Authentication failed for x"
        return run

    give = lambda *tokens: lambda url, n: (asked.append(n), ("u", tokens[n - 1]) if tokens[n - 1] else None)[1]
    git.with_credentials("u", attempt("b"), give("a", "b"))
    assert seen == [None, "a", "b"] and asked == [1, 2]
    with pytest.raises(ValueError, match="after 3 attempts"):
        git.with_credentials("u", attempt("z"), give("a", "b", "c"))
    with pytest.raises(ValueError, match="no credentials provided"):
        git.with_credentials("u", attempt("z"), give(None))
    with pytest.raises(ValueError, match="No credentials were asked"):
        git.with_credentials("u", attempt("z"))
    with pytest.raises(ValueError, match="disk full"):
        git.with_credentials("u", lambda env: (False, "disk full"), give("a"))


def test_a_pull_request_by_number(spark, repo, tmp_path, monkeypatch):
    top, run = repo
    run("checkout", "-qb", "change")
    (top / "log.py").write_text("print(1)\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    run("update-ref", "refs/pull/5/head", "change")
    run("checkout", "-q", "main")
    clone = tmp_path / "clone"
    subprocess.run(["git", "clone", "-q", str(top), str(clone)], check=True)
    tools = tmp_path / "bin"
    tools.mkdir()
    (tools / "gh").write_text("#!/bin/sh\n[ $3 = 5 ] && echo main\n")
    (tools / "gh").chmod(0o755)
    monkeypatch.setenv("PATH", f"{tools}:{os.environ['PATH']}")
    assert git.base_of(str(clone), 5) == "main" and git.base_of(str(clone), 6) is None
    code, said = command(spark, "diff", "--pr", "5", "--repo-path", clone, "--output-dir", tmp_path / "out")
    assert code == 0 and "RULE-007" in said and reports_in(tmp_path / "out")[0].name.startswith("clone_pr5_")
    assert not subprocess.run(["git", "-C", str(clone), "for-each-ref", "refs/sievelake"], capture_output=True, check=True).stdout


def test_names_are_freed_if_a_report_fails(spark, tmp_path, monkeypatch):
    done = review.review(spark.createDataFrame([("a.py", "scanned", "", None, "x\n")], TARGET), "audit")
    monkeypatch.setattr(render.wordfile, "write", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        render.finish(done, str(tmp_path), "/r", "name")
    assert not list(tmp_path.iterdir())


def test_texts_of_others_are_inert_in_a_terminal():
    assert render.inert("\x1b[31mred\x1b[0m [link=x]y\r\nz\x07") == "\\[31mred\\[0m \\[link=x]y z" and render.inert(None) == ""


def test_word_files_hold_any_text(tmp_path):
    from sievelake.plans import wordfile

    with open(tmp_path / "x.docx", "wb") as f:
        wordfile.write(f, "now", [("Repo", "<a> & \x00b")], [("f\x0b.py", [(1, "high", "C", None), (None, "odd", "D", "]]>")])], ["s"])
    with zipfile.ZipFile(tmp_path / "x.docx") as z:
        assert "<a> & �b" in "".join(ElementTree.fromstring(z.read("word/document.xml")).itertext())

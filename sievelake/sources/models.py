"""Model tiers: what is asked of a model server, how its answers are waited for, and which files are asked about again.

A tier is data (addresses, headers, protocol, limits); requests run in batches on the
executors with a session of their own a task, and answers are stored before they are
used, so that a repeated task of a later step asks nothing again.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions import retry
from sievelake.functions.storage import cut
from sievelake.functions.text import content_hash, line_count
from sievelake.operators import resume, scope
from sievelake.sources import config, reports, responses

#: (status, headers, text) of a POST to an address with headers and a body, within so many seconds.
Post = Callable[[str, dict, bytes, float], tuple[int, dict, str]]

#: Names and types of a finding's fields, the function that a model calls, the service that has a protocol of its own, tokens of an answer.
FIELDS = {"severity": "string", "title": "string", "explanation": "string", "line_start": "integer", "line_end": "integer", "suggestion": "string"}
REQUIRED = ("severity", "title", "explanation", "line_start")
LEVELS = ("info", "low", "medium", "high", "critical")
FUNCTION = "report_findings"
ANTHROPIC_URL, ANTHROPIC_VERSION, ANTHROPIC_KEY = "https://api.anthropic.com/v1/messages", "2023-06-01", "ANTHROPIC_API_KEY"
KEYS = {"groq": "GROQ_API_KEY", "mistral": "MISTRAL_API_KEY", "cerebras": "CEREBRAS_API_KEY", "openrouter": "OPENROUTER_API_KEY"}
LOCAL_PROVIDERS = ("lm_studio", "ollama")
TOKENS, BODY = 4096, 500

PROMPT = (
    "You review source code. Each message holds one file, and the diff of a change to it if there is one. Look for wrong results, unhandled cases (empty input, missing values, races, "
    "bounds), security holes (injection, unsafe loading, secrets, missing authorisation) and, in Frappe code, SQL put together from strings, missing permission checks and writes that go "
    f"round the document hooks. With a diff, speak of changed lines only. Leave style to linters. Answer by calling {FUNCTION}; an empty list means that nothing was found."
)


def schema() -> dict:
    item = {name: {"type": kind} | ({"enum": list(LEVELS)} if name == "severity" else {}) for name, kind in FIELDS.items()}
    return {"type": "object", "properties": {"findings": {"type": "array", "items": {"type": "object", "properties": item, "required": list(REQUIRED)}}}, "required": ["findings"]}


@dataclass(frozen=True)
class Tier:
    """name: cloud_llm or local_llm; prefix: of the findings' ids; protocol: chat or blocks; key: the variable that holds the key, if one is needed."""

    name: str
    prefix: str
    protocol: str
    url: str | None
    model: str
    key: str | None
    provider: str
    enabled: bool
    max_lines: int
    timeout: float
    headers: dict = field(default_factory=dict)

    def missing(self, environ: dict | None = None) -> str | None:
        """Why the tier can't run, or None."""
        environ = os.environ if environ is None else environ
        section, known = ("cloud", KEYS) if self.name == "cloud_llm" else ("local", LOCAL_PROVIDERS)
        if not self.enabled:
            return "cloud tier disabled" if section == "cloud" else "local LLM tier disabled"
        if not self.url:
            return f"no base_url configured for provider {self.provider!r} (set {section}.base_url, or use a known provider: {', '.join(known)})"
        if section == "local" and not self.model:
            return "local.model not set — specify the model currently loaded in your local server"
        if self.key and not environ.get(self.key):
            return f"{self.key} env var not set"
        return None

    def body(self, message: str) -> dict:
        """The request for one message."""
        said = [{"role": "user", "content": message}]
        tool = {"name": FUNCTION, "description": "Report code review findings for this file."}
        if self.protocol == "blocks":
            return {"model": self.model, "max_tokens": TOKENS, "system": PROMPT, "messages": said, "tools": [tool | {"input_schema": schema()}], "tool_choice": {"type": "tool", "name": FUNCTION}}
        function = {"type": "function", "function": tool | {"parameters": schema()}}
        return {"model": self.model, "max_tokens": TOKENS, "messages": [{"role": "system", "content": PROMPT}, *said], "tools": [function], "tool_choice": "required"}

    def sent_headers(self, environ: dict | None = None) -> dict:
        secret = (os.environ if environ is None else environ).get(self.key or "", "")
        own = {"x-api-key": secret, "anthropic-version": ANTHROPIC_VERSION} if self.protocol == "blocks" else {"authorization": f"Bearer {secret}"} if secret else {}
        return {"content-type": "application/json"} | own | self.headers


def cloud(c: config.Cloud) -> Tier:
    if c.provider == "anthropic":
        return Tier("cloud_llm", "CLOUD", "blocks", ANTHROPIC_URL, c.model, c.api_key_env or ANTHROPIC_KEY, c.provider, c.enabled, c.max_file_lines, c.request_timeout_seconds)
    url = c.base_url or (config.PRESETS[c.provider] if c.provider in KEYS else None)
    return Tier("cloud_llm", "CLOUD", "chat", url, c.model, c.api_key_env or KEYS.get(c.provider), c.provider, c.enabled, c.max_file_lines, c.request_timeout_seconds)


def local(c: config.Local) -> Tier:
    url = c.base_url or (config.PRESETS[c.provider] if c.provider in LOCAL_PROVIDERS else None)
    return Tier("local_llm", "LOCAL", "chat", url, c.model, c.api_key_env, c.provider, c.enabled, c.max_file_lines, c.request_timeout_seconds)


def post(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, dict, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as r:  # noqa: S310
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode("utf-8", "replace")


def http_error(status: int, url: str, text: str) -> str:
    """A failed request's text: the status, and the beginning of what the server said."""
    said = text.strip()[:BODY]
    return f"HTTP status {status} for {url}" + (f" — {said}" if said else "")


def seconds_asked(headers: dict) -> float | None:
    """retry.retry_after for one response."""
    try:
        return max(0.0, float(headers.get("retry-after", "").strip()))
    except ValueError:
        return None


def asker(tier: Tier, send: Post = post, sleep: Callable[[float], None] = time.sleep, retries: int = retry.RETRIES) -> Callable[[str], tuple[str | None, str | None]]:
    """A function from a message to (response, error): rate-limited requests wait and try again, other failures don't."""
    headers = tier.sent_headers()

    def ask(message: str) -> tuple[str | None, str | None]:
        body, delay = json.dumps(tier.body(message)).encode(), retry.FIRST
        for left in range(retries, -1, -1):
            try:
                status, said, text = send(tier.url, headers, body, tier.timeout)
            except OSError as e:
                return None, f"API request failed: {e}"
            if status == 429 and left:
                sleep(min(seconds_asked(said) or delay, retry.LONGEST))
                delay = min(2 * delay, retry.LONGEST)
                continue
            return (text, None) if status < 400 else (None, f"API request failed: {http_error(status, tier.url, text)}")
        return None, None

    return ask


@dataclass
class Answered:
    """Of one tier: its findings (reused ones first), skip rows, an outcome for each file that was asked about, and how many files were reused."""

    findings: DataFrame
    skips: DataFrame
    outcomes: DataFrame
    reused: int = 0


def hashes(files: DataFrame) -> DataFrame:
    return files.where("content is not null").select("path", content_hash(F.col("content")).alias("hash"))


def run(tier: Tier, files: DataFrame, mode: str, prior: DataFrame | None = None, client: Callable[[], Callable[[str], tuple[str | None, str | None]]] | None = None) -> Answered:
    """Asks about all live files that an earlier report has no usable result for. files: path, status, diff_text, changed_lines, content."""
    rows = scope.live(files).withColumn("n_lines", line_count(F.col("content")))
    old, reused = None, 0
    if prior is not None:
        done = cut(resume.succeeded(hashes(rows), reports.files(prior, tier.name, mode), reports.skipped(prior), tier.name))
        rows, old, reused = resume.remaining(rows, done), resume.reused(reports.findings(prior, tier.name), done), done.count()
    kept, skipped = scope.readable(rows, tier.name, tier.max_lines)
    asked = responses.requested(kept.select("path", responses.user_message(F.col("path"), F.col("status"), F.col("content"), F.col("diff_text")).alias("message")), client or (lambda: asker(tier)))
    asked = cut(asked)  # nothing is asked twice
    ordered = kept.select("path", "changed_lines", F.col("path").alias("file_ord"))
    parsed = cut(responses.parsed(asked.join(ordered, "path"), tier.protocol).withColumn("reason", F.coalesce("error", "reason")).withColumn("findings", F.when(F.col("error").isNull(), F.col("findings"))))
    new = cut(responses.findings(parsed, tier.name, tier.name, tier.prefix))
    skips = skipped.unionByName(responses.skips(parsed, tier.name))
    counts = new.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n"))
    said = parsed.where("reason is null").select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
    outcomes = said.select("path", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " finding").otherwise(" findings")).alias("outcome")).unionByName(skips.select("path", F.concat(F.lit("skipped: "), "reason").alias("outcome")))
    found = new.withColumn("part", F.lit(0)) if old is None else resume.resumed(old, new)
    return Answered(found, skips, outcomes, reused)

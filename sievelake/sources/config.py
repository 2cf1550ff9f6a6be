"""Settings of a review; a driver-side object. Names and defaults are fixed values: existing files keep working."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Rules:
    enabled: bool = True
    ruff: bool = True
    eslint: bool = True
    semgrep: bool = True
    house_rules: bool = True
    test_coverage: bool = True


@dataclass(frozen=True)
class Cloud:
    enabled: bool = False
    provider: str = "anthropic"
    model: str = "claude-sonnet-4-6"
    api_key_env: str | None = None
    base_url: str | None = None
    max_file_lines: int = 800
    audit_file_cap: int = 50
    request_timeout_seconds: float = 120.0


@dataclass(frozen=True)
class Local:
    enabled: bool = False
    provider: str = "lm_studio"
    base_url: str | None = None
    model: str = ""
    api_key_env: str | None = None
    max_file_lines: int = 2000
    request_timeout_seconds: float = 300.0


@dataclass(frozen=True)
class Thresholds:
    fail_on_severity: str = "high"


@dataclass(frozen=True)
class Config:
    rules: Rules = field(default_factory=Rules)
    cloud: Cloud = field(default_factory=Cloud)
    local: Local = field(default_factory=Local)
    thresholds: Thresholds = field(default_factory=Thresholds)


#: Chat-completion addresses of known providers.
PRESETS = {
    "groq": "https://api.groq.com/openai/v1/chat/completions", "mistral": "https://api.mistral.ai/v1/chat/completions", "cerebras": "https://api.cerebras.ai/v1/chat/completions",
    "openrouter": "https://openrouter.ai/api/v1/chat/completions", "lm_studio": "http://localhost:1234/v1/chat/completions", "ollama": "http://localhost:11434/v1/chat/completions",
}


def base_url(model: Cloud | Local) -> str | None:
    """The address set, else the provider's, else None."""
    return model.base_url or PRESETS.get(model.provider)


def load(path: str | None) -> Config:
    """Settings of a YAML or JSON file; the defaults without one. Unknown keys are ignored."""
    if path is None or not Path(path).is_file():
        return Config()
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text) if text.lstrip().startswith("{") else two_levels(text)
    return build(Config, data or {})


def build(kind: type, data: dict):
    values = {}
    for f in fields(kind):
        if f.name in data:
            default = f.default_factory() if callable(f.default_factory) else f.default
            values[f.name] = build(type(default), data[f.name] or {}) if is_dataclass(default) else data[f.name]
    return kind(**values)


def two_levels(text: str) -> dict:
    """The part of YAML that settings need where no parser is installed: sections of `key: scalar`."""
    out: dict = {}
    section: dict = out
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        key, colon, value = bare.strip().partition(":")
        if not colon:
            raise ValueError(f"not a setting: {line!r}")
        if not line[0].isspace():
            section = out.setdefault(key, {})
            if value.strip():
                raise ValueError(f"not a section: {line!r}")
        else:
            section[key] = scalar(value.strip())
    return out


def scalar(text: str):
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text

"""Settings of a knowledge base: sections of a TOML file with defaults, and what makes them invalid."""

from __future__ import annotations

import posixpath
import tomllib

# Sections, settings and their defaults.
DEFAULTS: dict[str, dict] = {
    "project": {"name": "knowledge", "wiki_dir": "./wiki"},
    "source": {"root": "./docs", "include": ["**/*.md", "**/*.markdown", "**/*.mdx"], "exclude": ["wiki/**", ".git/**", "node_modules/**"]},
    "llm": {"base_url": "http://localhost:8000/v1", "model": "", "api_key_env": "LOREKILN_API_KEY", "max_output_tokens": 4096, "max_concurrency": 4, "timeout_seconds": 120},
    "embedding": {"base_url": "", "model": "", "api_key_env": "LOREKILN_API_KEY", "max_concurrency": 1, "batch_size": 16, "max_retries": 3, "requests_per_minute": 0},
    "rerank": {"base_url": "", "model": "", "api_key_env": "LOREKILN_API_KEY"},
    "analysis": {"max_input_tokens": 32_000, "section_target_tokens": 6_000, "max_plan_input_tokens": 32_000, "max_rejected_claim_ratio": 0.10},
    "planning": {"max_cluster_nodes": 24, "reconcile_rounds": 64},
    "search": {"full_text": True, "graph": True, "rerank": "none", "source_mode": "wiki"},
    "build": {"incremental": True, "keep_generations": 3},
    "aggregate": {"llm_summary": False, "top_hub_pages": 10, "top_concepts": 12, "max_summary_pages": 40},
    "server": {"bind": "127.0.0.1", "max_queued_jobs": 8, "rate_limit_per_minute": 120},
}


class ConfigError(ValueError):
    """Settings that no build may run with."""


def parsed(text: str = "") -> dict[str, dict]:
    """Settings of a TOML text over the defaults. Unknown sections and settings, wrong types and values out of range are errors."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(f"not TOML: {error}") from error
    out = {section: dict(values) for section, values in DEFAULTS.items()}
    for section, values in given.items():
        if section not in out or not isinstance(values, dict):
            raise ConfigError(f"unknown section {section}")
        for name, value in values.items():
            if name not in out[section]:
                raise ConfigError(f"unknown setting {section}.{name}")
            default = out[section][name]
            kinds = (int, float) if isinstance(default, float) else (type(default),)
            if not isinstance(value, kinds) or isinstance(value, bool) != isinstance(default, bool):
                raise ConfigError(f"{section}.{name} has the wrong type")
            out[section][name] = value
    problems = faults(out)
    if problems:
        raise ConfigError("; ".join(problems))
    return out


def faults(settings: dict[str, dict]) -> list[str]:
    """What is out of range."""
    least = {
        "llm.max_concurrency": 1, "llm.timeout_seconds": 1, "analysis.max_input_tokens": 1, "analysis.max_plan_input_tokens": 1, "planning.max_cluster_nodes": 2,
        "build.keep_generations": 1, "aggregate.top_hub_pages": 1, "aggregate.top_concepts": 1, "aggregate.max_summary_pages": 1,
    }
    at = lambda name: settings[name.split(".")[0]][name.split(".")[1]]
    out = [f"{name} must be at least {low}" for name, low in least.items() if at(name) < low]
    if not 0 <= at("analysis.max_rejected_claim_ratio") <= 1:
        out.append("analysis.max_rejected_claim_ratio must be within 0 and 1")
    strategy = at("search.rerank")
    if strategy not in ("none", "cohere-compatible"):
        out.append(f"unknown search.rerank {strategy}")
    elif strategy != "none" and not at("rerank.model").strip():
        out.append("search.rerank needs rerank.model")
    if at("search.source_mode") not in ("wiki", "source", "fusion"):
        out.append(f"unknown search.source_mode {at('search.source_mode')}")
    if overlap(at("source.root"), at("project.wiki_dir")):
        out.append("source.root and project.wiki_dir overlap")
    return out


def overlap(a: str, b: str) -> bool:
    """Whether one of two folders holds the other, by their names alone."""
    parts = [posixpath.normpath(posixpath.join("/", p)).split("/") for p in (a, b)]
    parts = [[x for x in p if x] for p in parts]
    n = min(map(len, parts))
    return parts[0][:n] == parts[1][:n]


def as_toml(settings: dict[str, dict]) -> str:
    """A TOML text that ``parsed`` reads back."""

    def value(x) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "[" + ", ".join(map(value, x)) + "]"
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(x, str) else str(x)

    return "\n".join(f"[{section}]\n" + "".join(f"{name} = {value(x)}\n" for name, x in values.items()) for section, values in settings.items())

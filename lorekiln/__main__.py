"""Command line over one knowledge base: ``python -m lorekiln --home FOLDER COMMAND``. Answers are one JSON object a line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Iterator
from pathlib import Path

from . import config
from .engine import KnowledgeBase
from .sources import http

# Exit codes by what went wrong.
CONFIG, STORAGE, MODEL, LINT = 2, 5, 6, 11


class Failure(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lorekiln")
    parser.add_argument("--home", default=".lorekiln", help="folder of settings and state")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "status", "doctor", "lint", "embed"):
        commands.add_parser(name)
    for name in ("scan", "build"):
        own = commands.add_parser(name)
        own.add_argument("root", nargs="?")
        if name == "build":
            own.add_argument("--build-id")
    for name in ("search", "context", "ask"):
        own = commands.add_parser(name)
        own.add_argument("query")
        own.add_argument("--hybrid", action="store_true")
        own.add_argument("--limit", type=int, default=10)
    return parser


def _settings(home: Path) -> dict:
    path = home / "config.toml"
    return config.parsed(path.read_text() if path.exists() else "")


def _provider(settings: dict, section: str, kind: type):
    own = settings[section]
    if not own["model"]:
        raise Failure(CONFIG, f"{section}.model is not set")
    url = own["base_url"] or settings["llm"]["base_url"]
    return kind(http.Transport(url, own["api_key_env"], settings["llm"]["timeout_seconds"]), own["model"])


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lorekiln").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _init(home: Path) -> Iterator[dict]:
    path = home / "config.toml"
    if path.exists():
        raise Failure(CONFIG, f"{path} is there already")
    home.mkdir(parents=True, exist_ok=True)
    path.write_text(config.as_toml(config.DEFAULTS))
    yield {"created": str(path)}


def _doctor(settings: dict, home: Path) -> Iterator[dict]:
    """What is set, without a request and without a key's value."""
    yield {"check": "settings", "ok": True}
    yield {"check": "state", "ok": (home / "state").is_dir()}
    for section in ("llm", "embedding", "rerank"):
        own = settings[section]
        yield {"check": section, "ok": bool(own["model"]), "key": bool(os.environ.get(own["api_key_env"]))}


def run(argv: list[str], spark=None) -> Iterator[dict]:
    asked = _arguments().parse_args(argv)
    home = Path(asked.home)
    if asked.command == "init":
        yield from _init(home)
        return
    settings = _settings(home)
    if asked.command == "doctor":
        yield from _doctor(settings, home)
        return
    hybrid = asked.command == "embed" or getattr(asked, "hybrid", False)
    embedding = _provider(settings, "embedding", http.HttpEmbedding) if hybrid else None
    text = _provider(settings, "llm", http.HttpText) if asked.command == "ask" else None
    kb = KnowledgeBase(spark or _session(), str(home / "state"), settings["project"]["name"], text, embedding)
    globs = {"include": tuple(settings["source"]["include"]), "exclude": tuple(settings["source"]["exclude"])}
    if asked.command == "scan":
        yield from (r.asDict() for r in kb.scan(asked.root or settings["source"]["root"], **globs).toLocalIterator())
    elif asked.command == "build":
        build_id = asked.build_id or f"b{time.time_ns() // 1_000_000}"
        yield {"build_id": build_id, "outcome": kb.build(asked.root or settings["source"]["root"], build_id, settings["analysis"]["section_target_tokens"], **globs)}
    elif asked.command == "status":
        yield kb.status()
    elif asked.command == "embed":
        yield {"vectors": kb.embed()}
    elif asked.command == "search":
        yield from (r.asDict() for r in kb.search(asked.query, asked.limit).orderBy("rank").collect())  # fifty at most
    elif asked.command == "context":
        yield from (r.asDict() for r in kb.context(asked.query).collect())  # bounded by the budget
    elif asked.command == "ask":
        answer = kb.ask(asked.query)
        yield answer
        if answer["codes"]:
            raise Failure(MODEL, "the answer is not valid")
    elif asked.command == "lint":
        errors = 0
        for row in kb.lint().toLocalIterator():
            errors += row["severity"] == "error"
            yield row.asDict()
        if errors:
            raise Failure(LINT, f"{errors} errors")


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        for row in run(sys.argv[1:] if argv is None else argv, spark):
            print(json.dumps(row, ensure_ascii=False, default=str))
    except Failure as failure:
        print(f"error: {failure}", file=sys.stderr)
        return failure.code
    except config.ConfigError as error:
        print(f"error: {error}", file=sys.stderr)
        return CONFIG
    except LookupError as error:
        print(f"error: {error}", file=sys.stderr)
        return STORAGE
    except (http.ApiError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return MODEL
    return 0


if __name__ == "__main__":
    sys.exit(main())

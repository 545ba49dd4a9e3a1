"""The boundary to language, embedding and rerank models: providers are injected, and called once for each miss."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

# Backoff between tries.
FIRST_WAIT, LONGEST_WAIT = 0.5, 8.0


class TextProvider(Protocol):
    model: str

    def generate(self, prompt: str) -> str: ...


class EmbeddingProvider(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class RerankProvider(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[int]: ...


def backoff(attempt: int) -> float:
    return min(FIRST_WAIT * 2 ** min(attempt, 4), LONGEST_WAIT)


def with_retries(call: Callable, tries: int = 3, wait: Callable[[float], None] | None = None):
    """The call's result; what it raises if the last try fails too."""
    for attempt in range(tries):
        try:
            return call()
        except (OSError, TimeoutError):
            if attempt == tries - 1:
                raise
            if wait:
                wait(backoff(attempt))


class FakeText:
    """Answers by a function of the prompt."""

    def __init__(self, answer: Callable[[str], str], model: str = "fake"):
        self.answer, self.model = answer, model

    def generate(self, prompt: str) -> str:
        return self.answer(prompt)


class FakeEmbedding:
    """Unit vectors from hashed character pairs: equal texts are equal, similar ones near."""

    def __init__(self, width: int = 64, model: str = "fake"):
        self.width, self.model = width, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for a, b in zip(text, text[1:], strict=False):
                v[int.from_bytes(hashlib.blake2b((a + b).encode(), digest_size=4).digest(), "little") % self.width] += 1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


def json_payload(text: str) -> str | None:
    """The first balanced JSON object or array in a text; brackets inside strings do not count."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    return text[start : i + 1]
        later = [i for i in (text.find("{", start + 1), text.find("[", start + 1)) if i >= 0]
        start = min(later, default=-1)
    return None


def parse_embeddings(body: str, wanted: int) -> list[list[float]]:
    """Vectors of an embeddings response in the order of their indexes."""
    data = sorted(json.loads(body)["data"], key=lambda x: x["index"])
    if [x["index"] for x in data] != list(range(wanted)):
        raise ValueError("indexes are not those of the request")
    return [x["embedding"] for x in data]


def parse_rerank(body: str, n: int) -> list[int]:
    """Indexes of a rerank response by falling relevance; those out of range or repeated are left out."""
    results = sorted(json.loads(body)["results"], key=lambda x: -x["relevance_score"])
    return list(dict.fromkeys(x["index"] for x in results if 0 <= x["index"] < n))


def generate_cached(wanted: DataFrame, cache: DataFrame, provider: TextProvider, valid: Callable[[str], bool] = lambda _: True) -> tuple[DataFrame, DataFrame]:
    """Answers (cache_key, response) to wanted (cache_key, prompt), and the rows that the cache gains.

    Only distinct misses reach the provider, and only valid answers, after one more try, are remembered.
    """
    misses = wanted.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, prompt in zip(rows["cache_key"], rows["prompt"], strict=True):
                answer = provider.generate(prompt)
                if not valid(answer):
                    answer = provider.generate(prompt + "\n\nThe last answer was not valid.")
                if valid(answer):
                    out.append((key, answer))
            yield pd.DataFrame(out, columns=["cache_key", "response"])

    # written: both results read it, and no miss may reach the provider twice
    gained = written(misses.select("cache_key", "prompt").mapInPandas(part, "cache_key string, response string"), "cache-gained")
    answers = wanted.select("cache_key").join(cache.select("cache_key", "response").unionByName(gained), "cache_key", "left")
    return answers, gained


def backfill(sections: DataFrame, stored: DataFrame, provider: EmbeddingProvider, batch: int = 8) -> DataFrame:
    """text_hash, model, embedding of texts (text_hash, text) without a stored vector of the model."""
    have = stored.where(F.col("model") == provider.model).select("text_hash")
    missing = sections.dropDuplicates(["text_hash"]).join(have, "text_hash", "left_anti")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                own = rows.iloc[i : i + batch]
                vectors = with_retries(lambda own=own: provider.embed(own["text"].tolist()))
                yield pd.DataFrame({"text_hash": own["text_hash"], "model": provider.model, "embedding": vectors})

    return missing.select("text_hash", "text").mapInPandas(part, "text_hash string, model string, embedding array<float>")


def answer_codes(answer: str, citable: set[str]) -> list[str]:
    """What makes an answer invalid."""
    import re

    if not answer.strip():
        return ["EMPTY_ANSWER"]
    codes = []
    claims = re.findall(r'<!--\s*(?:[\w-]+:)?cite\s+claim="([^"]*)"\s*-->', answer)
    if answer.count("<!--") > answer.count("-->"):
        codes.append("UNCLOSED_COMMENT")
    if not claims:
        codes.append("UNGROUNDED_ANSWER")
    if any(not c.strip() for c in claims):
        codes.append("EMPTY_CLAIM_REF")
    if any(c.strip() and c not in citable for c in claims):
        codes.append("UNKNOWN_CLAIM_REF")
    return codes

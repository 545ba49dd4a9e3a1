"""Providers behind HTTP endpoints of the usual form: chat completions, embeddings, rerank."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from .providers import backoff, parse_embeddings, parse_rerank

# The longest wait that a server may ask for.
LONGEST_RETRY_AFTER = 30


class ApiError(RuntimeError):
    def __init__(self, status: int, message: str):
        super().__init__(f"{status}: {message}")
        self.status = status


class Transport:
    """POST of JSON with a bearer key and bounded retries after 429, 5xx and network errors; other statuses fail at once.

    The key is read from the environment where a request is made, so it is never part of a task.
    """

    def __init__(self, base_url: str, api_key_env: str, timeout: float = 120, tries: int = 4, wait: Callable[[float], None] = time.sleep):
        self.base_url, self.api_key_env, self.timeout, self.tries, self.wait = base_url.rstrip("/"), api_key_env, timeout, tries, wait

    def post(self, path: str, body: dict) -> str:
        headers = {"Content-Type": "application/json"}
        key = os.environ.get(self.api_key_env, "").strip()
        if key:
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(f"{self.base_url}/{path}", json.dumps(body).encode(), headers)
        near = urllib.parse.urlparse(self.base_url).hostname in ("localhost", "127.0.0.1", "::1")
        opener = urllib.request.build_opener(*([urllib.request.ProxyHandler({})] if near else []))
        for attempt in range(self.tries):
            last = attempt == self.tries - 1
            try:
                with opener.open(request, timeout=self.timeout) as response:
                    return response.read().decode()
            except urllib.error.HTTPError as error:
                if last or error.code != 429 and error.code < 500:
                    raise ApiError(error.code, error.read().decode(errors="replace")) from error
                asked = error.headers.get("Retry-After", "")
                self.wait(min(int(asked), LONGEST_RETRY_AFTER) if asked.isdigit() else backoff(attempt))
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if last:
                    raise
                self.wait(backoff(attempt))
        raise AssertionError("unreachable")


class HttpText:
    def __init__(self, transport: Transport, model: str, most_tokens: int = 4096):
        self.transport, self.model, self.most_tokens = transport, model, most_tokens

    def generate(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": self.most_tokens}
        return json.loads(self.transport.post("chat/completions", body))["choices"][0]["message"]["content"] or ""


class HttpEmbedding:
    def __init__(self, transport: Transport, model: str):
        self.transport, self.model = transport, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        return parse_embeddings(self.transport.post("embeddings", {"model": self.model, "input": texts}), len(texts))


class HttpRerank:
    def __init__(self, transport: Transport, model: str):
        self.transport, self.model = transport, model

    def rerank(self, query: str, documents: list[str]) -> list[int]:
        body = {"model": self.model, "query": query, "documents": documents, "top_n": len(documents)}
        return parse_rerank(self.transport.post("rerank", body), len(documents))

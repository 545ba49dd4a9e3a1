"""Settings, endpoints and the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lorekiln import config
from lorekiln.__main__ import main
from lorekiln.sources import http


def test_settings():
    assert config.parsed(config.as_toml(config.DEFAULTS)) == config.DEFAULTS
    assert config.parsed("[analysis]\nmax_rejected_claim_ratio = 1\n")["analysis"]["max_rejected_claim_ratio"] == 1
    bad = ["[llm]\nmax_concurrency = 0", "[planning]\nmax_cluster_nodes = 1", "[search]\nrerank = 'cohere-compatible'", "[search]\nrerank = 'x'", "[source]\nroot = './wiki/in'", "[x]\ny = 1", "[llm]\ny = 1", "[llm]\nmodel = 1", "[build]\nincremental = 1", "["]
    for text in bad:
        with pytest.raises(config.ConfigError):
            config.parsed(text)
    assert config.overlap("a", "./a/b") and config.overlap("/", "x") and not config.overlap("docs", "docs2")


@pytest.fixture
def endpoint():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization")))
            status, out = 200, {"choices": [{"message": {"content": "said " + str(body.get("messages", [{}])[0].get("content"))}}]}
            if self.path == "/v1/embeddings":
                out = {"data": [{"index": i, "embedding": [float(len(x)), 1.0]} for i, x in reversed(list(enumerate(body["input"])))]}
            if self.path == "/v1/rerank":
                status, out = (429, {}) if len(seen) == 1 else (200, {"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}, {"index": 7, "relevance_score": 1}]})
            if body.get("model") == "none":
                status = 404
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "99")
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen
    server.shutdown()


def test_endpoints(endpoint, monkeypatch):
    url, seen = endpoint
    waits = []
    transport = http.Transport(url, "LOREKILN_TEST_KEY", wait=waits.append)
    assert http.HttpRerank(transport, "m").rerank("q", ["a", "b"]) == [1, 0] and waits == [30]
    monkeypatch.setenv("LOREKILN_TEST_KEY", " k ")
    assert http.HttpText(transport, "m").generate("hi") == "said hi" and seen[-1] == ("/v1/chat/completions", "Bearer k")
    assert http.HttpEmbedding(transport, "m").embed(["a", "bbb"]) == [[1.0, 1.0], [3.0, 1.0]]
    with pytest.raises(http.ApiError):
        http.HttpText(transport, "none").generate("hi")
    assert waits == [30]  # no second try after 404
    with pytest.raises(OSError):
        http.Transport("http://127.0.0.1:9", "X", tries=3, wait=waits.append).post("x", {})
    assert waits[1:] == [0.5, 1.0]


def test_command_line(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Alpha\n\nten ports, see [[Beta]]\n")
    (docs / "b.markdown").write_text("# Beta\n\nno ports\n")
    said = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    go = lambda *argv: main(["--home", str(tmp_path / "home"), *argv], spark)
    assert go("init") == 0 and go("init") == 2
    assert go("search", "ports") == 5
    said()
    assert go("build", str(docs), "--build-id", "b1") == 0 and said() == [{"build_id": "b1", "outcome": "published"}]
    assert go("search", "ten ports") == 0 and said()[0]["path"] == "a.md"
    assert go("status") == 0 and said()[0]["pages"] == 2
    assert go("ask", "x") == 2 and go("doctor") == 0 and len(said()) == 5
    assert go("lint") == 0

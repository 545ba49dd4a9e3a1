"""The entry points end to end over a small folder."""

import pytest

from lorekiln.engine import KnowledgeBase
from lorekiln.sources.providers import FakeEmbedding, FakeText


def test_knowledge_base(spark, tmp_path):
    source = tmp_path / "docs"
    (source / "guide").mkdir(parents=True)
    (source / "guide" / "a.md").write_text("---\ntitle: A\nlang: en\n---\n# Alpha\n\nconnect to the server\n\n## Limits\n\nat most ten clients, see [[Beta]] and [[Gamma]]\n")
    (source / "b.mdx").write_text('# Beta\n\n<Callout type="warn">close every connection</Callout>\n')
    kb = KnowledgeBase(spark, str(tmp_path / "state"), text=FakeText(lambda p: 'ten <!-- kb:cite claim="guide/a.md#Alpha#Limits" -->'), embedding=FakeEmbedding())
    assert kb.status() == {"build_id": None, "pages": 0, "sections": 0}
    with pytest.raises(LookupError):
        kb.search("x")
    assert {r["status"] for r in kb.scan(str(source)).collect()} == {"added"}
    assert kb.build(str(source), "b1") == "published" and kb.build(str(source), "b2") == "unchanged"
    assert kb.status() == {"build_id": "b1", "pages": 2, "sections": 3}
    (hit,) = kb.search("ten CLIENTS").collect()
    assert (hit["path"], hit["heading_path"], hit["exact"]) == ("guide/a.md", ["Alpha", "Limits"], True) and "[ten] [clients]" in hit["snippet"]
    assert "**Warning:**" in kb.context("close").first()["body"]
    assert kb.embed() == 3 == kb.embed()
    answer = kb.ask("how many clients")
    assert answer["codes"] == [] and "guide/a.md" in answer["sources"]
    assert [(r["check"], r["message"]) for r in kb.lint().collect()] == [("broken-link", "no page is called Gamma")]
    (source / "b.mdx").write_text("# Beta\n\nnew text\n")
    assert {r["rel_path"]: r["status"] for r in kb.scan(str(source)).collect()} == {"b.mdx": "modified", "guide/a.md": "unchanged"}
    assert kb.build(str(source), "b3") == "published"
    assert sorted(r["outcome"] for r in kb.diff("b1").collect()) == ["carried", "changed"]


def test_context_is_reranked_and_spares_uncovered_queries(spark, tmp_path):
    source = tmp_path / "docs"
    source.mkdir()
    for name, text in (("a", "ports ports ports"), ("b", "ports and more"), ("c", "a port, ports")):
        (source / f"{name}.md").write_text(f"# {name}\n\n{text}\n")

    class Last:
        def rerank(self, query, documents):
            return [len(documents) - 1]

    class Never(FakeEmbedding):
        def embed(self, texts):
            raise AssertionError("no section has a vector")

    kb = KnowledgeBase(spark, str(tmp_path / "state"))
    kb.build(str(source), "b1")
    plain = [r["path"] for r in kb.context("ports").collect()]
    kb.rerank, kb.embedding = Last(), Never()
    assert len(plain) == 3 and [r["path"] for r in kb.context("ports").collect()] == [plain[2], *plain[:2]]
    assert kb.context("absent").collect() == []

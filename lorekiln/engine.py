"""The entry points: scan, build, status, search, context, ask, embed, lint and replan over one knowledge base.

State is Parquet under one root: generations, and tables by build beside them. A build writes
new partitions first and moves the pointer last, so readers see the old build or the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import context as C
from .operators import ingest, lifecycle, lint, retrieval, versions
from .operators.state import clamped
from .sources import files, markdown, providers
from .sources.tables import remove


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, workspace: str = "kb", text: providers.TextProvider | None = None, embedding: providers.EmbeddingProvider | None = None, rerank: providers.RerankProvider | None = None):
        self.spark, self.root, self.workspace = spark, root.rstrip("/"), workspace
        self.text, self.embedding, self.rerank = text, embedding, rerank
        self.store = files.Generations(spark, root)

    def _table(self, name: str, build_id: str | None = None) -> DataFrame:
        build_id = build_id or self.store.current()
        if build_id is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/{name}/build_id={build_id}")

    def scan(self, source_root: str, **globs) -> DataFrame:
        """rel_path, status against the active build. Reads only."""
        now = ingest.manifest(files.scan(self.spark, source_root, **globs).where("problem IS NULL"), self.workspace)
        before = self._table("manifest") if self.store.current() else now.limit(0)
        return ingest.manifest_diff(before, now)

    def build(self, source_root: str, build_id: str, section_tokens: int = 6000, **globs) -> str:
        """Parse, chunk, index and publish. 'unchanged' if the snapshot is that of the active build, else 'published'."""
        found = files.scan(self.spark, source_root, **globs).where("problem IS NULL").select("rel_path", "content")
        manifest = ingest.manifest(found, self.workspace)
        if self.store.current():
            same = ingest.snapshot_hash(manifest).first() == ingest.snapshot_hash(self._table("manifest")).first()
            if same:
                return "unchanged"
        out = lambda df, name: df.write.mode("overwrite").parquet(f"{self.root}/{name}/build_id={build_id}")
        out(manifest, "manifest")
        raw = found.select(F.col("rel_path").alias("path"), F.decode("content", "UTF-8").alias("raw"))
        out(markdown.read_sections(raw), "sections")
        sections = self._table("sections", build_id)
        out(markdown.read_chunks(sections, section_tokens), "chunks")
        title = F.coalesce(F.min_by("heading", F.when(F.col("level") == 1, F.col("ord"))), F.regexp_extract(F.first("path"), r"([^/]+)\.(?:mdx?|markdown)$", 1))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda s: s["content"]), "\n\n")
        pages = sections.groupBy("path").agg(title.alias("title"), body.alias("content"), F.first("language").alias("language"))
        pages = pages.select(F.concat(F.lit("wp_"), F.sha2("path", 256)).alias("page_id"), T.slug(F.regexp_replace("path", r"\.(mdx?|markdown)$", "")).alias("slug"), "title", "content", F.sha2("content", 256).alias("body_hash"), "path", F.coalesce("language", T.language("content", path=F.col("path"))).alias("language"))
        retrieval.store_index(self._indexed(sections), "section_id", F.col("words"), self._index(build_id))
        self.store.publish(pages, build_id)
        return "published"

    def _index(self, build_id: str) -> str:
        return f"{self.root}/index/build_id={build_id}"

    def ensure_index(self) -> bool:
        """Whether the index covers exactly the active build's sections; if not, it is built again."""
        build_id = self.store.current()
        if build_id is None:
            return False
        sections = self._indexed(self._table("sections"))
        drift = retrieval.index_drift(retrieval.stored_lengths(self.spark, self._index(build_id), dict(sections.dtypes)["section_id"]), sections.select(F.col("section_id").alias("id"))).first()
        if not drift["matches"]:
            remove(self.spark, self._index(build_id))
            retrieval.store_index(sections, "section_id", F.col("words"), self._index(build_id))
        return drift["matches"]

    @staticmethod
    def _indexed(sections: DataFrame) -> DataFrame:
        key = F.concat_ws("#", "path", F.col("ord").cast("string")).alias("section_id")
        return sections.select(key, "path", "ord", "heading_path", "content", retrieval.index_tokens(F.array_join("heading_path", " "), F.col("content")).alias("words"))

    def status(self) -> dict:
        build_id = self.store.current()
        return {"build_id": build_id, "pages": self.store.read().count() if build_id else 0, "sections": self._table("sections").count() if build_id else 0}

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """rank, path, heading_path, score, exact, snippet of the active build's sections."""
        build_id = self.store.current()
        if build_id is None:
            raise LookupError("nothing is published")
        hits = retrieval.search_stored(self.spark, self._index(build_id), query, clamped(limit, 50))
        sections = self._indexed(self._table("sections"))
        joined = retrieval.ranked(hits, F.desc("score"), "id").join(sections, F.col("id") == F.col("section_id"))
        exact = retrieval.exact_match(query, F.array_join("heading_path", " "), F.col("content"))
        return joined.select("rank", "path", "heading_path", "score", exact.alias("exact"), T.snippet(F.col("content"), F.lit(query)).alias("snippet"))

    def context(self, query: str, chunks: int = C.CHUNKS, tokens: int = C.TOKENS) -> DataFrame:
        """pos, path, heading_path, body of a budgeted bundle, in order."""
        lexical = self.search(query, min(50, 3 * chunks)).select("path", F.array_join("heading_path", "\x1f").alias("heading"), "rank")
        covered = self.embedding and lifecycle.covered(self._hashed(), self.embeddings(), self.embedding.model)
        vector = self._nearest(query) if covered else lexical.limit(0)  # without stored vectors the query is not embedded either
        fused = retrieval.ranked(retrieval.fuse_sum(lexical, vector, ["path", "heading"]), F.desc("score"), "path", "heading")
        sections = self._table("sections").groupBy("path", F.array_join("heading_path", "\x1f").alias("heading")).agg(F.min_by("content", "ord").alias("body"))
        found = fused.join(sections, ["path", "heading"])
        if self.rerank:
            found = self._reranked(query, found)
        candidates = found.select(F.col("rank").cast("long").alias("pos"), F.col("path").alias("page_id"), F.col("path").alias("source"), T.estimate_tokens("body").alias("tokens"), "heading", "body")
        taken = C.select_context(candidates, chunks=chunks, tokens=tokens).where("taken")
        return taken.select("pos", F.col("page_id").alias("path"), F.split("heading", "\x1f").alias("heading_path"), "body").orderBy("pos")

    def _reranked(self, query: str, found: DataFrame) -> DataFrame:
        """Candidates, as many as two top-k lists have, in the reranker's order; those that it leaves out follow in theirs."""
        rows = found.orderBy("rank").select("path", "heading", "body").collect()
        places = self.rerank.rerank(query, [r["body"] for r in rows]) if rows else []
        order = self.spark.createDataFrame([(rows[i]["path"], rows[i]["heading"], n) for n, i in enumerate(places)], "path string, heading string, place int")
        joined = found.drop("rank").join(F.broadcast(order), ["path", "heading"], "left")
        return retrieval.ranked(joined, F.col("place").asc_nulls_last(), F.desc("score"), "path", "heading").drop("place")

    def _hashed(self) -> DataFrame:
        sections = self._table("sections")
        text = T.section_text(F.col("path"), F.col("heading_path"), F.col("content"))
        return sections.select("path", F.array_join("heading_path", "\x1f").alias("heading"), text.alias("text"), F.sha2(text, 256).alias("text_hash"))

    def embed(self) -> int:
        """Vectors for sections that have none of the provider's model; how many there are now."""
        path = f"{self.root}/embeddings"
        stored = self.embeddings()
        rows = providers.backfill(self._hashed(), stored, self.embedding)
        rows.write.mode("append").parquet(path)
        return self.embeddings().count()

    def embeddings(self) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/embeddings").dropDuplicates(["text_hash", "model"])
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], "text_hash string, model string, embedding array<float>")

    def _nearest(self, query: str) -> DataFrame:
        vectors = self.embeddings().where(F.col("model") == self.embedding.model)
        hits = retrieval.ranked(retrieval.vector_top_k(vectors, self.embedding.embed([query])[0]), F.desc("score"), "text_hash")
        return hits.join(self._hashed(), "text_hash").select("path", "heading", "rank")

    def ask(self, query: str) -> dict:
        """An answer over the context, with what makes it invalid, if anything. Claims are section paths."""
        rows = self.context(query).collect()  # bounded by the budget
        citable = {"#".join([r["path"], *r["heading_path"]]) for r in rows}
        prompt = query + "\n\n" + "\n\n".join(f'[{"#".join([r["path"], *r["heading_path"]])}]\n{r["body"]}' for r in rows)
        answer = self.text.generate(prompt)
        codes = providers.answer_codes(answer, citable)
        if codes:
            answer = self.text.generate(prompt + "\n\nThe last answer was not valid: " + ", ".join(codes))
            codes = providers.answer_codes(answer, citable)
        return {"answer": answer, "codes": codes, "sources": sorted({r["path"] for r in rows})}

    def lint(self, files_on_disk: DataFrame | None = None, citations: DataFrame | None = None, sources: DataFrame | None = None, relations: DataFrame | None = None, insights: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
        """Findings of the active build: duplicates, broken links, unsupported sections, and the checks whose tables are given.

        citations with sources: missing and changed ones; relations (source, target: slugs): orphans; insights with
        current (citation_id, current): stale ones; files_on_disk: edited files. The columns are those of operators/lint.py.
        """
        if (citations is None) != (sources is None) or (insights is None) != (current is None):
            raise ValueError("citations need sources, and insights need current")
        pages = self.store.read()
        page = pages.select("path", "page_id", "slug", "title", F.lit("source").alias("category"), F.array("slug").alias("refs"))
        links = lint.body_links(pages)
        found = [lint.duplicates(pages), lint.broken_links(links, pages)]
        found.append(lint.unsupported_sections(self._table("sections").select("path", "level", "heading", "content").join(page, "path")))
        if citations is not None:
            found.append(lint.citation_sources(citations, sources))
        if relations is not None:
            key = lambda c: F.lower(F.trim(c)).alias("key")
            ends = links.select("slug", key("target")).join(page.select(key("title"), F.col("page_id").alias("to_page")), "key")
            found.append(lint.orphans(page, ends.join(page.select("slug", F.col("page_id").alias("from_page")), "slug"), relations))
        if insights is not None:
            found.append(lint.stale_insights(insights, current))
        if files_on_disk is not None:
            found.append(lint.edited_files(pages, files_on_disk))
        return lint.report(*found)

    def diff(self, build_id: str) -> DataFrame:
        """page_id, outcome of the active build's pages against another build's."""
        return ingest.body_diff(self.store.read(build_id), self.store.read())

    def replan(self, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Classes of new pages and fates of old ones; see operators.versions.plan_diff."""
        return versions.plan_diff(old, new)

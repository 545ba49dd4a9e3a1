"""Retrieval over documents, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import retrieval as R
from ..sources.tables import new_path
from .tables import Tables, registry

QUERIES, SQL, query = registry()

ASK = "the threat of idiot und worthless"
_FOLD = "lower(translate(x, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyaaaaaaceeeeiiiinooooouuuuy'))"


def _bm25_sql(rows: str, k: int | None) -> str:
    """rows: SQL of id, x."""
    terms = ", ".join(f"'{w}'" for w in dict.fromkeys(ASK.split()))
    return f"""
WITH w AS (SELECT id, regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+') AS w FROM ({rows})),
l AS (SELECT id, len(w) AS dl FROM w), g AS (SELECT count(*) AS n, avg(dl) AS mean FROM l),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w) WHERE term IN ({terms}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT tf.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score
FROM tf JOIN df ON tf.term = df.term JOIN l ON tf.id = l.id, g GROUP BY tf.id""" + ("" if k is None else f" ORDER BY score DESC, id LIMIT {k}")


_DOCS = "SELECT doc_id AS id, text AS x FROM documents"
_TURNS = "SELECT conv_id * 1000 + turn AS id, role || ' ' || text AS x FROM conversations"


def _docs(t: Tables, k: int | None) -> DataFrame:
    return R.bm25(t.documents, "doc_id", R.index_tokens(F.col("text")), ASK, k)


def _turns(t: Tables, k: int | None) -> DataFrame:
    turns = t.conversations.withColumn("section_id", F.col("conv_id") * 1000 + F.col("turn"))
    return R.bm25(turns, "section_id", R.index_tokens(F.col("role"), F.col("text")), ASK, k)


@query(f"SELECT id AS doc_id, round(score, 6) AS score FROM ({_bm25_sql(_DOCS, 10)})")
def bm25_search(t: Tables) -> DataFrame:
    return _docs(t, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT id AS section_id, round(score, 6) AS score FROM ({_bm25_sql(_TURNS, 10)})")
def bm25_conversations(t: Tables) -> DataFrame:
    return _turns(t, 10).select("section_id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql(_DOCS, 20)})")
def bm25_from_index(t: Tables) -> DataFrame:
    """The same ranking from stored postings and lengths."""
    posting, lengths = R.postings(t.documents, "doc_id", R.index_tokens(F.col("text")))
    return R.search_postings(posting, lengths, ASK, 20).select("id", F.round("score", 6).alias("score"))


_stored: dict[tuple[str, str], str] = {}


def _index(t: Tables, kind: str, rows, id_col: str, *columns: str) -> str:
    """The stored index of a folder's table, built by the first query of a session that asks for it."""
    key = (t.spark.sparkContext.applicationId, f"{t.sf_dir}/{kind}")
    if key not in _stored:
        path = new_path(t.spark, f"index-{kind}")
        R.store_index(rows, id_col, R.index_tokens(*[F.col(c) for c in columns]), path)
        _stored[key] = path
    return _stored[key]


def _stored_docs(t: Tables, k: int) -> DataFrame:
    return R.search_stored(t.spark, _index(t, "documents", t.documents, "doc_id", "text"), ASK, k)


def _stored_turns(t: Tables, k: int) -> DataFrame:
    turns = t.conversations.withColumn("section_id", F.col("conv_id") * 1000 + F.col("turn"))
    return R.search_stored(t.spark, _index(t, "conversations", turns, "section_id", "role", "text"), ASK, k)


@query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql(_DOCS, 20)})")
def bm25_stored(t: Tables) -> DataFrame:
    """From an index on disk, of which the terms' buckets are read."""
    return _stored_docs(t, 20).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(score, 6) AS score FROM ({_bm25_sql(_DOCS, 20)})")
def index_update(t: Tables) -> DataFrame:
    """An index of older documents (some other, some since deleted, some missing), brought up to date and searched."""
    docs, path, to = t.documents.select("doc_id", "text"), new_path(t.spark, "index-old"), new_path(t.spark, "index-new")
    draft = F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit(" worthless draft"))).otherwise(F.col("text"))
    old = docs.where("doc_id % 11 <> 5").withColumn("text", draft).unionByName(docs.where("doc_id % 5 = 1").withColumn("doc_id", -F.col("doc_id") - 1))
    R.store_index(old, "doc_id", R.index_tokens(F.col("text")), path)
    changed = docs.where("doc_id % 7 = 3 OR doc_id % 11 = 5")
    gone = old.where("doc_id < 0").select(F.col("doc_id").alias("id"))
    R.update_index(t.spark, path, changed, gone, "doc_id", R.index_tokens(F.col("text")), to)
    return R.search_stored(t.spark, to, ASK, 20).select("id", F.round("score", 6).alias("score"))


@query("SELECT 0 AS missing, 0 AS surplus, true AS matches UNION ALL SELECT count(*) FILTER (doc_id % 4 = 0), 0, count(*) FILTER (doc_id % 4 = 0) = 0 FROM documents UNION ALL SELECT 0, count(*) FILTER (doc_id % 9 = 0), count(*) FILTER (doc_id % 9 = 0) = 0 FROM documents")
def index_drift(t: Tables) -> DataFrame:
    ids = t.documents.select(F.col("doc_id").alias("id"))
    return R.index_drift(ids, ids).unionByName(R.index_drift(ids.where("id % 4 <> 0"), ids)).unionByName(R.index_drift(ids, ids.where("id % 9 <> 0")))


@query(f"""
WITH h AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM ({_bm25_sql(_DOCS, 30)}))
SELECT id, row_number() OVER (ORDER BY CASE WHEN r % 3 = 0 THEN -r END NULLS LAST, score DESC, id) - 1 AS rank FROM h""")
def rerank_order(t: Tables) -> DataFrame:
    """A reranker that knows every third hit and turns their order round; the others follow by score."""
    hits = R.ranked(_stored_docs(t, 30), F.desc("score"), "id")
    order = hits.where("rank % 3 = 0").select("id", (-F.col("rank")).alias("place"))
    return R.reranked(hits.drop("rank"), order, "id").select("id", "rank")


@query(r"""
SELECT doc_id, len(list_filter(['the', 'of', 'and'], lambda q: NOT list_contains(w, q))) = 0 AS exact
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""")
def exact_match_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", R.exact_match("the of and the", F.col("text")).alias("exact"))


_EXACT = "list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['the', 'threat', 'of', 'idiot', 'und', 'worthless'])"
_FUSED = f"""
WITH a AS (SELECT id, score FROM ({_bm25_sql(_DOCS, 30)})), b AS (SELECT id, score FROM ({_bm25_sql(_TURNS, 30)})),
s AS (SELECT 'doc:' || id AS locator, row_number() OVER (ORDER BY score DESC, id) - 1 AS r, id FROM a),
w AS (SELECT 'turn:' || id AS locator, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM b),
e AS (
  SELECT 'source' AS kind, locator, {_EXACT} AS exact, 1.0::DOUBLE / (60 + r) AS score FROM s JOIN documents d ON d.doc_id = s.id
  UNION ALL SELECT 'wiki', locator, false, 1.0::DOUBLE / (60 + r) FROM w)
SELECT kind, locator, exact, round(score, 9) AS score, row_number() OVER (ORDER BY exact DESC, score DESC, CASE kind WHEN 'wiki' THEN 0 ELSE 1 END, locator) - 1 AS rank FROM e"""


@query(_FUSED)
def rrf_stored(t: Tables) -> DataFrame:
    """As rrf_fusion, from stored indexes; only the hits' texts are read for the exact flag."""
    exact = R.exact_match(ASK, F.col("text")).alias("exact")
    top = R.ranked(_stored_docs(t, 30), F.desc("score"), "id")
    hits = t.documents.select("doc_id", "text").join(F.broadcast(top), F.col("doc_id") == F.col("id"))  # thirty rows
    source = hits.select(F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("locator"), "rank", exact)
    wiki = R.ranked(_stored_turns(t, 30), F.desc("score"), "id").select(F.concat(F.lit("turn:"), F.col("id").cast("string")).alias("locator"), "rank")
    return R.fuse(source, wiki).withColumn("score", F.round("score", 9))


@query(_FUSED)
def rrf_fusion(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", "text").join(F.broadcast(R.ranked(_docs(t, 30), F.desc("score"), "doc_id")), "doc_id")  # thirty rows
    source = hits.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("locator"), "rank", R.exact_match(ASK, F.col("text")).alias("exact"))
    wiki = R.ranked(_turns(t, 30), F.desc("score"), "section_id").select(F.concat(F.lit("turn:"), F.col("section_id").cast("string")).alias("locator"), "rank")
    return R.fuse(source, wiki).withColumn("score", F.round("score", 9))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_COS = f"""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, {_DOT.format(a='embedding', b='e')} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='e', b='e')})) AS score
FROM embeddings, q ORDER BY round(score, 9) DESC, vec_id LIMIT 8"""


def _nearest(t: Tables) -> DataFrame:
    first = t.embeddings.where("vec_id = 0").first()
    return R.vector_top_k(t.embeddings, list(first["embedding"]) if first else [], 8, "vec_id")


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_COS})")
def vector_topk(t: Tables) -> DataFrame:
    return _nearest(t).select("vec_id", F.round("score", 6).alias("score"))


@query()
def vector_topk_all(t: Tables) -> DataFrame:
    """Every row whose id is divisible by 20 asks; all rows answer."""
    found = R.vector_top_k_all(t.embeddings, t.embeddings.where("vec_id % 20 = 0"))
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM ({_bm25_sql(_DOCS, 36)})),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS r FROM ({_COS}))
SELECT coalesce(l.id, v.id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0), 9) AS score
FROM l FULL JOIN v ON l.id = v.id ORDER BY 2 DESC, 1 LIMIT 10""")
def hybrid_topk(t: Tables) -> DataFrame:
    lexical = R.ranked(_docs(t, 36), F.desc("score"), "doc_id").select("doc_id", "rank")
    vector = R.ranked(_nearest(t), F.desc("score"), "vec_id").select(F.col("vec_id").alias("doc_id"), "rank")
    return R.fuse_sum(lexical, vector, ["doc_id"]).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"""
WITH RECURSIVE c AS (
  SELECT row_number() OVER (ORDER BY score DESC, h.id) AS pos, id, conv_id AS page, role AS source,
    CAST(ceil(length(text) / 4) AS BIGINT) + CASE WHEN length(text) = 0 THEN 1 ELSE 0 END AS tokens
  FROM ({_bm25_sql(_TURNS, 36)}) h JOIN conversations v ON h.id = v.conv_id * 1000 + v.turn),
s AS (
  SELECT 0::BIGINT AS pos, 0::BIGINT AS id, []::BIGINT[] AS pages, []::VARCHAR[] AS sources, 0::BIGINT AS spent, 0::BIGINT AS n, false AS taken
  UNION ALL
  SELECT pos, id, CASE WHEN a AND NOT list_contains(pages, page) THEN list_append(pages, page) ELSE pages END,
    CASE WHEN b THEN list_append(sources, source) ELSE sources END, spent + CASE WHEN b AND spent + tokens <= 900 THEN tokens ELSE 0 END,
    n + CASE WHEN b AND spent + tokens <= 900 THEN 1 ELSE 0 END, b AND spent + tokens <= 900
  FROM (SELECT *, a AND len(list_filter(sources, lambda z: z = source)) < 4 AS b
    FROM (SELECT c.*, s.pages, s.sources, s.spent, s.n, s.n < 12 AND (list_contains(s.pages, c.page) OR len(s.pages) < 4) AS a FROM s JOIN c ON c.pos = s.pos + 1)))
SELECT pos, id AS section_id, taken FROM s WHERE pos > 0""")
def context_select(t: Tables) -> DataFrame:
    hits = R.ranked(_turns(t, 36), F.desc("score"), "section_id")
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("section_id"), F.col("conv_id").alias("page_id"), F.col("role").alias("source"), T.estimate_tokens("text").alias("tokens"))
    candidates = turns.join(F.broadcast(hits), "section_id").select((F.col("rank") + 1).cast("long").alias("pos"), "section_id", "page_id", "source", "tokens")
    return C.select_context(candidates, tokens=900).select("pos", "section_id", "taken")


@query("""
SELECT doc_id, n_chars, nth, (SELECT count(*) FROM documents) > 20 AS more
FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS nth FROM documents) WHERE nth <= 20""")
def truncation_limit_plus_one(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    from ..operators.state import truncated

    top = t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(21)
    return truncated(top.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))), 20)


@query()
def snippets(t: Tables) -> DataFrame:
    """Sixteen tokens around the query's words for each of the best hits."""
    hits = t.documents.select("doc_id", "text").join(F.broadcast(_docs(t, 10)), "doc_id")  # ten rows
    return hits.select("doc_id", T.snippet(F.col("text"), F.lit(ASK)).alias("snippet"))


@query()
def locate_evidence(t: Tables) -> DataFrame:
    """Each document's first line, upper-cased, sought in the document: byte range and digest of the original slice."""
    quote = F.upper(F.substring_index("text", "\n", 1))
    found = t.documents.select("doc_id", T.locate_evidence(quote, F.col("text"), F.array().cast("array<string>")).alias("e"))
    return found.select("doc_id", "e.section", "e.start", "e.end", "e.digest")

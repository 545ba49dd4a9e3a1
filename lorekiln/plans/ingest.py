"""Scanning, text functions, manifests and carried state over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from .tables import Tables, registry

QUERIES, SQL, query = registry()

_FILES = "SELECT source || '/' || doc_id || '.md' AS rel_path, text AS content FROM documents"
_MANIFEST = f"SELECT rel_path, 'loc_' || sha256('kb' || chr(0) || rel_path) AS locator_key, sha256(content) AS content_hash, strlen(content) AS size FROM ({_FILES})"


def _files(t: Tables) -> DataFrame:
    return t.documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.col("text").alias("content"), "lang", "source")


def _titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


_TITLES = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"


@query(_MANIFEST)
def scan_manifest(t: Tables) -> DataFrame:
    return I.manifest(_files(t), "kb")


_SUMS = ", ".join(f"sum(CAST('0x' || substr(line, {16 * i + 1}, 16) AS HUGEINT)) AS s{i}" for i in range(4))


@query(f"""
WITH m AS (SELECT sha256(concat_ws(chr(31), rel_path, locator_key, content_hash, CAST(size AS VARCHAR))) AS line FROM ({_MANIFEST})),
sums AS (SELECT count(*) AS entries, {_SUMS} FROM m)
SELECT sha256(concat_ws(chr(10), entries, s0, s1, s2, s3)) AS snapshot_hash, entries FROM sums""")
def snapshot_hash(t: Tables) -> DataFrame:
    return I.snapshot_hash(I.manifest(_files(t), "kb"))


@query(f"""
WITH f AS ({_FILES.replace('text AS content', 'text AS content, lang, source')}),
o AS (SELECT rel_path, sha256(CASE WHEN source = 'src3' THEN content || ' (draft)' ELSE content END) AS h FROM f WHERE lang <> 'es'),
n AS (SELECT rel_path, sha256(content) AS h FROM f WHERE source <> 'src7')
SELECT coalesce(n.rel_path, o.rel_path) AS rel_path,
  CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS status
FROM o FULL JOIN n ON o.rel_path = n.rel_path""")
def manifest_diff(t: Tables) -> DataFrame:
    files = _files(t)
    old = files.where("lang <> 'es'").withColumn("content", F.when(F.col("source") == "src3", F.concat("content", F.lit(" (draft)"))).otherwise(F.col("content")))
    return I.manifest_diff(I.manifest(old, "kb"), I.manifest(files.where("source <> 'src7'"), "kb"))


@query("""
SELECT lower(path) AS portable_key, count(*) AS n
FROM (SELECT CASE WHEN lang = 'en' THEN upper(source) ELSE source END || '/' || md5(text) || '.md' AS path FROM documents)
GROUP BY 1 HAVING count(*) > 1""")
def portable_collisions(t: Tables) -> DataFrame:
    head = F.when(F.col("lang") == "en", F.upper("source")).otherwise(F.col("source"))
    return I.portable_collisions(t.documents.select(F.concat(head, F.lit("/"), F.md5("text"), F.lit(".md")).alias("rel_path")))


@query(r"""
SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, w[1] AS first_token, md5(array_to_string(w, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""")
def tokenize_docs(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", T.tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.get(F.col("w"), 0).alias("first_token"), F.md5(F.array_join("w", " ")).alias("digest"))


_WIDE = r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}"


@query(f"""
WITH n AS (SELECT doc_id, length(text) AS l, length(regexp_replace(text, '[^{_WIDE}]', '', 'g')) AS w FROM documents)
SELECT doc_id, CAST(ceil(2 * w / 3) + ceil((l - w) / 4) + CASE WHEN l = 0 THEN 1 ELSE 0 END AS BIGINT) AS estimated FROM n""")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.estimate_tokens("text").alias("estimated"))


@query(rf"SELECT page_id, regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM ({_TITLES})")
def slugify_titles(t: Tables) -> DataFrame:
    return _titles(t).select("page_id", T.slug("title").alias("slug"))


@query(f"SELECT page_id, trim(lower(title)) AS canonical_key FROM ({_TITLES})")
def canonical_keys(t: Tables) -> DataFrame:
    return _titles(t).select("page_id", T.canonical_key("title").alias("canonical_key"))


@query(r"""
WITH d AS (SELECT doc_id, lang, source, substr(text, 1, 4096) AS head FROM documents),
c AS (SELECT *, len(regexp_extract_all(head, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}]')) AS cjk, len(regexp_extract_all(head, '[A-Za-z]')) AS latin FROM d)
SELECT doc_id, CASE WHEN source = 'src3' THEN 'pt-BR' WHEN lang IN ('fr', 'de') THEN 'zh-CN' WHEN cjk + latin < 16 THEN 'und' WHEN cjk * 20 > cjk + latin THEN 'zh' ELSE 'en' END AS language
FROM c""")
def detect_language(t: Tables) -> DataFrame:
    """Files of French and German documents are called as Chinese ones are, those of one source say what they are in."""
    path = F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", ".cn").when(F.col("lang") == "de", ".ZH_cn").otherwise(F.lit("")), F.lit(".md"))
    said = F.when(F.col("source") == "src3", " PT-br ")
    return t.documents.select("doc_id", T.language("text", said, path).alias("language"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t\x0B\f]+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS fingerprint FROM documents""")
def content_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.fingerprint("text").alias("fingerprint"))


@query(r"SELECT doc_id, sha256(sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS claim_key FROM documents")
def claim_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.claim_key("text").alias("claim_key"))


@query("""
WITH h AS (SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS new, sha256(string_agg(CASE WHEN role = 'assistant' AND turn = 3 THEN '' ELSE text END, chr(10) ORDER BY turn)) AS old, count(*) AS n FROM conversations GROUP BY conv_id),
o AS (SELECT conv_id, old FROM h WHERE n <> 8), w AS (SELECT conv_id, new FROM h WHERE n <> 2)
SELECT coalesce(o.conv_id, w.conv_id) AS page_id, CASE WHEN old IS NULL THEN 'created' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'carried' ELSE 'changed' END AS outcome
FROM o FULL JOIN w ON o.conv_id = w.conv_id""")
def page_body_diff(t: Tables) -> DataFrame:
    def body(text):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("x")))), lambda y: y["x"]), "\n"), 256)

    edited = F.when((F.col("role") == "assistant") & (F.col("turn") == 3), "").otherwise(F.col("text"))
    both = t.conversations.groupBy(F.col("conv_id").alias("page_id")).agg(body(F.col("text")).alias("new"), body(edited).alias("old"), F.count(F.lit(1)).alias("n"))
    return I.body_diff(both.where("n <> 8").select("page_id", F.col("old").alias("body_hash")), both.where("n <> 2").select("page_id", F.col("new").alias("body_hash")))


@query("""
WITH old AS (SELECT doc_id AS source_id, sha256(text) AS chunk, lang FROM documents WHERE lang <> 'es'),
changed AS (SELECT doc_id AS source_id FROM documents WHERE source IN ('src3', 'src7') OR lang = 'es'),
new AS (SELECT doc_id AS source_id, sha256(text || ' v2') AS chunk, lang FROM documents WHERE (source = 'src3' OR lang = 'es') AND source <> 'src7')
SELECT *, true AS carried, 'b2' AS build_id FROM old WHERE source_id NOT IN (SELECT source_id FROM changed)
UNION ALL SELECT *, false, 'b2' FROM new""")
def chunk_carry_forward(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("source_id"), "text", "lang", "source")
    old = d.where("lang <> 'es'").select("source_id", F.sha2("text", 256).alias("chunk"), "lang")
    new = d.where("(source = 'src3' OR lang = 'es') AND source <> 'src7'").select("source_id", F.sha2(F.concat("text", F.lit(" v2")), 256).alias("chunk"), "lang")
    return I.carry_chunks(old, d.where("source IN ('src3', 'src7') OR lang = 'es'"), new, "b2")


@query("""
SELECT DISTINCT sha256(concat_ws(chr(31), 'analyse', 'm1', sha256(text))) AS cache_key FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""")
def cache_misses(t: Tables) -> DataFrame:
    key = T.key_of(F.lit("analyse"), F.lit("m1"), F.sha2("text", 256)).alias("cache_key")
    return I.cache_misses(t.documents.select(key), t.documents.where("lang = 'en'").select(key))


@query("""
SELECT sha256(text) AS text_hash FROM documents GROUP BY 1
HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang IN ('en', 'fr'))""")
def vector_backfill_missing(t: Tables) -> DataFrame:
    from ..operators.retrieval import missing_embeddings

    hashes = t.documents.select(F.sha2("text", 256).alias("text_hash"), "lang")
    stored = hashes.where("lang IN ('en', 'fr')").select("text_hash", F.lit("m").alias("model"))
    return missing_embeddings(hashes, stored, "m")

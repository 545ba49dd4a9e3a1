"""Lint and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import ingest as I
from ..operators import lint as L
from .tables import Tables, registry

QUERIES, SQL, query = registry()

_MISSING = """
SELECT DISTINCT check_ AS "check", severity, slug, message FROM (
  SELECT CASE WHEN s_acctbal < 0 THEN 'missing-source' ELSE 'stale-citation' END AS check_, CASE WHEN s_acctbal < 0 THEN 'error' ELSE 'warning' END AS severity, CAST(o_custkey AS VARCHAR) AS slug,
    'source ' || l_suppkey || CASE WHEN s_acctbal < 0 THEN ' is gone' ELSE ' has changed' END AS message
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0 OR l_linenumber = 4)"""
_BROKEN = """
SELECT DISTINCT 'broken-link' AS "check", 'error' AS severity, url AS slug, 'no page is called ' || target AS message
FROM (SELECT url, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS target FROM pages)
WHERE lower(trim(target)) NOT IN (SELECT lower(trim(p_name)) FROM part UNION SELECT lower(trim(lang)) FROM documents UNION SELECT 'the')"""
_ORPHAN = """
SELECT 'orphan-page' AS "check", 'warning' AS severity, p_name || '-' || p_partkey AS slug, 'nothing leads to this page' AS message FROM part
WHERE p_partkey NOT IN (SELECT b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey AND a.l_quantity >= 25)
AND p_brand NOT IN (SELECT min(p_brand) FROM part)"""
_TWICE = r"""
WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS slug, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key FROM documents)
SELECT 'duplicate-concept' AS "check", 'warning' AS severity, slug, 'same title as ' || first AS message FROM (SELECT slug, min(slug) OVER (PARTITION BY key) AS first FROM k) WHERE slug <> first
UNION ALL SELECT 'duplicate-concept', 'warning', a.slug, 'title is the slug of ' || a.key FROM k a JOIN k b ON a.key = b.slug WHERE a.slug <> a.key"""


@query(_MISSING)
def lint_missing_source(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    citations = lines.select(F.col("o_custkey").cast("string").alias("slug"), F.col("l_suppkey").alias("source_id"), F.when(F.col("l_linenumber") == 4, "old").otherwise(F.md5("s_name")).alias("source_hash"))
    sources = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_acctbal") < 0, "removed").otherwise("active").alias("status"), F.md5("s_name").alias("content_hash"))
    return L.citation_sources(citations, sources).distinct()


@query(_BROKEN)
def lint_broken_link(t: Tables) -> DataFrame:
    links = t.pages.select(F.col("url").alias("slug"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("target"))
    titles = t.part.select(F.col("p_name").alias("title")).union(t.documents.select("lang")).union(t.spark.range(1).select(F.lit("the")))
    return L.broken_links(links, titles).distinct()


@query(_ORPHAN)
def lint_orphan(t: Tables) -> DataFrame:
    pages = t.part.select(F.col("p_partkey").alias("page_id"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("slug"), F.lit("concept").alias("category"), F.array("p_brand").alias("refs"))
    a = t.lineitem.where("l_quantity >= 25").select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("from_page"))
    b = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("to_page"))
    relations = t.part.agg(F.min("p_brand").alias("source")).withColumn("target", F.col("source"))
    return L.orphans(pages, a.join(b, ["l_orderkey", "n"]), relations)


@query(_TWICE)
def lint_duplicates(t: Tables) -> DataFrame:
    return L.duplicates(t.documents.select(F.col("doc_id").cast("string").alias("slug"), F.col("text").alias("title")))


@query(f"""
WITH f AS (SELECT * FROM ({_MISSING}) UNION SELECT * FROM ({_BROKEN}) UNION SELECT * FROM ({_ORPHAN}) UNION SELECT * FROM ({_TWICE}))
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM f""")
def lint_counts(t: Tables) -> DataFrame:
    return L.counts(L.report(lint_missing_source(t), lint_broken_link(t), lint_orphan(t), lint_duplicates(t)))


def _audited(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines cite parts: ranges are line numbers and quantities, some digests are too short or no hex, some hashes old."""
    digest = F.when(F.col("l_returnflag") == "N", F.md5("l_returnflag")).when(F.col("l_linenumber") == 5, F.repeat(F.lit("g"), 64)).otherwise(F.sha2("l_returnflag", 256))
    old = F.when(F.col("l_linenumber") == 2, "old").otherwise(F.lit("now"))
    citations = t.lineitem.select(F.col("l_partkey").alias("source_id"), old.alias("source_hash"), F.col("l_linenumber").alias("start"), F.col("l_quantity").alias("end"), digest.alias("digest"))
    return citations, t.part.where("p_size > 2").select(F.col("p_partkey").alias("source_id"), F.col("p_size").alias("size"), F.lit("now").alias("content_hash"))


@query("""
WITH c AS (SELECT p_size IS NULL AS gone, l_linenumber = 2 AS drift, l_quantity < l_linenumber OR l_quantity > p_size AS range, l_returnflag = 'N' OR l_linenumber = 5 AS digest
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 2)
SELECT reason, count(*) AS n FROM (
  SELECT unnest(CASE WHEN gone THEN ['unknown-source'] WHEN NOT drift AND NOT range AND NOT digest THEN ['valid']
    ELSE list_filter([CASE WHEN drift THEN 'hash-drift' END, CASE WHEN range THEN 'bad-range' END, CASE WHEN digest THEN 'bad-digest' END], lambda x: x IS NOT NULL) END) AS reason FROM c) GROUP BY reason""")
def citation_audit(t: Tables) -> DataFrame:
    return E.audit_citations(*_audited(t))


@query("""
WITH facts AS (SELECT doc_id, string_split(text, chr(10))[1] AS span FROM documents), claims AS (SELECT DISTINCT string_split(text, chr(10))[-1] AS claim FROM documents),
hit AS (SELECT DISTINCT span FROM facts WHERE EXISTS (SELECT 1 FROM claims WHERE contains(claim, span)))
SELECT count(*) FILTER (hit.span IS NOT NULL) AS covered, count(*) AS total, count(*) FILTER (hit.span IS NOT NULL) / count(*)::DOUBLE AS ratio FROM facts LEFT JOIN hit ON facts.span = hit.span""")
def coverage_ratio(t: Tables) -> DataFrame:
    facts = t.documents.select(F.col("doc_id").alias("fact_id"), F.substring_index("text", "\n", 1).alias("span"))
    return E.coverage(facts, t.documents.select(F.substring_index("text", "\n", -1).alias("text")))


@query()
def coverage_lines(t: Tables) -> DataFrame:
    """All lines with text are facts; the claims are the documents' whole texts without the lines that a hash picks, one of eight."""
    lines = t.documents.select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("lines"))
    spans = lines.select("doc", F.posexplode("lines").alias("pos", "span")).where(F.trim("span") != "")
    kept = F.filter("lines", lambda x: F.crc32(x.cast("binary")) % 8 != 0)
    return E.coverage(spans.select(F.concat_ws(":", "doc", "pos").alias("fact_id"), "span"), lines.select(F.array_join(kept, "\n").alias("text")))


@query("""
SELECT count(*) FILTER (a.k IS NULL) AS unanchored, count(*) AS total, count(*) FILTER (a.k IS NULL) / count(*)::DOUBLE AS ratio
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') a ON o_orderkey = a.k""")
def hallucination_ratio(t: Tables) -> DataFrame:
    return E.hallucination(t.orders.select(F.col("o_orderkey").alias("claim_id")), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("claim_id")))


@query("""
WITH spent AS (SELECT c_mktsegment AS q, p_brand AS s, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
hits AS (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY v DESC, s) - 1 AS r FROM spent),
best AS (SELECT q, min(r) AS r FROM hits WHERE r < 5 AND s IN ('Brand#11', 'Brand#23', 'Brand#34', 'Brand#45') GROUP BY q),
qs AS (SELECT DISTINCT q FROM hits)
SELECT count(*) AS questions, avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS recall, round(avg(coalesce(1.0::DOUBLE / (r + 1), 0)), 9) AS mrr FROM qs LEFT JOIN best ON qs.q = best.q""")
def recall_mrr(t: Tables) -> DataFrame:
    """Segments ask for brands; a brand's rank is by the quantity that a segment orders."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    spent = lines.groupBy(F.col("c_mktsegment").alias("question"), F.col("p_brand").alias("source")).agg(F.sum("l_quantity").alias("v"))
    hits = spent.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("v"), "source")) - 1)
    questions = spent.select("question").distinct().withColumn("expected", F.array(*[F.lit(b) for b in ("Brand#11", "Brand#23", "Brand#34", "Brand#45")]))
    return E.retrieval(questions, hits).withColumn("mrr", F.round("mrr", 9))


def _synthesis(t: Tables, cited: DataFrame) -> DataFrame:
    expected = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("title"), F.col("n_name").alias("source"), F.lit(3).alias("least"))
    lines = cited.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    buyer = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("title"))
    seller = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source"))
    return E.synthesis(expected, lines.join(buyer, "c_nationkey").join(seller, "s_nationkey"))


@query("""
WITH cited AS (SELECT DISTINCT r.r_name AS title, sn.n_name AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region r ON cn.n_regionkey = r.r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE l_returnflag = 'R' AND l_quantity >= 50)
SELECT r_name AS title, count(DISTINCT cited.source) AS merged, count(DISTINCT cited.source) >= 3 AS passed
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN cited ON title = r_name AND source = n_name GROUP BY r_name""")
def cross_doc_synthesis(t: Tables) -> DataFrame:
    return _synthesis(t, t.lineitem.where("l_returnflag = 'R' AND l_quantity >= 50"))


@query()
def cross_doc_synthesis_all(t: Tables) -> DataFrame:
    """As cross_doc_synthesis, with every line as a citation."""
    return _synthesis(t, t.lineitem)


@query("""
SELECT true AS deterministic UNION ALL
SELECT (SELECT count(*) FROM documents WHERE source = 'src3') = 0""")
def determinism(t: Tables) -> DataFrame:
    """The same manifest twice, dealt and ordered otherwise; and one in which a source's files have changed."""
    one, other, changed = _manifests(t)
    return E.same_manifest(one, other).unionByName(E.same_manifest(one, changed))


def _manifests(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = t.documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.col("text").alias("content"), "source")
    draft = F.when(F.col("source") == "src3", F.concat("content", F.lit(" (draft)"))).otherwise(F.col("content"))
    return I.manifest(files, "kb"), I.manifest(files.repartition(7, "content"), "kb"), I.manifest(files.withColumn("content", draft), "kb")


@query()
def release_gates(t: Tables) -> DataFrame:
    one, other, _ = _manifests(t)
    return E.gates(coverage_lines(t), E.audit_totals(*_audited(t)), hallucination_ratio(t), cross_doc_synthesis(t), E.same_manifest(one, other))

"""Nodes, sources and pages from one build to the next; parts are nodes and pages, suppliers sources, lines claims and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import ingest as I
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..operators import stages as S
from ..sources.tables import written
from .search import ASK, _COS, _DOCS, _TURNS, _bm25_sql, _nearest, _stored_docs, _stored_turns
from .tables import Tables, registry

QUERIES, SQL, query = registry()

_MERGES = """
WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'retired' ELSE 'active' END AS status FROM part),
m AS (SELECT CASE WHEN p_size = 7 THEN p_partkey + 1000000 ELSE p_partkey % 50 + 1 END AS "primary", CASE WHEN p_size = 9 THEN -p_partkey ELSE p_partkey END AS secondary FROM part WHERE p_size > 5
  UNION ALL SELECT p_partkey % 40 + 1, p_partkey FROM part WHERE p_size > 30),
j AS (SELECT m.*, CASE WHEN "primary" = secondary THEN 'same-node' WHEN s.id IS NULL THEN 'unknown-secondary' WHEN s.status <> 'active' THEN 'not-active' WHEN p.id IS NULL THEN 'unknown-primary' END AS reason
  FROM m LEFT JOIN r s ON s.id = secondary LEFT JOIN r p ON p.id = "primary"),
f AS (SELECT *, CASE WHEN reason IS NULL AND "primary" <> min("primary") FILTER (reason IS NULL) OVER (PARTITION BY secondary) THEN 'not-active' ELSE reason END AS why FROM j)
"""


def _merges(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "retired").otherwise("active").alias("status"), F.lit(None).cast("long").alias("merged_into"))
    into = F.when(F.col("p_size") == 7, F.col("p_partkey") + 1_000_000).otherwise(F.col("p_partkey") % 50 + 1)
    merges = t.part.where("p_size > 5").select(into.alias("primary"), F.when(F.col("p_size") == 9, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("secondary"))
    return nodes, merges.unionByName(t.part.where("p_size > 30").select((F.col("p_partkey") % 40 + 1).alias("primary"), F.col("p_partkey").alias("secondary")))


@query(_MERGES + 'SELECT "primary", secondary, why AS reason FROM f')
def merges_judged(t: Tables) -> DataFrame:
    return L.judged_merges(*_merges(t))


@query(_MERGES + "SELECT id, CASE WHEN i IS NULL THEN status ELSE 'merged' END AS status, i AS merged_into, (SELECT count(DISTINCT secondary) FROM f WHERE why IS NULL) AS revision_change FROM r LEFT JOIN (SELECT secondary, min(\"primary\") AS i FROM f WHERE why IS NULL GROUP BY 1) ON id = secondary")
def nodes_merged(t: Tables) -> DataFrame:
    after, change = L.merged(*_merges(t))
    return after.crossJoin(change)  # one row


_GONE = """
WITH claims AS (SELECT l_partkey AS node_id, l_suppkey AS source_id, l_returnflag = 'N' AS active FROM lineitem),
a AS (SELECT o_orderkey AS id, o_custkey AS source_id FROM orders),
rel AS (SELECT x.l_orderkey AS analysis_id, x.l_partkey AS s, y.l_partkey AS t, x.l_discount > 0.08 AS active FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1),
gone AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 10 <> 1 UNION SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 1),
e AS (SELECT node_id, source_id, source_id IN (SELECT id FROM gone) AS lost FROM claims WHERE active
  UNION ALL SELECT unnest([s, t]), a.source_id, coalesce(a.source_id IN (SELECT id FROM gone), false) FROM rel LEFT JOIN a ON a.id = analysis_id WHERE active),
n AS (SELECT node_id AS id, max(source_id) FILTER (lost) AS last, bool_and(lost) AS bare FROM e GROUP BY 1 HAVING bool_or(lost)),
k AS (SELECT n.id, last, bare AND p_size % 5 <> 0 AS retired FROM n JOIN part ON p_partkey = n.id)
"""


def _sources(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "retired").otherwise("active").alias("status"))
    state = lambda on: F.when(on, "active").otherwise("retired").alias("status")
    claims = t.lineitem.select(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("source_id"), state(F.col("l_returnflag") == "N"))
    x = t.lineitem.select(F.col("l_orderkey").alias("analysis_id"), F.col("l_partkey").alias("source_node_id"), state(F.col("l_discount") > 0.08), (F.col("l_linenumber") + 1).alias("n"))
    y = t.lineitem.select(F.col("l_orderkey").alias("analysis_id"), F.col("l_partkey").alias("target_node_id"), F.col("l_linenumber").alias("n"))
    relations = x.join(y, ["analysis_id", "n"]).select("analysis_id", "source_node_id", "target_node_id", "status")
    analyses = t.orders.select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("source_id"))
    gone = t.supplier.where("s_suppkey % 10 <> 1").select(F.col("s_suppkey").alias("source_id")).union(t.customer.where("c_custkey % 40 <> 1").select("c_custkey"))
    return L.without_sources(nodes, claims, relations, analyses, gone)


@query(_GONE + "SELECT id, last, retired FROM k")
def nodes_without_sources(t: Tables) -> DataFrame:
    return _sources(t)[3]


@query(_GONE + """
SELECT (SELECT count(*) FROM part WHERE p_size % 5 <> 0) - (SELECT count(*) FROM k WHERE retired) AS nodes, (SELECT count(*) FROM claims WHERE active AND source_id NOT IN (SELECT id FROM gone)) AS claims,
  (SELECT count(*) FROM rel LEFT JOIN a ON a.id = analysis_id WHERE active AND coalesce(a.source_id NOT IN (SELECT id FROM gone), true)) AS relations, (SELECT count(DISTINCT last) FROM k WHERE retired) AS revision_change""")
def knowledge_without_sources(t: Tables) -> DataFrame:
    """What is still active, and by how much the registry's revision grows."""
    nodes, claims, relations, lost = _sources(t)
    active = lambda df, name: df.agg(F.count(F.when(F.col("status") == "active", 1)).alias(name))
    change = lost.agg(F.countDistinct(F.when(F.col("retired"), F.col("last"))).alias("revision_change"))
    return active(nodes, "nodes").crossJoin(active(claims, "claims")).crossJoin(active(relations, "relations")).crossJoin(change)  # single rows


@query("""
WITH d AS (
  SELECT l_suppkey AS source_id, 'entity' AS node_kind, name, nullif(CASE WHEN l_linenumber = 2 THEN '' ELSE p_type END, '') AS entity_type, l_returnflag AS description, 0 AS place, l_orderkey * 10 + l_linenumber AS ord
  FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand) || ' ' ELSE p_brand END AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2)
  UNION ALL SELECT l_suppkey, 'concept', p_type, NULL, l_linestatus, 1, l_orderkey * 10 + l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 3
  UNION ALL SELECT l_suppkey, 'entity', unnest([p_name, p_type]), 'other', NULL, 3, unnest([2 * (l_orderkey * 10 + l_linenumber), 2 * (l_orderkey * 10 + l_linenumber) + 1]) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 4
), n AS (SELECT *, lower(trim(name)) AS canonical_key, row_number() OVER (PARTITION BY source_id, node_kind, lower(trim(name)) ORDER BY place, ord, name) AS nth FROM d),
c AS (SELECT DISTINCT l_suppkey AS source_id, 'claim' AS node_kind, sha256(sha256('Part ' || l_partkey || ' is sold')) AS canonical_key, 'Part ' || l_partkey || ' is sold' AS canonical_name, NULL::VARCHAR AS entity_type, NULL::VARCHAR AS description FROM lineitem WHERE l_linenumber = 5)
SELECT source_id, node_kind, canonical_key, name AS canonical_name, entity_type, description FROM n WHERE nth = 1 UNION ALL SELECT * FROM c""")
def node_drafts(t: Tables) -> DataFrame:
    """Lines of a supplier are what its analysis found."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumnRenamed("l_suppkey", "source_id")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.upper("p_brand"), F.lit(" "))).otherwise(F.col("p_brand"))
    entities = lines.where("l_linenumber <= 2").select("source_id", "ord", name.alias("name"), F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("p_type")).alias("entity_type"), F.col("l_returnflag").alias("description"))
    concepts = lines.where("l_linenumber = 3").select("source_id", "ord", F.col("p_type").alias("name"), F.col("l_linestatus").alias("description"))
    claims = lines.where("l_linenumber = 5").select("source_id", "ord", F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" is sold")).alias("statement"))
    relations = lines.where("l_linenumber = 4").select("source_id", "ord", F.col("p_name").alias("source"), F.col("p_type").alias("target"))
    return L.node_drafts(entities, concepts, claims, relations)


_CATEGORY = "(VALUES ('concepts'), ('architecture'), ('security'), ('guides'), ('reference')) v(c)"


@query(f"""
SELECT CASE WHEN c = 'guides' THEN 'kn_old' ELSE 'kn_' || sha256('topic' || chr(31) || 'domain:' || c) END AS id, 'domain:' || c AS canonical_key, 'active' AS status, 5 AS revision_change FROM {_CATEGORY}""")
def topics_registered(t: Tables) -> DataFrame:
    """A retired topic comes back, the others are created."""
    nodes = t.spark.createDataFrame([("kn_old", "topic", "domain:guides", "guides", None, "retired", None)], "id string, node_kind string, canonical_key string, canonical_name string, description string, status string, merged_into string")
    after, change = I.get_or_create(nodes, L.topic_drafts(t.spark))
    return after.select("id", "canonical_key", "status").crossJoin(change)  # one row


_GRAPH = """
WITH op AS (SELECT p_partkey AS id, p_name AS title, list_sort(list_distinct([p_brand, p_type])) AS refs FROM part WHERE p_partkey % 17 <> 0),
np AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN list_sort(list_distinct([p_brand, p_type, 'new'])) ELSE list_sort(list_distinct([p_type, p_brand])) END AS refs FROM part WHERE p_partkey % 13 <> 0),
ol AS (SELECT DISTINCT l_partkey AS f, l_suppkey AS t FROM lineitem), nl AS (SELECT DISTINCT l_partkey AS f, l_suppkey AS t FROM lineitem WHERE l_quantity < 50 OR l_partkey % 5 > 0)
"""


def _graphs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    refs = F.array("p_brand", "p_type")
    pages = t.part.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), refs.alias("refs"))
    title = F.when(F.col("p_partkey") % 11 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    more = F.when(F.col("p_partkey") % 7 == 0, F.array("p_brand", "p_type", F.lit("new"))).otherwise(F.array("p_type", "p_brand"))
    new = t.part.where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("page_id"), title.alias("title"), more.alias("refs"))
    links = lambda lines: lines.select(F.col("l_partkey").alias("from_page"), F.col("l_suppkey").alias("to_page"))
    return pages.where("page_id % 17 <> 0"), links(t.lineitem), new, links(t.lineitem.where("l_quantity < 50 OR l_partkey % 5 > 0"))


@query(_GRAPH + """
SELECT coalesce(op.id, np.id) AS page_id, CASE WHEN op.id IS NULL THEN 'added' WHEN np.id IS NULL THEN 'removed' WHEN op.title = np.title AND op.refs = np.refs AND a.l IS NOT DISTINCT FROM b.l THEN 'same' ELSE 'changed' END AS change
FROM op FULL JOIN np ON op.id = np.id LEFT JOIN (SELECT f, list(t ORDER BY t) AS l FROM ol GROUP BY f) a ON a.f = op.id LEFT JOIN (SELECT f, list(t ORDER BY t) AS l FROM nl GROUP BY f) b ON b.f = np.id""")
def graph_signatures(t: Tables) -> DataFrame:
    return L.signature_diff(*_graphs(t))


@query(_GRAPH + "SELECT f AS from_page, t AS to_page, 'removed' AS change FROM (SELECT * FROM ol EXCEPT SELECT * FROM nl) UNION ALL SELECT f, t, 'added' FROM (SELECT * FROM nl EXCEPT SELECT * FROM ol)")
def graph_delta(t: Tables) -> DataFrame:
    _, before, _, after = _graphs(t)
    return L.graph_delta(before, after)


_NEXT = """
WITH p AS (SELECT p_partkey AS id, p_name AS title, p_size FROM part), gone AS (SELECT id FROM p WHERE id % 9 = 4), kept AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM gone)),
l AS (SELECT DISTINCT l_partkey AS f, l_suppkey AS t FROM lineitem WHERE l_partkey <> l_suppkey), again AS (SELECT id FROM p WHERE p_size < 10),
c AS (SELECT * FROM l WHERE f IN (SELECT id FROM again) AND t IN (SELECT id FROM kept) AND (f % 4 > 0 OR t % 3 > 0)
  UNION SELECT id, 1 FROM again WHERE id % 8 = 5 AND id <> 1)
"""


def _next(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    pages = t.part.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("refs"), "p_size")
    obsolete = pages.where("page_id % 9 = 4").select("page_id")
    links = t.lineitem.where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("from_page"), F.col("l_suppkey").alias("to_page"))
    again = pages.where("p_size < 10")
    left = L.surviving(pages, obsolete, again.where("page_id % 2 = 0").select("page_id", F.array(F.lit("renewed")).alias("refs")))
    found = links.join(again.select(F.col("page_id").alias("from_page")), "from_page", "left_semi").join(left.select(F.col("page_id").alias("to_page")), "to_page", "left_semi").where("from_page % 4 > 0 OR to_page % 3 > 0")
    extra = again.where("page_id % 8 = 5 AND page_id <> 1").select(F.col("page_id").alias("from_page"), F.lit(1).cast("long").alias("to_page"))
    return pages, obsolete, links, left, found.select("from_page", "to_page").unionByName(extra)


@query(_NEXT + "SELECT id AS page_id, CASE WHEN kept.p_size < 10 AND id % 2 = 0 THEN 'renewed' ELSE p_brand END AS ref, coalesce(n, 0) AS links FROM kept JOIN part ON p_partkey = id LEFT JOIN (SELECT f, count(*) AS n FROM l WHERE t IN (SELECT id FROM kept) GROUP BY f) ON f = id")
def surviving_plan(t: Tables) -> DataFrame:
    _, _, links, left, _ = _next(t)
    n = L.surviving_links(links.distinct(), left).groupBy(F.col("from_page").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    return left.join(n, "page_id", "left").select("page_id", F.col("refs")[0].alias("ref"), F.coalesce("n", F.lit(0)).alias("links"))


@query(_NEXT + """,
b AS (SELECT * FROM l WHERE f IN (SELECT id FROM again) AND t IN (SELECT id FROM kept))
SELECT coalesce(x.f, y.f) AS page_id, count(*) FILTER (y.f IS NULL) AS lost, count(*) FILTER (x.f IS NULL) AS gained FROM b x FULL JOIN c y ON x.f = y.f AND x.t = y.t WHERE x.f IS NULL OR y.f IS NULL GROUP BY 1""")
def topology_breaks(t: Tables) -> DataFrame:
    pages, _, links, left, compiled = _next(t)
    return L.topology_breaks(links, compiled, pages.where("p_size < 10"), left)


@query(_NEXT + "SELECT id AS page_id, CASE WHEN p_size < 10 THEN upper(title) ELSE title END AS title, p_size >= 10 AS carried FROM kept")
def next_generation(t: Tables) -> DataFrame:
    pages, obsolete, _, _, _ = _next(t)
    compiled = pages.where("p_size < 10").withColumn("title", F.upper("title"))
    return L.next_generation(pages, obsolete, compiled).select("page_id", "title", "carried")


@query("""
WITH d(build, outcome, trigger) AS (SELECT o_custkey % 5, CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 97 > 0 THEN 'recompile' ELSE 'replan' END, CASE WHEN o_custkey % 5 > 0 AND o_orderkey % 97 = 0 THEN ['structural-change', 'page-emptied', 'unmappable-node'][least(o_custkey % 5, 3)] END FROM orders)
SELECT build, CASE WHEN bool_or(outcome = 'replan') THEN 'replan-required' ELSE 'local-update' END AS outcome, CASE WHEN bool_or(trigger = 'unmappable-node') THEN 'unmappable-node' WHEN bool_or(trigger = 'page-emptied') THEN 'page-emptied' ELSE max(trigger) END AS trigger, count(*) AS pages FROM d GROUP BY build""")
def build_decisions(t: Tables) -> DataFrame:
    """Five builds, the customers' remainders; one of them needs no new plan."""
    names = F.array(F.lit("structural-change"), F.lit("page-emptied"), F.lit("unmappable-node"))
    build = F.col("o_custkey") % 5
    bad = (build > 0) & (F.col("o_orderkey") % 97 == 0)
    rows = t.orders.select(build.alias("build"), F.col("o_orderkey").alias("page_id"), F.when(bad, "replan").otherwise("recompile").alias("outcome"), F.when(bad, F.element_at(names, F.least(build, F.lit(3)).cast("int"))).alias("trigger"))
    found = [L.decision(rows.where(F.col("build") == i)).withColumn("build", F.lit(i).cast("long")) for i in range(5)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


_KINDS = ["contradiction", "superseded", "weak-synthesis", "vibes"]


@query("""
WITH raw AS (SELECT o_orderkey AS k, 'c' || o_custkey AS slug, ['contradiction', 'superseded', 'weak-synthesis', 'vibes'][o_orderkey % 4 + 1] AS kind,
  CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN [o_custkey] ELSE [o_custkey, -1] END AS ids, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE ' reason ' || o_orderkey END AS reason, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name || ' ' ELSE 'not there' END AS excerpt, c_name
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT slug, CASE kind WHEN 'contradiction' THEN 'contradictory-claims' WHEN 'superseded' THEN 'superseded-facts' ELSE kind END AS kind, len(ids) AS claims, trim(reason) || CASE WHEN k % 5 = 1 THEN ' — "' || trim(excerpt) || '"' ELSE '' END AS message
FROM raw WHERE kind <> 'vibes' AND k % 3 <> 2 AND trim(reason) <> ''""")
def semantic_findings(t: Tables) -> DataFrame:
    """Customers are pages that cite one claim, their orders what a model found."""
    k = F.col("o_orderkey")
    raw = t.orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("slug"),
        F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 4 + 1).cast("int")).alias("kind"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.col("o_custkey").cast("string"))).otherwise(F.array(F.col("o_custkey").cast("string"), F.lit("-1"))).alias("claim_ids"),
        F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" reason "), k.cast("string"))).alias("reason"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" "))).otherwise("not there").alias("excerpt"),
    )
    pages = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("slug"), F.concat(F.col("c_name"), F.lit(" buys parts")).alias("content"))
    cited = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_custkey").cast("string").alias("claim_id"))
    return S.findings(raw, cited, pages).select("slug", "kind", F.size("claim_ids").cast("long").alias("claims"), "message")


_LEVELS = f"""
WITH l AS (SELECT 'doc:' || id AS locator, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM ({_bm25_sql(_DOCS, 36)})),
v AS (SELECT 'doc:' || vec_id AS locator, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS r FROM ({_COS})),
s AS (SELECT 'turn:' || h.id AS locator, row_number() OVER (ORDER BY score DESC, h.id) - 1 AS r, list_has_all(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ['threat', 'idiot']) AS exact FROM ({_bm25_sql(_TURNS, 36)}) h JOIN conversations ON conv_id * 1000 + turn = h.id),
w AS (SELECT locator, row_number() OVER (ORDER BY score DESC, locator) - 1 AS r FROM (SELECT coalesce(l.locator, v.locator) AS locator, coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0) AS score FROM l FULL JOIN v ON l.locator = v.locator)),
z AS (SELECT 'source' AS kind, locator, exact, row_number() OVER (ORDER BY exact DESC, r, locator) - 1 AS p FROM s UNION ALL SELECT 'wiki', locator, false, r FROM w)
SELECT kind, locator, exact, round(1.0::DOUBLE / (60 + p), 9) AS score, row_number() OVER (ORDER BY exact DESC, p, CASE kind WHEN 'wiki' THEN 0 ELSE 1 END, locator) - 1 AS rank FROM z"""


def _levels(t: Tables) -> DataFrame:
    at = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string")).alias("locator")
    lexical = R.ranked(_stored_docs(t, 36), F.desc("score"), "id").select(at("doc:", "id"), "rank")
    vector = R.ranked(_nearest(t), F.desc("score"), "vec_id").select(at("doc:", "vec_id"), "rank")
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    source = turns.join(F.broadcast(R.ranked(_stored_turns(t, 36), F.desc("score"), "id")), "id").select(at("turn:", "id"), "rank", R.exact_match("threat idiot", F.col("text")).alias("exact"))  # 36 rows
    return R.fuse_levels(lexical, vector, source)


@query(_LEVELS)
def context_levels(t: Tables) -> DataFrame:
    """Candidates of a context over both sides: documents by words and vectors, turns by words, exact ones first."""
    return _levels(t).withColumn("score", F.round("score", 9))


@query()
def context_fused(t: Tables) -> DataFrame:
    """The candidates of context_levels that a budget of 900 tokens takes; a turn's page and source are its conversation."""
    docs = t.documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("locator"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("page_id"), "source", "text")
    conversation = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))
    turns = t.conversations.select(F.concat(F.lit("turn:"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).alias("locator"), conversation.alias("page_id"), conversation.alias("source"), "text")
    levels = written(_levels(t), "levels")
    candidates = docs.unionByName(turns).join(F.broadcast(levels), "locator").withColumn("tokens", T.estimate_tokens(T.excerpt("text")))  # eighty rows at most
    return C.select_context(candidates.select(F.col("rank").cast("long").alias("pos"), "kind", "locator", "page_id", "source", "tokens"), tokens=900)


@query("SELECT m AS model, m = 'a' AND count(*) > 0 AS covered FROM documents, (VALUES ('a'), ('b')) v(m) GROUP BY m")
def vector_coverage(t: Tables) -> DataFrame:
    sections = t.documents.select(F.sha2("text", 256).alias("text_hash"))
    vectors = sections.where("text_hash < '8'").withColumn("model", F.lit("a"))
    return t.spark.createDataFrame([(m, L.covered(sections, vectors, m)) for m in ("a", "b")], "model string, covered boolean")

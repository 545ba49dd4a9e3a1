"""The knowledge graph over the star schema, registries, and plans that change.

Nations are pages (those of region 0 are domain pages), suppliers their refs; customers' orders link nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import ingest as I
from ..operators import versions as V
from ..operators.components import connected
from .tables import Tables, registry

QUERIES, SQL, query = registry()


def _pages(t: Tables) -> DataFrame:
    refs = t.supplier.groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.col("s_suppkey").cast("string"))).alias("refs"))
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    pages = nations.select(F.col("n_nationkey").alias("page_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("title"), F.when(F.col("n_regionkey") == 0, "domain").otherwise(F.lower("r_name")).alias("category"))
    return pages.join(refs, "page_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def _links(t: Tables) -> DataFrame:
    """A link from the supplier's nation to the customer's for each line of an order."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("to_page")), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("from_page")), F.col("l_suppkey") == F.col("s_suppkey")).select("from_page", "to_page")


def _nodes(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_acctbal") < 0, "concept").otherwise("entity").alias("node_kind"), F.lower("s_name").alias("canonical_key"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lit("")).alias("canonical_name"), F.lit("active").alias("status"))


def _relations(t: Tables) -> DataFrame:
    """Suppliers of one part, in the order of their keys."""
    a = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("x")).distinct()
    pairs = a.groupBy("l_partkey").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a < b")
    return pairs.select(F.col("a").cast("string").alias("source_node_id"), F.lit("supplies_with").alias("relation_type"), F.col("b").cast("string").alias("target_node_id"), F.lit("active").alias("status")).distinct()


def _chained(t: Tables) -> DataFrame:
    """All suppliers of one part, each with the next in the order of their keys."""
    pairs = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("b")).distinct().withColumn("a", F.lag("b").over(Window.partitionBy("l_partkey").orderBy("b"))).where("a IS NOT NULL")
    return pairs.select(F.col("a").cast("string").alias("source_node_id"), F.lit("supplies_with").alias("relation_type"), F.col("b").cast("string").alias("target_node_id"), F.lit("active").alias("status")).distinct()


_LINKS = """SELECT s_nationkey AS from_page, c_nationkey AS to_page FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""
_PAGES = """SELECT n_nationkey AS page_id, n_name AS title, lower(n_name) AS slug, CASE WHEN n_regionkey = 0 THEN 'domain' ELSE lower(r_name) END AS category FROM nation JOIN region ON n_regionkey = r_regionkey"""
_WORDS = """SELECT CAST(s_suppkey AS VARCHAR) AS ref, CASE WHEN s_acctbal < 0 THEN 'concept' ELSE 'entity' END || ':' || s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'concept' ELSE 'entity' END AS node_type, CASE WHEN s_suppkey % 2 = 0 AND s_name <> '' THEN s_name ELSE lower(s_name) END AS label, s_nationkey FROM supplier"""
_EDGES = f"""
SELECT DISTINCT * FROM (
  SELECT 'page:' || from_page AS source, CASE category WHEN 'domain' THEN 'aggregates' ELSE 'links_to' END AS relation, 'page:' || to_page AS target FROM ({_LINKS}) l JOIN ({_PAGES}) p ON p.page_id = l.from_page
  UNION ALL SELECT 'page:' || s_nationkey, 'contains', id FROM ({_WORDS}) JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT a.id, 'supplies_with', b.id FROM (SELECT min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY l_partkey HAVING min(l_suppkey) < max(l_suppkey)) r
    JOIN ({_WORDS}) a ON a.ref = CAST(r.a AS VARCHAR) JOIN ({_WORDS}) b ON b.ref = CAST(r.b AS VARCHAR))"""


def _graph(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return G.build(_pages(t), _links(t), _nodes(t), _relations(t))


@query(f"SELECT relation, count(*) AS n FROM ({_EDGES}) GROUP BY relation")
def graph_edges_by_relation(t: Tables) -> DataFrame:
    return _graph(t)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query()
def graph_edges_chained(t: Tables) -> DataFrame:
    """Edges by relation where every supplier of a part is related, not its first and last only."""
    return G.build(_pages(t), _links(t), _nodes(t), _chained(t))[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH e AS ({_EDGES}), n AS (SELECT 'page:' || page_id AS id, 'page' AS node_type, title AS label FROM ({_PAGES}) UNION ALL SELECT id, node_type, label FROM ({_WORDS}))
SELECT relation, h.id, node_type, label FROM (SELECT relation, target AS id FROM e WHERE source = 'page:3' UNION ALL SELECT relation, source FROM e WHERE target = 'page:3') h
JOIN n ON n.id = h.id ORDER BY relation, label, h.id LIMIT 10""")
def graph_expand(t: Tables) -> DataFrame:
    nodes, edges, _ = _graph(t)
    return G.expand(nodes, edges, "page:3").select("relation", "id", "node_type", "label")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, 1000000000 + l_orderkey AS o FROM lineitem WHERE l_quantity >= 50),
b AS (SELECT p AS a, o AS b FROM e UNION SELECT o, p FROM e),
r(a, b) AS (SELECT a, a FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a)
SELECT a AS uid, min(b) AS label FROM r GROUP BY a""")
def connected_components(t: Tables) -> DataFrame:
    """Parts and the orders of full lots that they are in."""
    lots = t.lineitem.where("l_quantity >= 50").select(F.col("l_partkey").alias("a"), (F.col("l_orderkey") + 1_000_000_000).alias("b")).distinct()
    return connected(lots)


@query()
def connected_components_all(t: Tables) -> DataFrame:
    """Parts and all orders that they are in; a closure in SQL is out of reach at this size, so tests count by union-find."""
    return connected(t.lineitem.select(F.col("l_partkey").alias("a"), (F.col("l_orderkey") + 1_000_000_000).alias("b")).distinct())


def _related(t: Tables, cited: DataFrame) -> DataFrame:
    refs = t.part.select(F.col("p_brand").alias("page_id"), F.col("p_partkey").alias("node"))
    a = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("source"))
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("target"))
    relations = a.join(b, ["l_orderkey", "n"]).select("source", "target").distinct()
    sources = cited.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("page_id"), F.col("l_suppkey").alias("source_id"))
    return G.related_pages(refs, relations, sources)


@query("""
WITH refs AS (SELECT p_brand AS page, p_partkey AS node FROM part),
pairs AS (SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber),
one AS (SELECT a.page AS p, b.page AS q FROM pairs JOIN refs a ON a.node = source JOIN refs b ON b.node = target WHERE a.page <> b.page),
src AS (SELECT DISTINCT p_brand AS page, l_suppkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50),
scores AS (
  SELECT p, q, 2 * count(*) AS score FROM (SELECT p, q FROM one UNION ALL SELECT q, p FROM one) GROUP BY p, q
  UNION ALL SELECT a.page, b.page, count(*) FROM src a JOIN src b ON a.s = b.s AND a.page <> b.page GROUP BY 1, 2),
total AS (SELECT p, q, CAST(sum(score) AS BIGINT) AS score FROM scores GROUP BY p, q)
SELECT * FROM (SELECT p AS page_id, q AS related, score, row_number() OVER (PARTITION BY p ORDER BY score DESC, q) AS rank FROM total) WHERE rank <= 8""")
def related_pages_top8(t: Tables) -> DataFrame:
    return _related(t, t.lineitem.where("l_quantity >= 50"))


@query()
def related_pages_all(t: Tables) -> DataFrame:
    """As related_pages_top8, with the suppliers of every line as sources."""
    return _related(t, t.lineitem)


_INBOUND = f"""SELECT to_page AS page_id, count(*) AS inbound FROM ({_LINKS}) l JOIN ({_PAGES}) p ON l.from_page = p.page_id
WHERE category NOT IN ('overview', 'index', 'domain') AND from_page <> to_page GROUP BY to_page"""


@query(_INBOUND)
def inbound_degree(t: Tables) -> DataFrame:
    return G.inbound(_links(t), _pages(t))


@query(f"SELECT i.page_id, inbound, title FROM ({_INBOUND}) i JOIN ({_PAGES}) p ON i.page_id = p.page_id ORDER BY inbound DESC, title LIMIT 10")
def hub_pages(t: Tables) -> DataFrame:
    return G.hubs(_links(t), _pages(t))


@query("""
SELECT * FROM (SELECT category, id, label, pages, row_number() OVER (PARTITION BY category ORDER BY pages DESC, id) AS rank FROM (
  SELECT c_mktsegment AS category, l_partkey AS id, p_name AS label, count(DISTINCT c_custkey) AS pages
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)) WHERE rank <= 12""")
def key_concepts_top12(t: Tables) -> DataFrame:
    """Segments as categories, customers as pages, the parts that they order as nodes."""
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    refs = lines.groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("refs"))
    pages = t.customer.join(refs, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("page_id"), "refs")
    return G.key_concepts(pages, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def dominant_language(t: Tables) -> DataFrame:
    return G.dominant(t.documents, ["source"], "lang")


@query(f"SELECT category, string_agg(title, '|' ORDER BY title, slug) AS members, count(*) AS n FROM ({_PAGES}) WHERE category NOT IN ('overview', 'index', 'domain') GROUP BY category")
def category_groups(t: Tables) -> DataFrame:
    return G.category_groups(_pages(t)).withColumn("members", F.array_join("members", "|"))


@query("SELECT o_custkey AS page_id, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS paths FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def page_sources(t: Tables) -> DataFrame:
    citations = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("page_id"), F.col("l_suppkey").alias("source_id"))
    return G.page_sources(citations, t.supplier.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("rel_path"))).withColumn("paths", F.array_join("paths", "|"))


@query("""
WITH RECURSIVE r AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal < 3000 AND s_suppkey > 0 THEN s_suppkey - 1 END AS merged_into FROM supplier),
c AS (SELECT id, id AS now, 0 AS hops FROM r UNION ALL SELECT c.id, r.merged_into, hops + 1 FROM c JOIN r ON c.now = r.id WHERE merged_into IS NOT NULL AND hops < 17)
SELECT CAST(c.id AS VARCHAR) AS id, CASE WHEN max(hops) > 16 THEN NULL ELSE CAST(max_by(now, hops) AS VARCHAR) END AS target, least(max(hops), 17) AS hops FROM c GROUP BY c.id""")
def merge_chain_resolve(t: Tables) -> DataFrame:
    """Suppliers with small balances are merged into the one before them."""
    into = F.when((F.col("s_acctbal") < 3000) & (F.col("s_suppkey") > 0), (F.col("s_suppkey") - 1).cast("string"))
    return I.resolve_merges(t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), into.alias("merged_into")))


@query("""
SELECT p_partkey AS id FROM part WHERE p_size > 5
AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40)
AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)""")
def ghost_sweep(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, "active").otherwise("retired").alias("status"))
    claims = t.lineitem.select(F.col("l_partkey").alias("node_id"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40), "active").otherwise("retired").alias("status"))
    relations = t.lineitem.select(F.col("l_partkey").alias("source_node_id"), F.col("l_partkey").alias("target_node_id"), F.when(F.col("l_quantity") >= 48, "active").otherwise("retired").alias("status"))
    return I.ghosts(nodes, claims, relations)


def _plans(t: Tables, ref: str) -> tuple[DataFrame, DataFrame]:
    """Old pages: what a customer has ordered. New ones: two customers' together in one segment, by status in another.

    With orders as refs each ref is on one page of a plan, as valid plans have it; with parts, pages share them.
    """
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    lines = orders if ref == "o_orderkey" else orders.join(t.lineitem.select("l_orderkey", ref), F.col("l_orderkey") == F.col("o_orderkey"))
    old = lines.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("page_id")).agg(F.collect_set(ref).alias("refs"))
    key = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("n"), F.col("o_custkey").cast("string"), "o_orderstatus")).when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("m"), F.floor(F.col("o_custkey") / 2).cast("string"))).otherwise(F.concat(F.lit("k"), F.col("o_custkey").cast("string")))
    kept = (F.col("c_mktsegment") != "FURNITURE") | (F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp"))
    new = lines.where(kept).groupBy(key.alias("page_id")).agg(F.collect_set(ref).alias("refs"))
    dressed = [df.withColumn("slug", F.col("page_id")).withColumn("title", F.lit("page")).withColumn("category", F.lit("concept")) for df in (old, new)]
    return dressed[0], dressed[1]


_DIFF = """
lines AS (SELECT REF AS ref, 'c' || o_custkey AS o, CASE c_mktsegment WHEN 'BUILDING' THEN 'n' || o_custkey || o_orderstatus WHEN 'MACHINERY' THEN 'm' || (o_custkey // 2) ELSE 'k' || o_custkey END AS n,
  c_mktsegment <> 'FURNITURE' OR o_orderdate < TIMESTAMP '1995-06-17' AS kept FROM orders LINES JOIN customer ON o_custkey = c_custkey),
o AS (SELECT DISTINCT o, ref FROM lines), n AS (SELECT DISTINCT n, ref FROM lines WHERE kept),
so AS (SELECT o, count(*) AS so FROM o GROUP BY o), sn AS (SELECT n, count(*) AS sn FROM n GROUP BY n),
overlap AS (SELECT o, n, count(*) AS shared FROM o JOIN n ON o.ref = n.ref GROUP BY o, n),
best AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY shared DESC, o) = 1 AS is_best, row_number() OVER (PARTITION BY o ORDER BY shared DESC, n) = 1 AS flows FROM overlap),
pairs AS (SELECT b.*, so, sn, 2 * shared >= so AND 2 * shared >= sn AS covers, sum(is_best::INT) OVER (PARTITION BY b.o) >= 2 AS is_split FROM best b JOIN so ON b.o = so.o JOIN sn ON b.n = sn.n),
flow AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY shared DESC, o) AS nth FROM pairs WHERE flows AND NOT is_split),
judged AS (
  SELECT sn.n, coalesce((SELECT bool_or(is_best AND is_split) FROM pairs p WHERE p.n = sn.n), false) AS split,
    (SELECT count(*) FROM flow f WHERE f.n = sn.n) AS flowing, (SELECT max(o) FROM flow f WHERE f.n = sn.n AND nth = 1 AND covers) AS dominant,
    (SELECT max(o) FROM pairs p WHERE p.n = sn.n AND is_best AND flows AND covers) AS mutual,
    (SELECT bool_or(shared = so AND shared = p.sn) FROM pairs p WHERE p.n = sn.n AND is_best AND flows AND covers) AS same
  FROM sn),
classes AS (SELECT n, CASE WHEN split THEN 'split' WHEN flowing >= 2 AND dominant IS NOT NULL THEN 'merged' WHEN mutual IS NOT NULL AND same THEN 'unchanged' WHEN mutual IS NOT NULL THEN 'modified' ELSE 'created' END AS class, dominant, mutual FROM judged)
"""


_DISJOINT = _DIFF.replace("REF", "o_orderkey").replace("LINES", "")
_SHARED = _DIFF.replace("REF", "l_partkey").replace("LINES", "JOIN lineitem ON l_orderkey = o_orderkey")


@query(f"WITH {_DISJOINT} SELECT n AS page_id, class, CASE class WHEN 'merged' THEN dominant WHEN 'unchanged' THEN mutual WHEN 'modified' THEN mutual END AS kept_id FROM classes")
def plan_diff_classes(t: Tables) -> DataFrame:
    """Refs are orders: each stands on one page of either plan."""
    return V.plan_diff(*_plans(t, "o_orderkey"))[0]


@query(f"""
WITH {_SHARED}, fate AS (
  SELECT so.o, coalesce((SELECT bool_or(is_split) FROM pairs p WHERE p.o = so.o), false) AS split,
    (SELECT max(f.n) FROM flow f JOIN classes c ON c.n = f.n WHERE f.o = so.o AND class = 'merged') AS merged_into,
    (SELECT max(c.n) FROM classes c WHERE class IN ('unchanged', 'modified') AND mutual = so.o) AS kept_as FROM so)
SELECT o AS predecessor, CASE WHEN merged_into IS NOT NULL THEN (SELECT dominant FROM classes WHERE n = merged_into) WHEN kept_as IS NOT NULL THEN o END AS successor,
  CASE WHEN merged_into IS NOT NULL THEN 'merge' WHEN kept_as IS NOT NULL THEN 'keep' ELSE 'retire' END AS kind FROM fate WHERE NOT split
UNION ALL SELECT f.o, p.n, 'split' FROM fate f JOIN pairs p ON p.o = f.o WHERE split AND is_best""")
def page_id_map(t: Tables) -> DataFrame:
    """Refs are parts, which many pages share."""
    return V.page_id_map(*_plans(t, "l_partkey"))


@query("""
WITH refs AS (SELECT DISTINCT o_custkey AS page, l_partkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
gone AS (SELECT p_partkey AS node, bool_or(p_size <= 4) AS del FROM part WHERE p_size <= 6 GROUP BY p_partkey),
own AS (SELECT DISTINCT o_custkey AS page, l_suppkey AS source FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
fresh AS (SELECT 1000000 + s_suppkey AS node, s_suppkey AS source FROM supplier WHERE s_acctbal < 500),
absorbed AS (SELECT f.node, min(page) AS page FROM fresh f LEFT JOIN own ON own.source = f.source GROUP BY f.node),
touched AS (SELECT page FROM refs JOIN gone ON refs.node = gone.node UNION SELECT page FROM own JOIN fresh ON own.source = fresh.source UNION SELECT page FROM absorbed WHERE page IS NOT NULL),
left_ AS (SELECT t.page, count(r.node) FILTER (g.node IS NULL) AS n, bool_and(coalesce(del, true)) AS deletion_only FROM touched t LEFT JOIN refs r ON r.page = t.page LEFT JOIN gone g ON g.node = r.node GROUP BY t.page),
total AS (SELECT l.page, n + (SELECT count(*) FROM absorbed a WHERE a.page = l.page) AS n, deletion_only FROM left_ l)
SELECT page AS page_id, CASE WHEN n = 0 AND deletion_only THEN 'obsolete' WHEN n = 0 THEN 'replan' ELSE 'recompile' END AS outcome, n AS n_refs, CASE WHEN n = 0 AND NOT deletion_only THEN 'page-emptied' END AS trigger FROM total
UNION ALL SELECT NULL, 'replan', 1, 'unmappable-node' FROM absorbed WHERE page IS NULL""")
def incremental_outcomes(t: Tables) -> DataFrame:
    """Customers are pages, parts nodes, suppliers sources; small parts go, some sources gain a node."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pages = lines.groupBy(F.col("o_custkey").alias("page_id")).agg(F.collect_set("l_partkey").alias("refs"))
    own = lines.select(F.col("o_custkey").alias("page_id"), F.col("l_suppkey").alias("source_id"), F.lit(None).cast("string").alias("section_id")).distinct()
    gaining = t.supplier.where("s_acctbal < 500").select(F.col("s_suppkey").alias("source_id"))
    small = t.part.where("p_size > 4 AND p_size <= 6").select(F.col("p_partkey").alias("node"))
    # small parts are what a source (-1), which no page cites, supported before
    nowhere = F.lit(None).cast("string").alias("section_id")
    before = small.select(F.lit(-1).cast("long").alias("source_id"), nowhere, "node")
    # a gained node is no part, however many parts there are
    after = gaining.select("source_id", nowhere, (-F.col("source_id") - 1).alias("node"))
    after = after.unionByName(t.part.where("p_size > 6").agg(F.max("p_partkey").alias("node")).select(F.lit(-1).cast("long").alias("source_id"), nowhere, "node"))
    modified = gaining.unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("source_id")))
    dirs = t.spark.createDataFrame([], "node long, dir string, version string")
    known = t.part.select(F.col("p_partkey").alias("node"))
    changed = V.map_change(pages, own, modified, before, after, known, t.part.where("p_size <= 4").select(F.col("p_partkey").alias("node")), dirs)
    return changed.select("page_id", "outcome", F.size("refs").cast("long").alias("n_refs"), "trigger")


@query("""
SELECT count(*) AS nodes, count(*) FILTER (s_suppkey >= 0) AS placed FROM supplier""")
def cluster_coverage(t: Tables) -> DataFrame:
    """Every node is in one cluster of at most 24 nodes."""
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("entity").alias("node_kind"), F.array(F.col("s_nationkey").cast("string")).alias("dirs"), F.lit(10).cast("long").alias("tokens"))
    relations = _relations(t).select(F.col("source_node_id").cast("long").alias("source"), F.col("target_node_id").cast("long").alias("target"))
    found = G.clusters(nodes, relations).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return found.agg(F.sum("n").alias("nodes"), F.sum(F.when(F.col("n") <= 24, F.col("n")).otherwise(0)).alias("placed"))


@query()
def supplier_clusters(t: Tables) -> DataFrame:
    """id, component, cluster of every supplier, over all chained relations."""
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("entity").alias("node_kind"), F.array(F.col("s_nationkey").cast("string")).alias("dirs"), F.lit(10).cast("long").alias("tokens"))
    return G.clusters(nodes, _chained(t).select(F.col("source_node_id").cast("long").alias("source"), F.col("target_node_id").cast("long").alias("target")))


@query()
def aggregate_pages(t: Tables) -> DataFrame:
    labels = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("label"))
    return G.aggregate_pages(_pages(t), _links(t), labels)

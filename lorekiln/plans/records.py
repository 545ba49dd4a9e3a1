"""Lookups, counts and set tests; parts of orders and lines serve as records. Inline rows hold what the tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lint as L
from ..operators import records as R
from ..operators import retrieval as S
from ..operators import state as J
from .tables import Tables, registry

QUERIES, SQL, query = registry()


def _rows(t: Tables, rows: list, schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def _values(rows: list, columns: str) -> str:
    def literal(x) -> str:
        if isinstance(x, bool) or isinstance(x, int):
            return str(x)
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


@query("SELECT p_partkey AS page_id, p_name AS slug FROM part WHERE p_partkey = 7 OR p_name = '7' UNION ALL SELECT p_partkey, p_name FROM part WHERE CAST(p_partkey AS VARCHAR) = (SELECT max(p_name) FROM part) OR p_name = (SELECT max(p_name) FROM part)")
def page_lookup(t: Tables) -> DataFrame:
    pages = t.part.select(F.col("p_partkey").cast("string").alias("page_id"), F.col("p_name").alias("slug"))
    last = pages.agg(F.max("slug")).first()[0]
    return R.by_id_or_slug(pages, "7").unionByName(R.by_id_or_slug(pages, last)).select(F.col("page_id").cast("long").alias("page_id"), "slug")


@query("SELECT 'all' AS asked, count(*) AS n FROM orders UNION ALL SELECT 'F', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'F urgent', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def jobs_by_status(t: Tables) -> DataFrame:
    asked = {"all": {}, "F": {"o_orderstatus": "F", "o_orderpriority": None}, "F urgent": {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}}
    found = [R.matching(t.orders, **wanted).agg(F.lit(name).alias("asked"), F.count(F.lit(1)).alias("n")) for name, wanted in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'a%' OR p_name LIKE 'b%'")
def edges_by_prefix(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name")
    return R.with_prefix(rows, "p_name", "a").unionByName(R.with_prefix(rows, "p_name", "b"))


@query("SELECT o_orderkey AS claim_id, s_suppkey AS source_id, s_name AS rel_path FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F'")
def claim_sources(t: Tables) -> DataFrame:
    citations = t.lineitem.select(F.when(F.col("l_returnflag") == "R", "claim").otherwise("page").alias("owner_kind"), F.col("l_orderkey").alias("owner_id"), F.col("l_suppkey").alias("source_id"))
    sources = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("rel_path"))
    return R.claim_sources(t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("claim_id")), citations, sources)


@query("WITH r AS (SELECT l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 1) SELECT 'p' || l_partkey AS node FROM r UNION SELECT 's' || l_suppkey FROM r")
def source_nodes(t: Tables) -> DataFrame:
    """Orders are analyses, customers their sources, lines relate parts with suppliers."""
    relations = t.lineitem.select(F.col("l_orderkey").alias("analysis_id"), F.concat(F.lit("p"), "l_partkey").alias("source_node_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_node_id"))
    return R.source_nodes(relations, t.orders.select(F.col("o_orderkey").alias("analysis_id"), "o_custkey"), F.col("o_custkey") % 50 == 1)


@query("SELECT l_partkey AS page_id, count(*) AS citations FROM lineitem GROUP BY 1")
def citations_per_page(t: Tables) -> DataFrame:
    return R.per_page(t.lineitem.select(F.col("l_partkey").alias("page_id")), "page_id", "citations")


@query("SELECT o_custkey AS page_id, count(*) AS inbound FROM orders GROUP BY 1")
def inbound_links(t: Tables) -> DataFrame:
    return R.per_page(t.orders.select(F.col("o_custkey").alias("page_id")), "page_id", "inbound")


@query("SELECT count(*) AS sections, count(nullif(source, 'src1')) AS hashed, count(*) = count(nullif(source, 'src1')) AS complete FROM documents")
def hash_coverage(t: Tables) -> DataFrame:
    return R.hash_coverage(t.documents.select(F.nullif("source", F.lit("src1")).alias("text_hash")))


@query("SELECT coalesce(max(vec_id), 0) AS revision FROM embeddings UNION ALL SELECT coalesce(max(vec_id), 0) FROM embeddings WHERE vec_id < 0")
def revision_token(t: Tables) -> DataFrame:
    return R.revision(t.embeddings, "vec_id").unionByName(R.revision(t.embeddings.where("vec_id < 0"), "vec_id"))


_CLASSES = "['unchanged', 'modified', 'merged', 'split', 'successor', 'created', 'retired']"


@query(f"""
WITH c AS (SELECT {_CLASSES}[o_orderkey % 7 + 1] AS s FROM orders),
n AS (SELECT count(*) FILTER (s = 'unchanged') AS unchanged, count(*) FILTER (s = 'modified') AS modified, count(*) FILTER (s = 'merged') AS merged, count(*) FILTER (s = 'split') AS split,
  count(*) FILTER (s = 'successor') AS successor, count(*) FILTER (s = 'created') AS created, count(*) FILTER (s = 'retired') AS retired FROM c)
SELECT *, modified + merged + successor + created AS recompile, modified + merged + split + created + retired = 0 AS empty FROM n""")
def diff_summary(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in R.DIFF])
    return R.diff_summary(t.orders.select(F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("status")))


@query("SELECT DISTINCT l_partkey AS page_id, l_linenumber AS build_id, l_suppkey AS node_id FROM lineitem")
def page_memberships(t: Tables) -> DataFrame:
    return R.memberships(t.lineitem.select(F.col("l_partkey").alias("page_id"), F.col("l_linenumber").alias("build_id"), F.col("l_suppkey").alias("node_id")))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) || ' ' ELSE p_type END AS title, lower(replace(p_type, ' ', '-')) AS slug FROM part),
n AS (SELECT p_partkey, trim(title) AS title, slug, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY p_partkey) AS i, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS j FROM p)
SELECT p_partkey, CASE WHEN i > 1 THEN title || ' (' || i || ')' ELSE title END AS unique_title, CASE WHEN j > 1 THEN slug || '-' || j ELSE slug END AS unique_slug FROM n""")
def unique_titles(t: Tables) -> DataFrame:
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_type"), F.lit(" "))).otherwise(F.col("p_type"))
    pages = t.part.select("p_partkey", title.alias("title"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("slug"))
    return R.unique_slugs(R.unique_titles(pages, "p_partkey"), "p_partkey").select("p_partkey", "unique_title", "unique_slug")


@query("""
SELECT 'latest' AS asked, o_orderkey AS build_id FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
UNION ALL SELECT 'completed', o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
def latest_builds(t: Tables) -> DataFrame:
    builds = t.orders.select(F.col("o_orderkey").alias("build_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    asked = lambda name, status: R.latest(builds, status).select(F.lit(name).alias("asked"), "build_id")
    return asked("latest", None).unionByName(asked("completed", "F"))


@query("""
WITH s AS (SELECT l_orderkey, list(l_suppkey) FILTER (l_returnflag = 'R') AS a, list(l_suppkey) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_has_all(coalesce(b, []), coalesce(a, [])) AS subset, list_has_all(coalesce(b, []), coalesce(a, [])) AND list_has_all(coalesce(a, []), coalesce(b, [])) AS same FROM s""")
def member_guards(t: Tables) -> DataFrame:
    """Whether the suppliers of an order's returned lines are among those of its other lines, and whether they are the same."""
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("a"), F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("b"))
    return sets.select("l_orderkey", R.is_subset(F.col("a"), F.col("b")).alias("subset"), R.same_members(F.col("a"), F.col("b")).alias("same"))


@query("""SELECT c_custkey, sha256('{"config_hash":"' || c_mktsegment || '","model":"' || c_name || '","schema_version":"' || c_nationkey || '"}') AS fingerprint FROM customer""")
def record_fingerprints(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", R.record_fingerprint(model=F.col("c_name"), schema_version=F.col("c_nationkey"), config_hash=F.col("c_mktsegment")).alias("fingerprint"))


@query("""SELECT n_nationkey, '["' || n_name || '","' || n_regionkey || '"]' AS encoded, n_name AS first, 2 AS n FROM nation""")
def json_lists(t: Tables) -> DataFrame:
    encoded = t.nation.select("n_nationkey", R.encoded_list(F.array("n_name", F.col("n_regionkey").cast("string"))).alias("encoded"))
    back = R.decoded_list(F.col("encoded"))
    return encoded.select("n_nationkey", "encoded", back[0].alias("first"), F.size(back).alias("n"))


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') = 0 AS may_start, count(*) FILTER (o_orderstatus = 'O') < 5 AS may_queue FROM orders")
def admission(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("COMPLETED")
    return J.admitted(t.orders.select(state.alias("state")), 5)


@query("""
WITH p AS (SELECT url AS slug FROM pages), c AS (SELECT slug FROM p ORDER BY slug LIMIT 1 OFFSET 30),
r AS (SELECT slug, row_number() OVER (ORDER BY slug) AS nth FROM p WHERE slug > (SELECT slug FROM c))
SELECT slug, nth, (SELECT count(*) FROM r) > 20 AS more FROM r WHERE nth <= 20""")
def slug_page(t: Tables) -> DataFrame:
    pages = t.pages.select(F.col("url").alias("slug"))
    return J.slug_page(pages, pages.orderBy("slug").offset(30).first()["slug"])


_SIDES = [("off", True, True, True, 1, "disabled"), ("new", False, False, True, 1, "not_published"), ("bare", False, True, False, 1, "index_not_built"), ("none", False, True, True, 0, "no_matches"), ("some", False, True, True, 3, "served"), ("all", True, False, False, 0, "disabled")]


@query(_values([(r[0], r[5]) for r in _SIDES], "side, status"))
def side_status(t: Tables) -> DataFrame:
    rows = _rows(t, [r[:5] for r in _SIDES], "side string, disabled boolean, published boolean, built boolean, hits int")
    return rows.select("side", S.side_status(*[F.col(c) for c in ("disabled", "published", "built", "hits")]).alias("status"))


# name, what the table lacks: CJK, full-width and combining characters; words; slug; key; title
_FORMS = [
    ("cjk", "全文検索", "全 全文 文 文検 検 検索 索", "全文検索", "全文検索", "全文検索"),
    ("wide", "ＦＵＬＬ　ｗｉｄｔｈ １２", "full width 12", "ｆｕｌｌ-ｗｉｄｔｈ-１２", "full width 12", "full width 12"),
    ("composed", "Été à la Plage", "ete a la plage", "été-à-la-plage", "été à la plage", "été à la plage"),
    ("combining", "E\u0301te\u0301 a\u0300 la Plage", "ete a la plage", "été-à-la-plage", "été à la plage", "été à la plage"),
    ("turkish", "ğüş Sokağı", "gus sokagı", "ğüş-sokağı", "ğüş sokağı", "ğüş sokağı"),
    ("mixed", "Spark で検索 4.1", "spark で 検 検索 索 4 1", "spark-で検索-4-1", "spark で検索 4.1", "spark で検索 4.1"),
    ("space", "\u3000 Two\t\u00a0 words \u2003", "two words", "two-words", "two\t  words", "two words"),
]


@query(_values([(r[0], *r[2:]) for r in _FORMS], "name, words, slug, key, title"))
def text_forms(t: Tables) -> DataFrame:
    rows = _rows(t, [r[:2] for r in _FORMS], "name string, x string")
    return rows.select("name", F.array_join(T.tokens("x", fold=True), " ").alias("words"), T.slug("x").alias("slug"), T.canonical_key("x").alias("key"), T.normalized_title("x").alias("title"))


@query(_values([("a\r\nb  \n\n", True), ("\u3000a\t\nb\u2003", True), ("a\rb", False), ("a \n b", False)], "x, same"))
def fingerprint_forms(t: Tables) -> DataFrame:
    rows = _rows(t, [("a\r\nb  \n\n",), ("\u3000a\t\nb\u2003",), ("a\rb",), ("a \n b",)], "x string")
    return rows.select("x", (T.fingerprint("x") == T.fingerprint(F.lit("a\nb"))).alias("same"))


_NAMES = [("plain-Slug_1", "plain-Slug_1.md"), ("全文", "p.md"), ("alpha-服务", "alpha-{}.md"), ("a b--c", "a-b--c-{}.md"), ("aé-éb", "a--b-{}.md"), ("..", "p.md"), ("", "p.md"), ("x" * 60 + "é", "x" * 48 + "-{}.md")]


@query("SELECT slug, replace(pattern, '{}', substr(sha256(slug), 1, 8)) AS file FROM (" + _values(_NAMES, "slug, pattern") + ")")
def page_file_names(t: Tables) -> DataFrame:
    return _rows(t, [(n,) for n, _ in _NAMES], "slug string").select("slug", T.page_file_name(F.col("slug"), F.lit("p")).alias("file"))


_KANA = "ひらがなとカタカナの文章です。これは日本語"
_TAGS = [
    ("a.cn.md", None, "plain words, many of them", "zh-CN"), ("a.zh-cn.md", None, "", "zh-CN"), ("A.ZH_CN.mdx", None, "", "zh-CN"), ("x/a.en.md", None, _KANA, "en"), ("a.fr.md", None, "un texte assez long en français", "en"),
    ("a.md", None, _KANA, "zh"), ("a.md", None, "few", "und"), ("a.md", None, "только кириллица в этом тексте", "und"), ("a.cn.md", " PT-br ", "x", "pt-BR"), ("a.md", "ZH-hans-cn", "x", "zh-HANS"), ("zh.cn/a.md", None, "plain words, many of them", "en"), ("b.md", " ", "plain words, many of them", "en"),
]


@query(_values([(i, r[3]) for i, r in enumerate(_TAGS)], "i, tag"))
def language_forms(t: Tables) -> DataFrame:
    rows = _rows(t, [(i, *r[:3]) for i, r in enumerate(_TAGS)], "i int, path string, said string, body string")
    return rows.select("i", T.language("body", F.col("said"), F.col("path")).alias("tag"))


_CJK = [(1, "全文検索システムの設計"), (2, "データベースの設計"), (3, "search the index"), (4, "検索 index and search"), (5, "ｓｅａｒｃｈ"), (6, "ğüş")]


@query(_values([("検索", 1), ("検索", 4), ("search", 3), ("search", 4), ("search", 5), ("ｉｎｄｅｘ", 3), ("ｉｎｄｅｘ", 4), ("ğus", 6), ("設計", 1), ("設計", 2)], "asked, id"))
def search_forms(t: Tables) -> DataFrame:
    """Which rows a lexical search finds: Han words by their parts, full-width words by their usual form, letters without diacritics."""
    rows = _rows(t, _CJK, "id int, x string")
    found = None
    for asked in ("検索", "search", "ｉｎｄｅｘ", "ğus", "設計"):
        posting, lengths = S.postings(rows, "id", S.index_tokens(F.col("x")))
        wanted = T.query_terms(F.lit(asked), fold=True)
        both = S.bm25(rows, "id", S.index_tokens(F.col("x")), asked).join(S.search_postings(posting, lengths, asked, 10).select("id"), "id")
        whole = both.join(rows, "id").where(F.size(F.array_except(wanted, S.index_tokens(F.col("x")))) == 0)
        hits = whole.select(F.lit(asked).alias("asked"), "id")
        found = hits if found is None else found.unionByName(hits)
    return found


_PROPOSED = [("a", " ", "concepts", "", ["1", "9"]), ("b", "t", "concept", "x", ["1"]), ("c", "u", "guides", "x", []), ("d", "v", "reference", "x", ["2"])]


@query(_values([("proposals", "a", "EMPTY_TITLE"), ("proposals", "a", "UNKNOWN_NODE_REF"), ("proposals", "b", "UNKNOWN_CATEGORY"), ("proposals", "b", "DUPLICATE_NODE_ASSIGNMENT"), ("proposals", "c", "EMPTY_REFS")]
    + [("merged", "a", "EMPTY_TITLE"), ("merged", "a", "UNKNOWN_NODE_REF"), ("merged", "a", "EMPTY_PURPOSE"), ("merged", "b", "UNKNOWN_CATEGORY"), ("merged", "b", "DUPLICATE_NODE_ASSIGNMENT"), ("merged", "c", "EMPTY_REFS"), ("merged", None, "MISSING_NODE_COVERAGE"), ("none", None, "EMPTY_PLAN")], "plan, page, code"))
def plan_validation(t: Tables) -> DataFrame:
    proposals = _rows(t, _PROPOSED, "page string, title string, category string, purpose string, refs array<string>")
    nodes = _rows(t, [("1",), ("2",), ("3",)], "id string")
    of = lambda name, rows, merged: L.plan_codes(rows, nodes, merged).select(F.lit(name).alias("plan"), "page", "code")
    return of("proposals", proposals, False).unionByName(of("merged", proposals, True)).unionByName(of("none", proposals.limit(0), False))


_BODIES = [
    ("ok", 'x <!-- kb:cite claim="c1" --> [[ Yes | shown ]]', None), ("bare", "no claim is cited", "UNGROUNDED_BODY"), ("free", "nothing to cite", None), ("blank", ' <!-- kb:cite claim="c1" --> ', "EMPTY_BODY"),
    ("empty", 'x <!-- kb:cite claim="" -->', "EMPTY_CLAIM_REF"), ("lacks", "x <!-- kb:cite -->", "EMPTY_CLAIM_REF"), ("lost", 'x <!-- kb:cite claim="c9" -->', "UNKNOWN_CLAIM_REF"), ("loose", 'x <!-- kb:cite claim="c2" -->', "UNANCHORED_CLAIM"),
    ("link", 'x <!-- kb:cite claim="c1" --> [[No]]', "UNKNOWN_LINK_TARGET"), ("open", 'x <!-- kb:cite claim="c1" --> ]]', "UNCLOSED_WIKILINK"), ("tail", 'x <!-- kb:cite claim="c1" --> -->', "UNCLOSED_COMMENT"), ("long", 'x <!-- kb:cite claim="c1" -->' + " word" * 101, "NO_SECTIONS"), ("parts", 'x <!-- kb:cite claim="c1" -->## ' + " word" * 101, None),
]


@query(_values([(p, c) for p, _, c in _BODIES if c], "page_id, codes"))
def body_validation(t: Tables) -> DataFrame:
    pages = _rows(t, [r[:2] for r in _BODIES], "page_id string, content string")
    claims = _rows(t, [(p, c, c == "c1") for p, _, _ in _BODIES if p != "free" for c in ("c1", "c2")], "page_id string, claim_id string, anchored boolean")
    return L.body_codes(pages, claims, _rows(t, [("yes ",)], "title string")).select("page_id", F.array_join("codes", ",").alias("codes"))


@query()
def expanded_citations(t: Tables) -> DataFrame:
    """A page for each order that cites its lines' parts; suppliers of a part anchor its claim."""
    cite = F.concat(F.lit('said <!-- kb:cite claim="'), F.col("l_partkey").cast("string"), F.lit('" -->'))
    pages = t.lineitem.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(cite)), "\n").alias("content"))
    lines = t.lineitem.where("l_linenumber = 1").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("start"))
    anchors = lines.select(F.col("l_partkey").cast("string").alias("claim_id"), F.col("l_suppkey").alias("nth"), F.col("l_suppkey").cast("string").alias("source_id"), F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("rel_path"), F.array(F.lit("A"), F.lit("B")).alias("heading_path"), "start", (F.col("start") + 1).alias("end"), F.md5(F.col("start").cast("string")).alias("digest"))
    found = R.expand_citations(pages, anchors)
    return found.select("page_id", F.sha2("body", 256).alias("body_sha256"), F.size("citations").alias("citations"), F.array_join("sources", "|").alias("sources"))

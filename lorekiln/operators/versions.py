"""What becomes of sections and pages between two versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, written


def match_sections(previous: DataFrame, current: DataFrame) -> DataFrame:
    """source_id, ord, outcome (carried, ambiguous, created, retired), section_id.

    previous: source_id, ord, section_id, path, fingerprint; current: source_id, ord, path,
    fingerprint. Current sections are taken in order, and each previous one at most once: by
    a unique fingerprint; of several with that fingerprint, by a unique equal path, else
    it is ambiguous; by a path, the first occurrence that is left; else it is created. What is left is retired.
    The order matters, so a source's sections (one document's) are one group.
    """

    def match(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        old, new = old.sort_values("ord", ignore_index=True), new.sort_values("ord", ignore_index=True)
        left = list(range(len(old)))
        out = []
        for row in new.itertuples(index=False):
            same = [i for i in left if old["fingerprint"][i] == row.fingerprint]
            there = [i for i in (same if len(same) > 1 else left) if old["path"][i] == row.path]
            if len(same) == 1:
                hit = same[0]
            elif same:
                hit = there[0] if len(there) == 1 else None
            else:
                hit = there[0] if there else None
            outcome = "carried" if hit is not None else "ambiguous" if same else "created"
            if hit is not None:
                left.remove(hit)
            out.append((row.source_id, row.ord, outcome, None if hit is None else old["section_id"][hit]))
        out += [(old["source_id"][i], old["ord"][i], "retired", old["section_id"][i]) for i in left]
        return pd.DataFrame(out, columns=["source_id", "ord", "outcome", "section_id"])

    kinds = dict(previous.dtypes)
    schema = f"source_id {kinds['source_id']}, ord {kinds['ord']}, outcome string, section_id {kinds['section_id']}"
    return previous.groupBy("source_id").cogroup(current.groupBy("source_id")).applyInPandas(match, schema)


def apply_matches(previous: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """Sections after a match: carried ones with their new content under the old id, created and ambiguous ones new, retired ones kept as such."""
    live = current.join(matches.where("outcome <> 'retired'"), ["source_id", "ord"]).select("source_id", "ord", F.coalesce("section_id", F.concat(F.lit("sec_"), F.sha2(F.concat_ws("\x1f", F.col("source_id").cast("string"), F.col("ord").cast("string"), "fingerprint"), 256))).alias("section_id"), "path", "fingerprint", F.lit("active").alias("status"))
    gone = previous.join(matches.where("outcome = 'retired'").select("section_id"), "section_id", "left_semi").select("source_id", "ord", "section_id", "path", "fingerprint", F.lit("retired").alias("status"))
    return live.unionByName(gone)


#: Refs by which a page's likely partner is guessed, shared refs that a page must have among another's first ones to be compared with it, and pairs of pages that a task counts.
GUESSES, MEETINGS, PAIRS = 8, 3, 2_000_000


def _numbered(plan: DataFrame, name: str) -> DataFrame:
    """Pages with ``number``, which rises with slug and page_id."""
    return written(plan.select("page_id", "slug", "refs").orderBy("slug", "page_id").withColumn("number", F.monotonically_increasing_id()), name)


def _met(refs: DataFrame, other: DataFrame, *kept: str) -> DataFrame:
    """a, b, hits and what is kept of a: pages of ``other`` (b, ref) that hold any of refs (a, ref, often)."""
    parts = (refs.agg(F.sum("often")).first()[0] or 0) // PAIRS + 1
    least = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # pairs come to their page's task uncombined, as hardly any two of a task are equal, and as many tasks as bound their counts
    return refs.join(other, "ref").select("a", "b", *kept).repartition(max(parts, least), "a").groupBy("a", "b", *kept).agg(F.count(F.lit(1)).alias("hits"))


def _common(pairs: DataFrame, refs: DataFrame, other: DataFrame) -> DataFrame:
    """a, b, shared of pairs (a, b)."""
    return pairs.select("a", "b").join(refs.select("a", "ref"), "a").join(other, ["b", "ref"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _nearest(own: DataFrame, other: DataFrame) -> DataFrame:
    """a, b, shared: for each page of ``own`` (a, ref) the one of ``other`` (b, ref) that shares most refs, of equals the first.

    Pages that share no fewer refs than any other page is known to share lack so many of a page's refs at most, hence hold
    some of its rarest ones; only these are met with all pages that have them.
    """
    often = other.groupBy("ref").agg(F.count(F.lit(1)).alias("often"))
    mine = Window.partitionBy("a")
    refs = own.join(often, "ref").select("a", "ref", "often", F.row_number().over(mine.orderBy("often", "ref")).alias("nth"))
    refs = written(refs.withColumn("size", F.count(F.lit(1)).over(mine)), "plan-refs")
    guess = _met(refs.where(F.col("nth") <= GUESSES), other).groupBy("a").agg(F.max_by("b", F.struct("hits", "b")).alias("b"))
    known = _common(guess, refs, other).select("a", F.col("shared").alias("least"))
    meetings = F.least(F.col("least"), F.lit(MEETINGS))
    first = written(refs.join(known, "a").where(F.col("nth") <= F.col("size") - F.col("least") + meetings).select("a", "ref", "often", "least", meetings.alias("meetings")), "plan-first-refs")
    # refs beyond the first ones, least - meetings of them, can add as many shared ones
    bound = F.greatest(F.max("hits").over(mine), F.col("least"))
    pairs = _met(first, other, "least", "meetings").where("hits >= meetings").withColumn("bound", bound)
    pairs = written(pairs.where("hits + least - meetings >= bound").select("a", "b"), "plan-pairs")
    best = written(_common(pairs, refs, other).groupBy("a").agg(F.min(F.struct((-F.col("shared")).alias("less"), "b")).alias("top")).select("a", "top.b", (-F.col("top.less")).alias("shared")), "plan-best")
    discard(refs, first, pairs)
    return best


def _matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """o, o_slug, n, n_slug, shared, is_best, flows: each new page's best old page and each old page's best new one.

    Plans that are valid give a ref to one page, and an equi-join over refs is one to one. Of pages that share refs not all
    pairs are met (see ``_nearest``). Only the best of each side go on, at most a row for each page.
    """
    o_pages, n_pages = _numbered(old, "plan-old"), _numbered(new, "plan-new")
    o = o_pages.select(F.col("number").alias("b"), F.explode(F.array_distinct("refs")).alias("ref"))
    n = n_pages.select(F.col("number").alias("b"), F.explode(F.array_distinct("refs")).alias("ref"))
    own = lambda refs: refs.withColumnRenamed("b", "a")
    of_new = _nearest(own(n), o).select(F.col("a").alias("n"), F.col("b").alias("o"), "shared", F.lit(True).alias("is_best"))
    of_old = _nearest(own(o), n).select(F.col("b").alias("n"), F.col("a").alias("o"), "shared", F.lit(True).alias("flows"))
    chosen = of_new.join(of_old, ["n", "o", "shared"], "full_outer").select("n", "o", "shared", F.coalesce("is_best", F.lit(False)).alias("is_best"), F.coalesce("flows", F.lit(False)).alias("flows"))
    named = lambda pages, x: pages.select(F.col("number").alias(x), F.col("page_id").alias(f"{x}_id"), F.col("slug").alias(f"{x}_slug"))
    rows = chosen.join(named(o_pages, "o"), "o").join(named(n_pages, "n"), "n")
    return written(rows.select(F.col("o_id").alias("o"), "o_slug", F.col("n_id").alias("n"), "n_slug", "shared", "is_best", "flows"), "plan-matches")


def plan_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of the new pages (page_id, class, kept_id) and fates of the old ones (page_id, fate, successor).

    Both have page_id, slug, title, category, refs (array). Two pages overlap by the number of refs that both
    hold. Of new pages: 'split' (their best old page
    is the best of several), 'merged', 'unchanged', 'modified' or 'created'. Of old ones: 'split', 'merged', 'kept' or 'retired'.
    """
    return _classified(old, new, _matched(old, new))


def _classified(old: DataFrame, new: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    claims = F.sum(F.col("is_best").cast("int")).over(Window.partitionBy("o"))
    pairs = pairs.withColumn("is_split", claims >= 2)
    sizes_o, sizes_n = old.select(F.col("page_id").alias("o"), F.size(F.array_distinct("refs")).alias("o_size"), F.trim("title").alias("o_title"), F.col("category").alias("o_category")), new.select(F.col("page_id").alias("n"), F.size(F.array_distinct("refs")).alias("n_size"), F.trim("title").alias("n_title"), F.col("category").alias("n_category"))
    pairs = pairs.join(sizes_o, "o").join(sizes_n, "n")
    covers = (2 * F.col("shared") >= F.col("o_size")) & (2 * F.col("shared") >= F.col("n_size"))
    same = (F.col("shared") == F.col("o_size")) & (F.col("shared") == F.col("n_size")) & F.col("o_title").eqNullSafe(F.col("n_title")) & F.col("o_category").eqNullSafe(F.col("n_category"))
    flowing = F.col("flows") & ~F.col("is_split")
    lead = F.row_number().over(Window.partitionBy("n", flowing).orderBy(F.desc("shared"), "o_slug"))
    pairs = pairs.withColumn("lead", flowing & (lead == 1) & covers)
    judged = pairs.groupBy("n").agg(
        F.max(F.col("is_best") & F.col("is_split")).alias("split"),
        F.sum(flowing.cast("int")).alias("flowing"),
        F.max(F.when(F.col("lead"), F.col("o"))).alias("dominant"),
        F.max(F.when(F.col("is_best") & F.col("flows") & covers, F.struct("o", same.alias("same")))).alias("mutual"),
    )
    merged = (F.col("flowing") >= 2) & F.col("dominant").isNotNull()
    kind = F.when(F.col("split"), "split").when(merged, "merged").when(F.col("mutual").isNotNull(), F.when(F.col("mutual.same"), "unchanged").otherwise("modified")).otherwise("created")
    classes = new.select(F.col("page_id").alias("n")).join(judged, "n", "left").select(F.col("n").alias("page_id"), F.coalesce(kind, F.lit("created")).alias("class"), F.when(kind == "merged", F.col("dominant")).when(kind.isin("unchanged", "modified"), F.col("mutual.o")).alias("kept_id"))
    fated = pairs.join(classes.select(F.col("page_id").alias("n"), "class", "kept_id"), "n")
    fates = fated.groupBy("o").agg(
        F.max("is_split").alias("split"),
        F.min(F.when(F.col("is_split") & F.col("is_best"), F.col("n"))).alias("first_successor"),
        F.max(F.when((F.col("class") == "merged") & flowing, F.col("n"))).alias("merged_into"),
        F.max(F.when(F.col("class").isin("unchanged", "modified") & (F.col("kept_id") == F.col("o")), F.col("n"))).alias("kept_as"),
    )
    fate = F.when(F.col("split"), "split").when(F.col("merged_into").isNotNull(), "merged").when(F.col("kept_as").isNotNull(), "kept").otherwise("retired")
    ends = old.select(F.col("page_id").alias("o")).join(fates, "o", "left").select(F.col("o").alias("page_id"), F.coalesce(fate, F.lit("retired")).alias("fate"), F.when(fate == "split", F.col("first_successor")).when(fate == "merged", F.col("merged_into")).when(fate == "kept", F.col("kept_as")).alias("successor"))
    return classes, ends


def page_id_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """predecessor, successor, kind (keep, merge, split, retire): one row for each way of an old page."""
    pairs = _matched(old, new)
    classes, ends = _classified(old, new, pairs)
    names = classes.select(F.col("page_id").alias("successor"), F.coalesce("kept_id", "page_id").alias("name"))
    simple = ends.where("fate <> 'split'").join(names, "successor", "left")
    kinds = F.when(F.col("fate") == "kept", "keep").when(F.col("fate") == "merged", "merge").otherwise("retire")
    rows = simple.select(F.col("page_id").alias("predecessor"), F.col("name").alias("successor"), kinds.alias("kind"))
    best = pairs.where("is_best").select("o", "n")
    split = best.join(ends.where("fate = 'split'").select(F.col("page_id").alias("o")), "o")
    return rows.unionByName(split.select(F.col("o").alias("predecessor"), F.col("n").alias("successor"), F.lit("split").alias("kind")))


def lost_refs(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, lost: refs of retired pages that no new page holds."""
    _, ends = plan_diff(old, new)
    gone = old.join(ends.where("fate = 'retired'").select("page_id"), "page_id", "left_semi").select("page_id", F.explode("refs").alias("ref"))
    return gone.join(new.select(F.explode("refs").alias("ref")).distinct(), "ref", "left_anti").groupBy("page_id").agg(F.array_sort(F.collect_list("ref")).alias("lost"))


def map_change(pages: DataFrame, ownership: DataFrame, modified: DataFrame, before: DataFrame, after: DataFrame, known: DataFrame, deleted: DataFrame, dirs: DataFrame) -> DataFrame:
    """page_id, outcome, refs, trigger for each page that a change of sources touches; a null page_id for nodes that no page can take.

    pages: page_id, refs; ownership: page_id, source_id, section_id (cited); modified: source_id; before, after:
    source_id, section_id, node of modified and of all changed sources; known: node of the previous knowledge base; deleted: node
    gone with deleted sources; dirs: node, dir, version ('prev' or 'new').

    Outcomes: 'recompile', 'obsolete', or 'replan' with trigger unmappable-node, page-emptied or structural-change.
    """
    replaced = before.join(modified, "source_id", "left_semi").join(after.select("source_id").distinct(), "source_id", "left_semi").join(after.select("source_id", "node").distinct(), ["source_id", "node"], "left_anti").select("node").distinct()
    gone = deleted.select("node", F.lit(True).alias("by_deletion")).unionByName(replaced.select("node", F.lit(False).alias("by_deletion"))).groupBy("node").agg(F.max("by_deletion").alias("by_deletion"))
    fresh = after.join(known.select("node"), "node", "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("source_id", "section_id"))).where("nth = 1").drop("nth")
    by_section = ownership.where("section_id IS NOT NULL").groupBy("source_id", "section_id").agg(F.min("page_id").alias("section_page"))
    by_source = ownership.groupBy("source_id").agg(F.min("page_id").alias("source_page"))
    absorbed = fresh.join(by_section, ["source_id", "section_id"], "left").join(by_source, "source_id", "left").select("node", F.coalesce("section_page", "source_page").alias("page_id"))
    refs = pages.select("page_id", F.explode_outer("refs").alias("node")).join(gone, "node", "left")
    touched = refs.where("by_deletion IS NOT NULL").select("page_id").union(ownership.join(modified, "source_id", "left_semi").select("page_id")).union(absorbed.where("page_id IS NOT NULL").select("page_id")).distinct()
    left = refs.join(touched, "page_id").groupBy("page_id").agg(F.collect_set(F.when(F.col("by_deletion").isNull(), F.col("node"))).alias("kept"), F.min(F.coalesce("by_deletion", F.lit(True))).alias("deletion_only"))
    gains = absorbed.where("page_id IS NOT NULL").groupBy("page_id").agg(F.collect_set("node").alias("gained"))
    after_refs = left.join(gains, "page_id", "left").select("page_id", F.array_sort(F.array_union("kept", F.coalesce("gained", F.array().cast(dict(left.dtypes)["kept"])))).alias("refs"), "deletion_only")
    old_dirs = pages.select("page_id", F.explode("refs").alias("node")).join(dirs.where("version = 'prev'"), "node").select("page_id", "dir").distinct()
    new_dirs = after_refs.select("page_id", F.explode("refs").alias("node")).join(dirs.where("version = 'new'"), "node").select("page_id", "dir").distinct()
    mixing = new_dirs.join(old_dirs, ["page_id", "dir"], "left_anti").select("page_id").distinct().withColumn("mixing", F.lit(True))
    judged = after_refs.join(mixing, "page_id", "left")
    empty = F.size("refs") == 0
    outcome = F.when(empty & F.col("deletion_only"), "obsolete").when(empty | F.coalesce("mixing", F.lit(False)), "replan").otherwise("recompile")
    trigger = F.when(empty & ~F.col("deletion_only"), "page-emptied").when(~empty & F.coalesce("mixing", F.lit(False)), "structural-change")
    pages_out = judged.select("page_id", outcome.alias("outcome"), "refs", trigger.alias("trigger"))
    homeless = absorbed.where("page_id IS NULL").select("page_id", F.lit("replan").alias("outcome"), F.array("node").alias("refs"), F.lit("unmappable-node").alias("trigger"))
    return pages_out.unionByName(homeless)

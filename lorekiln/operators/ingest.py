"""Manifests, their differences, registries, chunks and caches: the incremental side of ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..sources.tables import written


def manifest(files: DataFrame, workspace: str) -> DataFrame:
    """rel_path, locator_key, content_hash, size from rel_path, content (string or binary)."""
    bytes_ = F.col("content").cast("binary")
    return files.select("rel_path", F.concat(F.lit("loc_"), F.sha2(F.concat(F.lit(workspace + "\0"), F.col("rel_path")), 256)).alias("locator_key"), F.sha2(bytes_, 256).alias("content_hash"), F.octet_length(bytes_).cast("long").alias("size"))


def snapshot_hash(entries: DataFrame) -> DataFrame:
    """snapshot_hash, entries: one digest of a manifest that changes with any of its lines.

    Each line's SHA-256 is four numbers of 64 bits; these are added up over all lines, in any order and with
    map-side sums, and the sums are hashed with the number of lines. No task holds more than a row of sums.
    """
    line = F.sha2(F.concat_ws("\x1f", "rel_path", "locator_key", "content_hash", F.col("size").cast("string")), 256)
    part = lambda i: F.conv(F.substring("line", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = entries.select(line.alias("line")).agg(F.count(F.lit(1)).alias("entries"), *[F.sum(part(i)).alias(f"s{i}") for i in range(4)])
    text = F.concat_ws("\n", F.col("entries").cast("string"), *[F.coalesce(f"s{i}", F.lit(0)).cast("string") for i in range(4)])
    return sums.select(F.sha2(text, 256).alias("snapshot_hash"), "entries")


def manifest_diff(registered: DataFrame, scanned: DataFrame) -> DataFrame:
    """rel_path, status: added, modified, unchanged or deleted, by locator."""
    old = registered.select("locator_key", F.col("content_hash").alias("old_hash"), F.col("rel_path").alias("old_path"))
    new = scanned.select("locator_key", F.col("content_hash").alias("new_hash"), F.col("rel_path").alias("new_path"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return old.join(new, "locator_key", "full_outer").select(F.coalesce("new_path", "old_path").alias("rel_path"), status.alias("status"))


def portable_collisions(paths: DataFrame) -> DataFrame:
    """portable_key, n: paths that are one on a file system without case."""
    return paths.groupBy(F.lower(nfc("rel_path")).alias("portable_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert_sources(registry: DataFrame, scanned: DataFrame) -> DataFrame:
    """Registry after a scan: source_id, locator_key, rel_path, content_hash, size, status, created.

    Ids stay; new sources get one derived from the locator; sources that are gone are 'removed'.
    """
    new = scanned.select("locator_key", *[F.col(c).alias(f"new_{c}") for c in ("rel_path", "content_hash", "size")])
    both = registry.join(new, "locator_key", "full_outer")
    gone = F.col("new_rel_path").isNull()
    return both.select(
        F.coalesce("source_id", F.concat(F.lit("src_"), F.sha2("locator_key", 256))).alias("source_id"),
        "locator_key",
        *[F.coalesce(f"new_{c}", c).alias(c) for c in ("rel_path", "content_hash", "size")],
        F.when(gone, "removed").otherwise("active").alias("status"),
        F.col("source_id").isNull().alias("created"),
    )


def resolve_merges(registry: DataFrame, hops: int = 16) -> DataFrame:
    """id, target, hops: follows merged_into; a chain longer than ``hops`` (or a cycle) has no target.

    Each round all chains that go on take one step, by an equi-join; rounds end with the longest chain.
    """
    step = registry.select(F.col("id").alias("at"), "merged_into")
    open_ = registry.select("id", F.col("id").alias("at"), F.lit(0).alias("hops"))
    done = None
    for n in range(hops + 1):
        joined = open_.join(step, "at")
        ended = joined.where("merged_into IS NULL").select("id", F.col("at").alias("target"), "hops")
        done = ended if done is None else done.unionByName(ended)
        open_ = written(joined.where("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("at"), (F.col("hops") + 1).alias("hops")), "merges")
        if n == hops or open_.isEmpty():
            break
    return done.unionByName(open_.select("id", F.lit(None).cast("string").alias("target"), "hops"))


def get_or_create(registry: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry rows after drafts (node_kind, canonical_key, canonical_name, description), and the change of its revision.

    A draft resolves to the key's node, followed through merges; a retired node becomes active
    again, absent details are filled in, and unknown keys are created. The first draft of a key counts.
    """
    key = ["node_kind", "canonical_key"]
    first = Window.partitionBy(*key).orderBy("canonical_name", "description")
    drafts = drafts.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    targets = resolve_merges(registry).where("target IS NOT NULL").select("id", "target")
    known = registry.join(targets, "id").select(*key, "target")
    wanted = drafts.join(known, key, "left").withColumn("id_", F.coalesce("target", F.concat(F.lit("kn_"), F.sha2(F.concat_ws("\x1f", *key), 256))))
    details = wanted.groupBy("id_").agg(F.min("description").alias("new_description"), F.min("canonical_name").alias("new_name"), F.min("node_kind").alias("new_kind"), F.min("canonical_key").alias("new_key"))
    joined = registry.join(details, registry["id"] == details["id_"], "full_outer")
    created, revived = F.col("id").isNull(), (F.col("status") == "retired") & F.col("id_").isNotNull()
    after = joined.select(
        F.coalesce("id", "id_").alias("id"),
        F.coalesce("node_kind", "new_kind").alias("node_kind"),
        F.coalesce("canonical_key", "new_key").alias("canonical_key"),
        F.coalesce("canonical_name", "new_name").alias("canonical_name"),
        F.coalesce("description", "new_description").alias("description"),
        F.when(created | revived, "active").otherwise(F.col("status")).alias("status"),
        "merged_into",
        (created | revived).alias("changed"),
    )
    return after.drop("changed"), after.agg(F.coalesce(F.sum(F.col("changed").cast("long")), F.lit(0)).alias("revision_change"))


def ghosts(nodes: DataFrame, claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Active nodes (id) without any active claim or active relation."""
    ends = relations.where("status = 'active'").select(F.col("source_node_id").alias("id")).union(relations.where("status = 'active'").select("target_node_id"))
    return nodes.where("status = 'active'").select("id").join(claims.where("status = 'active'").select(F.col("node_id").alias("id")), "id", "left_anti").join(ends, "id", "left_anti")


def replace_source(claims: DataFrame, source: DataFrame, new: DataFrame) -> DataFrame:
    """Claims after a source's re-analysis: its old ones retired, the new ones added."""
    hit = claims.join(source.select("source_id", F.lit(True).alias("hit")), "source_id", "left")
    return hit.withColumn("status", F.when(F.col("hit"), "retired").otherwise(F.col("status"))).drop("hit").unionByName(new)


def carry_chunks(old: DataFrame, changed: DataFrame, new: DataFrame, build_id: str) -> DataFrame:
    """Chunks of a new build: those of sources that did not change are carried, others replaced or gone."""
    carried = old.join(changed.select("source_id"), "source_id", "left_anti").withColumn("carried", F.lit(True))
    return carried.unionByName(new.withColumn("carried", F.lit(False))).withColumn("build_id", F.lit(build_id))


def body_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, outcome: carried, changed, created or removed, by body_hash."""
    joined = old.select("page_id", F.col("body_hash").alias("old")).join(new.select("page_id", F.col("body_hash").alias("new")), "page_id", "full_outer")
    return joined.select("page_id", F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "carried").otherwise("changed").alias("outcome"))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct cache_keys that the cache lacks."""
    return wanted.select("cache_key").distinct().join(cache.select("cache_key"), "cache_key", "left_anti")


def retained(builds: DataFrame, keep: int = 3, current: Column | None = None) -> DataFrame:
    """Adds ``kept``: the newest ``keep`` builds by id, and the current one."""
    nth = F.row_number().over(Window.orderBy(F.desc("build_id")))
    return builds.withColumn("kept", (nth <= keep) | (current if current is not None else F.lit(False)))


def admitted(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Claims with ``codes``: what makes each invalid (none: it is valid)."""
    known = sections.select("section_id", F.lit(True).alias("known"))
    codes = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("statement", F.lit(""))) == "", "EMPTY_STATEMENT"),
            F.when(F.trim(F.coalesce("evidence", F.lit(""))) == "", "EMPTY_EVIDENCE"),
            F.when(F.col("known").isNull(), "SECTION_NOT_FOUND"),
        )
    )
    return claims.join(known, "section_id", "left").withColumn("codes", codes).drop("known")


def admitted_relations(relations: DataFrame) -> DataFrame:
    blank = (F.trim(F.coalesce("source", F.lit(""))) == "") | (F.trim(F.coalesce("target", F.lit(""))) == "")
    same = F.lower(F.trim("source")) == F.lower(F.trim("target"))
    return relations.withColumn("codes", F.array_compact(F.array(F.when(blank, "EMPTY_ENDPOINT"), F.when(~blank & same, "SAME_ENDPOINTS"))))


def over_rejected(admitted_claims: DataFrame, most: float = 0.10) -> DataFrame:
    """Units (unit, ratio) whose share of rejected claims is above ``most``."""
    ratio = F.avg((F.size("codes") > 0).cast("double"))
    return admitted_claims.groupBy("unit").agg(ratio.alias("ratio")).where(F.col("ratio") > most)

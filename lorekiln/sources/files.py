"""Directory scans, generations of published pages, and exports."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfc, page_file_name
from .tables import remove

# Limits of a scan and of retries when a pointer is replaced.
LARGEST, PROBE = 16 << 20, 8192
RETRIES, WAIT = 10, 0.025


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob with *, ** and ?."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "/_-" else c
            i += 1
    return f"^{out}$"


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*.md", "**/*.markdown", "**/*.mdx"), exclude: tuple[str, ...] = (), hidden: tuple[str, ...] = ()) -> DataFrame:
    """rel_path, content, size, problem (too-large, binary or null), sorted by path. Excludes win over includes; ``hidden`` folders are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(nfc(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{_quoted('/' + base.split(':')[-1].lstrip('/'))}/*", "")), r"\\", "/")
    found = files.select(rel.alias("rel_path"), "content", F.col("length").alias("size"))
    for folder in hidden:
        found = found.where(~F.col("rel_path").startswith(folder.rstrip("/") + "/"))
    for glob in exclude:
        found = found.where(~F.col("rel_path").rlike(glob_pattern(glob)))
    wanted = F.lit(False)
    for glob in include:
        wanted = wanted | F.col("rel_path").rlike(glob_pattern(glob))
    binary = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, PROBE)), "(..)", "$1 ")) > 0
    problem = F.when(F.col("size") > LARGEST, "too-large").when(binary, "binary")
    return found.where(wanted).withColumn("problem", problem).orderBy("rel_path")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in text)


def collisions(pages: DataFrame) -> DataFrame:
    """File names that two pages of a generation would share."""
    return pages.groupBy(F.lower(page_file_name(F.col("slug"), F.col("page_id"))).alias("file")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class Generations:
    """Immutable generations of pages under one folder, and the pointer to the current one.

    A generation is a partition that is written once; readers follow the pointer, which is replaced
    last and at once. A journal tells what a publication had in mind if it breaks off.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, build_id: str) -> str:
        return f"{self.root}/generations/build_id={build_id}"

    @property
    def _pointer(self) -> str:
        return f"{self.root}/current.json"

    @property
    def _journal(self) -> str:
        return f"{self.root}/journal.json"

    def current(self) -> str | None:
        return (_read_json(self.spark, self._pointer) or {}).get("build_id")

    def write(self, pages: DataFrame, build_id: str) -> None:
        """Pages (page_id, title, content, body_hash). Names that collide are refused before anything is written."""
        if not collisions(pages).isEmpty():
            raise ValueError("pages share a file name")
        pages.withColumn("file", page_file_name(F.col("slug"), F.col("page_id"))).write.mode("errorifexists").parquet(self.path(build_id))

    def read(self, build_id: str | None = None) -> DataFrame:
        build_id = build_id or self.current()
        if build_id is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(self.path(build_id))

    def invalid(self, build_id: str) -> DataFrame:
        """Pages whose content is empty or not what its hash says."""
        return self.read(build_id).where((F.length("content") == 0) | (F.sha2("content", 256) != F.col("body_hash")))

    def publish(self, pages: DataFrame, build_id: str) -> None:
        before = self.current()
        _write_json(self.spark, self._journal, {"build_id": build_id, "before": before})
        self.write(pages, build_id)
        if not self.invalid(build_id).isEmpty():
            raise ValueError("a page is not what its hash says")
        _write_json(self.spark, self._pointer, {"build_id": build_id})
        remove(self.spark, self._journal)

    def recover(self) -> str:
        """After a publication broke off: 'clean', 'forward' if the pointer had moved, else 'back'."""
        journal = _read_json(self.spark, self._journal)
        if journal is None:
            return "clean"
        if self.current() == journal["build_id"]:
            outcome = "forward"
        else:
            remove(self.spark, self.path(journal["build_id"]))
            outcome = "back"
        remove(self.spark, self._journal)
        return outcome


def _at(spark: SparkSession, path: str):
    """A path and the file system that holds it, whichever that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_json(spark: SparkSession, path: str) -> dict | None:
    at, system = _at(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside and renamed over, so readers see the old or the new one."""
    jvm = spark.sparkContext._jvm
    beside, system = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(beside)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    at, _ = _at(spark, path)
    modes = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = next(m for m in modes if m.name() == "OVERWRITE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    for attempt in range(RETRIES):
        try:
            context.rename(system.makeQualified(beside), system.makeQualified(at), over)
            return
        except Py4JJavaError:
            if attempt == RETRIES - 1:
                raise
            time.sleep(WAIT)


def export(pages: DataFrame, links: DataFrame, citations: DataFrame) -> DataFrame:
    """A JSON object for each page with its links and citations, for a static browser."""
    out = links.groupBy("page_id").agg(F.array_sort(F.collect_set("target")).alias("links"))
    cited = citations.groupBy("page_id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))
    joined = pages.join(out, "page_id", "left").join(cited, "page_id", "left")
    return joined.select("page_id", F.to_json(F.struct("slug", "title", "category", "content", F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.coalesce(F.col("sources").cast("array<string>"), F.array().cast("array<string>")).alias("sources"))).alias("payload"))

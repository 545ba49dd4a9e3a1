"""Full-text, vector and fused retrieval.

An index is a pair of tables: postings (term, id, tf), dealt by term, and lengths (id, dl). A query
reads the postings of its terms only; what follows is a sum for each id and a top-k.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, tokens, words_of
from ..functions.vectors import cosine, norm
from ..sources.tables import written

# Fixed values of the ranking functions.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
#: Vectors and queries of a block at most.
VECTORS, QUERIES = 4096, 512
#: Rows whose words are counted together.
LOT = 1000


def index_tokens(*columns: Column) -> Column:
    """Words of all indexed columns of a row, diacritics folded."""
    return F.concat(*[tokens(F.coalesce(c, F.lit("")), fold=True) for c in columns])


def postings(rows: DataFrame, id_col: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """term, id, tf and id, dl. Terms are counted within each row's own array before anything is shuffled."""
    base = rows.select(F.col(id_col).alias("id"), words.alias("words"))
    lengths = base.select("id", F.size("words").cast("long").alias("dl"))
    exploded = base.select("id", F.explode("words").alias("term"))
    return exploded.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf")), lengths


def bm25(rows: DataFrame, id_col: str, words: Column, query: str, k: int | None = None) -> DataFrame:
    """id, score of rows that hold any word of the query; the best ``k``, ties by id.

    Rows are tokenised once: their lengths and the query terms' counts, a few numbers for each row, are written.
    """
    spark = rows.sparkSession
    terms = spark.range(1).select(query_terms(F.lit(query), fold=True).alias("t")).first()["t"]
    if not terms:
        return rows.sparkSession.createDataFrame([], f"{id_col} {dict(rows.dtypes)[id_col]}, score double")
    base = rows.select(F.col(id_col).alias("id"), words.alias("words"))
    # each word is looked at once; what is left is few
    base = base.select("id", F.size("words").cast("long").alias("dl"), F.filter("words", lambda w: w.isin(terms)).alias("asked"))
    counted = written(base.select("id", "dl", *[(F.size("asked") - F.size(F.array_remove("asked", t))).alias(f"tf{i}") for i, t in enumerate(terms)]), "term-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    scored = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}").cast("double")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))).otherwise(0.0)
    found = scored.select(F.col("id").alias(id_col), score.alias("score"))
    return found if k is None else found.orderBy(F.desc("score"), id_col).limit(k)


def search_postings(posting: DataFrame, lengths: DataFrame, query: str, k: int) -> DataFrame:
    """As ``bm25``, from a stored index: only the query terms' postings are read and joined with their lengths."""
    terms = posting.sparkSession.range(1).select(query_terms(F.lit(query), fold=True).alias("t")).first()["t"]
    terms = terms or [""]
    hits = posting.where(F.col("term").isin(terms))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("mean"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has terms
    joined = hits.join(F.broadcast(df), "term").join(lengths, "id").join(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return _summed(joined, part, terms).orderBy(F.desc("score"), "id").limit(k)


def _summed(hits: DataFrame, part: Column, terms: list[str]) -> DataFrame:
    """id, score: parts are added in the order of the query's terms, as ``bm25`` adds them, so that equal rows score the same to the last bit."""
    parts = hits.groupBy("id").agg(*[F.sum(F.when(F.col("term") == t, part)).alias(f"part{i}") for i, t in enumerate(terms)])
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.coalesce(f"part{i}", F.lit(0.0))
    return parts.select("id", score.alias("score"))


#: Buckets by a hash of the term that a stored index is dealt to, and parts of each, so that a frequent word fills no one task.
BUCKETS, PARTS = 32, 8
_POSTING = "term", "id", "tf", "dl"


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


#: The bucket of lengths: a row without a term for each id.
LENGTHS = -1
#: Ids that an update sends to all postings at most; more are joined by a shuffle.
TOUCHED = 1_000_000


def _counted(rows: DataFrame, id_col: str, words: Column) -> DataFrame:
    """term, id, tf, dl, and a row without a term for each id. A row's words are counted where it is read, so nothing is shuffled."""
    kind = dict(rows.dtypes)[id_col]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, LOT):
                batch = whole.slice(start, LOT)
                ids, lists = batch.column("id"), batch.column("words")
                dl = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                codes = lists.flatten().dictionary_encode()
                pairs, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * max(1, len(codes.dictionary)) + codes.indices.to_numpy(), return_counts=True)
                row, term = np.divmod(pairs, max(1, len(codes.dictionary)))
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(term)).cast(pa.string()), ids.take(pa.array(row)), pa.array(tf.astype(np.int64)), pa.array(dl[row])], ["term", "id", "tf", "dl"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(dl), pa.string()), ids, pa.array(np.zeros(len(dl), np.int64)), pa.array(dl)], ["term", "id", "tf", "dl"])

    base = rows.select(F.col(id_col).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    return base.mapInArrow(part, f"term string, id {kind}, tf long, dl long")


def _dealt(posting: DataFrame) -> DataFrame:
    return posting.select(*_POSTING, F.coalesce(_bucket(F.col("term")), F.lit(LENGTHS)).alias("bucket"))


def store_index(rows: DataFrame, id_col: str, words: Column, path: str) -> None:
    """Write postings (term, id, tf, dl) by bucket, lengths (id, dl) as a bucket of their own, and a row of statistics.

    ``rows`` are a generation's sections; what a query needs beyond its terms' postings is that row.
    """
    _write_postings(_counted(rows, id_col, words), path, "overwrite")
    _write_statistics(rows.sparkSession, path, dict(rows.dtypes)[id_col])


def _write_postings(posting: DataFrame, path: str, mode: str) -> None:
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    _dealt(posting).repartition("bucket", part).sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")


def _write_statistics(spark: SparkSession, path: str, kind: str) -> None:
    lengths = stored_lengths(spark, path, kind)
    lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("mean"), F.first(F.lit(kind)).alias("kind")).write.mode("overwrite").parquet(f"{path}/statistics")


def stored_lengths(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """id, dl of a stored index."""
    return _stored_postings(spark, path, kind).where(F.col("bucket") == LENGTHS).select("id", "dl")


def _statistics(spark: SparkSession, path: str) -> Row:
    """n, mean, kind (the type of id) of a stored index: one row."""
    return spark.read.schema("n long, mean double, kind string").parquet(f"{path}/statistics").first()


def _stored_postings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The schema is given, for an index without words has no files."""
    return spark.read.schema(f"term string, id {kind}, tf long, dl long, bucket int").parquet(f"{path}/postings")


def search_stored(spark: SparkSession, path: str, query: str, k: int) -> DataFrame:
    """As ``bm25``, from a stored index: the buckets of the query's terms are read, one aggregation follows."""
    terms = list(dict.fromkeys(words_of(query, fold=True))) or [""]
    known = _statistics(spark, path)
    hits = _stored_postings(spark, path, known["kind"] or "string").where(F.col("bucket").isin([zlib.crc32(t.encode()) % BUCKETS for t in terms]) & F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has terms
    idf = F.greatest(F.log((F.lit(float(known["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(known["mean"] or 1.0)))
    return _summed(hits.join(F.broadcast(df), "term"), part, terms).orderBy(F.desc("score"), "id").limit(k)


def update_index(spark: SparkSession, path: str, changed: DataFrame, gone: DataFrame, id_col: str, words: Column, to: str) -> None:
    """Write the index at ``path`` anew with rows that changed or came (``changed``) and without those of ``gone`` (id).

    Postings of all other rows are carried over; only changed rows are tokenised.
    """
    kind = _statistics(spark, path)["kind"] or "string"
    touched = gone.select("id").union(changed.select(id_col)).distinct()
    few = touched.limit(TOUCHED + 1).count() <= TOUCHED
    carried = _stored_postings(spark, path, kind).join(F.broadcast(touched) if few else touched, "id", "left_anti").select(*_POSTING, "bucket")
    if few:  # they lie in their buckets' files already
        carried.write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/postings")
    else:
        _write_postings(carried, to, "overwrite")
    _write_postings(_counted(changed, id_col, words), to, "append")
    _write_statistics(spark, to, kind)


def index_drift(lengths: DataFrame, active: DataFrame) -> DataFrame:
    """missing, surplus, matches: ids of the active generation that the index lacks, and of the index that are not active."""
    both = lengths.select("id", F.lit(1).alias("indexed")).join(active.select("id", F.lit(1).alias("active")), "id", "full_outer")
    counted = both.agg(F.count(F.when(F.col("indexed").isNull(), 1)).alias("missing"), F.count(F.when(F.col("active").isNull(), 1)).alias("surplus"))
    return counted.withColumn("matches", (F.col("missing") == 0) & (F.col("surplus") == 0))


def exact_match(query: str, *columns: Column) -> Column:
    """Whether all words of the query are among the columns' words; never for an empty query."""
    wanted = query_terms(F.lit(query))
    words = F.concat(*[tokens(F.coalesce(c, F.lit(""))) for c in columns])
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, words)) == 0)


def ranked(hits: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``rank`` from 0. ``hits`` is a top-k list: bounded by its limit."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def reciprocal(rank: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(float(RRF_K)) + F.col(rank) if isinstance(rank, str) else F.lit(float(RRF_K)) + rank)


def fuse(source: DataFrame, wiki: DataFrame) -> DataFrame:
    """Source and wiki hits (locator, rank, exact) in one order: exact first, then score, wiki before source, locator.

    Kinds are never merged with each other.
    """
    both = source.select("locator", "rank", "exact", F.lit("source").alias("kind")).unionByName(wiki.select("locator", "rank", F.lit(False).alias("exact"), F.lit("wiki").alias("kind")))
    scored = both.select("kind", "locator", "exact", reciprocal("rank").alias("score"))
    return ranked(scored, F.desc("exact"), F.desc("score"), F.when(F.col("kind") == "wiki", 0).otherwise(1), "locator")


def fuse_sum(lexical: DataFrame, vector: DataFrame, key: list[str]) -> DataFrame:
    """key, score: sum of reciprocal ranks over both lists. Of a key that a list repeats, its worst rank counts."""
    a = lexical.groupBy(*key).agg(F.max("rank").alias("lexical_rank"))
    b = vector.groupBy(*key).agg(F.max("rank").alias("vector_rank"))
    joined = a.join(b, key, "full_outer")
    return joined.select(*key, (F.coalesce(reciprocal("lexical_rank"), F.lit(0.0)) + F.coalesce(reciprocal("vector_rank"), F.lit(0.0))).alias("score"))


def vector_top_k(vectors: DataFrame, query: list[float], k: int = 8, id_col: str = "text_hash", vector_col: str = "embedding") -> DataFrame:
    """id, score of the ``k`` nearest by cosine, ties by id. A query of another width or without length scores 0 everywhere."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col), cosine(F.col(vector_col), literal).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def _blocks(vectors: DataFrame, most: int, id_col: str, vector_col: str) -> DataFrame:
    """width, ids, data: packed vectors of one width each, sorted by id. Vectors with nulls have width -1, as nothing is like them."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in batches:
            for width, own in group.sort_values("id").groupby("width"):
                for i in range(0, len(own), most):
                    some = own.iloc[i : i + most]
                    data = np.stack(some["v"].to_numpy()).astype("<f4").tobytes() if width > 0 else b""
                    yield pd.DataFrame({"width": [width], "ids": [some["id"].to_numpy("<i8").tobytes()], "data": [data]})

    v = F.col(vector_col)
    width = F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), -1).otherwise(F.size(v))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), width.alias("width")).mapInPandas(part, "width int, ids binary, data binary")


def vector_top_k_all(vectors: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: for each query row the ``k`` nearest of all vectors by cosine (to nine places), ties by id.

    Exact: every block of queries meets every block of vectors, and each pair of blocks gives ``k`` for a query at most.
    """
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _blocks(queries, QUERIES, id_col, vector_col).toDF("query_width", "query_ids", "query_data")
    pairs = _blocks(vectors, VECTORS, id_col, vector_col).repartition(partitions).crossJoin(left)

    def unit(data: bytes, width: int) -> np.ndarray:
        rows = np.frombuffer(data, "<f4").reshape(-1, width).astype(np.float64)
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return np.divide(rows, norms, out=np.zeros_like(rows), where=norms != 0)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in batches:
            for row in group.itertuples():
                ids, asked = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.query_ids, "<i8")
                scores = np.zeros((len(asked), len(ids)))
                if row.width == row.query_width > 0:
                    scores = np.round(unit(row.query_data, row.width) @ unit(row.data, row.width).T, 9) + 0.0  # no negative zero
                order = np.where(np.isnan(scores), np.inf, scores)  # as Spark sorts them
                least = np.partition(order, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                best = [np.flatnonzero(o >= low) for o, low in zip(order, least, strict=True)]
                best = [at[np.argsort(-o[at], kind="stable")[:k]] for o, at in zip(order, best, strict=True)]
                n, at = [len(x) for x in best], np.concatenate(best)
                yield pd.DataFrame({"query_id": np.repeat(asked, n), "id": ids[at], "score": scores[np.repeat(np.arange(len(asked)), n), at]})

    found = pairs.mapInPandas(nearest, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1
    return found.withColumn("rank", place).where(F.col("rank") < k)


def with_norm(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """A vector table that stores norms, so queries need not compute them."""
    return vectors.withColumn("norm", norm(F.col(vector_col)))


def missing_embeddings(sections: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Distinct text_hashes of sections that have no vector of the model."""
    have = stored.where(F.col("model") == model).select("text_hash")
    return sections.select("text_hash").distinct().join(have, "text_hash", "left_anti")


def reranked(hits: DataFrame, order: DataFrame, key: str, keep_unknown: bool = True) -> DataFrame:
    """Hits in a reranker's order (key, place); unknown keys last by score, or left out."""
    joined = hits.join(order.select(key, "place"), key, "left" if keep_unknown else "inner")
    return ranked(joined, F.col("place").asc_nulls_last(), F.desc("score"), key).drop("place")


def side_status(disabled: Column, published: Column, built: Column, hits: Column) -> Column:
    """Why a side of a fused search answers as it does; the first reason that holds."""
    return F.when(disabled, "disabled").when(~published, "not_published").when(~built, "index_not_built").when(hits == 0, "no_matches").otherwise("served")


def fuse_levels(lexical: DataFrame, vector: DataFrame, source: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Candidates of a context from both sides (kind, locator, exact, score, rank), fused twice.

    First wiki hits (locator, rank) of the lexical and the vector list, by the sum of reciprocal ranks, and in a reranker's order
    (locator, place) if there is one; source hits (locator, rank, exact) go exact ones first. Then both lists by their places.
    """
    summed = fuse_sum(lexical, vector, ["locator"])
    wiki = ranked(summed, F.desc("score"), "locator") if order is None else reranked(summed, order, "locator")
    places = ranked(source.select("locator", "exact", F.col("rank").alias("side")), F.desc("exact"), "side", "locator")
    return fuse(places.select("locator", "rank", "exact"), wiki.select("locator", "rank"))

"""Token counts through a digest cache.

A text is known by the digest of its normalised content (UTF-8, null as empty; nothing else
is changed, since any change could change the count) together with the digest of the
tokenizer's file and the library's version. Counts of known texts come from the cache by a
join; only distinct texts that it lacks are encoded, once each, and appended to it.

Defined results: a null text counts as empty and has no tokens; copies and repeated rows
each get their text's count; an empty table gives an empty result. The cache may hold a
digest twice if two runs append at a time; both rows agree, and reading drops one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import digest_of, lookup, new_path, text_of, written

CACHE = "digest binary, tokenizer string, n_bytes long, n_tokens long"
_known: dict = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        body = f.read()
    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    return hashlib.sha256(body + version.encode()).hexdigest()


def counter(path: str):
    """A function from texts to token counts, as the library of the file's kind gives them."""
    if path in _known:
        return _known[path]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def count(texts: list[str]) -> list[int]:
            return [len(model.encode(x, num_threads=1)) for x in texts]
    else:
        import tokenizers

        model = tokenizers.Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()

        def count(texts: list[str]) -> list[int]:
            return [len(model.encode(x, add_special_tokens=False).ids) for x in texts]

    return _known.setdefault(path, count)


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).dropDuplicates(["digest"])


def fill_cache(docs: DataFrame, model: str, cache: str, text_col: str = "text") -> None:
    """Encode what the cache lacks and append it. Distinct contents are found with map-side combining, so hot copies never meet."""
    spark, tokenizer = docs.sparkSession, tokenizer_version(model)
    text = text_of(text_col)
    contents = docs.select(digest_of(text).alias("digest"), text.alias("text")).distinct()
    misses = contents.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(model)
        for rows in batches:
            texts = rows["text"].tolist()
            yield pd.DataFrame({"digest": rows["digest"], "tokenizer": tokenizer, "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "n_tokens": count(texts)})

    misses.mapInPandas(part, CACHE).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, model: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. Without ``cache`` a new one serves this call alone."""
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-counts")
    fill_cache(docs, model, cache, text_col)
    known = read_cache(spark, cache, tokenizer_version(model))
    rows = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), digest_of(text_of(text_col)).alias("digest")), "token-digests")
    found = lookup(rows, known, "digest", ["n_bytes", "n_tokens"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

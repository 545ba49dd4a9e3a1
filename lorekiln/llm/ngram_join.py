"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. Each shingle flips one bit of a sketch, so two
sketches differ in at most as many bits as their sets have elements that are not shared. Sizes of linked sets
differ by a bounded ratio; documents meet in joint bands of two neighbouring size bands. In a
band at most D elements can differ, so of the parts of two linked sketches at most D are unlike (pigeonhole).

1. Keys. A part travels as a 64-bit digest. Parts are counted over the corpus and ordered by rising
   count. The D + 1 rarest parts of one sketch have one in common with the D + 1 rarest of any
   linked one, whatever the other parts are. A document of which more than D parts occur nowhere else
   thus has no link, and parts that many documents hold in common are hardly ever keys.
2. Distances. Within a key's bucket, each member's sketch is held against that of one centre; only pairs whose
   sketches differ in no more bits than linked sets can, and whose sizes allow a link, are near. Buckets that
   this doesn't settle (members neither all near the centre nor all of one component) are
   dealt to cells of bounded size, and there all members that are in different components are held against each other.
3. Verification. Components of near pairs are blocks. Any link lies within a block, and blocks are verified with
   exact sets: a centre's overlap with all members is one vector operation, and centres are taken
   until those that have not been centres are of one component. Blocks beyond a task's
   bounds are dealt to chunks, and rounds of centres go to all chunks until the same holds.

Equal sets are one class, which its smallest uid represents. No step gathers a bucket or a block
of unbounded size in one task, and none makes a row for each pair of a group.

Defined results: null or wordless texts have no shingles and link with nothing, not even each
other; a text of fewer words than a shingle has one element. Rows that repeat a doc_id, or have
none, count as documents of their own in the order of doc_id (null last) and text. Empty tables
give empty results. Extra columns, whatever their names, neither matter nor change.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .sequences import bucket_count, in_batches, windows_of
from .shared import discard, fresh, lookup, mixed, numbered, odd_numbers, release_shuffles, rolling, text_bytes, text_of, word_hashes, written

SHINGLE = 3
THRESHOLD = 90
PART_BITS = 1024
#: Parts of a sketch for each element in which linked sets can differ.
SPARE = 1.6
#: Bytes of text whose keys one bucket counts.
BUCKET_BYTES = 8 << 20
#: Words of documents whose keys are combined before they are sent; with BUCKET_BYTES it bounds a Python worker's memory.
BATCH_WORDS = 400_000
#: Bits of the sketches that are held against each other, for each element, at least.
BITS = 4
#: Members of a bucket that one cell compares with another such number.
CELL = 1_000
#: Elements of sets that one task verifies at a time; a block of more than BLOCK is dealt to chunks of as many.
LOT = 2_000_000
BLOCK = 1_000_000
#: Centres of a large block in the first round; each round takes four times as many.
CENTRES = 64


def _words():
    return lambda texts: word_hashes(texts, lower=True)


def shingle_sets(units: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a batch: hash and document's number, in order of document."""
    key, doc, _ = windows_of(units, width, 20)
    short = [(rolling(x, len(x), 20 + len(x))[0], i) for i, x in enumerate(units) if 0 < len(x) < width]
    if short:
        key = np.concatenate([key, np.array([k for k, _ in short], np.uint64)])
        doc = np.concatenate([doc, np.array([i for _, i in short], np.int32)])
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(units) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        key[a:b].sort()
    first = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)]
    return key[first], doc[first]


@lru_cache
def bands(threshold: int) -> np.ndarray:
    """Smallest sizes of the size bands: linked sets lie in the same or in neighbouring bands."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(100 * low[-1] // threshold + 1)
    return np.array(low, np.int64)


def joints_of(sizes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For both joint bands of sets: the joint band, its parts, and in how many elements a set can differ from what it links with there.

    In joint band j, sets of band j meet each other and those of band j + 1. From 100 I >= t U and
    U = a + b - I follows a + b - 2 I <= (a + b)(100 - t) / (100 + t), where b <= 100 a / t. Sets that
    can link with equal sets only have no parts.
    """
    low = bands(threshold)
    band = np.searchsorted(low, np.maximum(sizes, 1), "right") - 1
    for joint in (band, band - 1):
        top = low[joint + 1] - 1
        differ = sizes * (100 - threshold) // threshold
        if joint is not band:
            differ = np.minimum(differ, (sizes + top) * (100 - threshold) // (100 + threshold))
        yield joint, np.where((differ > 0) & (joint >= 0), parts_of(joint, threshold), 0), differ


def parts_of(joint: np.ndarray, threshold: int) -> np.ndarray:
    """Parts of a joint band, more than elements of linked sets in it can differ by."""
    low = bands(threshold)
    top, next_top = low[joint + 1] - 1, low[joint + 2] - 1
    most = np.maximum(top * (100 - threshold) // threshold, (top + next_top) * (100 - threshold) // (100 + threshold))
    return np.maximum(most + 1, (SPARE * most).astype(np.int64))


def part_keys(key: np.ndarray, doc: np.ndarray, sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the parts of documents' sketches in both joint bands, their documents, and either slack of each document.

    The last bit of a digest is that of its joint band's number, and so is the place of a slack. Slack is how many of
    these digests may be left out, the most frequent ones: the others are one more than a
    linked set can differ in. Empty parts come last in any order and are given only where others are too few.
    """
    digests, docs, slack = [], [], np.zeros((len(sizes), 2), np.int64)
    for joint, parts, most in joints_of(sizes, threshold):
        offset = np.cumsum(parts) - parts
        salt = mixed(joint.astype(np.uint64) * odd_numbers(1, 31)[0])
        own = parts[doc] > 0
        element, holder = key[own], doc[own]
        bit = mixed(element ^ salt[holder]) % (parts[holder].astype(np.uint64) * np.uint64(PART_BITS))
        digest = np.zeros(int(parts.sum()), np.uint64)
        np.bitwise_xor.at(digest, offset[holder] + (bit // np.uint64(PART_BITS)).astype(np.int64), mixed(bit ^ odd_numbers(1, 32)[0]))
        filled, holder = digest != 0, np.repeat(np.arange(len(sizes)), parts)
        lacking = np.maximum(most + 1 - np.bincount(holder, filled, len(sizes)).astype(np.int64), 0)
        empties = np.cumsum(~filled)
        nth = empties - np.repeat(np.r_[0, empties][offset], parts)
        given = filled | (nth <= lacking[holder])
        number = np.arange(len(digest)) - np.repeat(offset, parts)
        digest = mixed(digest ^ mixed(np.repeat(salt, parts) + number.astype(np.uint64) * odd_numbers(1, 33)[0]))
        parity = (joint & 1).astype(np.uint64)
        digests.append((digest[given] & ~np.uint64(1)) | parity[holder[given]])
        docs.append(holder[given])
        some = np.flatnonzero(parts)
        slack[some, joint[some] & 1] = np.bincount(docs[-1], minlength=len(sizes))[some] - most[some] - 1
    return np.concatenate(digests), np.concatenate(docs), slack


def sketches(key: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 bits, and how many each document has: a power of two, with BITS bits for each element or more (none for none).

    A sketch of half as many words is the XOR of a sketch's halves.
    """
    words = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(BITS * sizes / 64, 1))).astype(np.int64), 0)
    offset = np.cumsum(words) - words
    bit = mixed(key ^ odd_numbers(1, 34)[0])
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, offset[doc] + ((bit >> np.uint64(6)).astype(np.int64) & (words[doc] - 1)), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64), words


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


SETS = "uid long, n long, class binary, sketch array<long>, slack array<int>, repeated array<long>"
PACKED = "bucket int, keys binary, docs binary, counts binary, repeats binary, times binary"


def packed(digest: np.ndarray, doc: np.ndarray, uids: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple]]:
    """Which of a batch's digests occur in it repeatedly, and its rows of PACKED for ``n`` buckets.

    A digest that one document has travels with it; documents are given once for all of their digests of a
    bucket. One that several have travels once, with their number.
    """
    order = np.argsort(digest)
    ranked = digest[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(digest) else np.empty(0, np.int64)
    held = np.diff(np.r_[starts, len(digest)])
    repeated = np.zeros(len(digest), bool)
    repeated[order[np.repeat(held > 1, held)]] = True
    lone, many = np.flatnonzero(~repeated), order[starts[held > 1]]
    place = ((digest >> np.uint64(1)) % np.uint64(n)).astype(np.int64)
    lone, times = lone[np.argsort(place[lone] * len(uids) + doc[lone])], held[held > 1]
    turn = np.argsort(place[many])
    many, times = many[turn], times[turn]
    low, low_many = (np.searchsorted(place[at], np.arange(n + 1)) for at in (lone, many))
    rows = []
    for b in np.flatnonzero((np.diff(low) > 0) | (np.diff(low_many) > 0)).tolist():
        own, others = lone[low[b] : low[b + 1]], slice(low_many[b], low_many[b + 1])
        holders, counts = np.unique(doc[own], return_counts=True)
        rows.append((b, digest[own].tobytes(), uids[holders].tobytes(), counts.astype("<u4").tobytes(), digest[many[others]].tobytes(), times[others].astype("<u4").tobytes()))
    return repeated, rows


def features(rows: DataFrame, width: int, threshold: int, n_buckets: int) -> DataFrame:
    """Rows of SETS, one for each document, and of PACKED, one for each bucket of a batch.

    n is the size of the set, class 128 bits that equal sets share, ``repeated`` those keys that other documents of the
    batch have too. Of equal sets in a batch only the first has a sketch and keys.
    """
    names = [x.split()[0] for x in f"{SETS}, {PACKED}".split(", ")]
    kinds = {"uid": pa.int64(), "n": pa.int64(), "class": pa.binary(), "sketch": pa.list_(pa.int64()), "slack": pa.list_(pa.int32()), "repeated": pa.list_(pa.int64()), "bucket": pa.int32()}

    def table(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(n, kinds.get(x, pa.binary()))) for x in names], names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = odd_numbers(2, 30)
        for uids, units, _ in in_batches((b.to_pandas() for b in batches), _words(), most=BATCH_WORDS):
            turn = np.argsort(uids, kind="stable")
            uids, units = uids[turn], [units[i] for i in turn]
            key, doc = shingle_sets(units, width)
            sizes = np.bincount(doc, minlength=len(units)).astype(np.int64)
            sums = np.zeros((len(units), 2), np.uint64)
            full = sizes > 0
            if full.any():
                starts = (np.cumsum(sizes) - sizes)[full]
                sums[full, 0], sums[full, 1] = np.add.reduceat(mixed(key ^ one), starts), np.add.reduceat(mixed(key ^ two), starts)
            leads = np.zeros(len(units), bool)
            leads[np.unique(sums, axis=0, return_index=True)[1]] = True
            leads &= full
            own = leads[doc]
            key, doc, led = key[own], doc[own], np.where(leads, sizes, 0)
            bits, words = sketches(key, doc, led)
            digest, holder, slack = part_keys(key, doc, led, threshold)
            again, out = packed(digest, holder, uids, n_buckets)
            at = np.flatnonzero(again)[np.argsort(holder[again], kind="stable")]
            repeated = _lists(digest[at].view(np.int64), np.bincount(holder[at], minlength=len(uids)))
            slacks = _lists(slack.astype(np.int32).ravel(), np.full(len(uids), 2))
            yield table({"uid": pa.array(uids), "n": pa.array(sizes), "class": pa.array([x.tobytes() for x in sums], pa.binary()), "sketch": _lists(bits, words), "slack": slacks, "repeated": repeated})
            if out:
                yield table({x: pa.array(c, kinds.get(x, pa.binary())) for x, c in zip(names[6:], zip(*out, strict=True), strict=True)})

    return rows.select("uid", "text").mapInArrow(part, f"{SETS}, {PACKED}")


def counted(rows: pd.DataFrame) -> pd.DataFrame:
    """key, times, uid of the keys of one bucket that occur more than once; uid is null where a batch holds the key repeatedly."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in rows[name]]
    uid = np.concatenate([np.repeat(d, c) for d, c in zip(read("docs", "<i8"), read("counts", "<u4"), strict=True)])
    key, repeats = np.concatenate(read("keys", "<u8")), np.concatenate(read("repeats", "<u8"))
    both = np.concatenate([key, repeats])
    order = np.argsort(both)
    ranked = both[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    held = np.concatenate([np.ones(len(key), np.int64), np.concatenate(read("times", "<u4")).astype(np.int64)])
    total, n = np.add.reduceat(held[order], starts), np.diff(np.r_[starts, len(both)])
    total = np.repeat(total, n)
    at = order[total > 1]
    lone = at < len(key)
    holder = pd.Series(np.where(lone, np.r_[uid, 0][np.where(lone, at, len(key))], 0), dtype="Int64").mask(~lone)
    return pd.DataFrame({"key": both[at].view(np.int64), "times": total[total > 1], "uid": holder})


def buckets(found: DataFrame, classes: DataFrame) -> DataFrame:
    """key, uid: the keys by which representatives meet.

    Batches have combined their own keys, so a key's bucket gets one entry for each batch at most. Counts go back to
    what is repeated within a batch by a join whose skew Spark can split.
    """
    sets = found.where("uid IS NOT NULL")
    shared = written(found.where("bucket IS NOT NULL").select(*[x.split()[0] for x in PACKED.split(", ")]).groupBy("bucket").applyInPandas(counted, "key long, times long, uid long"), "ngram-shared")
    release_shuffles(found.sparkSession)
    of_batches = shared.where("uid IS NULL").groupBy("key").agg(F.max("times").alias("times"))
    within = sets.select("uid", F.explode("repeated").alias("key")).join(of_batches, "key")
    pairs = shared.where("uid IS NOT NULL").unionByName(within)
    ranked = pairs.groupBy("uid", F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("side")).agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("keys"))
    ranked = ranked.join(sets.where("size(sketch) > 0").select("uid", "slack"), "uid").withColumn("most", F.size("keys") - F.get("slack", F.col("side")))
    rarest = ranked.where("most > 0").select("uid", F.explode(F.slice("keys", F.lit(1), F.col("most"))["key"]).alias("key"))
    moved = sets.where("size(sketch) > 0").join(classes, "class").where("uid <> rep").select("uid", "rep")
    members = written(rarest.join(moved, "uid", "left").select("key", F.coalesce("rep", "uid").alias("uid")).distinct(), "ngram-members")
    discard(shared)
    release_shuffles(found.sparkSession)
    return members


def _distance(a: Column, b: Column, folds: int) -> Column:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    short = F.least(F.size(a), F.size(b))

    def word(x: Column, i: Column) -> Column:
        out = F.get(x, i)
        for k in range(1, folds):
            out = out.bitwiseXOR(F.coalesce(F.get(x, i + short * k), F.lit(0).cast("long")))
        return out

    bits = F.transform(F.sequence(F.lit(0), short - 1), lambda i: F.bit_count(word(a, i).bitwiseXOR(word(b, i))))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def near(edges: DataFrame, sketched: DataFrame, threshold: int) -> DataFrame:
    """Those edges (a, b) whose sizes and sketches (uid, n, sketch) allow a link."""
    folds = 1
    while folds * threshold < 200:
        folds *= 2
    of = lambda x: sketched.select(F.col("uid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    pairs = edges.join(of("a"), "a").join(of("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold)
    return pairs.where(_distance(F.col("s_a"), F.col("s_b"), folds) * (100 + threshold) <= (F.col("n_a") + F.col("n_b")) * (100 - threshold)).select("a", "b")


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def compared(uid: np.ndarray, n: np.ndarray, half: np.ndarray, label: np.ndarray, sketch: list[np.ndarray], threshold: int) -> tuple[list, list]:
    """Ends of edges that join the components of a cell's members whose sketches are near.

    Members of half 0 meet members of half 1; in a cell of one half (-1) all members meet. Members of the most frequent
    component need no centre: their pairs with all others are met from the other end.
    """
    words = min(len(x) for x in sketch)
    bits = np.stack([x if len(x) == words else _fold(x, words) for x in sketch])
    _, label, crowd = np.unique(label, return_inverse=True, return_counts=True)
    common = label == np.argmax(crowd)
    a, b = [], []
    for i in np.flatnonzero(~common):
        rest = np.flatnonzero((label != label[i]) & ((half < 0) | (half != half[i])))
        if not len(rest):
            continue
        rest = rest[np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * threshold]
        apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
        close = rest[apart * (100 + threshold) <= (n[rest] + n[i]) * (100 - threshold)]
        for x in np.unique(label[close]):
            b.append(uid[close[np.argmax(label[close] == x)]])
            a.append(uid[i])
            label[label == x] = label[i]
    return a, b


def cell_edges(lot: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Edges (a, b) of the cells (key, i, j) of a lot."""
    turn = np.lexsort((lot["uid"], lot["j"], lot["i"], lot["key"]))
    uid, n, half, label, key, i, j = (lot[x].to_numpy()[turn] for x in ("uid", "n", "half", "label", "key", "i", "j"))
    sketch = [np.asarray(x, np.int64).view(np.uint64) for x in lot["sketch"].to_numpy()[turn]]
    edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
    a, b = [], []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        own = slice(low, high)
        more = compared(uid[own], n[own], half[own], label[own], sketch[own], threshold)
        a += more[0]
        b += more[1]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def unsettled(members: DataFrame, centres: DataFrame, labels: DataFrame) -> DataFrame:
    """key, uid, label of the members, but for the centres, of buckets in which these are not all of one component.

    Of buckets with the same members one is enough.
    """
    rest = members.join(centres, "key").where("uid <> centre").join(labels, "uid", "left").select("key", "uid", F.coalesce("label", "uid").alias("label"))
    mark = F.xxhash64("uid", F.lit(7)).cast("decimal(38,0)")
    sums = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("uid").alias("sum"), F.sum(mark).alias("marks"))
    open_ = sums.where("low < high").groupBy("low", "high", "size", "sum", "marks").agg(F.min("key").alias("key"))
    return rest.join(open_.select("key", "size"), "key")


def cells(rest: DataFrame, sketched: DataFrame, threshold: int) -> DataFrame:
    """Edges between near members of different components of the buckets ``rest`` (key, uid, label, size).

    A bucket of more than CELL members is dealt to k parts and each two parts, and each part alone, are a
    cell, so that a cell has a bounded size and a member goes to k of them. Cells go to lots of bounded mean size.
    """
    lots = (rest.agg(F.sum(F.ceil(F.col("size") / CELL))).first()[0] or 0) // (20 * CELL) + 1
    k = F.ceil(F.col("size") / CELL).cast("int")
    dealt = rest.join(sketched, "uid").withColumn("k", k).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("k")).cast("int"))
    placed = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    half = F.when(F.col("part") == F.col("other"), -1).when(F.col("part") < F.col("other"), 0).otherwise(1)
    placed = placed.select("key", low.alias("i"), high.alias("j"), half.alias("half"), "uid", "n", "label", "sketch")
    lot = F.pmod(F.xxhash64("key", "i", "j"), F.lit(int(lots))).alias("lot")
    return placed.groupBy(lot).applyInPandas(lambda cells: cell_edges(cells, threshold), "a long, b long")


def sweep(flat: np.ndarray, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Labels of the components of sets that lie end to end in ``flat``.

    The next centre is of the component that has the fewest members which were none; those of one component need no comparison.
    """
    label = np.arange(len(sizes))
    starts = np.cumsum(sizes) - sizes
    values, number = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(values), np.int64)
    waiting = np.ones(len(sizes), bool)
    while True:
        at = np.flatnonzero(waiting)
        crowd = np.bincount(label[at], minlength=len(sizes))
        if (crowd > 0).sum() < 2:
            return label
        c = at[np.argmin(crowd[label[at]])]
        waiting[c] = False
        own = number[starts[c] : starts[c] + sizes[c]]
        mark[own] = 1
        shared = np.add.reduceat(mark[number], starts)
        mark[own] = 0
        linked = 100 * shared >= threshold * (sizes + sizes[c] - shared)
        joined = np.unique(label[linked])
        label = np.where(np.isin(label, joined), joined[0], label)


def _verified(blocks: DataFrame, rows: DataFrame, width: int, threshold: int) -> DataFrame:
    """uid, label of the members of blocks (uid, block, lot) that fit one task each."""

    def lot(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "uid"], ignore_index=True)
        words = _words()
        key, doc = shingle_sets(list(words(group["text"])), width)
        sizes = np.bincount(doc, minlength=len(group))
        ends = np.cumsum(sizes)
        block, uid = group["block"].to_numpy(), group["uid"].to_numpy()
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        labels = [uid[a:b][sweep(key[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], threshold)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame({"uid": uid, "label": np.concatenate(labels)})

    return rows.select("uid", "text").join(blocks.hint("merge"), "uid").groupBy("lot").applyInPandas(lot, "uid long, label long")


def _large(members: DataFrame, rows: DataFrame, width: int, threshold: int) -> DataFrame:
    """uid, label of the members (uid, block, n) of blocks that no single task could hold.

    Members lie in chunks of bounded size. Each round sends up to CENTRES members of a block,
    which have not been centres yet, to all of its chunks; links that are found join labels.
    A block is done when its members that have not been centres have one label.
    """
    total = members.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK).alias("chunks"))
    dealt = written(members.join(total, "block").select("uid", "block", F.pmod(F.xxhash64("uid"), F.col("chunks")).alias("chunk")), "large-members")
    texts = written(rows.select("uid", "text").join(dealt, "uid").select("uid", "text", "block", "chunk"), "large-texts")
    labels = written(dealt.select("uid", "block", F.col("uid").alias("label"), F.lit(False).alias("used")), "large-labels")

    def chunk(own: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        words = _words()
        key, doc = shingle_sets(list(words(own["text"])), width)
        sizes = np.bincount(doc, minlength=len(own))
        order = np.argsort(key, kind="stable")
        a, b = [], []
        for uid, text in zip(centres["uid"], centres["text"], strict=True):
            wanted, _ = shingle_sets(list(words([text])), width)
            low, high = np.searchsorted(key[order], wanted, "left"), np.searchsorted(key[order], wanted, "right")
            hits = np.concatenate([order[x:y] for x, y in zip(low, high, strict=True)]) if len(wanted) else np.empty(0, np.int64)
            shared = np.bincount(doc[hits], minlength=len(own))
            linked = np.flatnonzero(100 * shared >= threshold * (sizes + len(wanted) - shared))
            a.append(own["uid"].to_numpy()[linked])
            b.append(np.full(len(linked), uid))
        return pd.DataFrame({"a": np.concatenate(a) if a else np.empty(0, np.int64), "b": np.concatenate(b) if b else np.empty(0, np.int64)})

    most = CENTRES
    while True:
        # members of the largest components come last: most others are linked with them already
        crowd = labels.where("NOT used").groupBy("block", "label").agg(F.count(F.lit(1)).alias("crowd"))
        open_blocks = crowd.groupBy("block").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1").select("block")
        if open_blocks.isEmpty():
            discard(dealt, texts)
            return labels.select("uid", "label")
        waiting = labels.where("NOT used").join(open_blocks, "block").join(crowd, ["block", "label"])
        # the first by this order in each of as many hash ranges: no block is sorted in one task
        first = waiting.groupBy("block", F.pmod(F.xxhash64("uid"), F.lit(most)).alias("range")).agg(F.min_by("uid", F.struct("crowd", "uid")).alias("uid"))
        centres = written(first.select("block", "uid"), "large-centres")
        sent = written(texts.select("uid", "text").join(centres.select("uid", "block"), "uid").join(dealt.select("block", "chunk").distinct(), "block"), "large-sent")
        found = texts.join(open_blocks, "block").groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInPandas(chunk, "a long, b long")
        groups = connected(labels.select(F.col("uid").alias("a"), F.col("label").alias("b")).unionByName(found))
        used = centres.select("uid", F.lit(True).alias("now"))
        before = labels, centres, sent, groups
        labels = written(
            labels.join(groups.withColumnRenamed("label", "least"), "uid", "left")
            .join(used, "uid", "left")
            .select("uid", "block", F.coalesce("least", "label").alias("label"), (F.col("used") | F.coalesce("now", F.lit(False))).alias("used")),
            "large-labels",
        )
        discard(*before)
        most *= 4


def ngram_components(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that can be reached by links)."""
    return _components(numbered(docs, id_col, text_col), width, threshold)


def blocks_of(found: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """uid, block, n: components of representatives whose sketches are near."""
    members = buckets(found, classes)
    found = found.where("uid IS NOT NULL")
    sketched = found.select("uid", "n", "sketch")
    centres = written(members.groupBy("key").agg(F.min("uid").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "centre"), "ngram-centres")
    stars = members.join(centres, "key").where("uid <> centre").select(F.col("uid").alias("a"), F.col("centre").alias("b")).distinct()
    edges = written(near(stars, sketched, threshold), "ngram-near")
    labels = connected(edges)
    rest = written(unsettled(members, centres, labels), "ngram-unsettled")
    discard(members, centres)
    if not rest.isEmpty():
        more = written(cells(rest, sketched, threshold), "ngram-cells")
        both = written(edges.unionByName(more).distinct(), "ngram-near")
        discard(labels, edges, more)
        edges, labels = both, connected(both)
    discard(edges, rest)
    blocks = written(labels.withColumnRenamed("label", "block").join(found.select("uid", "n"), "uid"), "ngram-blocks")
    discard(labels)
    release_shuffles(found.sparkSession)
    return blocks


def _components(rows: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, component_id, uid, component of each row (uid, doc_id, text)."""
    found = written(features(rows, width, threshold, bucket_count(text_bytes(rows), BUCKET_BYTES)), "ngram-features")
    classes = written(found.where("n > 0").groupBy("class").agg(F.min("uid").alias("rep")), "ngram-classes")
    blocks = blocks_of(found, classes, threshold)
    plain = written(found.where("uid IS NOT NULL").select("uid", "n", "class"), "ngram-sets")
    discard(found)
    total = blocks.groupBy("block").agg(F.sum("n").alias("total"))
    lots = max(1, (blocks.agg(F.sum("n")).first()[0] or 0) // LOT)
    small = total.where(F.col("total") <= BLOCK).select("block", F.pmod(F.xxhash64("block"), F.lit(lots)).alias("lot"))
    labels = written(_verified(blocks.select("uid", "block").join(small, "block"), rows, width, threshold), "ngram-labels")
    large = written(total.where(F.col("total") > BLOCK).select("block"), "ngram-large")
    if not large.isEmpty():
        labels = labels.unionByName(_large(blocks.join(large, "block"), rows, width, threshold))
    release_shuffles(rows.sparkSession)
    least = labels.groupBy("label").agg(F.min("uid").alias("component")).join(labels, "label").select("uid", "component")
    named = classes.join(least, classes["rep"] == least["uid"], "left").select("class", F.coalesce("component", "rep").alias("component"))
    names = rows.select("uid", "doc_id")
    named = named.join(names.select(F.col("uid").alias("component"), F.col("doc_id").alias("component_id")), "component").select("class", "component", "component_id")
    placed = lookup(plain, named, "class", ["component", "component_id"])
    placed = placed.join(names, "uid")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "uid", F.coalesce("component", "uid").alias("component"))


def one_of_each(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if of each component the one with the smallest doc_id does, with all their columns.

    Documents without shingles are in no group and stay.
    """
    rows = numbered(docs, id_col, text_col)
    found = _components(rows, width, threshold)
    id_ = F.col(f"`{id_col}`")
    one, two = fresh(docs, "one"), fresh(docs, "two")
    if rows.where("uid <> doc_id OR doc_id IS NULL").isEmpty():
        gone = found.where("component <> uid").select(F.col("uid").alias(one))
        return docs.join(gone, id_ == F.col(one), "left_anti")
    first = found.where("component = uid").select("uid").join(rows, "uid").select(F.col("doc_id").alias(one), F.md5("text").alias(two)).distinct()
    mark = fresh(docs, "mark")
    kept = docs.withColumn(mark, F.md5(text_of(text_col))).join(first, id_.eqNullSafe(F.col(one)) & (F.col(mark) == F.col(two)), "left_semi")
    return kept.dropDuplicates([id_col, mark]).drop(mark)


def report(docs: DataFrame) -> DataFrame:
    return ngram_components(docs).select("doc_id", "n_shingles", "component_id")

"""Every operator against a brute-force version on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekiln.llm import bpe, exact_dedup, fingerprints, line_dedup, mixing, ngram_join, quality, queries, substring_dedup, token_counts, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, `a.b` string"


def make(spark, rows, parts=5):
    """Rows (doc_id, text, source) with extra columns whose names clash with those that operators use."""
    full = [(i, t, "en", s, 0 if t is None else len(t), True, "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def corpus(seed=1, n=120):
    """Texts with exact copies, near copies, shared passages, repeats, nulls, empty and very long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = i % 8
        words = [word() for _ in range(rng.randint(1, 90))]
        if kind == 1 and rows:
            text = rng.choice(rows)[1]
        elif kind == 2:
            at = rng.randint(0, 20)
            text = " ".join(words[:20] + passage[at : at + 35] + words[20:])
        elif kind == 3 and rows:
            base = WORDS.findall(rng.choice(rows)[1] or "")
            if base:
                base[rng.randrange(len(base))] = "edited"
            text = " ".join(base)
        elif kind == 4:
            text = " ".join(words * 3)
        elif kind == 5:
            lines = [" ".join(passage[k : k + 5]) for k in range(0, 40, 5)]
            text = "\n".join([*lines[: rng.randint(0, 8)], " ".join(words[:9]), *lines])
        else:
            text = "\t ".join(words)
        rows.append((i, text, f"s{i % 5}"))
    rows += [(n, None, None), (n + 1, "", "s1"), (n + 2, " \n\t ", "s2"), (n + 3, "one", "s3"), (n + 4, "one two", "s3"), (n + 5, " ".join(passage * 400), "s4"), (n + 6, "x" * 50_000, "s4"), (n + 7, None, "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus()).cache()


@pytest.fixture(scope="module")
def rows():
    return corpus()


def empty(spark):
    return make(spark, [])


# 1 ---------------------------------------------------------------------------------------------


def brute_exact(rows):
    keep, size = {}, Counter()
    for i, t, _ in rows:
        keep[t or ""] = max(keep.get(t or "", i), i)
        size[t or ""] += 1
    return {(i, keep[t or ""], size[t or ""], i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}


def test_exact_dedup(spark, docs, rows):
    assert {tuple(r) for r in exact_dedup.report(docs).collect()} == brute_exact(rows)
    left = exact_dedup.exact_dedup(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {x[0] for x in brute_exact(rows) if x[3]}
    assert exact_dedup.report(empty(spark)).count() == exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_tells_contents_apart_when_digests_clash(spark, docs, rows):
    weak = F.substring(F.encode(F.md5(F.coalesce("text", F.lit(""))), "UTF-8"), 1, 1)
    found = exact_dedup.assign(docs, digest=weak).select("doc_id", "keep_id", "group_size", "kept")
    assert {tuple(r) for r in found.collect()} == {x[:4] for x in brute_exact(rows)}


def test_exact_dedup_with_a_hot_group_and_repeated_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "s") for i in range(3000)] + [(2997, "same text", "s"), (2998, "text 2998", "s"), (None, "same text", "s")]
    found = exact_dedup.report(make(spark, rows, 11)).collect()
    hot = [r for r in found if r["group_size"] == 1002]
    assert len(hot) == 1002 and {r["keep_id"] for r in hot} == {2997} and sum(r["kept"] for r in hot) == 1
    assert sum(r["kept"] for r in found) == 2001 == exact_dedup.exact_dedup(make(spark, rows, 11)).count()


# 3, 7 ------------------------------------------------------------------------------------------


def brute_windows(rows, units_of, width, skip=lambda w: False):
    seen, gone = set(), defaultdict(set)
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        units = units_of(t or "")
        for k in range(len(units) - width + 1):
            w = tuple(units[k : k + width])
            if skip(w):
                continue
            if w in seen:
                gone[i] |= set(range(k, k + width))
            seen.add(w)
    return gone


@pytest.mark.parametrize("window", [20, 7])
def test_substring_dedup(spark, docs, rows, window):
    gone = brute_windows(rows, WORDS.findall, window)
    found = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, window).collect()}
    assert len(found) == len(rows) and sum(len(x) for x in gone.values()) > 100
    for i, t, _ in rows:
        words = WORDS.findall(t or "")
        kept = " ".join(w for k, w in enumerate(words) if k not in gone[i])
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept"]) == (len(words), len(gone[i]), kept)
        assert {k for a, b in found[i]["spans"] for k in range(a, b)} == gone[i]
    assert substring_dedup.report(empty(spark)).count() == 0


def test_substring_dedup_numbers_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    found = substring_dedup.substring_dedup(make(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s")]))
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in found.collect()) == [(False, 0), (False, 30), (True, 30)]


def test_line_dedup(spark, docs, rows):
    gone = brute_windows(rows, lambda t: t.split("\n"), 3, lambda w: not "".join(w).strip())
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert sum(len(x) for x in gone.values()) > 20
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        assert (found[i]["n_lines"], found[i]["n_removed"]) == (len(lines), len(gone[i]))
        assert found[i]["kept"] == "\n".join(x for k, x in enumerate(lines) if k not in gone[i])
    assert line_dedup.report(empty(spark)).count() == 0


def test_line_dedup_numbers_repeated_and_null_ids(spark):
    text = "\n".join(f"line {i}" for i in range(5))
    found = line_dedup.line_dedup(make(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (None, None, "s")]))
    assert sorted((r["doc_id"] is None, r["n_lines"], r["n_removed"]) for r in found.collect()) == [(False, 5, 0), (False, 5, 5), (True, 1, 0), (True, 5, 5)]


# 4 ---------------------------------------------------------------------------------------------


def shingle_set(text, width):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width, threshold):
    sets = {i: shingle_set(t, width) for i, t, _ in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) > 0 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {(i, len(sets[i]), label[i]) for i in ids}


def near_rows():
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(60):
        words = list(base) if i % 3 else [f"v{rng.randrange(300)}" for _ in range(40)]
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"e{i}"
        rows.append((i, " ".join(words), "s"))
    return rows + [(i + 100, "A b c d e f g h i j k l m n o" + " x" * (i % 3), "s") for i in range(9)]


@pytest.mark.parametrize("width,threshold", [(3, 90), (5, 80), (1, 50)])
def test_ngram_components(docs, rows, spark, width, threshold):
    for df, own in ((docs, rows), (make(spark, near_rows(), 7), near_rows())):
        found = ngram_join.ngram_components(df, width, threshold).select("doc_id", "n_shingles", "component_id")
        assert {tuple(r) for r in found.collect()} == brute_components(own, width, threshold)
    assert ngram_join.report(empty(spark)).count() == ngram_join.one_of_each(empty(spark)).count() == 0


def test_ngram_components_of_blocks_that_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOT", 300)
    monkeypatch.setattr(ngram_join, "BLOCK", 200)
    monkeypatch.setattr(ngram_join, "CENTRES", 3)
    for width, threshold in ((3, 90), (5, 80)):
        found = ngram_join.ngram_components(make(spark, near_rows(), 7), width, threshold).select("doc_id", "n_shingles", "component_id")
        assert {tuple(r) for r in found.collect()} == brute_components(near_rows(), width, threshold)


def chained_rows(n=130):
    """One text whose words are replaced, one for each document, in turn: near links make a chain, few documents are near its start."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(words)
        words[i * 7 % 60] = f"n{i}"
        rows.append((i * 37 % 1009, " ".join(words), "s"))
    return rows


@pytest.mark.parametrize("width,threshold", [(1, 90), (2, 80)])
def test_ngram_components_of_chains_in_cells(spark, monkeypatch, width, threshold):
    monkeypatch.setattr(ngram_join, "CELL", 20)
    own = chained_rows()
    found = ngram_join.ngram_components(make(spark, own, 3), width, threshold).select("doc_id", "n_shingles", "component_id")
    assert {tuple(r) for r in found.collect()} == brute_components(own, width, threshold)


def test_ngram_join_of_documents_that_share_a_passage(spark):
    """10,000 documents with one passage in common, of which some hundred are near copies: no block of the others forms."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    own = []
    for i in range(10_000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if i % 100 == 99:
            words = own[-1][1].split()[:60]
            words[5] = f"e{i}"
        own.append((i, " ".join(words + passage), "s"))
    df = make(spark, own, 8).select("doc_id", "text")
    rows = ngram_join.numbered(df)
    found = ngram_join.written(ngram_join.features(rows, 5, 80, 8), "test-features")
    classes = found.where("n > 0").groupBy("class").agg(F.min("uid").alias("rep"))
    assert ngram_join.blocks_of(found, classes, 80).groupBy("block").count().agg(F.max("count")).first()[0] <= 4
    labels = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(df, 5, 80).collect()}
    assert labels == {i: i - (i % 100 == 99) for i, _, _ in own}


def test_one_of_each_keeps_all_columns_and_one_document(spark):
    df = make(spark, near_rows(), 3)
    left = ngram_join.one_of_each(df, 3, 90)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {c for _, _, c in brute_components(near_rows(), 3, 90)}
    again = make(spark, [(7, "a b c d", "s"), (7, "a b c d", "s"), (7, "other words here", "s"), (None, "a b c d", "s")])
    assert sorted(r["text"] for r in ngram_join.one_of_each(again, 3, 90).collect()) == ["a b c d", "other words here"]


def test_parts_bound_what_linked_sets_differ_by():
    low = ngram_join.bands(90)
    for a in range(1, 400):
        for b in range(a, a * 10 // 9 + 1):
            band_a, band_b = (int(np.searchsorted(low, x, "right")) - 1 for x in (a, b))
            assert band_b - band_a in (0, 1)
            most = max((a + b - 2 * i for i in range(a + 1) if 100 * i >= 90 * (a + b - i)), default=0)
            assert most < ngram_join.parts_of(np.array([band_a]), 90)[0]


# 5, 8 ------------------------------------------------------------------------------------------

HARD = ["", " ", "a", "  leading and   trailing  ", "don't we'll I've", "x" * 700, "a b" * 300, "naïve café    words", "\x1c\x1d odd \x1f", "漢字かな交じり文" * 20, "\r\n\r\n\t tabs", "123 4567,89", "🙂🙃" * 40, "é" * 50, "<|endoftext|> text", "word " * 200 + "\n" * 90]


@pytest.mark.parametrize("leaf", [1, 3, 17, 512])
def test_bpe_tree_equals_the_library(leaf):
    P = pytest.importorskip("public_tokenizers")
    encoding = bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    tree = bpe.Tree(encoding, leaf)
    rng = random.Random(leaf)
    texts = HARD + ["".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "9", "é", "　", "!", "漢"]) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    for text in texts:
        ids = encoding.encode_ordinary(text)
        assert tree.encode(text) == ids
        assert tree.decode(ids) == text.encode()


def test_bpe_round_trip(spark, docs, rows):
    P = pytest.importorskip("public_tokenizers")
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    encoding = bpe.encoder(*args)
    found = {r["doc_id"]: r for r in bpe.round_trip(docs, *args, leaf=64).collect()}
    for i, t, _ in rows:
        ids = encoding.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs, *args), *args)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()} == {i: t or "" for i, t, _ in rows}
    assert bpe.round_trip(empty(spark), *args).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_and_their_cache(spark, docs, rows, tmp_path, name):
    P = pytest.importorskip("public_tokenizers")
    path, cache = P.path(name), f"file://{tmp_path}/cache"
    count = token_counts.counter(path)
    wanted = {(i, len((t or "").encode()), count([t or ""])[0]) for i, t, _ in rows}
    for _ in range(2):
        found = token_counts.token_counts(docs, path, cache, limit=50)
        assert {tuple(r)[:3] for r in found.collect()} == wanted
        assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in found.collect())
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in rows})  # distinct texts, once each
    more = make(spark, [(1, "a new text", "s"), (2, "a new text", "s")])
    assert token_counts.token_counts(more, path, cache).count() == 2
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in rows}) + 1
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_token_counts_of_a_second_run_come_from_the_cache(spark, sf, tmp_path, monkeypatch):
    spark.conf.set(queries.TOKEN_CACHE, f"file://{tmp_path}/kept")
    try:
        first = sorted(map(tuple, queries.op8_token_counts(spark, sf).collect()))
        files = {p.name for p in (tmp_path / "kept").glob("*.parquet")}
        known = spark.read.parquet(f"file://{tmp_path}/kept").count()
        assert first == sorted(map(tuple, queries.op8_token_counts(spark, sf).collect()))
        again = spark.read.parquet(f"file://{tmp_path}/kept")
        assert again.count() == known and files <= {p.name for p in (tmp_path / "kept").glob("*.parquet")}
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)


# 6 ---------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mixing(spark, docs, rows):
    found = mixing.plan(docs).collect()
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in rows}
    by_source = Counter()
    for i, _, s in rows:
        by_source[s] += size[i]
    goal, took, largest = brute_targets(by_source), Counter(), Counter()
    source = {i: s for i, _, s in rows}
    for r in found:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by_source[s]) and r["target"] == pytest.approx(goal[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert sum(took.values()) <= sum(by_source.values())
    for s in goal:
        assert abs(took[s] - goal[s]) <= max(largest.values())
    assert sorted(map(tuple, mixing.plan(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, found), key=repr)
    copies = {r["doc_id"]: r["copies"] for r in found}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_mixing_of_tables_without_words(spark):
    assert mixing.report(empty(spark)).count() == mixing.mix(empty(spark)).count() == 0
    found = mixing.report(make(spark, [(1, None, "a"), (2, "", None), (None, " ", "b")])).collect()
    assert [r["taken"] for r in found] == [0, 0, 0]
    assert mixing.mix(make(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, "c", None)])).count() >= 2


def test_mix_is_cut_off_at_the_budget_in_merged_order(spark):
    """Against a plain merge of the queues, with equal finish times across sources."""
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(400)] + [(1000 + i, "w w", f"t{i % 3}") for i in range(90)]
    size = {i: len(WORDS.findall(t)) for i, t, _ in rows}
    by_source = Counter()
    for i, _, s in rows:
        by_source[s] += size[i]
    goal = brute_targets(by_source)
    place = {i: hashlib.md5(f"mix\x01{i}".encode()).hexdigest() for i in size}
    upto, entries = Counter(), []
    for i, _, s in sorted(rows, key=lambda r: place[r[0]]):
        upto[s] += size[i]
        entries += [((turn * by_source[s] + upto[s]) / goal[s], "s" + s, turn, place[i], i) for turn in range(3)]
    left, wanted = sum(size.values()), []
    for entry in sorted(entries):
        left -= size[entry[-1]]
        if left < 0:
            break
        wanted.append(entry[-1])
    assert len({e[0] for e in entries}) < len(entries)
    for parts in (1, 9):
        df = make(spark, rows, parts)
        assert {r["doc_id"]: r["copies"] for r in mixing.plan(df).where("copies > 0").collect()} == Counter(wanted)
        found = [r["doc_id"] for r in mixing.mix(df).collect()]
        assert Counter(found) == Counter(wanted) and found[:200] == wanted[:200]


# 10 --------------------------------------------------------------------------------------------


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, docs, rows):
    found = {r["doc_id"]: r for r in fingerprints.report(docs).collect()}
    text = {i: t or "" for i, t, _ in rows}
    ids = sorted(text, reverse=True)
    off = []
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(text[a]) // 2
        edited = text[a][: len(text[a]) - half] + text[b][:half]
        r = found[a]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text[a]), hashlib.sha256(edited.encode()).hexdigest())
        for estimate, x, y in ((r["near_edited"], text[a], edited), (r["near_next"], text[a], text[b])):
            one, two = shingle5(x), shingle5(y)
            j, n = jaccard(one, two), max(1, min(len(one | two), fingerprints.BINS))
            off.append(estimate - j)
            assert abs(estimate - j) <= 5 * (j * (1 - j) / n) ** 0.5 + 0.08  # few shingles are few draws
    assert np.abs(off).mean() < 0.03
    prints = defaultdict(set)
    for i, r in found.items():
        prints[text[i]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    alone = fingerprints.fingerprints(docs).collect()
    assert all(r["fingerprint"] == found[r["doc_id"]]["fingerprint"] for r in alone)


def shingle5(text):
    w = WORDS.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.report(empty(spark)).count() == 0
    (only,) = fingerprints.report(make(spark, [(1, "a b c d e f", "s")])).collect()
    assert only["near_next"] == 1.0
    again = fingerprints.report(make(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (None, None, "s")])).collect()
    assert len(again) == 3 and len({tuple(r) for r in again}) == 2
    assert [r["fingerprint"] for r in again if r["doc_id"] is None] == [""]


def test_fingerprint_estimates_are_unbiased(spark):
    rng = random.Random(3)
    pairs = []
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 600]))]
        cut = rng.randrange(len(words))
        pairs.append((i, " ".join(words), " ".join(words[:cut] + [f"x{rng.randrange(10**6)}" for _ in words[cut:]])))
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, F.col("a"), "pa"), F.col("b"), "pb")
    off = [r["e"] - jaccard(shingle5(pairs[r["i"]][1]), shingle5(pairs[r["i"]][2])) for r in df.select("i", fingerprints.likeness(F.col("pa"), F.col("pb")).alias("e")).collect()]
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.05


# 2, 9 ------------------------------------------------------------------------------------------


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = sum(y)
    return (sum(rank[np.array(y) == 1]) - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("label,module", [("quality", quality), ("toxic", toxicity)])
def test_classifiers_rank_held_out_rows(spark, label, module):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r[label] for r in labels.collect()}
    found = [r for r in module.report(docs, labels).collect() if r["held_out"] and r["doc_id"] in known]
    assert len(found) > 60 and all(0 <= r["score"] <= 1 for r in found)
    assert auc([r["score"] for r in found], [known[r["doc_id"]] for r in found]) > (0.97 if label == "quality" else 0.6)


@pytest.mark.parametrize("label,module", [("quality", quality), ("toxic", toxicity)])
def test_classifiers_on_odd_tables(spark, docs, rows, label, module):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(60)] + [(1, 1, 0), (500, 1, 1), (2, None, 7)], "doc_id long, quality int, toxic int")
    found = module.report(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    by_text = defaultdict(set)
    for r in found:
        by_text[dict((i, t or "") for i, t, _ in rows)[r["doc_id"]]].add(r["score"])
    assert all(len(x) == 1 for x in by_text.values())  # nothing but the text decides
    for some in (labels.limit(0), labels.where(f"{label} = 1")):
        assert len({r["score"] for r in module.report(docs, some).collect()}) == 1
    assert module.report(empty(spark), labels).count() == 0


def plain_grams(text):
    """Places of a text's n-grams, each n-gram hashed on its own with Python's integers."""
    clean = f" {' '.join((text or '').lower().split())} "
    odd, mask, found = [int(x) for x in toxicity.odd_numbers(toxicity.LONGEST, 50)], 2**64 - 1, set()
    for i in range(len(clean)):
        total = 0
        for n, c in enumerate(clean[i : i + toxicity.LONGEST], 1):
            total = (total + ord(c)) * odd[n - 1] & mask
            total ^= total >> 29
            if n >= toxicity.SHORTEST:
                found.add(total >> 44)
    return found


def test_toxicity_equals_a_plain_version(spark):
    """Ratios, regression and scores by loops over every row, place by place."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["good", "day", "Sun", "tree", "walk", "read"] + ["vile", "mean"] * (i % 3 == 0)) for _ in range(12)) for i in range(50)]
    labels = [(i, int(i % 3 == 0)) for i in range(50)]
    df = make(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r["doc_id"]: r["score"] for r in toxicity.report(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    known = [(plain_grams(texts[i]), y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [sum(y == k for _, y in known) for k in (0, 1)]
    ratio = {}
    for place in set().union(*(x for x, _ in known)):
        c = [sum(place in x and y == k for x, y in known) for k in (0, 1)]
        pooled = (sum(c) + 1) / (sum(n) + 2)
        if abs(c[1] / n[1] - c[0] / n[0]) >= toxicity.CLEAR * (pooled * (1 - min(pooled, 0.999)) * (1 / n[0] + 1 / n[1])) ** 0.5:
            ratio[place] = np.log((c[1] + 1) / (n[1] + 2)) - np.log((c[0] + 1) / (n[0] + 2))
    assert ratio
    rows = [([p for p in x if p in ratio], y) for x, y in known]
    w, base = dict.fromkeys(ratio, 0.0), np.log((n[1] + 1) / (n[0] + 1))
    squares = np.array([[ratio[p] if p in x else 0.0 for p in ratio] for x, _ in rows])
    for _ in range(40_000):  # plain gradient descent to the minimum of the same loss
        z = squares @ np.array(list(w.values())) + base
        off = 1 / (1 + np.exp(-z)) - np.array([y for _, y in rows])
        g = squares.T @ off + np.array(list(w.values()))
        w = dict(zip(w, np.array(list(w.values())) - 0.002 * g, strict=True))
        base -= 0.002 * off.sum()
    chosen = np.array(sorted(ratio))
    args = [np.array(sorted(x), np.int64) for x, _ in rows], np.array([float(y) for _, y in rows]), np.ones(len(rows)), chosen, np.array([ratio[p] for p in chosen])
    some, most = toxicity.fit(*args), toxicity.fit(*args, rounds=20_000)
    for i, t in enumerate(texts):
        scores = []
        for model in (some, most):
            z = model.base + sum(float(model.weights[p]) for p in plain_grams(t))
            scores.append(1 / (1 + np.exp(-z)))
        assert found[i] == pytest.approx(scores[0], abs=1e-6)
        z = base + sum(w[p] * ratio[p] for p in plain_grams(t) if p in ratio)
        assert scores[1] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4) and abs(scores[1] - scores[0]) < 0.05


def test_toxicity_finds_held_out_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in toxicity.report(docs, labels).collect() if r["held_out"] and known.get(r["doc_id"]) in (0, 1)]
    hits = sum(r["predicted"] and known[r["doc_id"]] for r in held)
    assert hits >= 0.9 * sum(known[r["doc_id"]] for r in held) and hits >= 0.95 * sum(r["predicted"] for r in held)


def test_quality_scores_and_trees_equal_plain_versions():
    rng = np.random.default_rng(4)
    x, noise = rng.normal(size=(300, 4)), rng.normal(size=300)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) | (x[:, 2] + 0.3 * noise > 1)).astype(float)
    model = quality.fit(x, y, np.ones(300))
    for row, score in zip(x, model.score(x), strict=True):
        total = model.base
        for f, (cuts, table) in enumerate(zip(model.cuts, model.tables, strict=True)):
            total += table[sum(c <= row[f] for c in cuts)]
        for a, b, table in model.pairs:
            total += table[sum(c <= row[a] for c in model.coarse[a]), sum(c <= row[b] for c in model.coarse[b])]
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs] and ((model.score(x) > 0.5) == y).mean() > 0.95
    g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    best = max(range(1, 9), key=lambda c: gain(0, c) + gain(c, 9))
    wanted = [g[:best].sum() / (h[:best].sum() + 1)] * best + [g[best:].sum() / (h[best:].sum() + 1)] * (9 - best)
    assert quality._leaves(g, h, 1) == pytest.approx(wanted)
    g2, h2 = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, (4, 5))
    parts = lambda i, j: [(slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))]
    whole = lambda i, j: sum(g2[p].sum() ** 2 / (h2[p].sum() + 1) for p in parts(i, j))
    top = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: whole(*c))
    values = np.empty((4, 5))
    for p in parts(*top):
        values[p] = g2[p].sum() / (h2[p].sum() + 1)
    assert quality._quadrants(g2, h2)[0] == pytest.approx(values)

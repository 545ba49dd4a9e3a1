"""Words of many texts are hashed together: equal hashes for equal words only, and no call for each word (no Spark)."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from lorekiln.llm import ngram_join, sequences, shared, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aAbB\0é中\x1c\x85\xa0　\ud800") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 63, 64, 65, 200])))
    odd = [None, "", " ", " \n\t ", "a", "a\0", "\0", " a", "a ", "x" * 64, "x" * 65, "x" * 50_000, "A" * 70 + " " + "a" * 70]
    return odd + ["".join(word() + rng.choice([" ", "\t", "\n", "\x0b", "\x0c", "\r", "  \r\n "]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, ""]


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("at_once", [1, 50, 4 << 20])
def test_hashes_are_equal_for_equal_words_only(monkeypatch, lower, at_once):
    monkeypatch.setattr(shared, "HASHED_BYTES", at_once)
    of, back = {}, {}
    found = list(shared.word_hashes(texts(), lower))
    assert len(found) == len(texts())
    for text, hashes in zip(texts(), found, strict=True):
        words = WORDS.findall(text or "")
        if lower:
            words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
        assert hashes.dtype == np.uint64 and len(hashes) == len(words)
        for word, value in zip(words, hashes.tolist(), strict=True):
            assert of.setdefault(word, value) == value and back.setdefault(value, word) == word
    assert len(of) > 1000 and list(shared.word_hashes([])) == []


@pytest.mark.parametrize("module", [substring_dedup, ngram_join])
def test_words_take_no_call_each(monkeypatch, module):
    calls = []
    digest = shared.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(shared.xxhash, "xxh3_64_intdigest", lambda word: calls.append(word) or digest(word))
    rows = pd.DataFrame({"uid": range(50), "text": [" ".join(f"w{i}x{k}" for k in range(100)) + " " + "y" * 100 for i in range(50)]})
    (_, units, _), = sequences.in_batches([rows], module._words())
    assert len(np.unique(np.concatenate(units))) == 5001 and len(calls) <= 50


def test_sets_of_a_batch_take_no_deduplication_each(monkeypatch):
    calls = []
    unique = np.unique
    monkeypatch.setattr(ngram_join.np, "unique", lambda *a, **k: calls.append(a) or unique(*a, **k))
    rng = random.Random(7)
    units = [np.array([rng.randrange(4) for _ in range(rng.choice([0, 1, 2, 3, 4, 50]))], np.uint64) for _ in range(300)]
    key, doc = ngram_join.shingle_sets(units, 3)
    assert (np.diff(doc) >= 0).all() and len(calls) < 10
    of = {}
    for i, x in enumerate(units):
        words = x.tolist()
        want = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()
        own = key[doc == i].tolist()
        assert len(own) == len(set(own)) == len(want) and own == sorted(own)
        assert of.setdefault(frozenset(want), own) == own
    assert len(of) == len({tuple(x) for x in of.values()})

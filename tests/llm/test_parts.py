"""Linked sets always share a part of those kept, and sketches differ in no more bits than sets (no Spark)."""

import random

import numpy as np
import pytest

from lorekiln.llm import ngram_join


@pytest.mark.parametrize("threshold", [50, 80, 90])
def test_linked_sets_share_a_part(threshold):
    rng = random.Random(threshold)
    for _ in range(400):
        n = rng.choice([1, 2, 3, 5, 9, 17, 40, 120, 400])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for x in rng.sample(sorted(a), rng.randint(0, max(1, n * (100 - threshold) // 100))):
            if rng.random() < 0.7:
                b.discard(x)
            if rng.random() < 0.7:
                b.add(rng.getrandbits(64))
        if not b or 100 * len(a & b) < threshold * len(a | b):
            continue
        key = np.array(sorted(a) + sorted(b), np.uint64)
        doc = np.array([0] * len(a) + [1] * len(b), np.int32)
        sizes = np.array([len(a), len(b)])
        digests, docs, slack = ngram_join.part_keys(key, doc, sizes, threshold)
        kept = [set(), set()]
        for d in (0, 1):
            for side in (0, 1):
                own = sorted((x for x in digests[docs == d].tolist() if x & 1 == side), key=rank)
                kept[d] |= set(own[: max(0, len(own) - int(slack[d, side]))])
        assert a == b or kept[0] & kept[1]
        bits, words = ngram_join.sketches(key, doc, sizes)
        one, two = (x.view(np.uint64) for x in (bits[: words[0]], bits[words[0] :]))
        short = min(words)
        apart = int(np.bitwise_count(ngram_join._fold(one, short) ^ ngram_join._fold(two, short)).sum())
        assert apart <= len(a ^ b)


def rank(digest):
    """Any order of the parts will do, as long as it is the same for all documents."""
    return digest * 0x9E3779B97F4A7C15 % 1009 // 2, digest

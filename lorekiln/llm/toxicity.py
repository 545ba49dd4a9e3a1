"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A text's distinct n-grams of three to six characters (lower case, white space as one space,
also before the first and after the last character) are hashed to 2**20 places. A place's
weight is the product of its log-count ratio, from add-one smoothed counts of labelled texts of either class
that have it, and a coefficient that logistic regression learns on the scaled features. Scoring
adds up the weights of a text's places.

The model is fitted on at most ``SAMPLE`` labelled rows of either class, taken in
the order of a hash. Places are counted on the executors; each place whose shares in the classes are ``CLEAR``
standard deviations apart takes part, however many these are, and only such places
of the sampled rows go to the driver. Everything else reads all rows and whole texts.

Defined results: a null text is empty and scores by the intercept; labels other than 0 and 1 are
no labels; of labels that disagree the larger holds; if the labelled rows show one class only,
every score is that class's share after add-one smoothing. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import collected, fold, sample
from .shared import discard, kind_of, odd_numbers, written

#: Labelled rows of either class at most that the model is fitted on.
SAMPLE = 3_000
#: Standard deviations by which the shares of two classes that have a place differ, at least, for it to have a weight.
CLEAR = 4.0
FOLDS, HELD_OUT, LEAST = 4, 2, 0.3
SHORTEST, LONGEST = 3, 6
SLOTS = 1 << 20
#: Characters hashed at a time; longer texts are hashed in overlapping pieces of that length.
PIECE = 1 << 18


class Grams:
    """Distinct n-gram places of texts, by a scratch table instead of a sort."""

    def __init__(self):
        self.last = np.zeros(SLOTS, np.int32)
        self.odd = odd_numbers(LONGEST, 50)

    def of(self, text: str | None) -> np.ndarray:
        clean = f" {' '.join((text or '').lower().split())} "
        found = [self._piece(clean[i : i + PIECE + LONGEST - 1]) for i in range(0, len(clean), PIECE)]
        return found[0] if len(found) == 1 else self._distinct(np.concatenate(found))

    def _piece(self, clean: str) -> np.ndarray:
        chars = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        total, places = np.zeros(len(chars), np.uint64), []
        for n in range(1, LONGEST + 1):
            if len(chars) < n:
                break
            total = (total[: len(chars) - n + 1] + chars[n - 1 :]) * self.odd[n - 1]
            total ^= total >> np.uint64(29)
            if n >= SHORTEST:
                places.append((total >> np.uint64(44)).astype(np.int64))
        return self._distinct(np.concatenate(places)) if places else np.empty(0, np.int64)

    def _distinct(self, places: np.ndarray) -> np.ndarray:
        at = np.arange(len(places), dtype=np.int32)
        self.last[places] = at
        return places[self.last[places] == at]


@dataclass
class Model:
    base: float
    weights: np.ndarray | None = None

    def score(self, grams: Grams, texts) -> np.ndarray:
        if self.weights is None:
            total = np.full(len(texts), self.base)
        else:
            total = np.array([self.base + self.weights[grams.of(x)].sum(dtype=np.float64) for x in texts])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def ratios(counts: list[np.ndarray], n0: float, n1: float, least: float = CLEAR) -> tuple[np.ndarray, np.ndarray]:
    """Places that tell the classes apart, in rising order, and their log-count ratios, from the rows of either class that have each place."""
    ratio = np.log((counts[1] + 1) / (n1 + 2)) - np.log((counts[0] + 1) / (n0 + 2))
    pooled = (counts[0] + counts[1] + 1) / (n0 + n1 + 2)
    clear = np.abs(counts[1] / n1 - counts[0] / n0) / np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / n0 + 1 / n1))
    chosen = np.flatnonzero(clear >= least)
    return chosen, ratio[chosen]


def fit(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, chosen: np.ndarray, r: np.ndarray, penalty: float = 1.0, rounds: int = 150) -> Model:
    """Logistic regression on the chosen places, scaled by their ratios (accelerated gradient steps)."""
    share = float((np.sum(weight * y) + 1) / (np.sum(weight) + 2))
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2 or not len(chosen):
        return Model(base)
    number = np.full(SLOTS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    columns = [number[x][number[x] >= 0] for x in docs]
    lengths = np.array([len(c) for c in columns])
    flat, row = np.concatenate(columns), np.repeat(np.arange(len(docs)), lengths)
    values = r[flat]
    w, b = np.zeros(len(chosen)), base
    look_w, look_b, momentum = w.copy(), b, 1.0
    # the largest eigenvalue of X'X, by power iteration, bounds the step
    v = np.ones(len(chosen))
    for _ in range(20):
        u = np.bincount(flat, values * np.bincount(row, values * v[flat], len(docs))[row], len(chosen))
        norm = np.linalg.norm(u)
        v = u / max(norm, 1e-12)
    step = 1 / (0.25 * weight.max() * (norm + len(docs)) + penalty)
    for _ in range(rounds):
        z = np.bincount(row, values * look_w[flat], len(docs)) + look_b
        off = weight * (1 / (1 + np.exp(-z)) - y)
        new_w = look_w - step * (np.bincount(flat, values * off[row], len(chosen)) + penalty * look_w)
        new_b = look_b - step * off.sum()
        new_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / new_momentum
        look_w, look_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, momentum = new_w, new_b, new_momentum
    weights = np.zeros(SLOTS, np.float32)
    weights[chosen] = w * r
    return Model(float(b), weights)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows outside the held-out fold. Rows count so that classes keep their shares."""
    rows, sizes = sample(docs, labels, label, folds, held_out, most, id_col, text_col)

    rows = written(rows, "toxicity-sample")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, counts = Grams(), np.zeros((SLOTS, 2), np.int64)
        for group in batches:
            for text, y in zip(group["text"], group["y"], strict=True):
                counts[grams.of(text), int(y)] += 1
        seen = np.flatnonzero(counts.any(axis=1))
        yield pd.DataFrame({"place": seen.astype(np.int32), "n0": counts[seen, 0], "n1": counts[seen, 1]})

    n = {int(r["y"]): int(r["count"]) for r in rows.groupBy("y").count().collect()}  # two rows
    if len(n) < 2:
        return fit([], np.array([float(x) for x in n]), np.array([float(v) for v in n.values()]), np.empty(0), np.empty(0)) if n else Model(0.0)
    by_place = rows.select("text", "y").mapInPandas(counted, "place int, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = by_place.toPandas()  # SLOTS rows at most
    counts = [np.zeros(SLOTS), np.zeros(SLOTS)]
    for k in (0, 1):
        counts[k][found["place"].to_numpy()] = found[f"n{k}"].to_numpy()
    chosen, r = ratios(counts, float(n[0]), float(n[1]))
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, wanted = Grams(), np.zeros(SLOTS, bool)
        wanted[sent.value] = True
        for group in batches:
            places = [grams.of(t) for t in group["text"]]
            yield pd.DataFrame({"__doc": group["__doc"].array, "y": group["y"], "x": [np.sort(p[wanted[p]]).astype("<i4").tobytes() for p in places]})

    found = collected(rows.mapInPandas(part, f"__doc {kind_of(rows, '__doc')}, y int, x binary"))
    discard(rows)
    y = found["y"].to_numpy().astype(float)
    weight = np.array([max(1.0, sizes[int(v)] / most) for v in y])
    return fit([np.frombuffer(x, "<i4") for x in found["x"]], y, weight / weight.mean(), chosen, r)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row. The model (4 MB of weights) is broadcast once."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, own = Grams(), sent.value
        for group in batches:
            yield pd.DataFrame({"doc_id": group["doc_id"].array, "score": own.score(grams, group["text"].tolist())})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(part, f"doc_id {kind_of(docs, id_col)}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= LEAST, 1).otherwise(0).cast("int").alias("predicted"))

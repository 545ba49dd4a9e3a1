"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become some twenty numbers (shares of character classes, repetition, lengths,
compressibility). Each number has a lookup table over quantile bins, learned by cyclic gradient
boosting: one feature after the other gets a shallow tree, whose leaves are added to its table.
When these main effects are learned, the pairs whose coarse tables would lower the loss the most get
tables of their own the same way. A score is the sum of looked-up bins, for whole batches at once.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows of either class, taken in
the order of a hash; everything else reads all rows and whole texts.

Defined results: a null text is empty and is scored like any other; labels other than 0 and 1 are
no labels; of labels that disagree the larger holds; if the labelled rows show one class only,
every score is that class's share after add-one smoothing. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import collected, fold, sample
from .shared import kind_of

#: Labelled rows of either class at most that the model is fitted on.
SAMPLE = 10_000
FOLDS, HELD_OUT = 3, 1
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 60, 8, 0.15
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "marks",
    "not_ascii", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "ends_in_mark", "upper_words", "lines_per_word",
    "repeated_lines", "short_lines", "compressed", "entropy", "capitalised",
)


def _class_masks() -> np.ndarray:
    masks = np.zeros((256, 6))
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(c for c in range(33, 127) if not chr(c).isalnum()), b"#$%&*+/<=>@\\^_`|~", b"!?")):
        masks[list(chars), i] = 1
    masks[128:, 5] = 1
    return masks


_MASKS = _class_masks()
_MARKS = frozenset(b"!#$%&*+/<=>?@^_`|~")


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text, each finite for any text."""
    body = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(body))
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    shares = counts @ _MASKS / n
    words = body.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = body.split(b"\n")
    p = counts[counts > 0] / n
    after = list(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(body)), np.log1p(len(words)), lengths.mean(), lengths.std(), *shares,
        len(tally) / m, max(tally.values(), default=0) / m, sum(a == b for a, b in after) / m, len(set(after)) / max(1, len(after)),
        sum(w[-1] in _MARKS for w in words) / m, sum(w.isupper() for w in words) / m, len(lines) / m,
        1 - len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), len(zlib.compress(body, 1)) / n, float(-(p * np.log2(p)).sum()),
        sum(w[:1].isupper() for w in words) / m,
    ]


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values of a shallow regression tree over one ordered feature, for each bin."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + 1.0) + (g.sum() - a) ** 2 / (h.sum() - b + 1.0)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
            return np.concatenate([_leaves(g[:cut], h[:cut], depth - 1), _leaves(g[cut:], h[cut:], depth - 1)])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts both features of a pair once, for each cell, and its gain."""
    a, b = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h))

    def corners(x: np.ndarray) -> list[np.ndarray]:
        top, left, all_ = x[:-1, -1:], x[-1:, :-1], x[-1, -1]
        return [x[:-1, :-1], top - x[:-1, :-1], left - x[:-1, :-1], all_ - top - left + x[:-1, :-1]]

    ga, hb = corners(a), corners(b)
    gain = sum(x**2 / (y + 1.0) for x, y in zip(ga, hb, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [x[i, j] / (y[i, j] + 1.0) for x, y in zip(ga, hb, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1.0))


@dataclass
class Model:
    """An intercept, cut points and a table for each feature, and coarse tables for pairs."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Fit by cyclic boosting of the weighted logistic loss."""
    share = float((np.sum(weight * y) + 1) / (np.sum(weight) + 2))
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) for f in range(x.shape[1])]
    model.cuts, model.coarse = quantiles(BINS), quantiles(PAIR_BINS)
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[f])
            step = RATE * _leaves(np.bincount(b, g, size), np.bincount(b, h, size), 2)
            model.tables[f] += step
            total += step[b]
    cells = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.coarse)]
    sizes = [len(c) + 1 for c in model.coarse]

    def tables(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = cells[a] * sizes[b] + cells[b], sizes[a] * sizes[b]
        return np.bincount(at, g, n).reshape(sizes[a], sizes[b]), np.bincount(at, h, n).reshape(sizes[a], sizes[b])

    g, h = slopes()
    usable = [f for f in range(x.shape[1]) if sizes[f] > 1]
    ranked = sorted(((_quadrants(*tables(a, b, g, h))[1], a, b) for i, a in enumerate(usable) for b in usable[i + 1 :]), key=lambda p: (-p[0], p[1:]))
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = RATE * _quadrants(*tables(a, b, *slopes()))[0]
            table += step
            total += step[cells[a], cells[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows outside the held-out fold. Rows count so that classes keep their shares."""
    rows, sizes = sample(docs, labels, label, folds, held_out, most, id_col, text_col)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in batches:
            yield pd.DataFrame({"__doc": group["__doc"].array, "y": group["y"], "x": [features(t) for t in group["text"]]})

    found = collected(rows.select("__doc", "text", "y").mapInPandas(part, f"__doc {kind_of(rows, '__doc')}, y int, x array<double>"))
    if not len(found):
        return Model(0.0)
    y = found["y"].to_numpy().astype(float)
    weight = np.array([max(1.0, sizes[int(v)] / most) for v in y])
    return fit(np.stack(found["x"].to_numpy()), y, weight / weight.mean())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in batches:
            x = np.array([features(t) for t in group["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": group["doc_id"].array, "score": model.score(x)})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(part, f"doc_id {kind_of(docs, id_col)}, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is ``least`` or more, with all their columns."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))

    return docs.where(scores(F.col(f"`{text_col}`")) >= least)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))

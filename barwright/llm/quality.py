"""Document quality by histogram gradient-boosted trees over statistics of the text.

Statistics come from byte counts, words and lines of the whole text. Trees are grown in numpy on a bounded sample of
labelled documents: statistics are binned at quantiles, gradients and Hessians of the logistic loss are summed by bin,
and every level splits where the gain is largest. The trees have one depth and are flattened into arrays of split
statistics, thresholds and leaves, through which all rows of a batch descend at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, rows_of, texts

#: Labelled documents learned from at most; trees, their depth, bins, learning rate, ridge.
SAMPLE = 16_000
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 48, 0.12, 2.0
_BYTE = np.arange(256)
_CLASSES = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "blank": np.isin(_BYTE, [32, *range(9, 14)]),
    "beyond": _BYTE >= 128,
    "stops": np.isin(_BYTE, list(b".,;:?")),
    "cries": np.isin(_BYTE, list(b"!")),
    "signs": np.isin(_BYTE, list(b"#$%&*@^~+=<>_\\")),
    "bars": np.isin(_BYTE, list(b"|{}[]()/")),
    "breaks": _BYTE == 10,
}
_MASKS = np.array(list(_CLASSES.values()), np.float64).T
STATISTICS = (*_CLASSES, "size", "entropy", "words", "word_size", "long_words", "distinct_words", "top_word", "repeated_pairs", "lines", "line_size", "repeated_lines", "ended_lines", "capital_words", "capital_starts", "marked_words")


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a text's UTF-8 bytes; all 0 for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    share = counts[counts > 0] / n
    out = (counts @ _MASKS / n).tolist()
    words = text.split()
    w = max(1, len(words))
    tally = Counter(words)
    lines = [x for x in (x.strip() for x in text.split(b"\n")) if x]
    rows = max(1, len(lines))
    pairs = set(zip(words, words[1:], strict=False))
    return [
        *out, float(np.log1p(n)), float(-(share * np.log2(share)).sum()), float(np.log1p(len(words))), sum(map(len, words)) / w, sum(len(x) > 12 for x in words) / w,
        len(tally) / w, max(tally.values(), default=0) / w, 1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0, float(np.log1p(len(lines))), n / rows, 1 - len(set(lines)) / rows, sum(x[-1:] in b".!?" for x in lines) / rows,
        sum(map(bytes.isupper, words)) / w, sum(map(bytes.istitle, words)) / w, sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / w,
    ]


@dataclass
class Forest:
    """Trees of one depth as arrays: node i's children are 2i+1 and 2i+2; row t of each array is a tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of statistics."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """The forest for statistics x and labels y (0 or 1); a node that no split improves sends all rows left."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(width) * BINS
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, total = 2**DEPTH - 1, np.full(n, base)
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS) for v in (g, h)]
            left = [s.cumsum(2)[:, :, :-1] for s in sums]
            whole = [s.sum(2, keepdims=True) for s in sums]
            gain = left[0] ** 2 / (left[1] + RIDGE) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(left[1] < 1) | (whole[1] - left[1] < 1)] = 0
            best = gain.reshape(count, -1).argmax(1)
            value = gain.reshape(count, -1)[np.arange(count), best]
            f, b = best // (BINS - 1), best % (BINS - 1)
            for k in range(count):
                if value[k] > 1e-6 and b[k] < len(cuts[f[k]]):
                    features[t, first + k], thresholds[t, first + k] = f[k], cuts[f[k]][b[k]]
            node = 2 * node + 1 + (x[np.arange(n), features[t][node]] > thresholds[t][node])
        sums = [np.bincount(node - inner, v, inner + 1) for v in (g, h)]
        leaves[t] = -RATE * sums[0] / (sums[1] + RIDGE)
        total += leaves[t][node - inner]
    return Forest(base, features, thresholds, leaves)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = 4, held: int = 2) -> Forest:
    """The forest from labelled documents outside of the held-out fold: at most about `sample`, by a hash of the id.

    Rows without a label are left out, null texts count as empty; statistics alone reach the driver. Without rows
    every score is a half.
    """
    ids = texts(labels, "doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held))
    some = bounded_sample(ids, "doc_id", sample, "quality")
    known = texts(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "doc_id", (F.col("quality") > 0).cast("double").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in rows_of(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "doc_id", "y"])

    rows = known.mapInArrow(run, "x array<double>, doc_id long, y double").toPandas().sort_values(["doc_id", "y"])
    if not len(rows):
        inner = 2**DEPTH - 1
        return Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    return grow(np.array(rows["x"].tolist()), rows["y"].to_numpy())


def scores(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from its whole text; null text is scored as an empty one.

    Repeated rows and rows without an id give a row each, equal texts the same score; an empty table gives none; other
    columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                x = np.array([statistics(t) for t in rows_of(b, "text")])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.score(x))], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scores(docs, fit(docs, labels)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

"""Language identification by a small byte convolutional network.

A lowered text is cut into windows of 256 UTF-8 bytes, the last one filled with bytes 0. Filters of widths 2, 3 and 4
over bytes, each pooled to its maximum in the window, feed a softmax over the learned languages. The network is trained
in numpy by Adam on windows of a bounded sample of labelled documents; where filters pool, only the bytes under the
maximum get gradient. Applied, filters are sums of tables indexed by pairs of bytes, and a document's probabilities are
the mean of its windows', weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, filtered, fold, texts

#: Labelled documents learned from at most, windows of each; window, filter widths and filters of each width.
SAMPLE, PER_DOCUMENT = 3_000, 2
LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 8
UNDECIDED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of bytes, bytes in each) of a whole text; no text, no window."""
    data = text.lower().encode()
    n = -(-len(data) // LENGTH)
    x = np.zeros(n * LENGTH, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, LENGTH)
    if n:
        sizes[-1] = len(data) - (n - 1) * LENGTH
    return x.reshape(n, LENGTH), sizes


@dataclass
class Network:
    """languages, and the weights: for each width a table (width, 256, filters), then the dense layer."""

    languages: tuple[str, ...]
    filters: tuple[np.ndarray, ...] = ()
    dense: np.ndarray | None = None
    bias: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """The filters summed over pairs of bytes: width 2, the first two of width 3, both halves of width 4."""
        f2, f3, f4 = self.filters
        both = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        return both(f2[0], f2[1]), both(f3[0], f3[1]), both(f4[0], f4[1]), both(f4[2], f4[3])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The languages' probabilities for each window."""
        pairs = self.tables
        out = np.empty((len(x), len(self.languages)))
        for at in range(0, len(x), 256):
            w = x[at : at + 256]
            p = w[:, :-1].astype(np.int32) * 256 + w[:, 1:]
            two = pairs[0][p].max(1)
            three = (pairs[1][p[:, :-1]] + self.filters[1][2][w[:, 2:]]).max(1)
            four = (pairs[2][p[:, :-2]] + pairs[3][p[:, 2:]]).max(1)
            z = np.maximum(np.hstack([two, three, four]), 0) @ self.dense + self.bias
            e = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 256] = e / e.sum(1, keepdims=True)
        return out


def train(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """The network for windows x and their languages' numbers y."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            b, rows = x[own], np.arange(len(own))
            pooled, peaks = [], []
            for w, table in zip(WIDTHS, params, strict=False):
                conv = sum(table[j][b[:, j : LENGTH - w + 1 + j]] for j in range(w))
                peak = conv.argmax(1)
                peaks.append(peak)
                pooled.append(np.take_along_axis(conv, peak[:, None, :], 1)[:, 0])
            h = np.hstack(pooled)
            a = np.maximum(h, 0)
            z = a @ params[3] + params[4]
            e = np.exp(z - z.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            p[rows, y[own]] -= 1
            p /= len(own)
            grads = [np.zeros_like(q) for q in params]
            grads[3], grads[4] = a.T @ p, p.sum(0)
            back = (p @ params[3].T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(grads[i][j], (b[rows[:, None], peaks[i] + j], np.arange(FILTERS)[None, :]), g)
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(languages, tuple(params[:3]), params[3], params[4])


def fit(docs: DataFrame, sample: int = SAMPLE, modulus: int = 4, held: int = 2) -> Network:
    """The network from documents with a language outside of the held-out fold: at most about `sample`, by a hash of the id.

    From each, PER_DOCUMENT windows at places that a hash of the id picks anywhere in the text. Texts without letters
    teach nothing. Without any labelled row there is no language, and every prediction is undecided.
    """
    known = texts(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held))
    some = bounded_sample(known, "doc_id", sample, "language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lang, place in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if _LETTER.search(t := text.as_py()):
                    x, _ = windows(t)
                    out += [(x[(place + k * 7919) % len(x)].tobytes(), lang) for k in range(min(PER_DOCUMENT, len(x)))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], ["window", "lang"])

    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.lit(1 << 40))
    rows = some.select("text", F.col("lang").cast("string"), place.alias("place")).mapInArrow(run, "window binary, lang string").orderBy("lang", "window").toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    if not languages:
        return Network(())
    x = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, LENGTH)
    return train(x, np.searchsorted(languages, rows["lang"].to_numpy()), languages)


def guess(batch: list[str | None], net: Network) -> tuple[list[str], list[float]]:
    """(language, probability) of each whole text; undecided, at 0, where there is no letter or nothing was learned."""
    decided = [i for i, t in enumerate(batch) if t and net.languages and _LETTER.search(t)]
    langs, scores = [UNDECIDED] * len(batch), [0.0] * len(batch)
    held, size = [], 0
    for n, i in enumerate(decided):
        held.append((i, *windows(batch[i])))
        size += len(held[-1][2])
        if size < 4096 and n + 1 < len(decided):
            continue
        p = net.predict(np.vstack([x for _, x, _ in held])) * np.concatenate([s for *_, s in held])[:, None]
        begins = np.cumsum([0] + [len(s) for *_, s in held[:-1]])
        for (j, _, s), total in zip(held, np.add.reduceat(p, begins), strict=True):
            langs[j], scores[j] = net.languages[int(total.argmax())], min(1.0, float(total.max() / s.sum()))
        held, size = [], 0
    return langs, scores


def predictions(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text, however long.

    Null, empty and letterless texts are undecided at 0; of equal probabilities the first language in order is taken.
    Repeated rows and rows without an id give a row each; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                langs, scores = guess(b.column(1).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows whose language is decided with at least probability `least`, all columns as they are, repeated rows too.

    Rows with null, empty or letterless text go, and a probability equal to `least` stays; of equal probabilities the
    first language counts; an empty table gives none; columns may have any names.
    """
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                langs, scores = guess(b.column(at_text).to_pylist(), net)
                yield b.filter(pa.array([g != UNDECIDED and s >= least for g, s in zip(langs, scores, strict=True)], pa.bool_()))

    return filtered(docs, run)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return predictions(docs, fit(docs)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

"""Toxicity from a learned lexicon, matched through Levenshtein automata on a trie.

Labelled documents give the lexicon: words, and stems of word families, that a surely larger share of toxic documents
than of others has outside of quotations. All of them are terms of one trie, and the automaton that accepts what is one edit away from
a word of it is intersected with the trie on the fly (states are sets of trie nodes with the edits spent, kept once
made); nothing else finds a term in a text. Words of five letters and more may be misspelled by an edit, unless clean
documents use the misspelling as a word of its own; shorter words and stems are matched as they are, a stem at the
beginning of a word. A match counts as quoted if it stands within quotation marks or close behind a reporting word,
else as abuse; counts, densities and the densest window of words feed a logistic regression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, filtered, fold, shared_root, texts

#: Labelled documents learned from at most; terms of each kind at most; words in a context window; chunks remembered.
SAMPLE, TERMS, WINDOW, REMEMBERED = 12_000, 300, 25, 150_000
#: Lengths of stems; letters from which a word may be misspelled; the least log odds, and the errors taken off them.
STEMS, FUZZY, SURE, ERRORS = range(4, 10), 5, 1.5, 1.64
_TRIM = "\"'“”„«»‹›‘’.,;:!?()[]{}<>|*#%&$-–—…_~/\\=+"
_OPEN, _CLOSE = "\"“„«‹", "\"”“»›"
#: Words that introduce someone else's words.
REPORTING = frozenset("said says say wrote writes called calls quoted quotes quote word words term terms dit disait écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())


def quotation(chunks: list[str]) -> list[bool]:
    """For each chunk whether it stands in quotation marks that close within 60 words."""
    inside, opened = [False] * len(chunks), None
    for i, c in enumerate(chunks):
        if opened is None and c[0] in _OPEN and len(c) > 1:
            opened = i
        end = c.rstrip(".,;:!?")[-1:]
        if opened is not None and end and end in _CLOSE and (i > opened or len(c) > 2):
            inside[opened : i + 1] = [True] * (i + 1 - opened)
            opened = None
        elif opened is not None and i - opened > 60:
            opened = None
    return inside


def is_quoted(chunks: list[str], inside: list[bool], i: int) -> bool:
    """Whether the chunk at i is quoted: within quotation marks or close behind a reporting word."""
    return inside[i] or any(chunks[j].strip(_TRIM) in REPORTING for j in range(max(0, i - 3), i))


def _terms(chunks: list[str]) -> set[str]:
    """What a document says in its own voice: its words, and the beginnings of words as stems, marked by a star."""
    inside = quotation(chunks)
    distinct = {w.strip(_TRIM) for i, w in enumerate(chunks) if not is_quoted(chunks, inside, i)}
    distinct.discard("")
    return distinct | {w[:n] + "*" for w in distinct if len(w) <= 40 for n in STEMS if len(w) > n}


@dataclass
class Automaton:
    """Finds the terms that a word is, starts with (terms that end in a star), or is one edit away from.

    The trie has two roots: below the first are words that may be misspelled, walked with an edit to spare; below the
    second short words and stems, walked without. match() gives the smallest number of a term, exact ones first.
    """

    terms: tuple[str, ...]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}, {}])
    ends: dict[int, int] = field(default_factory=dict)
    stems: dict[int, int] = field(default_factory=dict)
    states: dict[tuple, int] = field(default_factory=dict)
    sets: list[tuple] = field(default_factory=list)
    steps: list[dict[str, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for i, term in enumerate(self.terms):
            word = term.removesuffix("*")
            node = 0 if word == term and len(word) >= FUZZY else 1
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.ends if word == term else self.stems)[node] = i
        self.state({(0, 0), (1, 1)}, None)

    def state(self, pairs: set[tuple[int, int]], stem: int | None) -> int:
        """The number of a set of (node, edits), closed under leaving out a term's next letter, and the stem met so far."""
        closed = pairs | {(child, 1) for node, e in pairs if e == 0 for child in self.children[node].values()}
        stem = min((self.stems[n] for n, _ in closed if n in self.stems), default=stem) if stem is None else stem
        key = (frozenset(closed), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def step(self, at: int, c: str) -> int:
        """The state after c, -1 if none."""
        after = self.steps[at].get(c)
        if after is None:
            pairs, (before, stem) = set(), self.sets[at]
            for node, e in before:
                if c in self.children[node]:
                    pairs.add((self.children[node][c], e))
                if e == 0:
                    pairs.add((node, 1))
                    pairs |= {(child, 1) for child in self.children[node].values()}
            after = self.steps[at][c] = self.state(pairs, stem) if pairs or stem is not None else -1
        return after

    def match(self, word: str) -> tuple[int, int]:
        """(term's number, edits); (-1, 0) if none."""
        at = 0
        for c in word:
            at = self.step(at, c)
            if at < 0:
                return -1, 0
        pairs, stem = self.sets[at]
        exact = [self.ends[n] for n, e in pairs if n in self.ends and (e == 0 or self.terms[self.ends[n]] == word)]
        if exact or stem is not None:
            return min([*exact, *([stem] if stem is not None else [])]), 0
        near = [self.ends[n] for n, _ in pairs if n in self.ends]
        return (min(near), 1) if near else (-1, 0)


@dataclass
class Model:
    """Lexicon and weights: a term's log odds ratio (stems end in a star); allowed are variants that clean text uses."""

    terms: dict[str, float]
    allowed: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    prior: float = 0.0

    def __post_init__(self) -> None:
        self.names = tuple(sorted(self.terms))
        self.reset()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.reset()

    def reset(self) -> None:
        self.automaton, self.known = Automaton(self.names), {}

    def look_up(self, chunk: str) -> tuple[int, float]:
        """(kind, weight): 0 no match, 1 a term, 2 a misspelled term."""
        word = chunk.strip(_TRIM)
        i, edits = self.automaton.match(word)
        got = (0, 0.0) if i < 0 or edits and (len(word) < FUZZY - 1 or word in self.allowed) else (1 + edits, self.terms[self.names[i]])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(chunk) <= 64:
            self.known[chunk] = got
        return got

    def features(self, text: str) -> list[float]:
        """Abuse, quoted and misspelled matches by weight, their number by 100 words, the densest window, distinct terms."""
        chunks = text.lower().split()
        known, hits, quoted = self.known, [], []
        for i, c in enumerate(chunks):
            kind, weight = known.get(c) or self.look_up(c)
            if kind:
                hits.append((i, kind, weight))
        if not hits:
            return [0.0] * 6
        abuse = quote = misspelled = 0.0
        places, distinct = [], set()
        inside = quotation(chunks)
        for i, kind, weight in hits:
            if is_quoted(chunks, inside, i):
                quote += weight
                quoted.append(i)
                continue
            if kind == 2:
                misspelled += weight
            abuse += weight
            places.append(i)
            distinct.add(chunks[i].strip(_TRIM))
        densest = max((b - a for a, b in zip(range(len(places)), np.searchsorted(places, np.array(places) + WINDOW), strict=True)), default=0)
        return [float(np.log1p(abuse)), float(np.log1p(quote)), float(np.log1p(misspelled)), min(5.0, 100 * len(places) / len(chunks)), float(np.log1p(densest)), float(np.log1p(len(distinct)))]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[1:] + self.weights[0], -30, 30)))


def _counted(docs: DataFrame, pick) -> DataFrame:
    """(term, toxic, n): in how many of the labelled documents each of `pick`'s terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counts.update((t, toxic) for t in pick((text.as_py() or "").lower().split()))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts]), pa.array([x for _, x in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "toxic", "n"])

    return docs.select("text", F.col("toxic").cast("int")).mapInArrow(run, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression, by Newton's steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lexicon(counted: list[tuple[str, float, float]], bad: int, good: int) -> dict[str, float]:
    """The terms among (word or stem with a star, toxic documents, other documents), with their log odds ratios.

    A term's odds count less `ERRORS` standard errors. A stem stands for a family of words: one of its words that has
    half of the stem's documents is a term by itself instead, and of nested stems the best one stays, the longest on
    ties. Words of a family that is in by its stem are not listed again.
    """
    odds = {t: float(np.log(((b + 0.5) / (bad + 1)) / ((g + 0.5) / (good + 1)))) for t, b, g in counted}
    sure = {t: odds[t] - ERRORS * np.sqrt(1 / (b + 0.5) + 1 / (g + 0.5)) for t, b, g in counted}
    docs = {t: b for t, b, _ in counted}
    best = sorted((t for t in odds if sure[t] > SURE), key=lambda t: (-sure[t] * np.sqrt(docs[t]), -len(t), t))
    words, heads = [t for t in best if not t.endswith("*")], Counter()
    for w in words:
        for n in range(1, len(w) + 1):
            heads[w[:n]] = max(heads[w[:n]], docs[w])
    stems: list[str] = []
    for t in best:
        stem = t[:-1]
        if t.endswith("*") and len(stems) < TERMS and heads[stem] < docs[t] / 2 and not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            stems.append(stem)
    words = [w for w in words if not any(w.startswith(s) for s in stems)][:TERMS]
    return {t: odds[t] for t in [*words, *(s + "*" for s in stems)]}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = 5, held: int = 0) -> Model:
    """A model from labelled documents outside of the held-out fold: at most about `sample`, chosen by a hash of the id.

    Rows without text or label are left out, an id with several labels has the largest; without both classes the score
    is the classes' share (0 if no rows). Document frequencies are counted by Spark; candidates for the lexicon (the
    most telling words and stems, a bounded number of each) and features of the sample reach the driver.
    """
    ids = texts(labels, "doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held))
    some = bounded_sample(ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", sample, "toxicity")
    known = texts(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    shared_root(docs.sparkSession)
    known = known.checkpoint()
    counted = lambda: {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sizes = counted()
    if sum(sizes.values()) > 2 * sample:  # a few ids that hold many texts
        known = known.limit(2 * sample).checkpoint()
        sizes = counted()
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model({}, prior=bad / max(1, bad + good))
    counts = _counted(known, _terms).groupBy("term").pivot("toxic", [0, 1]).agg(F.sum("n")).fillna(0).select("term", F.col("0").alias("g"), F.col("1").alias("b"))
    odds = F.log(((F.col("b") + 0.5) / (bad + 1)) / ((F.col("g") + 0.5) / (good + 1))) - ERRORS * F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("g") + 0.5))
    telling = counts.filter((F.col("b") >= max(5, bad // 80)) & (odds > SURE)).withColumn("w", odds * F.sqrt("b"))
    kinds = [telling.filter(F.col("term").endswith("*") == star).orderBy(F.desc("w"), "term").limit(8 * TERMS) for star in (False, True)]
    model = Model(lexicon([(r.term, r.b, r.g) for k in kinds for r in k.collect()], bad, good))

    def variants(chunks: list[str]) -> set[str]:
        return {w for w in {w.strip(_TRIM) for w in chunks} if model.automaton.match(w)[1]}

    clean = _counted(known.filter("toxic = 0"), variants)
    model.allowed = frozenset(r.term for r in clean.select("term").distinct().collect())
    rows = known.select("text", "toxic").mapInArrow(_scored(model, raw=True), "x array<double>, toxic int").toPandas()
    model.weights = fit_logistic(np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float))
    model.reset()
    return model


def _scored(model: Model, raw: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, len(whole)), 1000):
                b = whole.slice(at, 1000)
                text = b.column(b.schema.get_field_index("text"))
                x = [model.features(t.as_py() or "") for t in text]
                if raw:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])
                else:
                    keep = [c for c in b.schema.names if c != "text"]
                    yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(model.score(np.array(x).reshape(-1, 6)))], [*keep, "score"])

    return run


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the toxicity of each row's whole text; null and empty texts are scored as texts without matches.

    Every row gives one, repeated ones and rows without an id too, equal texts the same score; an empty table gives none.
    Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double")


def keep_civil(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows whose score is below `limit`, all columns as they are, repeated rows too.

    Null and empty texts are scored as texts without matches; a score equal to `limit` goes; an empty table gives no
    rows; columns may have any names.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                x = [model.features(t.as_py() or "") for t in b.column(names.index("text"))]
                yield b.filter(pa.array(model.score(np.array(x).reshape(-1, 6)) < limit))

    return filtered(docs, run)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scores(docs, fit(docs, labels)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

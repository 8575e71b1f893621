"""Perplexity from Brown's class-based bigrams.

Tokens are lowered words and one end a text. Exchange clustering assigns the most frequent words, and buckets of all
other words by a hash of their last three bytes, to classes: each in turn moves to the class that raises the bigram
likelihood of classes most, until none moves. Then every other word that is seen `LEAST` times is assigned to its best
class by the same rule, from the classes that its neighbours in the corpus have, so that the vocabulary with classes of
its own grows with the corpus. Rarer and unseen words keep their bucket's class. A token's probability is that of its
class after the one before, times that of its word in the class (for words in buckets, of the bucket in the class and
of the word in its bucket); class transitions are counted with the final classes and smoothed towards class shares,
words in a bucket by add-one with a place for an unseen one.

Spark counts words, pairs and neighbours over all training texts. The driver holds the pair matrix of the first
clustering, whose size is fixed, and a bounded table of frequent words' counts and classes; counts and classes of all
other words meet their texts in a join on the word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, rows_of, texts, written

#: Words that are clustered first, buckets for the others, classes; words whose counts and classes every task gets.
FREQUENT, BUCKETS, CLASSES, COUNTED = 700, 323, 48, 1 << 16
#: How often a word is seen that gets a class of its own. Columns of a word's neighbours: classes before, classes after, itself.
LEAST, SIDES = 10, 2 * CLASSES + 1
END = FREQUENT + BUCKETS
SYMBOLS = END + 1
#: Weight of class shares in a transition, and of each symbol in a class; words counted before a task lets go of them.
PULL, FLOOR, HELD = 20.0, 0.5, 250_000
#: Bits of the table that tells words seen `LEAST` times from most of the rarer ones.
SLOTS = 1 << 24


class Symbols(dict):
    """word -> symbol number; remembers a bounded number of words beyond the frequent ones."""

    def __init__(self, frequent: list[bytes]):
        super().__init__()
        self.frequent = {w: i for i, w in enumerate(frequent)}
        self.update(self.frequent)

    def __missing__(self, word: bytes) -> int:
        symbol = FREQUENT + bucket_of(word)
        if len(self) < HELD:
            self[word] = symbol
        return symbol

    def of(self, words: list[bytes]) -> np.ndarray:
        """The text's symbols between two ends."""
        return np.array([END, *map(self.__getitem__, words), END], np.int64)


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


class Codes(dict):
    """word -> its place among `words`, or len(words) plus its bucket; remembers a bounded number of other words.

    With `marks` (see `often_marks`), other words that have a mark get their bucket's code plus BUCKETS.
    """

    def __init__(self, words: list[bytes], marks: np.ndarray | None = None):
        super().__init__((w, i) for i, w in enumerate(words))
        self.n, self.marks = len(words), marks

    def __missing__(self, word: bytes) -> int:
        code = self.n + bucket_of(word)
        if self.marks is not None:
            slot = zlib.crc32(word) % SLOTS
            if self.marks[slot >> 3] >> (slot & 7) & 1:
                code += BUCKETS
        if len(self) < self.n + HELD:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the column text of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in rows_of(b, "text"):
                counts.update(t.lower().split())
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def pair_counts(rows: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """How often each symbol follows each, in the texts of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, total, held, size = Symbols(frequent), np.zeros(SYMBOLS * SYMBOLS, np.int64), [], 0
        for b in batches:
            for t in rows_of(b, "text"):
                s = symbols.of(t.lower().split())
                held.append(s[:-1] * SYMBOLS + s[1:])
                size += len(s)
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        if len(at := np.flatnonzero(total)):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["pair", "n"])

    counts = rows.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS * SYMBOLS)
    out[counts["pair"].to_numpy()] = counts["n"].to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gains(m: np.ndarray, r: np.ndarray, c: np.ndarray, own: float) -> np.ndarray:
    """By how much each class's taking a word raises the likelihood; m counts classes without it, r follow it, c precede it."""
    f, rows, cols = _xlogx(m), m.sum(1), m.sum(0)
    gain_r, gain_c = _xlogx(m + r) - f, _xlogx(m + c[:, None]) - f
    d = np.diag(m)
    gain = gain_r.sum(1) - np.diag(gain_r) + gain_c.sum(0) - np.diag(gain_c) + _xlogx(d + r + c + own) - np.diag(f)
    gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(cols + c.sum() + own) - _xlogx(cols)
    gain[0] = -np.inf
    return gain


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 8) -> np.ndarray:
    """Each symbol's class, by the exchange algorithm; the last symbol (the end) keeps class 0 to itself."""
    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight[:-1], kind="stable")
    cls = np.zeros(n, np.int64)
    cls[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.eye(classes)[cls]
    after, before = pairs @ member, member.T @ pairs  # (symbol, class that follows), (class before, symbol)
    m = member.T @ after
    for _ in range(rounds):
        moved = 0
        for w in order[weight[order] > 0]:
            a, own = cls[w], pairs[w, w]
            r, c = after[w].copy(), before[:, w].copy()
            r[a] -= own
            c[a] -= own
            m[a] -= r
            m[:, a] -= c
            m[a, a] -= own
            np.maximum(m, 0, out=m)
            gain = _gains(m, r, c, own)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b] += r
            m[:, b] += c
            m[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[a] -= pairs[w]
                before[b] += pairs[w]
        if not moved:
            break
    return cls


@dataclass
class Model:
    """What every task needs of the corpus, all of bounded size; codes are those of Codes(list(counted))."""

    counted: dict[bytes, int]
    classes: np.ndarray  # code: its class
    emit: np.ndarray  # code: log10 of the word in its class; of its bucket in the class, less the bucket's denominator
    total: np.ndarray  # class: log10 of the weight of its words
    ends: int
    tokens: int
    distinct: int


def most_counted(counts: DataFrame, most: int = COUNTED) -> tuple[dict[bytes, int], Column]:
    """At most `most` words with the largest counts, most frequent first (ties by word), and the condition that picks them.

    Words are tallied by a sixteenth of the count's binary logarithm, so that no sort of all words is needed. Steps are
    taken whole from the top; of the first one that no longer fits, a hash of the word picks as large a share as does.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    held, chosen = 0, F.lit(False)
    for r in steps:
        if held + r.n > most:
            share = (most - held - 3 * math.sqrt(most - held)) / r.n
            if share > 0:
                chosen = chosen | ((step == r.step) & (F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(share * (1 << 40))))
            break
        held += r.n
        chosen = step >= r.step
    rows = counts.filter(chosen).collect()
    return {r.word.encode(): int(r.c) for r in sorted(rows, key=lambda r: (-r.c, r.word))}, chosen


def often_marks(tail: DataFrame) -> np.ndarray:
    """Bytes of SLOTS bits, set at the hashes of tail's words that are seen `LEAST` times; the table's size is fixed.

    A rarer word may share a bit; it only costs its way to `assigned`, which counts it and leaves it out.
    """
    slot = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(SLOTS))
    rows = tail.filter(F.col("c") >= LEAST).select(F.shiftright(slot, 3).alias("at"), F.call_function("shiftleft", F.lit(1), F.pmod(slot, F.lit(8)).cast("int")).alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    marks = np.zeros(SLOTS >> 3, np.uint8)
    marks[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    return marks


def neighbours(train: DataFrame, words: list[bytes], first: np.ndarray, low: int, often: int | None = None, marks: np.ndarray | None = None) -> DataFrame:
    """(word, id, sides, times): which classes stand beside a word and how often, one row for each task and word or more.

    Side c is class c before the word, CLASSES + c class c after it, 2 * CLASSES that it follows itself. Words with
    codes from `low` up to `often` come by their code as id, words with a mark that are not among `words` by themselves;
    all others are seen too seldom for a class of their own. Without `often` and `marks` no word is. `first`: code -> class. sides are unsigned bytes, times unsigned 32-bit numbers.
    """
    n = len(words)
    often = n if often is None else often
    marks = np.full(SLOTS >> 3, 255, np.uint8) if marks is None else marks
    first = np.concatenate((first, first[n:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total, held, size, local = Codes(words, marks), np.zeros((often - low) * SIDES, np.int32), [], 0, {}

        def rows(keys: np.ndarray, times: np.ndarray, by: pa.Array, by_id: bool) -> pa.RecordBatch:
            """One row for each word among keys (ascending; place in `by` times SIDES plus side)."""
            word, side = keys // SIDES, (keys % SIDES).astype(np.uint8)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            each = np.diff(np.append(begin, len(word)))
            named = by.take(pa.array(word[begin]))
            none = pa.nulls(len(begin), pa.string() if by_id else pa.int64())
            return pa.RecordBatch.from_arrays([none if by_id else named, named if by_id else none, packed(side, each), packed(times.astype(np.uint32), each)], ["word", "id", "sides", "times"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, local
            keys, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            known = int(np.searchsorted(keys, len(total)))
            total[keys[:known]] += times[:known].astype(np.int32)
            if local:
                yield rows(keys[known:] - len(total), times[known:], pa.array(list(local), pa.binary()).cast(pa.string()), False)
            held, size, local = [], 0, {}

        for b in batches:
            for t in rows_of(b, "text"):
                tokens = t.lower().split()
                code = codes.of(tokens)
                around = np.concatenate(([0], first[code], [0]))
                own = np.where(code < often, code - low, -1)
                for i in np.flatnonzero(code >= n + BUCKETS).tolist():
                    own[i] = often - low + local.setdefault(tokens[i], len(local))
                same = (code[1:] == code[:-1]) & (code[1:] < n)
                alone = np.concatenate(([False], same))[: len(code)], np.concatenate((same, [False]))[: len(code)]
                wanted = own >= 0
                for side, itself in ((around[:-2], alone[0]), (around[2:] + CLASSES, alone[1])):
                    held.append((own * SIDES + side)[wanted & ~itself])
                held.append((own * SIDES + 2 * CLASSES)[wanted & alone[0]])
                size += 2 * len(code)
                if size > 1_000_000 or len(local) > HELD:
                    yield from flush()
        yield from flush()
        found = np.flatnonzero(total)
        for part in np.array_split(found, max(1, len(found) >> 18)) if len(found) else ():
            yield rows(part, total[part], pa.array(np.arange(low, often)), True)

    return train.select("text").mapInArrow(run, "word string, id long, sides binary, times binary")


def best_classes(m: np.ndarray, own_class: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word (row of n, by side) by `_gains`, for many words at once; m counts all words where they are.

    Entries of the class table that a word doesn't touch gain nothing, so only the sides it has are looked at.
    """
    rows = np.arange(len(n))
    c, r, own = n[:, :CLASSES], n[:, CLASSES:-1], n[:, -1]
    gain = np.zeros((len(n), CLASSES))
    for mine, other, table in ((r, c, m.T), (c, r, m)):  # what follows the word, then what precedes it
        w, side = np.nonzero(mine)
        if not len(w):
            continue
        x, e = mine[w, side], np.arange(len(w))
        without = table[side]
        without[e, own_class[w]] -= x
        at_own = np.flatnonzero(side == own_class[w])
        without[at_own] -= other[w[at_own]]
        without[at_own, side[at_own]] -= own[w[at_own]]
        np.maximum(without, 0, out=without)
        more = _xlogx(without + x[:, None]) - _xlogx(without)
        more[e, side] = 0
        begin = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[begin]] += np.add.reduceat(more, begin)
    d, before, after = np.tile(np.diag(m), (len(n), 1)), m.sum(1) - c, m.sum(0) - r
    d[rows, own_class] -= r[rows, own_class] + c[rows, own_class] + own
    before[rows, own_class] -= r.sum(1) + own
    after[rows, own_class] -= c.sum(1) + own
    for x in (d, before, after):
        np.maximum(x, 0, out=x)
    gain += _xlogx(d + r + c + own[:, None]) - _xlogx(d)
    gain -= _xlogx(before + (r.sum(1) + own)[:, None]) - _xlogx(before) + _xlogx(after + (c.sum(1) + own)[:, None]) - _xlogx(after)
    gain[:, 0] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[rows, best] > gain[rows, own_class] + 1e-9, best, own_class)


def flat(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, number in each row) of a column of packed numbers."""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1]
    many = int(at[-1] - at[0]) // kind().itemsize
    return np.frombuffer(data, kind, many, at[0]) if many else np.zeros(0, kind), np.diff(at) // kind().itemsize


def packed(values: np.ndarray, each: np.ndarray) -> pa.Array:
    """A column of packed numbers, `each` of them in a row."""
    edges = np.concatenate(([0], np.cumsum(each))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(values.tobytes())])


def assigned(near: DataFrame, m: np.ndarray, words: list[bytes], cls: np.ndarray) -> DataFrame:
    """(word, id, class): the best class of each word seen `LEAST` times, as exchange would move it from its bucket's.

    All are judged from the same counts `m`. A word's rows, at most a few for each task, are sorted to stand together
    and summed as they stream by.
    """

    def judged(word: list[str | None], i: list[int | None], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(n[:, :CLASSES].sum(1) + n[:, -1] >= LEAST)
        for at in range(0, len(seen), 500):
            some = seen[at : at + 500].tolist()
            a = np.array([cls[FREQUENT + bucket_of(words[i[k]] if word[k] is None else word[k].encode())] for k in some], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([word[k] for k in some], pa.string()), pa.array([i[k] for k in some], pa.int64()), pa.array(best_classes(m, a, n[some]), pa.int64())], ["word", "id", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros((0, SIDES))  # the last word so far, whose rows may go on
        for b in batches:
            if not len(b):
                continue
            ids = b.column(1).fill_null(-1).to_numpy()
            names = b.column(0).dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (ids[1:] != ids[:-1]))))
            word, i = b.column(0).take(pa.array(begin)).to_pylist(), b.column(1).take(pa.array(begin)).to_pylist()
            side, each = flat(b.column(2), np.uint8)
            times, _ = flat(b.column(3), np.uint32)
            place = np.repeat(np.searchsorted(begin, np.arange(len(b)), "right") - 1, each)
            n = np.bincount(place * SIDES + side, times, len(begin) * SIDES).reshape(-1, SIDES)
            if key == (word[0], i[0]):
                n[0] += sums[0]
            elif key is not None:
                yield from judged([key[0]], [key[1]], sums)
            yield from judged(word[:-1], i[:-1], n[:-1])
            key, sums = (word[-1], i[-1]), n[-1:]
        if key is not None:
            yield from judged([key[0]], [key[1]], sums)

    dealt = near.repartition("word", "id").sortWithinPartitions("word", "id")
    return dealt.mapInArrow(run, "word string, id long, class long")


def fit(train: DataFrame, counts: DataFrame, words: int, distinct: int, ends: int, most: int = COUNTED) -> tuple[Model, DataFrame]:
    """The model of the texts in `train`, whose word counts are `counts` (summing to `words`), and (word, c, class) of all
    words outside of its bounded table; class is null for those that keep their bucket's.
    """
    counted, chosen = most_counted(counts, most)
    known, frequent = list(counted), list(counted)[:FREQUENT]
    pairs = pair_counts(train, frequent)
    cls = exchange(pairs)
    member = np.eye(CLASSES)[cls]
    m = member.T @ pairs @ member
    first = np.array([*cls[: len(frequent)], *[cls[FREQUENT + bucket_of(w)] for w in known[len(frequent) :]], *cls[FREQUENT:END]], np.int64)
    often = sum(c >= LEAST for c in counted.values())
    own = max(len(frequent), often)
    tail = counts.filter(~chosen)
    near = neighbours(train, known, first, len(frequent), own, often_marks(tail))
    found = written(assigned(near, m, known, cls), "lm-classes")
    classes = first.copy()
    for r in found.filter("word is null").collect():
        classes[r.id] = r["class"]
    rest = tail.join(found.filter("word is not null").select("word", "class"), "word", "left")

    weight, n = np.zeros(CLASSES), np.array(list(counted.values()), np.float64)
    np.add.at(weight, classes[:own], n[:own] + FLOOR)
    for r in rest.filter("class is not null").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        weight[r["class"]] += r.n + FLOOR * r.v
    size, bucket = np.zeros((BUCKETS, 2)), F.pmod(F.crc32(F.expr("substring(cast(word as binary), -3, 3)")), F.lit(BUCKETS))
    for r in rest.filter("class is null").groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        size[r.bucket] += r.n, r.v
    for w in known[own:]:
        size[bucket_of(w)] += counted[w], 1
    np.add.at(weight, cls[FREQUENT:END], size[:, 0] + FLOOR)
    weight[0] += ends + FLOOR
    total = np.log10(np.maximum(weight, FLOOR))
    of_bucket = np.log10(size[:, 0] + FLOOR) - total[cls[FREQUENT:END]] - np.log10(size.sum(1) + 1)
    emit = np.concatenate((np.log10(n[:own] + FLOOR) - total[classes[:own]], [of_bucket[bucket_of(w)] + np.log10(counted[w] + 1) for w in known[own:]], of_bucket))
    return Model(counted, classes, emit, total, ends, words + ends, distinct + (ends > 0)), rest


#: Marks a class in a text's classes that the join may replace.
OPEN = 128
FIELDS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, classes binary"


def _parts(model: Model):
    """Scores each text's words as far as the bounded tables go, and lists its classes and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, row = Codes(list(model.counted)), TaskContext.get().partitionId() << 40
        log = np.concatenate((np.log10(np.array(list(model.counted.values()), np.float64) + 1), np.zeros(BUCKETS)))
        denominator, end = float(np.log10(model.tokens + model.distinct + 1)), float(np.log10(model.ends + 1))
        marked = model.classes.astype(np.uint8)
        marked[codes.n :] += OPEN
        for whole in batches:
            for at in range(0, len(whole), 500):
                b, out = whole.slice(at, 500), []
                for doc_id, held_out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), rows_of(b, "text"), strict=True):
                    words = text.lower().split()
                    code, places = codes.of(words), {}
                    others = np.flatnonzero(code >= codes.n)
                    refs = np.array([places.setdefault(words[i], len(places)) for i in others.tolist()], np.int32)
                    known = len(words) - len(others) + (model.ends > 0)
                    base = float(log[code].sum()) + end - (len(words) + 1) * denominator
                    out.append((row, doc_id, held_out, len(words) + 1, known, base, float(model.emit[code].sum()), marked[code].tobytes(), refs.tobytes(), list(places), np.bincount(refs, minlength=len(places)).tolist()))
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                arrays[9] = arrays[9].cast(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "classes", "refs", "words", "times"])

    return run


def _joined(model: Model):
    """Adds to each text what the join found on its other words, and puts their classes in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.counted)
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
                lengths = {x: col[x].value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in ("words", "k")}
                begin = np.cumsum(lengths["words"]) - lengths["words"]  # a text's first word among all texts' other words
                k, c, own, times = (col[x].flatten().to_numpy() for x in ("k", "c", "class", "times"))
                words, row = col["words"].flatten(), np.repeat(np.arange(len(b)), lengths["k"])
                word, rare = begin[row] + k, own < 0
                t, kept = times[word], np.flatnonzero(own >= 0)
                was = model.emit[np.array([n + bucket_of(w) for w in words.take(pa.array(word[kept])).cast(pa.binary()).to_pylist()], np.int64)]
                more = t * np.log10(c + 1.0)
                by_row = lambda x, where: np.bincount(row[where], x, len(b))
                score = by_row(more[rare], rare) + by_row(t[kept] * (np.log10(c[kept] + FLOOR) - model.total[own[kept]] - was), kept)
                new = np.full(len(words), -1)
                new[word] = own
                seq, each = flat(col["classes"], np.uint8)
                refs, of_row = flat(col["refs"], np.int32)
                seq, is_open = seq & (OPEN - 1), seq >= OPEN
                new = new[np.repeat(begin, of_row) + refs]
                seq[is_open] = np.where(new >= 0, new, seq[is_open])
                added = by_row(t, slice(None)).astype(np.int64), by_row(more, slice(None)), score
                sums = [pa.array(col[x].to_numpy(zero_copy_only=False) + y) for x, y in zip(("n_known", "base_score", "score"), added, strict=True)]
                arrays = [*[col[x] for x in ("row", "doc_id", "held_out", "n_tokens")], *sums, packed(seq, each)]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "classes"])

    return run


def _between_ends(classes: bytes) -> np.ndarray:
    return np.frombuffer(b"\0" + classes + b"\0", np.uint8).astype(np.int64)


def transitions(classed: DataFrame) -> np.ndarray:
    """(class, class): log10 of a transition, from the classes of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                s = _between_ends(x)
                total += np.bincount(s[:-1] * CLASSES + s[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["pair", "n"])

    m = np.zeros(CLASSES * CLASSES)
    for r in classed.filter("not held_out").select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        m[r.pair] = r.n
    m = m.reshape(CLASSES, CLASSES)
    share = (m.sum(0) + 1) / (m.sum() + CLASSES)
    return np.log10((m + PULL * share) / (m.sum(1, keepdims=True) + PULL))


def scored(docs: DataFrame, modulus: int = 7, held: int = 2, most: int = COUNTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row.

    The model learns from the whole texts of all rows outside of the held-out fold; null text is an empty one, which
    has its end alone. Rows that share an id are texts of their own, repeated rows too. Without training rows both
    scores come from the smoothing alone. An empty table gives no rows; other columns are not read. Every task gets the
    counts and classes of `most` words; which these are changes no score, since all other words meet theirs in a join.
    """
    rows = texts(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), (fold("doc_id", modulus) == held).alias("held_out"), "text")
    train = rows.filter("not held_out")
    counts = written(word_counts(train), "lm-words")
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model, rest = fit(train, counts, words, distinct, train.count(), most)
    parts = written(rows.mapInArrow(_parts(model), f"{FIELDS}, refs binary, words array<string>, times array<long>"), "lm-parts")
    others = parts.select("row", F.posexplode("words").alias("k", "word")).join(rest, "word").groupBy("row").agg(F.collect_list(F.struct("k", "c", F.coalesce("class", F.lit(-1)).alias("class"))).alias("x"))
    both = parts.join(others, "row", "left").select(*parts.columns, F.col("x.k").alias("k"), F.col("x.c").alias("c"), F.col("x.class").alias("class"))
    classed = written(both.mapInArrow(_joined(model), FIELDS), "lm-classed")
    move = transitions(classed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [float(move[s[:-1], s[1:]].sum()) for s in map(_between_ends, b.column(7).to_pylist())]
            score = pa.array(b.column(6).to_numpy(zero_copy_only=False) + np.array(more), pa.float64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(1, 6)], score], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = classed.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scored(docs)

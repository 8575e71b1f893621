"""Spelling variants: words one error apart, found in forward and backward minimal automata.

Words are near if one inserted, deleted or replaced code point turns one into the other. The error lies in a word's
first half or behind it: a forward automaton (of words) is followed along the first half, a backward one (of reversed
words) along the second half, exactly each, and what is left is completed with one error. The automata are acyclic,
minimal and number their words: each edge holds how many words come before it, so a path's sum is a word's number, at
which its count is found. What the backward automaton finds again, because the first halves agree as well, is left out.

Words meet in cells: a word is filed under its beginnings, and under its ends, of those lengths that a near word's exact
half can have, and asks under its own. A key with very many words is dealt over cells, each of which gets all its
questions; so a cell's automaton is bounded, whatever the words look like.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: Runs of letters (ASCII and U+00C0 to U+00FF); words have this many code points and occurrences at least.
RUN, LETTERS, OCCURRENCES = "[A-Za-zÀ-ÿ]+", 5, 3
#: A word's form is seen this many times as often. One in so many (document, run) pairs loses a code point.
TIMES, THINNED = 2, 97
#: Words filed in a cell, about; words that a task counts before it lets go of them.
CELL, HELD = 20_000, 200_000


class Automaton:
    """The minimal acyclic automaton of distinct words in ascending order; a word's number is its place in that order.

    A node is (whether a word ends here, the words from here on, {character: (node, words before this edge)}).
    """

    def __init__(self, words: list[str]):
        self.nodes: list[tuple[bool, int, dict[str, tuple[int, int]]]] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]  # the last word's nodes, not yet settled
        last = ""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                node = frozen(*path.pop())
                path[-1][1][last[len(path) - 1]] = node

        def frozen(end: list[bool], to: dict[str, int]) -> int:
            key = (end[0], *to.items())
            if (at := known.get(key)) is None:
                before, edges = int(end[0]), {}
                for c, node in to.items():
                    edges[c] = (node, before)
                    before += self.nodes[node][1]
                self.nodes.append((end[0], before, edges))
                at = known[key] = len(self.nodes) - 1
            return at

        for word in words:
            same = 0
            for a, b in zip(word, last):  # noqa: B905
                if a != b:
                    break
                same += 1
            settle(same)
            path += [([False], {}) for _ in range(len(word) - same)]
            path[-1][0][0] = True
            last = word
        settle(0)
        self.root = frozen(*path[0])

    def __len__(self) -> int:
        return self.nodes[self.root][1]

    def follow(self, node: int, number: int, text: str) -> tuple[int, int] | None:
        """Where `text` leads from a node: (node, number so far)."""
        nodes = self.nodes
        for c in text:
            edge = nodes[node][2].get(c)
            if edge is None:
                return None
            node, before = edge
            number += before
        return node, number

    def spelt(self, number: int) -> str:
        """The word of a number."""
        node, out = self.root, []
        while True:
            end, _, edges = self.nodes[node]
            if end and number == 0:
                return "".join(out)
            for c, (to, before) in edges.items():
                if before <= number < before + self.nodes[to][1]:
                    out.append(c)
                    node, number = to, number - before
                    break
            else:
                raise IndexError(number)

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of words that differ from `word` by one code point, behind its first `exact` ones."""
        found: set[int] = set()
        at = self.follow(self.root, 0, word[:exact])
        nodes, follow, length = self.nodes, self.follow, len(word)

        def ends(place: tuple[int, int] | None) -> None:
            if place is not None and nodes[place[0]][0]:
                found.add(place[1])

        i = exact
        while at is not None:
            node, number = at
            edges, c = nodes[node][2], word[i] if i < length else None
            rest = word[i:]
            if c is not None:
                ends(follow(node, number, word[i + 1 :]))
            for d, (to, before) in edges.items():
                if c is None:
                    ends((to, number + before))
                else:
                    below = nodes[to][2]
                    if c in below:
                        ends(follow(to, number + before, rest))
                    if d != c and (i + 1 == length or word[i + 1] in below):
                        ends(follow(to, number + before, word[i + 1 :]))
            if c is None:
                break
            at, i = follow(node, number, c), i + 1
        return found


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thinned: int = THINNED) -> DataFrame:
    """(word, n): the words of at least `LETTERS` code points that come at least `OCCURRENCES` times in whole texts.

    A word is a run of letters, A-Z lowered; where `thinned` divides the crc32 of '<doc_id>:<run>', the run lost the code
    point at the crc32 modulo its length. A null id is written as nothing, a null text has no runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(RUN), Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % thinned == 0:
                        place = h % len(word)
                        word = word[:place] + word[place + 1 :]
                    if len(word) >= LETTERS:
                        held[word] += n
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def filed(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(cell, backward, word, n, filed, asks): each word's places in the cells, of about `cell` filed words at most."""
    length = F.length("word")
    keys = []
    for backward in (False, True):
        text, half = (F.reverse("word"), F.ceil(length / 2)) if backward else (F.col("word"), F.floor(length / 2))
        for near in (length - 1, length + 1):
            size = (F.ceil(near / 2) if backward else F.floor(near / 2)).cast("int")
            keys.append(F.struct(F.lit(backward).alias("backward"), text.substr(F.lit(1), size).alias("key"), (size == half.cast("int")).alias("asks")))
    each = written(words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*"), "variant-keys")
    sizes = each.groupBy("backward", "key").agg(F.count("*").alias("size"))
    cells = max(1, -(-4 * each.count() // (3 * cell)))
    hot = sizes.filter(F.col("size") > cell).withColumn("parts", F.ceil(F.col("size") / cell).cast("int"))
    plain = each.join(hot, ["backward", "key"], "left_anti")
    place = lambda *more: F.concat_ws(":", *more).alias("cell")
    few = plain.select(place(F.pmod(F.xxhash64("backward", "key"), F.lit(cells)).cast("string"), F.col("backward").cast("string")), "backward", "word", "n", F.lit(True).alias("filed"), "asks")
    split = each.join(hot, ["backward", "key"])
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))).alias("part")
    many = split.withColumn("own", own).select("*", every).select(place(F.col("part").cast("string"), F.col("backward").cast("string"), F.col("key")), "backward", "word", "n", (F.col("part") == F.col("own")).alias("filed"), "asks")
    return few.unionByName(many).repartition(cells, "cell")  # a cell is much work for its few bytes


def answered(cell: pa.Table) -> pa.Table:
    """(word, n, n_near, form_n, form) of the words that ask in a cell: near words found here, and the most frequent one.

    Of equally frequent ones, the first by code point. `form` and `form_n` are null where none is near.
    """
    backward = cell["backward"][0].as_py() if len(cell) else False
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    words, ns, files, asks = (cell[c].to_pylist() for c in ("word", "n", "filed", "asks"))
    count = {turn(w): n for w, n, f in zip(words, ns, files, strict=True) if f}
    order = sorted(count)
    automaton, counts, out = Automaton(order), [count[w] for w in order], []
    del order
    for word, n in dict((w, n) for w, n, a in zip(words, ns, asks, strict=True) if a).items():
        half, n_near, best = len(word) // 2, 0, None
        for number in automaton.near(turn(word), len(word) - half if backward else half):
            if backward and turn(automaton.spelt(number))[:half] == word[:half]:
                continue  # the forward automaton finds it
            n_near += 1
            if best is None or counts[number] > -best[0]:
                best = (-counts[number], turn(automaton.spelt(number)))
            elif counts[number] == -best[0]:
                best = min(best, (-counts[number], turn(automaton.spelt(number))))
        out.append((word, n, n_near, -best[0] if best else None, best[1] if best else None))
    return pa.table(list(map(list, zip(*out, strict=True))) or [[]] * 5, schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())]))


def grouped(words: DataFrame, cell: int = CELL, times: float = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct `words` (word, n).

    The form is the most frequent near word, if seen at least `times` as often (more than once as often), and the root is
    where forms lead in the end; a word without form is its own root. Words of a code point or none have no near words
    but those of the same first half, the empty text. An empty table gives no rows.
    """
    found = filed(words, cell).groupBy("cell").applyInArrow(answered, "word string, n long, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    whole = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    ok = -F.col("best.less") >= F.col("n") * times
    whole = written(whole.select("word", "n", "n_near", F.when(ok, F.col("best.form")).alias("form"), F.when(ok, -F.col("best.less")).alias("form_n")), "variant-forms")
    roots = whole.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that are behind a root, and counts at least double at each step
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return whole.join(roots.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    words = written(counted(texts(docs, "doc_id", "text")), "variant-words")
    return grouped(words).select("word", "form", "root", "n", "n_near", "form_n")

"""Collocations, spelling variants and URL rules against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barwright.llm import collocations, url_rules, variants

URLS = [
    "http://a.net/x", "https://net/", "http://a.net", "http://anet/x", "HTTP://A.NET/x?q#f", "http://blog.example.net/en/1", "http://example.net/english", "http://example.net/en/",
    "http://example.com/de/", "http://www.EXAMPLE.com/DE/", "http://x.org/fr/1", "http://org/fr/", "http://xorg/fr/", "no scheme net/", "", None, "://net/a", "http://u://net/", "http:///p",
    "http://x.com:80/de/?a=b", "http://spam-farm.x.com/", "http://free-bets.io?x", "http://spam.io/en/spam-x", "http://é.net/ñ", "http://a.net/en/\nb", "http://www.example.org#net/",
]


def judged(url, rules, default="allow"):
    """(host, path, rule, verdict, pattern) by trying every rule."""
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for layer, verdict, rule, pattern in rules:
        body = pattern.removeprefix("||")
        parts = "".join(".*" if c == "*" else r"(?:^|$|[\x00-/:-@\[-`{-\x7f])" if c == "^" else re.escape(c) for c in body)
        if re.search(("^(?:[^/]*[.])?" if pattern.startswith("||") else "") + parts, host + path, re.DOTALL):
            fits.append((layer, len(pattern), verdict == "block", pattern, rule or "", verdict))
    if not fits:
        return host, path, None, default, None
    *_, pattern, rule, verdict = max(fits)
    return host, path, rule or None, verdict, pattern


RULES = [(1, v, h + p, f"||{h}{p}") for v, h, p in url_rules.RULES] + [(0, v, None, p) for v, p in url_rules.PATTERNS]
OTHER = [(0, "block", "a", "x"), (0, "block", "b", "*.com^"), (0, "allow", "c", "||exa*le.com/d"), (0, "allow", "d", "^en^"), (0, "block", "e", "^en^"), (0, "block", None, "||example.com/de^"), (2, "allow", "f", "80/"), (0, "block", "g", "+(")]


@pytest.mark.parametrize("rules", [RULES, OTHER, RULES + OTHER])
@pytest.mark.parametrize("most", [url_rules.BROADCAST, -1])
def test_url_rules_are_those_of_trying_all(spark, rules, most, monkeypatch):
    monkeypatch.setattr(url_rules.decided, "__defaults__", (most,))
    table = spark.createDataFrame(rules, "layer int, verdict string, rule string, pattern string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0]), (1, URLS[0])], "page_id long, url string")
    found = url_rules.judged(pages, table).select("page_id", "url", "host", "path", "rule", "verdict", "pattern").collect()
    assert len(found) == len(URLS) + 5
    for r in found:
        assert tuple(r)[2:] == judged(r.url, rules), r


def test_url_rules_index_and_odd_tables(spark, sf_dir):
    table = url_rules.rule_table(spark)
    seen = spark.createDataFrame([(t,) for t in ["example"] * 5 + ["com"] * 3 + ["de"] * 4 + ["net"] * 9 + ["en"] * 7], "token string")
    assert {r.pattern: r.token for r in url_rules.indexed(table, seen).collect()} == {
        "||net/": "net", "||example.net/en/": "example", "||example.com/de/": "com", "||org/fr/": "fr",
        "^spam-": "spam", "^casino-": "casino", "^adult-": "adult", "^ads-": "ads", "-bets.": "bets", "-pills.": "pills",
    }
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    clash = pages.withColumns({"row": F.lit(1), "target": F.lit("t"), "token": F.lit("x"), "Host": F.lit("h"), "best": F.lit(0)})
    out = url_rules.judged(clash)
    assert sorted(out.columns) == sorted(["page_id", "url", "html", "row", "target", "token", "best", "host", "path", "rule", "pattern", "verdict"])
    assert {(r.row, r.target, r.token, r.best) for r in out.collect()} == {(1, "t", "x", 0)} and out.count() == pages.count()
    assert url_rules.judged(pages.filter("false")).count() == 0
    assert url_rules.judged(pages, table.filter("false")).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
    long = spark.createDataFrame([("http://a.net/" + "x/" * 200_000,)], "url string")
    assert [r.verdict for r in url_rules.judged(long).collect()] == ["block"]


# ---------------------------------------------------------------- op12
def near_words(words):
    """word -> near words, by letting go of one code point at each place."""
    gaps, found = defaultdict(set), defaultdict(set)
    for w in words:
        gaps[w].add((w, None))
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1 :]].add((w, i))
    for some in gaps.values():
        for a, i in some:
            found[a] |= {b for b, j in some if b != a and (i is None) + (j is None) == 1 or b != a and i is not None and i == j}
    return found


def grouped(n):
    near, form = near_words(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


def word_counts(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def of_rows(found):
    rows = found.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_automaton_numbers_and_is_minimal():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 7))) for _ in range(700)})
    a = variants.Automaton(words)
    assert len(a) == len(words) and [a.spelt(i) for i in range(len(words))] == words
    assert [a.follow(a.root, 0, w)[1] for w in words] == list(range(len(words)))
    with pytest.raises(IndexError):
        a.spelt(len(words))
    ways = {""}
    for _ in range(3):
        ways |= {w + c for w in ways for c in "ab"}
    assert len(variants.Automaton(sorted(w for w in ways if len(w) == 3)).nodes) == 4  # one node a length
    assert len(variants.Automaton([])) == 0 and variants.Automaton([]).near("word", 2) == set()


@pytest.mark.parametrize("cell", [variants.CELL, 40])
def test_variants_of_dense_words(spark, cell):
    rnd = random.Random(5)
    n = {"".join(rnd.choice("abé") for _ in range(rnd.randint(4, 8))): rnd.randint(3, 40) for _ in range(700)}
    n |= {"aaaa" + "".join(rnd.choice("abcdef") for _ in range(4)): rnd.randint(3, 9) for _ in range(300)} | {"a": 3, "ab": 9, "": 4, "b": 5}
    found = of_rows(variants.grouped(spark.createDataFrame(list(n.items()), "word string, n long"), cell))
    want = grouped(n)
    short = {w for w in n if len(w) < 3}  # words too short for a half
    assert {w: r for w, r in found.items() if w not in short} == {w: r for w, r in want.items() if w not in short}


def test_variants_of_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = word_counts((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert of_rows(variants.report(docs)) == grouped(n) and any(r[0] for r in grouped(n).values())


def test_variants_of_odd_rows(spark):
    rows = [(None, "Größe größe GRÖSSE Größe"), (1, None), (2, ""), (3, "größe grösse grösse " * 3 + "×÷×÷×÷ " * 4), (3, "größe"), (4, "abcde " * 60_000 + "abcdf " * 3), (5, "abcd " * 9 + "naïve1naïve_naïve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.withColumns({c: F.lit(1) for c in ("word", "n", "cell", "form", "key", "root")})
    assert of_rows(variants.report(clash)) == grouped(word_counts(rows))
    assert variants.report(docs.filter("false")).count() == 0


# ---------------------------------------------------------------- op11
def phrase_counts(rows, longest):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts, n


def best_phrases(rows, longest=3, least=10, share=50, top=2000):
    counts, n = phrase_counts(rows, longest)
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in some.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in some.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def phrases_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts_of_few_words(seed=7):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["en", "de", None, ""]), "".join(rnd.choice(["a", "bb", "Ccc", "\u00dcx", "x\u00a0y", "\u2028", "z\x00", "A"]) + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", " . ", ""]) for _ in range(rnd.randint(0, 60)))) for _ in range(400)]
    return rows + [("en", None), (None, None), ("xx", ""), ("yy", "one two"), ("en", "the whole phrase stays " * 40_000), ("en", "a." * 50), ("de", "new york city, " * 30)]


@pytest.mark.parametrize(("longest", "least", "share", "top", "bits"), [(3, 10, 50, 2000, None), (3, 10, 50, 2000, 5), (2, 3, 50, 7, 18), (4, 5, 80, 40, 12)])
def test_collocations_are_those_of_counting_all(spark, longest, least, share, top, bits, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 3000)
    rows = texts_of_few_words()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = collocations.collocations(docs, longest=longest, least=least, share=share, top=top, bits=bits)
    want = best_phrases(rows, longest, least, share, top)
    assert phrases_of(found) == want and len(want) > 20


def test_sketch_never_misses_and_is_small(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 2000)
    rows = texts_of_few_words(11)
    docs = spark.createDataFrame([(a or "und", b) for a, b in rows], "lang string, text string").repartition(7)
    bits = 17
    often = collocations.sketched(docs, bits=bits)
    assert often.nbytes == collocations.ROWS * 2**bits // 8
    counts, _ = phrase_counts([(a or "und", b) for a, b in rows], 3)
    passed = missed = rare = 0
    for lang, f in counts.items():
        chunk = collocations.Chunk(lang.encode(), [" ".join(p).encode() for p in f if len(p) == 3])
        for n, places, hashes in chunk.grams(3):
            ok = [all(often[row][c >> 3] >> (7 - (c & 7)) & 1 for row in range(collocations.ROWS) for c in [int(collocations.cell(hashes[i : i + 1], row, bits)[0])]) for i in range(len(places))]
            for i, place in enumerate(places):
                real = f[tuple(chunk.words[x].decode() for x in chunk.ids[place : place + n])] >= 10
                missed += real and not ok[i]
                passed += ok[i] and not real
                rare += not real
    assert missed == 0 and passed < 0.05 * rare


def test_collocations_of_odd_tables(spark):
    docs = spark.createDataFrame(texts_of_few_words()[:200], "lang string, text string")
    clash = docs.withColumns({c: F.lit(1) for c in ("words", "phrase", "f", "rank", "n", "first", "row", "block")})
    assert phrases_of(collocations.report(clash)) == phrases_of(collocations.report(docs)) == best_phrases(texts_of_few_words()[:200])
    assert collocations.report(docs.filter("false")).count() == 0


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    grams = spark.createDataFrame([("en", 1, "a", big + 5), ("en", 1, "b", big + 77), ("en", 2, "a b", big), ("en", 0, "", 4 * big)], "lang string, words int, phrase string, f long")
    assert [r.score for r in collocations.scored(grams).collect()] == [10**6 * big * big // ((big + 5) * (big + 77))]


def test_collocations_hold_little_text_at_once(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 800), pa.array(["ab cd " * 1600] * 800)], ["lang", "text"])  # 7.7 MB
    sizes = [len(chunk.ids) for _, chunk in collocations.chunks(iter([batch]))]
    assert sum(sizes) == 800 * 3200 + 800 - len(sizes) and max(sizes) < 1_000_000
    rows = [(lang, "x y. " * 12) for lang in ("a\nb", "\n", "", None)]
    found = {(r.lang, r.words, r.phrase, r.f) for r in collocations.counted(spark.createDataFrame(rows, "lang string, text string").fillna("und")).collect()}
    assert found == {(lang, *x) for lang in ("a\nb", "\n", "", "und") for x in ((0, "", 24), (1, "x", 12), (1, "y", 12), (2, "x y", 12))}


def random_pieces(seed, n):
    rnd = random.Random(seed)
    some = ["".join(rnd.choice("abcdefghü") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    return [(rnd.choice(["en", "de"]), " ".join(rnd.choice(some) + rnd.choice([""] * 12 + ["."]) for _ in range(rnd.randint(0, 500)))) for _ in range(n)]


def test_counted_phrases_are_shuffled_in_few_bytes(spark):
    rows = random_pieces(3, 400)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4).localCheckpoint()
    spark.sparkContext.setJobGroup("counted", "counted")
    found = {(r.lang, r.phrase): r.f for r in collocations.counted(docs, bits=5).collect()}
    counts, n = phrase_counts(rows, 3)
    assert found == {(lang, " ".join(p)): f for lang, own in counts.items() for p, f in own.items() if f >= 10} | {(lang, ""): f for lang, f in n.items()}
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {k for job in tracker.getJobIdsForGroup("counted") for k in tracker.getJobInfo(job).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(counts["en"]) + len(counts["de"]) > 150_000
    assert 0 < sum(store.lastStageAttempt(k).shuffleWriteBytes() for k in stages) < 12 * sum(map(len, counts.values()))


@pytest.mark.parametrize(("held", "buckets"), [(1, 1), (20_000, 7), (1 << 26, 50)])
def test_counts_do_not_depend_on_what_is_held(held, buckets, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(collocations, "COUNTED", held)
    monkeypatch.setattr(collocations, "CHUNK", 5000)
    rows = random_pieces(5, 40) + [("en", ""), ("fr", ". , "), ("it", "one"), ("it", "é " * 300)]
    often = np.full((collocations.ROWS, 4), 255, np.uint8)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 9], strict=True)], ["lang", "text"]) for i in range(0, len(rows), 9)]
    parts = pa.Table.from_batches(collocations._counts(iter(batches), often, 3, buckets))
    assert set(parts["bucket"].to_pylist()) <= set(range(buckets))
    found = pa.Table.from_batches(collocations._totals(iter(parts.sort_by([("lang", "ascending"), ("bucket", "ascending")]).to_batches(10)), 2)).to_pylist()
    counts, n = phrase_counts(rows, 3)
    want = {(lang, len(p), " ".join(p), f) for lang, own in counts.items() for p, f in own.items() if f >= 2} | {(lang, 0, "", f) for lang, f in n.items() if f}
    assert len(found) == len(want) and {tuple(x[c] for c in ("lang", "words", "phrase", "f")) for x in found} == want

"""The corpus operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barwright.llm import html_extract, langid, lm_classes, media_tar, mixing, packing, phrases, quality, simhash, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(WORDS[(i * i) % 19] for i in range(30_000))
ODD = [
    (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, "   \n\t ", None, None, 6), (3, "One two", "en", "b", 7), (4, "one TWO", "de", "b", 7),
    (5, "Ünïcode — ñandú 😀 b c", "es", "a", 20), (6, LONG, "en", "a", len(LONG)), (7, LONG + " more", "en", None, len(LONG)), (7, LONG + " more", "en", None, len(LONG)),
    (8, "1234 !!! ...", "fr", "c", 12), (None, "no id here", None, "c", 10), (40, "a b c d e f g", "en", "a", 13),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumn("score", F.lit(1)).withColumn("word", F.lit("x")).withColumn("fp", F.lit(0)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2 if i % 5 else None, (i + 1) % 2 if i % 7 else None) for i in range(10)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def empty(df):
    return df.filter(F.lit(False))


# ---------------------------------------------------------------- op1
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A   title</h1><p>First&nbsp;paragraph &amp; <b>bold</b> text that is fairly long,<br>with a break.<p>Second, short.</p>
<form><input>mail</form><div class="ad">Buy!</div><section id="comments"><p>A reader's long comment about all of this, and more and more.</p></section></article>
<aside>More</aside><footer>&copy; all</footer></body></html>"""


def test_html_article():
    assert html_extract.main_text(PAGE) == "A title\n\nFirst paragraph & bold text that is fairly long, with a break.\n\nSecond, short."


LONG_TEXT = "some words of a long text, " * 12


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<form id=f><div><h1>Title here</h1><p>{LONG_TEXT}</p><label>Name</label><input><select><option>One<option>Two</select><button>Go</button></div></form>", ["Title here", LONG_TEXT]),
        ("<form><p>Short article.</p></form>", ["Short article."]),
        (f"<form><p>Subscribe</p><input></form><div><p>{LONG_TEXT}</p></div>", [LONG_TEXT]),
        (f"<form><article><p>{LONG_TEXT}</p></article><label>Find</label><input></form>", [LONG_TEXT]),
        (f"<nav><a href=x>Home</a><a href=y>News</a><div><p>{LONG_TEXT}</p></div>", [LONG_TEXT]),
        (f"<nav><a href=x>Home</a><main><p>{LONG_TEXT}</p></main>", [LONG_TEXT]),
        (f"<nav><a href=x>Home</a><section><p>{LONG_TEXT}</p></section>", [LONG_TEXT]),
        (f"<aside><div><p>{LONG_TEXT}</p></div><footer>All rights</footer>", [LONG_TEXT]),
        (f"<select><option>a<option>b<p>{LONG_TEXT}</p>", [LONG_TEXT]),
        (f"<head><title>T</title><p>{LONG_TEXT}", [LONG_TEXT]),
        (f"<body><dialog><p>{LONG_TEXT}</body>", [LONG_TEXT]),
        (f"<aside>More<article><p>{LONG_TEXT}</p></article></aside>", [LONG_TEXT]),
        (f"<body><header><h1>The title</h1></header><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></body>", ["The title", LONG_TEXT, LONG_TEXT]),
        (f"<body><header><h1>Site</h1><a href=x>Home</a></header><p>{LONG_TEXT}</p></body>", [LONG_TEXT]),
        (f"<article><h1>T</h1><p>{LONG_TEXT}</p><article><p>I do not agree with this at all, dear author, not at all.</p></article></article>", ["T", LONG_TEXT]),
        (f"<article><h1>T</h1><article><p>{LONG_TEXT}</p></article></article>", ["T", LONG_TEXT]),
        ("<nav><a href=x>Home</a></nav><script>var a</script>", []),
        ("<nav>Home", ["Home"]),
    ],
)
def test_html_loses_no_page_to_an_element(html, want):
    assert html_extract.main_text(html) == "\n\n".join(x.strip() for x in want)


def test_html_without_article_and_broken():
    body = "<div class='menu'><a>x</a></div><div><p>" + "long text here. " * 20 + "</p><p>end.</p></div><div><a href=x>link</a> <a href=y>link</a></div>"
    assert html_extract.main_text(body) == ("long text here. " * 20).strip() + "\n\nend."
    assert html_extract.main_text("<![odd[ <p>x") == "x"
    assert html_extract.main_text("<p>open <b>never closed &am") == "open never closed &am"
    assert html_extract.main_text("") == ""


LONG_LINE = "A paragraph of the story that goes on for quite a while, as paragraphs of stories do, and says something. " * 3
PLAIN = f"""<body><div><p><a href=a>Home</a></p><p><a href=b>About us</a></p></div>
<div><h1>The story</h1><p>{LONG_LINE}</p><p>{LONG_LINE}</p><div class="tags"><p>A short block, which is part of it.</p></div><p>{LONG_LINE}</p><blockquote>Short quote.</blockquote><p>{LONG_LINE}</p></div>
<div><b>Also</b>{"<p><i>some</i> <b>other</b> <i>thing</i> <b>that</b> <i>stands</i> <b>aside</b> <i>from</i> <b>stories</b></p>" * 9}</div>
<div class="comments"><p><b>Ann</b> <i>1 May</i><br>{LONG_LINE}</p><p><b>Bob</b> <i>2 May</i><br>{LONG_LINE}</p></div></body>"""
STORY = "\n\n".join(["The story", *[LONG_LINE.strip()] * 2, "A short block, which is part of it.", LONG_LINE.strip(), "Short quote.", LONG_LINE.strip()])


def test_html_ratio_smoothing_and_threshold_decide_without_semantic_elements(monkeypatch):
    assert html_extract.main_text(PLAIN) == STORY
    for name, other in (("ratios", lambda lines: np.full(len(lines), 4.0)), ("smoothed", lambda x, sigma: x), ("halfway", lambda x: -np.inf)):
        with monkeypatch.context() as patch:
            patch.setattr(html_extract, name, other)
            assert html_extract.main_text(PLAIN) != STORY, name


def test_html_names_only_hint_inside_an_article():
    page = "<nav>x</nav><article><h1>Title</h1><p>{0}</p><div class='search-results'><p>{0}</p></div><label>{0}</label><div class='ad'>Buy now!</div><p>{0}</p></article>"
    text = html_extract.main_text(page.format(LONG_LINE))
    assert text == "\n\n".join(["Title", *[LONG_LINE.strip()] * 4])


def test_html_smoothing_and_clusters_against_loops():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40):
        x = rng.exponential(2, n) * (1 + 3 * (rng.random(n) < 0.5))
        for sigma in (1.0, 2.0):
            half = int(3 * sigma)
            want = []
            for i in range(n):
                near = [(np.exp(-0.5 * ((j - i) / sigma) ** 2), x[j]) for j in range(max(0, i - half), min(n, i + half + 1))]
                want.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
            assert np.allclose(html_extract.smoothed(x, sigma), want)
        t = sum(x) / n
        for _ in range(50):
            low, high = [v for v in x if v < t], [v for v in x if v >= t]
            if not low or not high:
                break
            t = (sum(low) / len(low) + sum(high) / len(high)) / 2
        apart = sum(high) / len(high) - sum(low) / len(low) if low and high else 0
        assert html_extract.halfway(x) == (pytest.approx(t, abs=1e-5) if apart >= html_extract.GAP else -np.inf)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9)], "page_id long, url string, html string, n_chars int")
    rows = html_extract.report(pages).collect()
    n = len(html_extract.main_text(PAGE))
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, n), (1, n), (2, 0)]
    assert html_extract.report(empty(pages)).count() == 0
    odd = html_extract.extract(pages.withColumn("a.b", F.lit("x")).withColumn("c0", F.lit(3)))
    assert odd.columns == ["page_id", "url", "a.b", "c0", "text", "n_chars"] and {(r["a.b"], r.c0) for r in odd.collect()} == {("x", 3)}


# ---------------------------------------------------------------- op2
def test_targets():
    assert mixing.targets([100, 50, 10]) == [165.0, 55.0, 20.0]
    assert mixing.targets([0, 10]) == [0.0, 15.0]
    assert sum(mixing.targets([5, 7, 11, 400])) == pytest.approx(1.5 * 423)


def test_permutation_and_deal():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    dealt = mixing.deal([10, 0, 500], 64, 1)
    assert {s: sum(n for _, i, _, n in dealt if i == s) for s in (0, 1, 2)} == {0: 10, 1: 0, 2: 500}
    shard = Counter()
    for s, _, _, n in dealt:
        shard[s] += n
    assert all(n == 64 for s, n in shard.items() if s < max(shard))


def test_mixing(docs):
    rows = mixing.report(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d[0], count(d[1])) for d in ODD)
    by = defaultdict(list)
    for d in ODD:
        by[d[3]].append(count(d[1]))
    size = {s: sum(v) for s, v in by.items()}
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sorted({r.source_size for r in rows}) == sorted(set(size.values()))
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.report(docs.repartition(2)).collect()))
    assert mixing.report(empty(docs)).count() == 0


@pytest.mark.parametrize(("shard_slots", "ranges"), [(1 << 16, 4096), (16, 4096), (16, 3), (5, 1)])
def test_mixing_takes_what_its_slots_hold(docs, shard_slots, ranges):
    mix = mixing.Mix(docs, block_words=8, shard_slots=shard_slots, ranges=ranges)
    slots, rows = mix.slots.collect(), mix.documents.collect()
    by_source, shards = defaultdict(list), Counter(r.shard for r in slots)
    for r in slots:
        by_source[r.source_id].append((r.slot, r.block))
    total = sum(shards.values())
    assert sorted(shards) == list(range(len(shards))) and sorted(shards.values())[1:] == [shard_slots] * (len(shards) - 1)
    assert total == sum(mix.taken_slots) and (ranges > 1 or len(shards) == -(-total // shard_slots))
    held = defaultdict(Counter)
    for source, own in by_source.items():
        n = mix.blocks[source]
        assert sorted(k for k, _ in own) == list(range(mix.taken_slots[source]))
        for turn in range(2):  # a pass takes no block twice
            some = [b for k, b in own if k // n == turn]
            assert len(set(some)) == len(some) and set(some) <= set(range(n))
        held[source] = Counter(b for _, b in own)
    want, ends = Counter(), defaultdict(list)
    for r in rows:
        taken = sum(held[r.source_id][word // 8] for word in range(r.start, r.start + r.size))
        want[(r.doc_id, r.size, taken)] += 1
        ends[r.source_id] += [(r.start, r.start + r.size)] if r.size else []
    assert Counter((r.doc_id, r.size, r.taken) for r in mix.taken().collect()) == want
    for own in ends.values():
        assert [a for a, _ in sorted(own)] == [0, *(b for _, b in sorted(own)[:-1])]


def test_mixing_near_target(corpus):
    rows = mixing.report(corpus).join(corpus.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 0.08 * r.g for r in rows)


def test_mixed_documents(corpus):
    out = mixing.mixed_documents(corpus)
    assert out.columns == corpus.columns
    words = out.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    taken = mixing.report(corpus).agg(F.sum("taken")).first()[0]
    assert abs(words - taken) < 0.01 * taken


# ---------------------------------------------------------------- op3
def test_hilbert_is_a_curve():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    h = packing.hilbert(cells, 3)
    order = cells[np.argsort(h)]
    assert sorted(h.tolist()) == list(range(512))
    assert np.abs(np.diff(order, axis=0)).sum(1).max() == 1


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.report(docs).collect()
    want = sorted(len(tok.encode(d[1] or "", add_special_tokens=False).ids) + 1 for d in ODD)
    first = [r for r in rows if r.start == 0]
    assert sorted(r.doc_tokens for r in first) == want
    for d in ODD:
        if d[0] in (3, 5, 6):
            ids = tok.encode(d[1], add_special_tokens=False).ids + [2]
            for r in (r for r in rows if r.doc_id == d[0]):
                assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for spans in held.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        sizes.append(at)
    assert sum(sizes) == sum(want) and all(s & (s - 1) == 0 and s <= 4096 for s in sizes)
    assert packing.report(empty(docs)).count() == 0


def test_packing_in_few_and_small_ranges(docs):
    whole = [packing.pieces(docs, range_tokens=n, most=m).drop("sequence_id").collect() for n, m in ((8 << 20, 64), (500, 64), (500, 3))]
    assert all(Counter(r.doc_id for r in some if r.start == 0) == Counter(d[0] for d in ODD) for some in whole)
    assert len({sum(r.length for r in some) for some in whole}) == 1


def test_sequences_hold_all_ids(docs):
    total = sum(len(r.ids) for r in packing.sequences(docs).collect())
    assert total // 2 == sum(r.length for r in packing.report(docs).collect())


# ---------------------------------------------------------------- op4, op5, op8
def test_language(corpus):
    out = langid.report(corpus).join(corpus.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.9 * len(out)


def test_language_odd_rows(docs):
    rows = langid.report(docs).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {0, 1, 2, 8} and len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.report(empty(docs)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_levenshtein():
    terms = ("clown", "idiot", "moron", "morons", "oaf", "xyz*")
    auto = toxicity.Automaton(terms)
    rng = np.random.default_rng(0)
    tried = list(terms) + ["", "mron", "mo0ron", "idiots", "idiotss", "own", "clwon", "oaf", "oa", "oafs", "xyz", "xyzabc", "xya", "axyz", "moronx", "moroxyz"]
    for _ in range(500):
        w = list(terms[rng.integers(4)])
        for _ in range(rng.integers(0, 3)):
            i = rng.integers(0, len(w) + 1)
            w[i : i + rng.integers(0, 2)] = list("abmo"[: rng.integers(0, 3)])
        tried.append("".join(w))
    for w in tried:
        exact = [i for i, t in enumerate(terms) if t == w or t.endswith("*") and w.startswith(t[:-1])]
        near = [i for i, t in enumerate(terms) if len(t) >= 5 and distance(w, t) <= 1]
        assert auto.match(w) == ((min(exact), 0) if exact else (min(near), 1) if near else (-1, 0)), w


def test_lexicon_prefers_words_and_takes_families():
    rows = [("idiot", 130, 0), ("idio*", 131, 1), ("idiot*", 2, 0), ("boko*", 60, 1), ("bokoa", 12, 0), ("bokoe", 9, 0), ("bok*x", 1, 0), ("noise", 6, 9), ("boko", 3, 3)]
    assert set(toxicity.lexicon(rows, 360, 2800)) == {"idiot", "boko*"}


def toxic_fixture(spark, n=900):
    """Toxic documents use terms (some misspelled), clean ones quote them or don't have them."""
    rng = np.random.default_rng(4)
    terms, rows = ["idiot", "moron", "clown", "stupid"], []
    for i in range(n):
        words = [WORDS[k] for k in rng.integers(0, 19, 40)]
        kind = i % 4
        for at in (8, 20):
            t = terms[rng.integers(0, 4)]
            if kind == 0:
                j = int(rng.integers(1, len(t)))
                words[at] = t if i % 8 else t[:j] + "qjwv"[rng.integers(0, 4)] + t[j + int(rng.integers(0, 2)) :]
            elif kind == 1:
                words[at] = f'said "{t}"'
        rows.append((i, " ".join(words), int(kind == 0)))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), rows


def test_automaton_and_quotation_context_decide(spark, monkeypatch):
    docs, labels, rows = toxic_fixture(spark)
    model = toxicity.fit(docs, labels)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]

    def right(m):
        return np.mean([(m.score(np.array([m.features(t)]))[0] >= 0.5) == bool(y) for _, t, y in held])

    full = right(model)
    assert set(model.terms) == {"idiot", "moron", "clown", "stupid"} and full > 0.97
    with monkeypatch.context() as patch:
        patch.setattr(toxicity.Automaton, "match", lambda self, w: (self.terms.index(w), 0) if w in self.terms else (-1, 0))
        model.reset()
        assert right(model) < full - 0.05
    with monkeypatch.context() as patch:
        patch.setattr(toxicity, "is_quoted", lambda chunks, inside, i: False)
        model.reset()
        assert right(model) < full - 0.1
    model.reset()
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    assert all(got[i] == pytest.approx(float(model.score(np.array([model.features(t)]))[0])) for i, t, _ in rows[:100])


def test_toxicity(spark):
    bad = [(i, " ".join(WORDS[(i * j) % 19] for j in range(1, 40)) + (" you idiot and moron" if i % 3 == 0 else " fine"), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([b[:2] for b in bad], "doc_id long, text string")
    labels = spark.createDataFrame([(b[0], b[2]) for b in bad], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    x = lambda t: float(model.score(np.array([model.features(t)]))[0])
    assert x("alpha beta you idiot moron") > 0.5 > x("alpha beta gamma")
    assert x("alpha you idi0t and m0ron beta") > x("alpha beta gamma")
    assert x('alpha said "you idiot and moron" beta gamma delta') < 0.5
    out = toxicity.report(docs, labels).join(labels, "doc_id").filter("held_out")
    assert out.filter("predicted <> toxic").count() == 0
    kept = toxicity.keep_civil(docs.withColumn("score", F.lit(2)), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 400


def test_scores_of_odd_rows(docs, labels):
    for rows in (toxicity.report(docs, labels).collect(), quality.report(docs, labels).collect(), toxicity.report(docs, empty(labels)).collect(), quality.report(docs, empty(labels)).collect()):
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.report(empty(docs), labels).count() == 0 and quality.report(empty(docs), labels).count() == 0


def test_quality(corpus, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.report(corpus, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)


# ---------------------------------------------------------------- op6
def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_brute_force(corpus):
    docs = {r.doc_id: brute_fingerprint(r.text) for r in corpus.collect()}
    name = {i: i for i in docs}
    for _ in docs:
        new = {i: min(name[j] for j in docs if (docs[i] ^ docs[j]).bit_count() <= 2) for i in docs}
        if new == name:
            break
        name = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(corpus).collect()}
    assert got == {i: (f"{docs[i]:016x}", name[i]) for i in docs}


def near_fingerprints(n, seed=1):
    """n distinct signed fingerprints, each one or two bits from another."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 62))
    fps = {base, base ^ (1 << 63)}
    while len(fps) < n:
        f = list(fps)[rng.integers(len(fps))]
        fps.add(f ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    return [f - (1 << 64) if f >> 63 else f for f in fps]


def test_long_lists_lose_no_link(spark):
    from barwright.llm.components import connected_components

    fps = near_fingerprints(300)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")

    def components(long_list):
        found = {r.node: r.component for r in connected_components(simhash.links(frame, long_list=long_list)).collect()}
        return {f: found.get(f, f) for f in fps}

    assert components(1) == components(100_000) == components(8)


def test_tally_counts_shared_positions_and_filters(spark):
    rng = np.random.default_rng(5)
    prefix = int(rng.integers(0, 1 << 31))
    fps = sorted({(prefix << 32) | int(rng.integers(0, 1 << 32)) & 0x0F0F0F0F for _ in range(400)})
    index = simhash.postings(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = Counter((r.u, r.v, r.shared) for r in simhash.tallied(index).collect())
    same = lambda a, b, places: sum((a >> 8 * p & 255) == (b >> 8 * p & 255) for p in places)
    want = Counter()
    slots = [((0, 1), (2, 3)), ((0, 1), (4, 5)), ((0, 1), (6, 7)), ((2, 3), (4, 5)), ((2, 3), (6, 7)), ((4, 5), (6, 7))]
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            for s in slots:
                inside = [p for pair in s for p in pair]
                more = same(a, b, set(range(8)) - set(inside))
                if same(a, b, inside) == 4 and more:
                    want[a, b, 4 + more] += 1
    assert got == want
    kept = [k for k in got if k[2] >= simhash.GUARANTEED]
    assert 0 < len(kept) < len(got) / 2 and all((a ^ b).bit_count() > 2 or any(k[:2] == (a, b) for k in kept) for i, a in enumerate(fps) for b in fps[i + 1 :])


def test_simhash_odd_rows(docs):
    rows = simhash.report(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[3].component_id == by[4].component_id == 3 and by[2].component_id == by[1].component_id == by[0].component_id == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted({r.component_id for r in rows if r.component_id is not None} - {None})
    assert simhash.report(empty(docs)).count() == 0


def test_keep_one_keeps_different_texts_without_or_with_shared_ids(spark):
    near = "one two three four five six seven"
    rows = [(None, "red apples grow on old trees here"), (None, "blue whales swim in the deep sea"), (None, near), (3, near), (4, "green tea is served in small cups"), (4, "grey clouds hang over the wide hills"), (None, "RED apples grow on old trees here")]
    frame = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text.lower()) for r in simhash.keep_one(frame).collect())
    assert kept == Counter({(i, t.lower()): 1 for i, t in [*rows[:2], *rows[3:6]]})
    named = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(frame).collect()}
    fp = simhash.fingerprint(near.encode())
    assert named[None, fp] == named[3, fp] == 3


# ---------------------------------------------------------------- op7
def test_exchange_separates_languages():
    rng = np.random.default_rng(0)
    pairs = np.zeros((41, 41))
    for a in range(40):
        for b in range(40):
            if a // 20 == b // 20:
                pairs[a, b] = rng.integers(1, 9)
    cls = lm_classes.exchange(pairs, classes=3, rounds=20)
    assert cls[40] == 0 and len(set(cls[:20])) == 1 and len(set(cls[20:40])) == 1 and cls[0] != cls[39]


def test_most_counted_words(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + 1000 // (i + 1)) for i in range(300)] + [(f"x{i}", 1) for i in range(2000)], "word string, c long")
    of = {r.word.encode(): r.c for r in counts.collect()}
    for most in (0, 1, 7, 50, 1000, 5000):
        found, chosen = lm_classes.most_counted(counts, most)
        assert all(of[w] == c for w, c in found.items()) and min(most, 2300) * 0.6 - 9 <= len(found) <= most
        assert list(found) == sorted(found, key=lambda w: (-of[w], w)) and {r.word.encode() for r in counts.filter(~chosen).collect()} == set(of) - set(found)
        left = [c for w, c in of.items() if w not in found]
        assert not found or not left or min(found.values()) >= max(left) / 2 ** (1 / 16)
    assert lm_classes.most_counted(empty(counts))[0] == {}
    assert len(lm_classes.most_counted(counts.filter("c = 1"), 1000)[0]) > 800


def test_lm(corpus):
    rows = {r.doc_id: r for r in lm_classes.report(corpus).collect()}
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in corpus.collect()]
    train = [w for i, w in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    gain = 0.0
    for i, w in docs:
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((len(train) + 1) / (n + v + 1))
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_lm_learns_classes_beyond_the_frequent_words(spark):
    rng = np.random.default_rng(0)
    names = {k: [f"{k}{i}xyz" for i in range(800)] for k in "ab"}
    p = 1 / (200 + np.arange(800))
    rows = [(i, " ".join(rng.choice(names["ab"[i % 2]], 60, p=p / p.sum()))) for i in range(1400)]
    pure, mixed = (10_000, " ".join(names["a"][500:540])), (10_001, " ".join(names["ab"[i % 2]][500 + i] for i in range(40)))
    frame = spark.createDataFrame([*rows, (None, ""), *[(i, t) for i in range(20_000, 21_000) if zlib.crc32(str(i).encode()) % 7 == 2 for t in (pure[1], mixed[1])][:2]], "doc_id long, text string").repartition(3)
    small, large = ({(r.doc_id, r.base_score): r for r in lm_classes.scored(frame, most=n).collect()} for n in (1200, 1 << 16))
    a, b = sorted((r.score for k, r in large.items() if r.doc_id is not None and r.doc_id >= 20_000), reverse=True)
    assert a - b > 0.3 * 20
    assert sorted((r.doc_id or 0, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in small.values()) == sorted((r.doc_id or 0, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in large.values())


def test_lm_score_is_the_class_bigram_of_brute_force(spark, monkeypatch):
    """score from plain counts, given the classes that clustering and assignment found."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "stuvwxyzéñ"]
    p = 1 / (900 + np.arange(1000))
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 80), p=p / p.sum())) for _ in range(450)]
    texts += [texts[0], "Unseen words here ast", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    made = {}
    keep = lm_classes.fit
    monkeypatch.setattr(lm_classes, "fit", lambda *a: made.setdefault("fit", keep(*a)))
    rows = {r.doc_id: r for r in lm_classes.scored(frame, most=800).collect()}
    model, rest = made["fit"]
    words = list(model.counted)
    beyond = {r.word.encode(): r["class"] for r in rest.collect()}
    split = [t.lower().encode().split() for t in texts]
    train = [w for i, w in enumerate(split) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(x for w in train for x in w)
    own = {w for w in count if (beyond[w] is not None if w in beyond else words.index(w) < lm_classes.FREQUENT or count[w] >= lm_classes.LEAST)}
    assert any(w in beyond for w in own) and any(w not in own for w in count)
    bucket_class = lambda w: int(model.classes[len(words) + lm_classes.bucket_of(w)])
    cls = lambda w: (beyond[w] if w in beyond else int(model.classes[words.index(w)])) if w in own else bucket_class(w)
    floor, k = lm_classes.FLOOR, lm_classes.CLASSES
    in_bucket, kinds = Counter(), Counter()
    for w, c in count.items():
        if w not in own:
            in_bucket[lm_classes.bucket_of(w)] += c
            kinds[lm_classes.bucket_of(w)] += 1
    weight = Counter({0: len(train) + floor})
    for w in own:
        weight[cls(w)] += count[w] + floor
    for b in range(lm_classes.BUCKETS):
        weight[int(model.classes[len(words) + b])] += in_bucket[b] + floor
    m = np.zeros((k, k))
    for w in train:
        path = [0, *map(cls, w), 0]
        for a, b in zip(path, path[1:]):
            m[a, b] += 1
    share = (m.sum(0) + 1) / (m.sum() + k)
    move = (m + lm_classes.PULL * share) / (m.sum(1, keepdims=True) + lm_classes.PULL)
    for i, w in enumerate(split):
        path = [0, *map(cls, w), 0]
        want = sum(np.log10(move[a, b]) for a, b in zip(path, path[1:]))
        for x in w:
            if x in own:
                want += np.log10((count[x] + floor) / weight[cls(x)])
            else:
                b = lm_classes.bucket_of(x)
                want += np.log10((in_bucket[b] + floor) / weight[cls(x)] * (count[x] + 1) / (in_bucket[b] + kinds[b] + 1))
        assert rows[i].score == pytest.approx(want, rel=1e-9), texts[i]


def test_best_classes_are_those_of_single_gains():
    rng, k = np.random.default_rng(2), lm_classes.CLASSES
    n = rng.integers(0, 4, (300, 2 * k + 1)) * (rng.random((300, 2 * k + 1)) < 0.2)
    n[5] = 0
    m = rng.integers(0, 40, (k, k)).astype(float) + 300
    own_class = rng.integers(1, k, 300)
    got = lm_classes.best_classes(m, own_class, n.astype(float))
    for x, a, b in zip(n, own_class, got):
        c, r, own = x[:k], x[k:-1], x[-1]
        rest = m.copy()
        rest[a] -= r
        rest[:, a] -= c
        rest[a, a] -= own
        gain = lm_classes._gains(rest, r, c, own)
        best = int(gain.argmax())
        assert b == (best if gain[best] > gain[a] + 1e-9 else a)


def test_words_are_summed_over_rows_and_batches(spark):
    rng, k = np.random.default_rng(6), lm_classes.CLASSES
    words, cls = [b"x", b"y"], rng.integers(1, k, lm_classes.SYMBOLS)
    m = rng.integers(1, 40, (k, k)) + 3000.0
    rows, sums = [], defaultdict(lambda: np.zeros(2 * k + 1))
    for i in range(3000):
        key = (None, int(i % 2)) if i % 10 == 0 else (f"w{i % 130}", None)
        side = np.unique(rng.integers(0, 2 * k, 5))
        times = rng.integers(1, 3, len(side))
        sums[key][side] += times
        rows.append((*key, bytearray(side.astype(np.uint8).tobytes()), bytearray(times.astype(np.uint32).tobytes())))
    rows.append(("rare", None, bytearray([1]), bytearray(np.array([2], np.uint32).tobytes())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        frame = spark.createDataFrame(rows, "word string, id long, sides binary, times binary").repartition(7)
        got = {(r.word, r.id): r["class"] for r in lm_classes.assigned(frame, m, words, cls).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = list(sums)
    a = np.array([cls[lm_classes.FREQUENT + lm_classes.bucket_of(words[i] if w is None else w.encode())] for w, i in keys])
    assert got == dict(zip(keys, lm_classes.best_classes(m, a, np.array([sums[x] for x in keys])).tolist(), strict=True))


def test_neighbour_counts(spark):
    texts = ["a b a a c", "c", "", "z z q a z", "b a"]
    words, first = [b"a", b"b", b"c"], np.array([1, 2, 3] + [4] * lm_classes.BUCKETS)
    rows = lm_classes.neighbours(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), words, first, 1).collect()
    got = Counter()
    for r in rows:
        for s, n in zip(np.frombuffer(r.sides, np.uint8).tolist(), np.frombuffer(r.times, np.uint32).tolist(), strict=True):
            got[words[r.id].decode() if r.word is None else r.word, s] += n
    want, of = Counter(), {"a": 1, "b": 2, "c": 3}
    for t in texts:
        t = t.split()
        for i, w in enumerate(t):
            if w != "a":
                want[w, of.get(t[i - 1], 4) if i else 0] += 1
                want[w, lm_classes.CLASSES + (of.get(t[i + 1], 4) if i + 1 < len(t) else 0)] += 1
    assert got == want


def test_lm_odd_rows(docs):
    assert len(lm_classes.report(docs).collect()) == len(ODD)
    assert lm_classes.report(empty(docs)).count() == 0


# ---------------------------------------------------------------- op9
def plain_feature(data):
    n, counts = len(data), Counter(data)
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values())
    bands = ",".join(f"{sum(c for v, c in counts.items() if v // 32 == k) / n:.4f}" for k in range(8))
    return f"mean={sum(data) / n:.4f};entropy={abs(entropy):.4f};bands={bands}"


def test_media_round_trip(docs):
    rows = media_tar.report(docs).collect()
    texts = {d[0]: (d[1] or "").encode() for d in ODD}
    assert len(rows) == len(ODD)
    for r in rows:
        p = media_tar.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert len(p) % 64 == 0 and len(p) > 0 and r.feature == plain_feature(p)
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            image = f.read(r.media_bytes)
        assert hashlib.sha256(image).hexdigest() == r.media_sha256 and image[:8] == media_tar.SIGNATURE and struct.unpack(">II", image[16:24]) == (r.width, r.height)
    places = {(r.payload_sha256, r.media_sha256, r.shard, r.offset) for r in rows}
    assert len(places) == len({p[0] for p in places})
    assert media_tar.report(empty(docs)).count() == 0


def test_media_shards_hold_images_once_and_headers_read_nothing_else(docs, tmp_path, monkeypatch):
    import tarfile

    folder = f"file://{tmp_path}/t"
    index = media_tar.store(docs.coalesce(1), folder)
    names = [m.name for f in (tmp_path / "t").glob("*.tar") for m in tarfile.open(f).getmembers()]
    assert sorted(names) == sorted({f"{r.digest}.png" for r in index.collect()})
    again = media_tar.store(docs.coalesce(1), folder)
    assert sorted(map(str, again.collect())) == sorted(map(str, index.collect())) and not list((tmp_path / "t").glob(".part-*"))
    for f in (tmp_path / "t").glob("*.tar"):  # all but the first 33 bytes of each image is lost
        data, kept = f.read_bytes(), bytearray(f.stat().st_size)
        for r in index.filter(F.col("shard").endswith(f.name)).collect():
            kept[r.offset : r.offset + 33] = data[r.offset : r.offset + 33]
        f.write_bytes(kept)
    found = media_tar.headers(media_tar.objects(index)).collect()
    assert all(r.width == 64 and r.bits == 8 for r in found)
    height = {r.digest: r.height for r in found}
    assert all(height[r.digest] * 64 >= r.n_bytes > (height[r.digest] - 1) * 64 - 1 for r in index.collect())
    with pytest.raises(Exception, match="reads otherwise|invalid|Error"):
        media_tar.read_back(media_tar.headers(media_tar.objects(index))).collect()


# ---------------------------------------------------------------- op10
def test_phrases_are_local():
    rng = np.random.default_rng(0)
    core = "".join(rng.choice(list("abcdefgh "), 3000))
    a, b = (set(phrases.fingerprints([x + core + y], most=10**6)[0].tolist()) for x, y in (("qqq", "zz"), ("some other lead ", "")))
    assert len(a & b) / len(a | b) > 0.9
    assert phrases.likeness(*phrases.fingerprints(["", ""])) == 1.0 and phrases.likeness(*phrases.fingerprints(["", "abc"])) == 0.0


def test_phrases_brute_force(docs):
    order = sorted(ODD, key=lambda d: (d[0] is not None, d[0] or 0))
    rows = phrases.report(docs).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    for i, d in enumerate(order):
        if d[0] == 7 or order[(i + 1) % len(order)][0] == 7 and d[0] == 7:
            continue
        text, after = d[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        e = text[: len(text) - k] + after[:k]
        (r,) = got[d[0]]
        own, changed, following = (phrases.fingerprints([t])[0] for t in (text, e, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (phrases.hexed(own), phrases.hexed(changed))
        assert r.near_edited == phrases.likeness(own, changed) and r.near_next == phrases.likeness(own, following)
    assert phrases.report(empty(docs)).count() == 0 and len(rows) == len(ODD)


def test_successors_across_ranges(corpus):
    ids = [r.doc_id for r in corpus.select("doc_id").orderBy("doc_id").collect()]
    rows = phrases._with_successors(corpus.select("doc_id", "text"), rows_each=16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["range"]].append((r.extra, r.doc_id))
    after = {}
    for spans in by.values():
        spans.sort()
        after |= {a[1]: b[1] for a, b in zip(spans, spans[1:], strict=False)}
    assert after == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_often_marks_hold_every_word_that_gets_a_class(spark):
    counts = [(f"w{i}", i % 25) for i in range(500)] + [("é", 10), ("", 9)]
    frame = spark.createDataFrame(counts, "word string, c long")
    marks = lm_classes.often_marks(frame)
    want = {zlib.crc32(w.encode()) % lm_classes.SLOTS for w, c in counts if c >= lm_classes.LEAST}
    assert set(np.flatnonzero(np.unpackbits(marks, bitorder="little")).tolist()) == want
    assert not lm_classes.often_marks(empty(frame)).any()


def test_neighbours_leave_out_words_without_a_mark(spark):
    words, first = [b"a", b"b", b"c"], np.array([1, 2, 3] + [4] * lm_classes.BUCKETS)
    marks = np.zeros(lm_classes.SLOTS >> 3, np.uint8)
    slot = zlib.crc32(b"often") % lm_classes.SLOTS
    marks[slot >> 3] |= 1 << (slot & 7)
    docs = spark.createDataFrame([("a b often rare c often",), (None,), ("",)], "text string")
    rows = lm_classes.neighbours(docs, words, first, 1, 2, marks).collect()
    assert sorted((r.word or "", -1 if r.id is None else r.id) for r in rows) == [("", 1), ("often", -1)]
    (found,) = [r for r in rows if r.word == "often"]
    k = lm_classes.CLASSES
    got = dict(zip(found.sides, np.frombuffer(found.times, np.uint32).tolist(), strict=True))
    assert got == {2: 1, 3: 1, k: 1, k + 4: 1}


def test_packed_numbers_come_back():
    for values, each in (([1, 2, 3], [0, 2, 0, 1]), ([], [0, 0]), ([], [])):
        column = lm_classes.packed(np.array(values, np.int32), np.array(each, np.int64))
        got, many = lm_classes.flat(column, np.int32)
        assert got.tolist() == values and many.tolist() == each


def test_chunks_have_the_tokenizers_ids():
    import random

    ids, rnd = packing.Ids(packing.tokenizer_path(), kept=40), random.Random(1)
    odd = ["a. b.c d.. e,; É. é, ñ; ×. ÷, —, “a”. ... 1.5 x1. ß. İx. ſ. K. A.\x1c b.\x85c a.\nb.", "Hello, World! it's don't' a&&& b$$$ c.%%%", "a" * 100 + ". " + "ö" * 50 + ",", "\x00. \x0b.x", "abc<|endoftext|> a<|startoftext|>."]
    odd += ["".join(rnd.choice("abcéßÿ×÷'.,$&-_|<>1  —ſKİ\n~`^@[]{}\\/:;!?\"#%()*+=") for _ in range(60)) for _ in range(500)]
    for text in odd:
        want = np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
        assert ids.of(text.encode()) == want, text
    assert len(ids) + len(ids.older) < 200


def test_network_is_that_of_plain_loops():
    rng = np.random.default_rng(2)
    filters = tuple(rng.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS)
    net = langid.Network(("de", "en", "fr"), filters, rng.normal(0, 1, (3 * langid.FILTERS, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    x = rng.integers(0, 256, (5, langid.LENGTH)).astype(np.uint8)
    for row, got in zip(x, net.predict(x), strict=True):
        pooled = [max(sum(float(table[j][row[i + j]][k]) for j in range(w)) for i in range(langid.LENGTH - w + 1)) for w, table in zip(langid.WIDTHS, filters, strict=True) for k in range(langid.FILTERS)]
        z = [sum(max(0.0, p) * float(net.dense[i][c]) for i, p in enumerate(pooled)) + float(net.bias[c]) for c in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        assert got == pytest.approx([v / sum(e) for v in e], abs=1e-4)


def test_training_lowers_the_loss_along_its_gradient():
    rng = np.random.default_rng(4)
    x = np.zeros((96, langid.LENGTH), np.uint8)
    y = np.arange(96) % 2
    for i in range(96):
        x[i, :40] = rng.choice(list(b"abcd " if y[i] else b"wxyz "), 40)
    loss = lambda net: -np.mean(np.log(net.predict(x)[np.arange(96), y]))
    some, more = langid.train(x, y, ("a", "b"), epochs=1), langid.train(x, y, ("a", "b"), epochs=6)
    assert loss(more) < loss(some) < np.log(2) and (more.predict(x).argmax(1) == y).all()


def test_forest_is_that_of_single_tree_walks():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 5)).round(1)
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5) | (x[:, 1] > 1.5)).astype(float)
    forest = quality.grow(x, y, trees=12)
    got = forest.score(x)
    for row, p in zip(x, got, strict=True):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == y.astype(bool)).mean() > 0.97
    # the first tree's first split is the best of all cuts by the gain of its gradients
    one = quality.grow(x, y, trees=1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    g, h = share - y, np.full(len(y), share * (1 - share))

    def gain(j, cut):
        left = x[:, j] <= cut
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
        return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + quality.RIDGE) if h[left].sum() >= 1 and h[~left].sum() >= 1 else 0

    best = max(gain(j, cut) for j in range(5) for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])))
    assert gain(one.feature[0][0], one.threshold[0][0]) == pytest.approx(best)


def plain_parse(text, levels):
    """The names of a text's phrases at a level, symbol by symbol."""
    mask = (1 << 64) - 1

    def mix(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & mask
        return x ^ (x >> 32)

    symbols = [mix(ord(c) + 1) for c in text]
    for _ in range(levels):
        single = []
        while symbols:
            n = next((i for i, s in enumerate(symbols) if s != symbols[0]), len(symbols))
            single.append(mix(symbols[0] ^ mix(n)) if n > 1 else symbols[0])
            symbols = symbols[n:]
        labels = single
        for _ in range(3):
            before = [~labels[0] & mask, *labels[:-1]] if labels else []
            places = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(labels, before, strict=True)]
            labels = [2 * k + (a >> k & 1) for a, k in zip(labels, places, strict=True)]
        phrase = []
        for i, s in enumerate(single):
            if i == 0 or i + 1 < len(single) and labels[i] < labels[i - 1] and labels[i] < labels[i + 1]:
                phrase.append([])
            phrase[-1].append(s)
        symbols = [mix((sum(mix((s + (j + 1) * 0x9E3779B97F4A7C15) & mask) for j, s in enumerate(p)) + len(p)) & mask) for p in phrase]
    return sorted({s >> 32 for s in symbols})


def test_phrases_are_those_of_a_plain_parse():
    rng = np.random.default_rng(8)
    some = ["", "a", "aa", "ab", "aaaab", "é😀é😀é", "the same the same the same " * 40, "x" * 500, *("".join(rng.choice(list("abcde fg"), n)) for n in (3, 17, 90, 400, 900))]
    for level in (1, 2, 3):
        for most in (5, 64):
            found = phrases.fingerprints(some, level, most)
            assert [f.tolist() for f in found] == [plain_parse(t, level)[:most] for t in some]

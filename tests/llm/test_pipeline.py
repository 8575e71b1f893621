"""The pipeline's stages on a small table, each against plain Python or what it must keep."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm import langid, mixing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and that with from have this would there", "fr": "les des une que dans pour avec nous cette être"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = np.random.default_rng(0), [], []
    for i in range(360):
        lang = ("en", "fr")[i % 2]
        words = list(rng.choice(WORDS[lang].split(), 60))
        if i % 6 == 0:
            words[5] = words[40] = "idiot"
        text = " ".join(words)
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(400, rows[1][1], "fr", "s0", 3), (401, rows[1][1].upper(), "fr", None, 3), (402, None, None, None, None), (403, "", "en", "s1", 0), (404, "12 34 !", None, "s1", 7), (None, rows[7][1], "fr", "s2", 3), (None, "une idée sans nom que nous avons", "fr", "s2", 3), (405, rows[3][1], "fr", "s0", 1), (405, rows[3][1], "fr", "s0", 1)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    civil = corpus_pipeline.toxicity_stage(spark, docs, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [r for r in rows if float(model.score(np.array([model.features(r.text or "")]))[0]) < 0.5]
    assert civil.columns == columns and sorted(civil.collect(), key=key) == sorted(want, key=key)
    assert {r.doc_id for r in rows if r.text and "idiot" in r.text} == {r.doc_id for r in rows} - {r.doc_id for r in want}

    known = corpus_pipeline.language_stage(spark, civil, folder)
    net = langid.fit(civil)
    guesses = [(r, *(x[0] for x in langid.guess([r.text], net))) for r in want]
    kept = [r for r, lang, score in guesses if lang != "und" and score >= 0.5]
    assert known.columns == columns and sorted(known.collect(), key=key) == sorted(kept, key=key)
    assert not {402, 403, 404} & {r.doc_id for r in kept} and len(kept) >= len(want) - 8

    once = corpus_pipeline.near_duplicate_stage(spark, known, folder)
    groups, fps = [], {}
    for r in kept:
        fps.setdefault(simhash.fingerprint((r.text or "").encode()) & (1 << 64) - 1, []).append(r)
    left = set(fps)
    while left:
        group, fresh = set(), [left.pop()]
        while fresh:
            f = fresh.pop()
            group.add(f)
            near = {g for g in left if (f ^ g).bit_count() <= 2}
            left -= near
            fresh += near
        groups.append([r for f in group for r in fps[f]])
    first = Counter(min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups)
    got = once.collect()
    assert once.columns == columns and Counter((r.doc_id is None, r.doc_id or 0) for r in got) == first

    mixed = corpus_pipeline.mixing_stage(spark, once, folder)
    taken = {r.doc_id: r.taken for r in mixing.report(once).filter("doc_id is not null").collect()}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = Counter()
    for r in mixed.collect():
        if r.doc_id is not None:
            words[r.doc_id] += count(r.text)
            assert r.n_chars == len(r.text) and set(r.text.split()) <= set(next(x.text for x in got if x.doc_id == r.doc_id).split())
    assert mixed.columns == columns and {i: n for i, n in taken.items() if n} == dict(words)

    packed = corpus_pipeline.packing_stage(spark, mixed, folder).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert sum(r.start == 0 for r in packed) == mixed.count()


HELPERS = "_id _n _spans _pass _near_id _near_text _near_row row spans pass content size start block h range fp u v times first kept_id id text_hash row_hash own_id own_nth nth shard slot source_id batch n place ids part at begin tie score lang_pred Row SPANS".split()


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = [], set()
    for name in HELPERS:  # Spark's names don't tell case
        if name.lower() not in seen:
            names.append(name)
            seen.add(name.lower())
    more = docs.select("*", *[F.concat_ws("-", F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in names], F.create_map(F.lit("k"), F.col("doc_id")).alias("some.map"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, more, folder), stage(spark, docs, folder)
        assert out.columns == more.columns, name
        rows = out.collect()
        for r in rows:
            own = "none" if r.doc_id is None else r.doc_id
            assert all(r[n] == f"{n}-{own}" for n in names) and r["some.map"] == {"k": r.doc_id}, (name, r)
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect()), name
    assert Counter(map(tuple, corpus_pipeline.packing_stage(spark, more, folder).collect())) == Counter(map(tuple, corpus_pipeline.packing_stage(spark, docs, folder).collect()))


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name


def test_workers_keep_few_tokens_beside_the_stages(spark, monkeypatch):
    from barwright.llm import packing

    made = []
    monkeypatch.setattr(packing, "pieces", lambda docs, path=None, **kept: made.append(kept) or docs)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    corpus_pipeline.packing_stage(spark, docs, "")
    assert made == [{"kept": corpus_pipeline.KEPT_CHUNKS}] and corpus_pipeline.KEPT_CHUNKS <= packing.CACHED // 10

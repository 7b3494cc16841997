"""The pipeline against a plain version of its stages, on the smallest documents."""

import hashlib
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from marlstone.llm import bpe
from marlstone.llm.decontaminate import RATE, distance
from marlstone.llm.langid import identify_languages

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def one_of_each(docs):
    ids = sorted(docs)
    sets = {}
    for i in ids:
        w = tuple(WORD.findall(docs[i]))
        sets[i] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: docs[i] for i in ids if root(i) == i}


def without_repeats(docs, width=35):
    words = {i: WORD.findall(t) for i, t in docs.items()}
    times = Counter(tuple(w[k : k + width]) for w in words.values() for k in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - width + 1) if times[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else docs[i]
    return out


def clean(docs, items):
    plain = lambda t: SPACES.sub(" ", t.lower()).strip()
    items = [plain(t) for t in items]
    grams = [{t[k : k + 10] for k in range(len(t) - 9)} for t in items]
    out = {}
    for i, t in docs.items():
        p = plain(t)
        own = {p[k : k + 10] for k in range(len(p) - 9)}
        if not any(x in p or (own & g and distance(x, p) <= int(RATE * len(x))) for x, g in zip(items, grams)):
            out[i] = t
    return out


def test_pipeline_matches_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r for r in identify_languages(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if known[r.doc_id].lang_pred != "und" and known[r.doc_id].score >= corpus_pipeline.LEAST_SCORE}
    want = clean(without_repeats(one_of_each(texts)), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    tok = bpe.library(bpe.default_path())
    for i, t in want.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].lang) == (len(ids), known[i].lang_pred)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_return_the_columns_of_documents_and_bear_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "Some words here.", "en", "s", 16), (4, "Some words here.", "en", "s", 16), (4, "Some words here.", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        out = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert out.count() == (1 if rows is odd else 0)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substrings", "decontamination", "encoding"]


def test_every_near_duplicate_class_keeps_a_row_whatever_its_id(spark):
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(40)) for c in "abcd")
    rows = [(None, one), (None, one), (None, two), (5, two), (7, three), (7, four), (9, four)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(None, one), (5, two), (7, three), (7, four)], key=str)

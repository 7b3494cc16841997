"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, crosspolytope, langid, mixcoder
from marlstone.llm import toxicity as toxicity_module
from marlstone.llm.bpe_batch import KnownChunks
from marlstone.llm.components import components
from marlstone.llm.crosspolytope import nearest
from marlstone.llm.dartminhash import signatures
from marlstone.llm.decontaminate import decontaminate, distance
from marlstone.llm.langid import identify_languages
from marlstone.llm.lmscore import MERGES, lowered, recalled, score_documents, subwords
from marlstone.llm.neardup import near_duplicates
from marlstone.llm.substrings import substring_dedup
from marlstone.llm.textbatch import Words, runs
from marlstone.llm.token_counts import count_word, token_counts
from marlstone.llm.token_files import token_files
from marlstone.llm.toxicity import decide_texts, fit, folded, kernel, toxicity
from marlstone.llm.transducer import Lexicon, bpe_round_trip, compile_lexicon, frequent_chunks

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens long, score double, words long, key long, class_id long"
ODD = ["I'll DON'T  <|endoftext|>x", "İstanbul ΣΑΣ éte x　y 12345 a1b2 ...'s", "漢字 ｶﾞ ẞ ʼn é \U0001f600", "\x0b\x0c a\x1cb \x85 k", "<|ENDOFTEXT|> a<|endoftext|"]


def table(spark, texts, langs=None):
    """Documents with ids 0.., columns that clash with the operators' own, a null id and a repeated row."""
    rows = [(i, t, (langs or {}).get(i, "en"), None, 7, 0.5, 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id here", None, None, None, None, None, None, None), rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]


@pytest.fixture(scope="module")
def texts(words):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [say(rng.randint(1, 120)) for _ in range(30)]
    passage = say(50)
    return [*base, base[3], base[4] + " end", f"{say(10)} {passage} {say(9)}", f"{passage} {say(3)}", None, "", " \n\t ", say(4000), *ODD]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


EMPTY_RUNS = {
    "langid": identify_languages, "counts": token_counts, "bpe": bpe_round_trip, "files": token_files, "substrings": substring_dedup, "neardup": near_duplicates,
    "lm": lambda d: score_documents(d, steps=2),
    "decontaminate": lambda d: decontaminate(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
    "toxicity": lambda d: toxicity(d, d.sparkSession.createDataFrame([], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", EMPTY_RUNS)
def test_empty_table(spark, name):
    assert EMPTY_RUNS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts_and_round_trip_match_the_library(spark, texts):
    docs, tok = table(spark, texts), bpe.library(bpe.default_path())
    counts, both = token_counts(docs, limit=100).collect(), bpe_round_trip(docs, lexicon_words=50).collect()
    assert len(counts) == len(both) == len(texts) + 2
    text = {**dict(enumerate(texts)), None: "no id here"}
    for r in counts:
        ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(ids), len((text[r.doc_id] or "").encode()), len(ids) > 100)
    for r in both:
        ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frequent_chunks_are_counted_whole(spark):
    # one word is met once by each of 40 tasks, others twice by one task
    rows = [f"everywhere t{k} t{k}" for k in range(40)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in rows], 40), "text string")
    assert frequent_chunks(docs, size=1) == ["everywhere"]
    assert frequent_chunks(docs, size=41) == ["everywhere", *sorted(f"t{k}" for k in range(40))]
    assert frequent_chunks(spark.createDataFrame([("b a",), ("a c",)], "text string"), size=3) == ["a", "b", "c"]


def test_heap_and_list_merging_agree(words):
    v = bpe.vocabulary(bpe.default_path())
    many = [*words, "a", "supercalifragilistic", "ééé", "漢字", "x" * 90]
    assert [list(np.frombuffer(b, "<u4")) for b in v.encode_chunks(many)] == [v.merge(w) for w in many]
    for w in [*words, "a", "supercalifragilistic", "ééé", "漢字"]:
        assert count_word(v, w) == len(v.merge(w))


def test_words_of_any_length(words):
    rng = random.Random(21)
    v = bpe.vocabulary(bpe.default_path())
    tok = bpe.library(v.path)
    for word in ("".join(rng.choice("abcdefghijklmnop") for _ in range(100_000)), "漢字かな" * 8000, "ab" * 50_000):
        ids = tok.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(v.encode_chunks([word])[0], "<u4").tolist() == ids
        assert sum(count_word(v, p) if isinstance(p, str) else 1 for p in v.parts(word)) == len(ids)
        one = Words(lowered(pa.array([word])))
        assert len(subwords(v.path, MERGES).texts(one)[0]) > 1


def test_chunks_met_before_have_the_same_ids(words):
    v = bpe.vocabulary(bpe.default_path())
    rng = random.Random(22)
    memo = KnownChunks(v.encode_distinct, limit=150)
    for _ in range(12):
        some = list(dict.fromkeys([*rng.sample(words, 60), rng.choice(ODD), "y" * 70]))
        pool, start, size = memo.look(pa.array(some))
        assert [pool[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist())] == v.encode_chunks(some)
        assert len(memo.chunks) <= 150


def thue_morse(n):
    return [bin(k).count("1") & 1 for k in range(n)]


def test_hashes_tell_thue_morse_words_and_runs_apart():
    one = "".join("ab"[b] for b in thue_morse(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    for n in (40, 64, 1024):
        h = Words(pa.array([f"{one[:n]} {other[:n]}"])).hashes()
        assert h[0] != h[1]
    w = Words(pa.array([" ".join(one), " ".join(other)]))
    for n in (32, 35, 1024):
        for which in (0, 1):
            r = runs(w.hashes(), n, which)
            assert r[0] != r[1024]
    assert len(set(w.keys())) == 2 and Words(pa.array(["a  b\n", "a b", None, ""])).keys()[0] == w.__class__(pa.array([" a b"])).keys()[0]


def test_different_texts_of_colliding_words_stay_apart(spark):
    one = "".join("ab"[b] for b in thue_morse(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, " ".join([one] * 35)), (2, " ".join([other] * 35)), (3, " ".join(one)), (4, " ".join(other))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(df.where("doc_id < 3")).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.class_id for r in near_duplicates(df.where("doc_id < 3")).collect()} == {1: 1, 2: 2}


def test_runs_are_windows():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    h[100:150] = h[20:70]
    for width in (1, 2, 3, 16, 35):
        r = runs(h, width)
        assert len(r) == 200 - width + 1
        same = {(i, j) for i in range(len(r)) for j in range(i) if r[i] == r[j]}
        assert same == {(i, j) for i in range(len(r)) for j in range(i) if (h[i : i + width] == h[j : j + width]).all()}


def test_transducer_knows_its_words_and_no_others(words):
    data = compile_lexicon({w: [i, i + 1] for i, w in enumerate(words)})
    lex = Lexicon(data)
    probe = [*words, *(w + "x" for w in words), *(w[:-1] for w in words), "", "é"]
    number = lex.numbers(pa.array(probe))
    known = sorted(set(words), key=str.encode)
    for w, n in zip(probe, number.tolist()):
        assert n == (known.index(w) if w in set(words) else -1)
    assert Lexicon(compile_lexicon({})).numbers(pa.array(["a"])).tolist() == [-1]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 200, 9000])
def test_coder_round_trip_and_checksum(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.zeros(n, np.int64), np.minimum(rng.zipf(1.3, n), 49407)):
        data = mixcoder.encode_block(ids, 49408)
        assert (mixcoder.decode_block(data) == ids).all()
    if n > 64:
        bad = bytearray(data)
        bad[8] ^= 1
        with pytest.raises(ValueError):
            mixcoder.decode_block(bytes(bad))


def test_token_files(spark, texts):
    tok = bpe.library(bpe.default_path())
    rows = sorted(token_files(table(spark, texts)).collect(), key=lambda r: r.start)
    text = {**dict(enumerate(texts)), None: "no id here"}
    assert [r.doc_id for r in rows] == [None, 0, 0, *range(1, len(texts))]
    start = 0
    for r in rows:
        ids = [*tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_substrings_match_brute_force(spark, texts):
    docs = [(None, "no id here"), *enumerate(texts), (0, texts[0])]
    split = [WORD.findall((t or "").encode()) for _, t in docs]
    for width in (35, 3):
        times = Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
        want = []
        for (i, _), w in zip(docs, split):
            gone = {j for k in range(len(w) - width + 1) if times[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
            want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
        got = [tuple(r) for r in substring_dedup(table(spark, texts), width=width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_substrings_that_overlap_themselves(spark):
    df = spark.createDataFrame([(1, "a " * 90), (2, "a b " * 20)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(df).collect()} == {1: 90, 2: 40}


def test_near_duplicates_match_brute_force(spark, words):
    rng = random.Random(9)
    base = [[rng.choice(words) for _ in range(n)] for n in (3, 40, 120, 300)]
    docs = [" ".join(b) for b in base]
    for b in base[1:]:
        for _ in range(25):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(words)
            docs.append(" ".join(c))
    docs += [None, "", docs[0], docs[2].upper()]
    sets = []
    for t in docs:
        w = tuple((t or "").split())
        sets.append({w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w})
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
    members = Counter(root(i) for i in range(len(docs)))
    least = {}
    for i in range(len(docs)):
        least.setdefault(root(i), i)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = by_id(near_duplicates(df.withColumn("label", F.lit(1))))
    assert {i: (r.class_id, r.class_size) for i, r in got.items()} == {i: (least[root(i)], members[root(i)]) for i in range(len(docs))}
    assert near_duplicates(df, weighted=True).count() == len(docs)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    e, a = np.arange(400, dtype=np.uint64), rng.integers(1, 9, 400).astype(float)
    b = np.where(rng.random(400) < 0.8, a, rng.integers(1, 9, 400)).astype(float)
    s = signatures(np.concatenate([e, e]), np.repeat([0, 1], 400), 3, 2048, np.concatenate([a, b]))
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    assert not s[2].any()


def test_components_of_a_chain_and_a_ring(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (40, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 32: 30}


def test_edit_distance():
    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(1)
    for _ in range(150):
        p, t = ("".join(rng.choice("abé ") for _ in range(rng.randint(a, b))) for a, b in ((1, 80), (0, 90)))
        assert distance(p, t) == brute(p, t)


def test_decontamination(spark, words):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(30) for _ in range(5)] + ["tiny", "   ", None]
    near = list(items[1])
    for k in range(5, len(near), len(near) // 5):
        near[k] = "#"
    far = list(items[2])
    for k in range(0, len(far), 4):
        far[k] = "#"
    docs = [f"{say(40)}\n{items[0].upper()} {say(5)}", f"{say(7)} {''.join(near)} {say(3)}", f"{say(7)} {''.join(far)}", say(200), f"{items[3]}  {items[4]} {items[3]}", "so tiny.", items[2].replace(" ", "\n  "), None, ""]
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (None, say(20))], "item_id long, text string")
    got = by_id(decontaminate(table(spark, docs), bench))
    assert {i: list(r["items"]) for i, r in got.items() if r.contaminated} == {0: [0], 1: [1], 4: [3, 4], 5: [5], 6: [2]}
    assert got[1].edits[0] > 0 and list(got[4].edits) == [0, 0]


def test_language_id(spark):
    rng = random.Random(3)
    parts = {"en": "the and of tion ing er st", "de": "der die und ung sch ein über", "fr": "le les est eau ment é ou"}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
    langs = {i: lang for i, lang in enumerate(list(parts) * 60)}
    docs = [text(langs[i]) for i in langs]
    extra = [None, "", "123 !?", "x" * 30000]
    got = by_id(identify_languages(table(spark, docs + extra, langs), landmarks=24))
    assert sum(got[i].lang_pred == langs[i] for i in langs if got[i].held_out) >= 0.95 * sum(got[i].held_out for i in langs)
    assert all(got[len(docs) + k].lang_pred == "und" and got[len(docs) + k].score == 0 for k in range(3))
    assert got[len(docs) + 3].lang_pred in parts and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in langs)
    none = identify_languages(table(spark, docs, dict.fromkeys(langs)).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_every_language_has_a_landmark():
    grams = [np.arange(20 * k, 20 * k + 20, dtype=np.int32) for k in range(12) for _ in range(3)]
    labels = [f"l{k:02}" for k in range(12) for _ in range(3)]
    m = langid.fit(grams, labels, landmarks=4)
    assert [m.languages[k] for k in (m.kernel(grams) @ m.weights + m.bias).argmax(1)] == labels


def test_toxicity_finds_disguised_insults(spark, words):
    rng = random.Random(8)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    bad = ["nastyfool", "horridpig"]
    docs, labels = [], []
    for i in range(240):
        w = say(40)
        if i % 3 == 0:
            w.insert(rng.randrange(40), rng.choice(bad))
        docs.append(" ".join(w))
        labels.append((i, 1 if i % 3 == 0 else 0))
    docs += [None, "", "nasty-fool " + " ".join(say(9)), "hor.ridpig", " ".join(say(3000))]
    known = spark.createDataFrame([*labels, (0, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    got = by_id(toxicity(table(spark, docs), known))
    assert sum(got[i].predicted == y for i, y in labels if got[i].held_out) >= 0.97 * sum(got[i].held_out for i, _ in labels)
    assert [got[240 + k].predicted for k in range(5)] == [0, 0, 1, 1, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert fit([], ["a b"]) is None


def test_toxicity_learns_insults_that_a_clean_text_quotes(words):
    rng = random.Random(14)
    say = lambda *more: " ".join(rng.sample([*rng.choices(words, k=20), *more], 20 + len(more)))
    toxic = [say("vilezzqux") if k % 40 == 0 else say() for k in range(1000)]  # 25 texts, under 1 % of predecessors a text as the sample grows
    clean = [say() for _ in range(1000)] + [say("vilezzqux")]
    toxic += [say("grubzzwok") for _ in range(60)]
    machine = fit(toxic, clean)
    assert (machine.decide(["vilezzqux", "grubzzwok"]) > 0).all()


@pytest.mark.parametrize("flips", [1, 12])
def test_toxicity_learns_from_noisy_labels(words, flips):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        w = rng.choices(words, k=40)
        if i % 3 == 0:
            w.insert(rng.randrange(40), rng.choice(["nastyfool", "horridpig"]))
        docs.append(" ".join(w))
        labels.append(i % 3 == 0)
    learn = [i for i in range(300) if i % 5]
    noisy = list(labels)
    for y in (True, False):
        for i in rng.sample([i for i in learn if labels[i] == y], flips):
            noisy[i] = not y
    machine = fit([docs[i] for i in learn if noisy[i]], [docs[i] for i in learn if not noisy[i]])
    value = decide_texts(machine, pa.array(docs))
    assert [v > 0 for v in value[::5]] == labels[::5]


def test_folded_machine_is_the_sum_of_kernels(words):
    rng = np.random.default_rng(7)
    marks, alpha = words[:40], rng.standard_normal(40)
    some = [w for w in words[40:] if len(w) >= toxicity_module.SHORTEST]
    assert np.allclose(folded(marks, alpha).decide(some), kernel(some, marks) @ alpha + toxicity_module.BIAS, atol=1e-4)

    def plain(a, b):
        def weights(w):
            s, out = [0, *map(toxicity_module.symbol, w), 0], Counter()
            for i, j, k in itertools.combinations(range(len(s)), 3):
                out[s[i], s[j], s[k]] += toxicity_module.DECAY ** (k - i + 1)
            return out

        x, y = weights(a), weights(b)
        return sum(v * y[t] for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    got = kernel(some[:12], some[5:15])
    assert np.allclose(got, [[plain(a, b) for b in some[5:15]] for a in some[:12]], atol=1e-5)


def test_toxicity_of_repeated_ids_is_the_same_in_any_order(spark, words):
    rng = random.Random(17)
    rows = [(i % 60, " ".join(rng.choices(words, k=15) + (["nastyfool", rng.choice(words)] if i % 2 else []))) for i in range(180)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    runs_ = [sorted((r.doc_id, r.score) for r in toxicity(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels).collect()) for x, n in ((rows, 3), (rows[::-1], 5))]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(*runs_))


def test_spelt_insults_count_for_their_own_row(words):
    rng = random.Random(15)
    say = lambda *more: " ".join([*rng.choices(words, k=20), *more, rng.choice(words)])
    machine = fit([say("nastyfool") for _ in range(80)], [say() for _ in range(80)])
    rows = ["plain words i", "n a s t y f o o l", "n a s t y f o o l", "", "words a"]
    together = decide_texts(machine, pa.array(rows))
    assert np.allclose(together, [decide_texts(machine, pa.array([r]))[0] for r in rows])
    assert (together > 0).tolist() == [False, True, True, False, False]


def test_lm_scores(spark, texts):
    docs = [(None, "no id here"), *enumerate(texts), (0, texts[0])]
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [[*WORD.findall((t or "").encode().translate(low)), None] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = {i: (h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for (i, _), x, h in zip(docs, tokens, held)}
    rows = score_documents(table(spark, texts), steps=20).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 * abs(want[r.doc_id][4]) and r.score < 0


def test_lm_scores_learn_from_rows_outside_the_sample(spark, words):
    rng = random.Random(12)
    say = lambda some: " ".join(rng.choice(some) for _ in range(60))
    rare = [w.translate(str.maketrans("abcdefghijklmnop", "qrstuvwxyzqrstuv")) for w in words]
    asked = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 7 == 2)
    ids, probe = list(range(400)), say(rare)
    base = spark.createDataFrame([(i, say(words)) for i in ids] + [(asked, probe)], "doc_id long, text string")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("model sample")), F.lit(1 << 30)) < (1 << 30) // 4
    sampled = {r.doc_id for r in base.where(drawn).collect()}  # a draw of 20 of some 340 is within these
    other = spark.createDataFrame([(r.doc_id, r.text if r.doc_id in sampled or r.doc_id == asked else say(rare)) for r in base.collect()], "doc_id long, text string")
    one, two = (by_id(score_documents(d, sample=20, steps=30))[asked].score for d in (base, other))
    assert two > one + 10


def test_lm_scores_train_on_every_subword(spark, words, monkeypatch):
    from marlstone.llm import lmscore
    from marlstone.llm.attention import AttentionModel

    rng = random.Random(13)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(2000), say(700), "", say(1), *(say(rng.randint(1, 90)) for _ in range(40))]
    fitted, fit = [], lmscore.Scorer.fit
    monkeypatch.setattr(lmscore.Scorer, "fit", lambda self, *what: (fitted.append(what), fit(self, *what))[1])
    rows = score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sample=2, steps=2).collect()
    sub = subwords(bpe.default_path(), MERGES)
    learned = pa.array([texts[r.doc_id] for r in rows if not r.held_out])
    ids, first, _ = sub.texts(Words(lowered(learned)))
    # the weights of pairs are fitted on every subword of all tasks, that of frequent words on every word and end
    (held,) = fitted[0]
    assert held[:-1].sum() == len(ids) and held[-1].sum() == rows[0].train_tokens
    # a task learns every subword once, after the one before it
    m, met = AttentionModel(sub.size, np.arange(sub.size)), Counter()
    trainer = lmscore.Trainer(lmscore.Scorer(m, lmscore.PairBlend(np.ones((sub.size + 1, sub.size), np.int64)), (np.empty(0, np.uint64), np.empty(0, np.int64)), 0))
    step = trainer.adam.step
    trainer.adam.step = lambda x, y, used, rate: (met.update(zip(x[used].tolist(), y[used].tolist())), step(x, y, used, rate))[1]
    assert (trainer.learn(ids, first) < 0).all()
    assert met == Counter(pair for a, z in zip(first, first[1:]) for pair in zip([sub.size, *ids[a : z - 1].tolist()], ids[a:z].tolist()))


def test_nearest(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 20))
    v[250:300] = v[100]
    rows = [(i, x.tolist(), 1, 1.0) for i, x in enumerate(v)]
    rows += [(1000, None, 0, 0.0), (1100, [0.0] * 20, 0, 0.0), (1200, [math.nan] * 20, 0, 0.0), (1300, [None] + [1.0] * 19, 0, 0.0), (None, [1.0] * 20, 0, 0.0), (1400, [1.0, 2.0], 0, 0.0), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    got = nearest(df).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(600), d))[:10].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        hits += len(set(order) & {r.vec_id for r in mine})
        if q == 100:
            assert [r.vec_id for r in mine] == list(range(250, 260))
    assert hits >= 54 and {r.query_id for r in got} == set(range(0, 600, 100))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_attention_model_has_its_full_size():
    from marlstone.llm.attention import AttentionModel

    p = AttentionModel(2048, np.arange(2048)).p
    assert p["w1"].shape == (32, 32) and p["d"].shape == (64, 32, 32)


# -- models against plain versions ------------------------------------------------------------------------------


def test_language_scores_match_a_plain_kernel(words):
    rng = random.Random(31)
    texts = ["Über die Straße, 12!", "le été à Noël", "a", "", "zz top"] + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)]
    labels = [["de", "fr", "en"][k % 3] for k in range(len(texts))]
    m = langid.fit(list(langid.presence(pa.array(texts))), labels, landmarks=12)
    codes = np.flatnonzero(m.column >= 0)
    marks = [set(codes[np.flatnonzero(row)].tolist()) for row in np.unpackbits(m.landmarks, axis=1, count=m.width)]

    def grams(text):
        c = langid.FOLD[np.frombuffer(text.encode(), np.uint8)].tolist()
        one, two = {64**3 + 64**2 + x for x in c}, {64**3 + x * 64 + y for x, y in zip(c, c[1:])}
        return one | two | {(x * 64 + y) * 64 + z for x, y, z in zip(c, c[1:], c[2:])}

    for t, got in zip(texts, m.scores(pa.array(texts))):
        own = grams(t)
        kernel_ = [len(own & mark) / math.sqrt(max(1, len(own)) * len(mark)) for mark in marks]
        assert np.allclose(got, np.array(kernel_) @ m.weights + m.bias, atol=1e-4)


def test_decontamination_equals_a_full_search(spark, words):
    rng = random.Random(32)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(rng.randint(4, 14)) for _ in range(12)]

    def edited(text, n):
        t = list(text)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["q"], [t[k], "q"]])
        return "".join(t)

    docs = []
    for k in range(60):
        item = items[k % 12]
        docs.append(f"{say(rng.randint(0, 20))} {edited(item, rng.randint(0, int(0.16 * len(item))))} {say(rng.randint(0, 20))}".strip())
    docs.append(say(30_000) + " " + items[0].upper())

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    want = {}
    for i, d in enumerate(docs[:-1]):
        found = {j: e for j, item in enumerate(items) if (e := least(item, d)) <= int(0.08 * len(item))}
        want[i] = (sorted(found), [found[j] for j in sorted(found)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = by_id(decontaminate(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench))
    assert {i: (list(got[i]["items"]), list(got[i].edits)) for i in want} == want
    assert 0 in got[60]["items"] and sum(bool(w[0]) for w in want.values()) >= 15


def small_model(n=70, seen=None):
    from marlstone.llm.attention import AttentionModel

    rng = np.random.default_rng(41)
    texts = [np.concatenate([[n], rng.integers(0, seen or n, 60).cumsum() % (seen or n)]) for _ in range(30)]
    m = AttentionModel(n, np.arange(n), seen)
    m.train(texts, 40)
    return m.ready(), rng


def test_attention_is_causal_and_scores_every_id_once():
    m, rng = small_model()
    ids = rng.integers(0, 70, 150)
    first = np.array([0, 3, 100, 100, 150])
    lp = m.score(ids, first)
    assert np.isfinite(lp).all() and (lp < 0).all()
    for at in (1, 40, 120):
        other = ids.copy()
        other[at:] = rng.integers(0, 70, 150 - at)
        assert np.allclose(m.score(other, first)[:at], lp[:at], atol=1e-5)
    for a, z in zip(first, first[1:]):  # texts don't see one another
        assert np.allclose(m.score(ids[a:z], np.array([0, z - a])), lp[a:z], atol=1e-5)


@pytest.mark.parametrize("seen", [None, 40])
def test_probabilities_sum_to_one(seen):
    from marlstone.llm.lmscore import Scorer
    from marlstone.llm.subword_pairs import PairBlend

    m, rng = small_model(seen=seen)
    pairs = rng.integers(0, 5, (71, 70))
    blend = PairBlend(pairs)
    blend.share[:] = rng.random(71)
    ids = rng.integers(0, 70, 90)
    first = np.array([0, 90])
    for at in (0, 5, 17, 33, 89):
        every = np.array([np.concatenate([ids[:at], [y], ids[at + 1 :]]) for y in range(70)])
        assert abs(sum(np.exp(m.score(x, first)[at]) for x in every) - 1) < 1e-4
        assert abs(sum(np.exp(blend(blend.before(x, first), x, m.score(x, first))[at]) for x in every) - 1) < 1e-4
    scorer = Scorer(m, blend, (np.arange(3, dtype=np.uint64), np.array([5, 2, 3])), 10)
    scorer.share = 0.3
    lp = np.log(rng.dirichlet(np.ones(6)))  # six words: three frequent ones, the end, and two others
    assert abs(np.exp(scorer.mixed(lp, np.array([5, 2, 3, 10, 0, 0]))).sum() - 1) < 1e-12


def test_windows_equal_a_plain_attention():
    from marlstone.llm.attention import STRIDE, WIDE, WINDOW

    m, rng = small_model()
    ids = rng.integers(0, 70, 75)
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    seq = np.concatenate([[70], ids])
    for t, got in enumerate(m.score(ids, np.array([0, 75]))):
        begin = max(0, t // STRIDE * STRIDE - (WINDOW - STRIDE)) if t >= STRIDE else 0
        x = seq[begin : t + 1]
        e = p["e"][x]
        s = (e @ p["k"]) @ (e[-1] @ p["q"]) / math.sqrt(WIDE) + p["r"][np.arange(len(x))[::-1]]
        a = np.exp(s - s.max())
        u = e[-1] + (a / a.sum()) @ (e @ p["v"]) @ p["o"]
        z = u + np.maximum(u @ p["w1"] + p["b1"], 0) @ p["w2"]
        c, w = m.cls[ids[t]], m.within[ids[t]]
        one, two = z @ p["c"] + p["bc"], z @ p["d"][c] + p["bd"][c]
        assert abs(one[c] - np.log(np.exp(one).sum()) + two[w] - np.log(np.exp(two).sum()) - got) < 1e-3


def test_attention_gradients():
    m, rng = small_model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = rng.integers(0, 71, (3, 32)), rng.integers(0, 70, (3, 32))
    used = rng.random((3, 32)) < 0.8
    _, g = m.step(x, y, used)
    for name, p in m.p.items():
        flat = p.reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            old, h = flat[k], 1e-5
            flat[k] = old + h
            up = m.step(x, y, used)[0]
            flat[k] = old - h
            down = m.step(x, y, used)[0]
            flat[k] = old
            if name != "bd" or abs(old) < 20:
                assert abs((up - down) / (2 * h) - g[name].reshape(-1)[k]) < 1e-4, name


def test_training_maps_every_id_once():
    m, rng = small_model()
    rows = []

    class Watched(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **more):
            if ufunc is np.matmul:
                rows.append(max(math.prod(np.shape(i)[:-1]) for i in inputs))
            return getattr(ufunc, method)(*map(np.asarray, inputs), **more)

    m.p |= {k: m.p[k].view(Watched) for k in "qkvo"}
    x, y = rng.integers(0, 71, (64, 32)), rng.integers(0, 70, (64, 32))
    lp, g = m.learn(x, y, np.ones((64, 32), bool))
    assert len(lp) == 64 * 32 and rows and max(rows) <= 71  # ids, not the 2,048 places that hold them


@pytest.mark.parametrize("scale", [1, 30, 300])
def test_training_holds_with_large_logits(scale):
    m, rng = small_model()
    x, y = rng.integers(0, 71, (5, 32)), rng.integers(0, 70, (5, 32))
    used = rng.random((5, 32)) < 0.8
    m.p |= {k: m.p[k] * np.float32(scale) for k in "qcd"}
    lp, g = m.learn(x, y, used)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    exact, want = m.learn(x, y, used)
    assert np.allclose(lp, exact, rtol=1e-3, atol=1e-3)
    assert all(np.allclose(g[k], want[k], rtol=1e-2, atol=1e-3 * abs(want[k]).max()) for k in g)
    assert not m.learn(x, y, used & False)[0].size


def test_segments_are_recalled_from_other_rows_only():
    rng = random.Random(43)
    ctx = [f"c{k}" for k in range(6)]
    rows = [[(rng.choice(ctx), rng.choice("xyz")) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    learned = np.array([rng.random() < 0.7 for _ in rows])
    names = sorted({s for r in rows for s in r})
    totals, last = [], None
    for c, s in names:
        inside = [t for r, ok in zip(rows, learned) if ok for t in r if t[0] == c]
        totals.append((len(inside), sum(t == (c, s) for t in inside), len(set(inside)), int(c == last)))
        last = c
    row = np.array([i for i, r in enumerate(rows) for _ in r])
    at = np.array([names.index(t) for r in rows for t in r])
    lp = -np.array([rng.random() * 20 for _ in at])
    got = recalled(row, at, lp, learned, np.array(totals))
    k = 0
    for i, r in enumerate(rows):
        others = [t for j, q in enumerate(rows) if learned[j] and j != i for t in q]
        for c, s in r:
            after = [t for t in others if t[0] == c]
            share = len(after) / (len(after) + len(set(after))) if after else 0.0
            want = math.log(share * (after.count((c, s)) / len(after) if after else 0) + (1 - share) * math.exp(lp[k])) - lp[k]
            assert abs(got[k] - want) < 1e-9
            k += 1


def test_lm_scores_tell_repeated_documents_and_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows, texts = by_id(score_documents(docs)), {r.doc_id: r.text for r in docs.collect()}
    times = Counter(t for i, t in texts.items() if not rows[i].held_out)
    each = lambda ids: [rows[i].score / rows[i].n_tokens for i in ids if rows[i].n_tokens > 60]
    once = each(i for i, t in texts.items() if times[t] - (not rows[i].held_out) == 0)
    again = each(i for i, t in texts.items() if times[t] - (not rows[i].held_out) > 0)
    assert len(again) >= 10 and np.median(again) > np.quantile(once, 0.9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > 0.92 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) >= 0.6 * len(held)


@pytest.mark.parametrize("dimension", [64, 128, 384, 768])
@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_nearest_recall(dimension, kind):
    rng = np.random.default_rng(dimension)
    n = 1500
    v = rng.standard_normal((n, dimension))
    if kind == "clustered":
        v = rng.standard_normal((60, dimension))[rng.integers(0, 60, n)] + 0.4 * v + 1e6
    made = crosspolytope.calibrated(v, n, 10)
    ask = np.arange(0, n, 25)
    q = crosspolytope.Asked(ask, v[ask], made.probed(v[ask]), made.buckets)
    i, found, d = q.search(v, made.codes(v), 11)
    hits = 0
    for k, a in enumerate(ask):
        dist = np.sqrt(((v - v[a]) ** 2).sum(1))
        mine = found[i == k]
        assert np.allclose(d[i == k], dist[mine], rtol=1e-12)
        dist[a] = np.inf
        hits += len(set(np.argsort(dist)[:10].tolist()) & set(mine.tolist()))
    share = len(q.candidates(made.codes(v), n)[0]) / (len(ask) * n)
    assert hits >= 0.9 * 10 * len(ask)
    assert kind == "gaussian" or share < 0.25


def test_nearest_of_huge_tiny_and_distant_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 8))
    for scale, offset in ((1e200, 0.0), (1e-200, 0.0), (0.01, 1e6), (1e300, 1e305)):
        v = base * scale + offset
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = nearest(df).collect()
        for a in (0, 100, 200):
            d = crosspolytope.lengths(v - v[a])
            d[a] = np.inf
            mine = sorted((r for r in got if r.query_id == a), key=lambda r: r["rank"])
            assert len(mine) == 10 and all(r.score == d[r.vec_id] and 0 < r.score < np.inf for r in mine)
            assert len({r.vec_id for r in mine} & set(np.argsort(d)[:10].tolist())) >= 8


def test_weighted_near_duplicates_match_brute_force(spark, words):
    rng = random.Random(45)
    base = [[rng.choice(words[:12]) for _ in range(n)] for n in (40, 90, 200)]
    docs = [" ".join(b) for b in base]
    for b in base:
        for _ in range(12):
            c = list(b)
            for _ in range(rng.randint(0, 6)):
                c[rng.randrange(len(c))] = rng.choice(words[:12])
            docs.append(" ".join(c + c[: rng.choice([0, 0, 10])]))
    bags = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(str.split, docs)]
    links = [(i, j) for i, a in enumerate(bags) for j, b in enumerate(bags[:i]) if sum((a & b).values()) >= 0.8 * sum((a | b).values())]
    least = list(range(len(docs)))
    for _ in docs:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    got = by_id(near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), weighted=True))
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(least))


def test_kept_columns_of_any_name(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text, "a", "b", "c"), (2, text + " end", "d", "e", "f")], "doc_id long, text string, md5 string, __x string, stretches string")
    got = by_id(substring_dedup(df, outputs=("n_removed", "kept"), keep=("md5", "__x", "stretches", "text")))
    assert (got[2].n_removed, got[2].kept, got[2].md5, got[2]["__x"], got[2].stretches, got[2].text) == (40, "end", "d", "e", "f", text + " end")

"""Importance resampling, phrase collocations and language ID against brute force, with odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import collocations, importance, language

SCHEMA = "doc_id long, text string, lang string, score double, rank long, n long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = ["w3 w4 W5 w3", None, "", "é w1, w2-w3"]


def sample(seed, n, vocabulary=30):
    rng = np.random.default_rng(seed)
    return "".join(f"w{int(min(x, vocabulary))}{rng.choice([' ', ' ', ' ', '. ', chr(10), chr(9)])}" for x in rng.geometric(0.15, n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, sample(i, 30 + 7 * i), ["en", "de", None][i % 3]) for i in range(40)]
    out += [(50, None, "en"), (51, "", None), (52, " .,\n", "en"), (53, "É É É é Ab-cd", "fr"), (5, out[5][1], "de"), (None, sample(7, 60), "en"), (54, "A " * 3000 + "x" * 70_000, "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_resample(rows, target, percent, least, shortest, longest, buckets):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        grams = [" ".join(w[i : i + k]) for k in range(shortest, longest + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, text, *_ in rows:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: len(fit) * percent // 100]
    return sorted((str(r[:4]) + str(next((k + 1 for k, d in enumerate(drawn) if d is r), None)) for r in out))


@pytest.mark.parametrize("shortest,longest,buckets,percent", [(1, 1, 10_000, 10), (1, 3, 50, 60), (2, 2, 7, 100)])
def test_resample(spark, docs, rows, shortest, longest, buckets, percent):
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    got = importance.resample(docs.repartition(3), target, percent, shortest=shortest, longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want, found = plain_resample(rows, TARGET, percent, 20, shortest, longest, buckets), sorted(str([r.doc_id, r.n_features, r.weight, r.score]) + str(r["rank"]) for r in got.collect())
    # of two equal rows under one id either may come first
    assert Counter(found) == Counter(want)


def test_resample_without_rows(docs, empty):
    assert importance.resample(empty, empty).count() == 0
    got = importance.resample(docs, empty)
    assert got.count() == docs.count() and got.filter("rank IS NOT NULL").count() == got.filter("n_features >= 20").count() // 10
    assert importance.resample(empty.unionByName(docs.filter("doc_id >= 50")), empty).filter("doc_id = 50").first().weight == 0


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 5000])
def test_prefix_crcs(size):
    data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8)
    prefix = importance.prefix_crcs(data)
    starts = np.random.default_rng(1).integers(0, size + 1, 200)
    ends = np.minimum(size, starts + np.random.default_rng(2).integers(0, 3000, 200))
    got = importance.span_crcs(prefix, starts, ends)
    assert [int(x) for x in got] == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def plain_collocations(rows, least, top, share, longest):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        key = (lang, tuple(w[i : i + k]))
                        f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(100 * b >= share * a for (m, v), b in cand.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("least,top,share,longest,listed,small", [(4, 30, 100, 5, 1 << 20, False), (3, 2000, 70, 4, 5, True), (2, 50, 100, 3, 0, True), (6, 2000, 100, 5, 1 << 20, True)])
def test_collocations(docs, rows, least, top, share, longest, listed, small, monkeypatch):
    if small:
        for name, value in {"BURST": 16, "ENTRIES": 300, "STEP": 50, "GROUP": 100, "HOT": 20, "LONG_RUN": 4, "WORDS_HELD": 20}.items():
            monkeypatch.setattr(collocations, name, value)
    got = collocations.collocations(docs.repartition(2), least, top, share, longest, listed)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {k for _, k in got.dtypes[3:]} == {"bigint"}
    assert {tuple(r) for r in got.collect()} == plain_collocations(rows, least, top, share, longest)


def test_collocations_without_rows(empty, docs):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.filter("doc_id in (50, 51, 52)"), least=1).count() == 0


def test_trie_keeps_every_suffix(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 64)
    rng = np.random.default_rng(3)
    trie, want = collocations.Trie(), Counter()
    for _ in range(20):
        ids = np.minimum(rng.geometric(0.3, 500), 40)
        high, low = collocations.suffixes(ids, rng.random(500) < 0.1, 5, 500)
        trie.add(high, low, np.ones(len(high), np.int64))
        want.update(zip(high.tolist(), low.tolist()))
    assert len(trie) == len(want) and len(trie.leaves) > 20
    assert (np.diff(trie.edges.astype(np.int64)) > 0).all()
    got = Counter()
    for keep in (len(trie) // 2, 0):
        high, low, n = trie.spill(keep)
        assert len(trie) <= keep
        got.update(dict(zip(zip(high.tolist(), low.tolist()), n.tolist())))
    assert got == want


def test_hash_clash_is_an_error(spark, docs, monkeypatch):
    clash = spark.createDataFrame([("en", "a", 7, 3), ("en", "b", 7, 2)], "lang string, word string, key long, n long")
    monkeypatch.setattr(collocations, "word_counts", lambda docs: clash)
    with pytest.raises(ValueError):
        collocations.collocations(docs)


PHRASES = {"en": "the cat and the dog went over there", "de": "der hund und die katze gingen dorthin", "el": "η γάτα και ο σκύλος πήγαν εκεί", "hi": "बिल्ली और कुत्ता वहाँ गए"}


def lettered(seed, lang):
    words = PHRASES[lang].split()
    return " ".join(np.random.default_rng(seed).choice(words, 12))


def plain_scores(rows, model_rows):
    """Every n-gram by itself, in Python."""
    lower, letter = language.alphabet()

    def grams(text):
        chars = [0]
        for c in map(ord, text):
            if lower[c] or chars[-1]:
                chars.append(int(lower[c]))
        if chars[-1]:
            chars.append(0)
        for n in range(1, language.LONGEST + 1):
            for i in range(len(chars) - n + 1):
                g = chars[i : i + n]
                if all(g[1:-1]) and (n > 1 or g[0]):
                    h = 0
                    for k, c in enumerate(g):
                        h = (h * 0x9E3779B97F4A7C15 + c + ((k + 1) << 24)) % 2**64
                    yield ((h * 0xD6E8FEB86659FD93 % 2**64) >> 32) % language.BUCKETS

    n, docs_of = {}, Counter()
    for _, text, lang in model_rows:
        if text is not None and lang is not None:
            docs_of[lang] += 1
            n.setdefault(lang, Counter()).update(grams(text))
    out = {}
    for doc_id, text, _ in rows:
        found = list(grams(text or ""))
        if not text or not any(letter[ord(c)] for c in text):
            out[doc_id] = ("und", 0.0)
            continue
        value = {}
        for lang, c in n.items():
            base = math.log(c.total() + language.SMOOTHING * language.BUCKETS)
            total = sum(round((math.log(c[g] + language.SMOOTHING) - base) * language.SCALE) for g in found)
            value[lang] = total / language.SCALE * min(1, language.EVIDENCE / max(1, len(found))) + math.log(docs_of[lang] / docs_of.total())
        best = max(sorted(value), key=value.get)
        out[doc_id] = (best, 1 / sum(math.exp(v - value[best]) for v in value.values()))
    return out


def test_language(spark, monkeypatch):
    rows = [(i, lettered(i, lang), lang) for i, lang in enumerate(list(PHRASES) * 12)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 … !?", "en"), (103, "THE CAT!! the", None), (104, "İßǅ ы", None), (105, "dog " * 50_000, None)]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    teach = frame.filter(language.learnable(F.col("doc_id")))
    want = plain_scores(rows, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1])
    for piece in (1 << 18, 7):
        monkeypatch.setattr(language, "PIECE", piece)
        part = frame if piece > 7 else frame.filter("doc_id < 105")
        got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(part.repartition(3), language.train(teach)).collect()}
        for doc_id, (lang, score) in got.items():
            assert lang == want[doc_id][0] and abs(score - want[doc_id][1]) < 2e-6, doc_id
    right = [want[i][0] == lang for i, _, lang in rows[:48]]
    assert sum(right) >= 44  # of 48; a dozen words of each language were learnt


def test_language_without_teachers(spark):
    frame = spark.createDataFrame([(1, "abc", None), (None, None, "en"), (1, "abc", None)], "doc_id long, text string, lang string")
    got = language.identify(frame, language.train(frame)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 3
    assert language.identify(frame.limit(0), language.train(frame.limit(0))).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGS", 2)
    frame = spark.createDataFrame([(k, "abc", x) for k, x in enumerate("aabbccdd")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.train(frame)
    assert language.counts(frame.coalesce(1)).agg(F.sum("n")).first()[0] == 8 * len("abc") + 8 * 4 + 8 * 3 + 8


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language.op13_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.filter("held_out").agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 300 and right >= 0.99 * n

"""Each stage of the corpus pipeline against a plain form of it on the stage's own input, then the whole pipeline."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusframe.llm import decontaminate, mixing, quality, repair
from corpusframe.llm.common import columns
from test_training_data import brute_groups, encoded, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of ``documents`` and what every stage makes of the one before."""
    docs = columns(spark.read.parquet(f"{SF}/documents.parquet"), *corpus_pipeline.COLUMNS)
    out, frames = [docs.collect()], [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
        frames.append(docs)
    return out, frames


def test_quality_stage(spark, stages):
    (before, after, *_), (docs, *_) = stages
    net = quality.Network(quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    keep = set()
    for r in before:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        if round(float(net.score(raw, np.array([0, len(raw)]))[0]), 6) >= corpus_pipeline.LEAST_QUALITY:
            keep.add(r.doc_id)
    assert sorted(map(tuple, after), key=str) == sorted((tuple(r) for r in before if r.doc_id in keep), key=str)
    assert 0 < len(after) < len(before)


def test_near_copies_stage(stages):
    (_, before, after, *_), _ = stages
    groups = brute_groups([tuple(r) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, smallest) in groups.items() if smallest == i)
    assert len(after) < len(before)


def test_decontamination_stage(spark, stages):
    (_, _, before, after, *_), (_, _, docs, *_) = stages
    leaked = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    items = [" ".join(words(r.text)).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    verbatim = {r.doc_id for r in before if any(i in " ".join(words(r.text)).lower() for i in items)}
    assert verbatim <= leaked
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in leaked)


def test_mixing_stage(stages):
    (_, _, _, before, after, _), _ = stages
    size, taken, texts = {}, {}, {r.doc_id: r.text for r in before}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
        pieces = words(r.text)
        own = words(texts[r.doc_id])
        assert pieces and set(pieces) <= set(own) and r.n_chars == len(r.text)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(size.values()))))
    assert all(abs(taken.get(s, 0) - want[s]) <= mixing.BLOCK + 0.1 * want[s] for s in names)


def test_tokens_stage(stages):
    (*_, before, after), _ = stages
    encoder = repair.Encoder(repair.default_tokenizer())
    ordered = sorted(before, key=lambda r: (r.doc_id, r.text))
    start, want = 0, []
    for r, ids in zip(ordered, encoded(encoder, [r.text for r in ordered])):
        full = ids + b"\x02\0\0\0"
        want.append((r.doc_id, start, len(full) // 4, zlib.crc32(full)))
        start += len(full) // 4
    assert sorted(map(tuple, after)) == sorted(want)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[0][-1]))


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, word string"
    odd = [(None, None, None, None, None, 0.5, 1, "x"), (1, "", "en", "s", 0, 0.5, 1, "x"), (1, "", "en", "s", 0, 0.5, 1, "x"), (2, "a b c " * 400, "en", None, 2400, None, None, None), (3, "é ñ", None, "s", 3, 0.1, 2, "y")]
    for name, rows in (("empty", []), ("odd", odd)):
        place = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{place}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
        assert corpus_pipeline.run(spark, place).count() >= (name == "odd")


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_substrings", "op3_matroska", "op4_repair", "op5_lines", "op6_token_counts", "op7_mix", "op8_quality", "op9_jaccard", "op10_urls"])
def test_queries_on_odd_tables(spark, tmp_path_factory, name):
    """Empty tables; then null ids and texts, repeated rows, a text beyond one slice, and columns with the operators' names."""
    from corpusframe.llm import queries

    base = tmp_path_factory.mktemp(name)
    extra = {c: F.lit(7) for c in ("order", "text_key", "node", "size", "score", "n_words", "gram", "host", "rule", "offset", "media", "size", "item")}
    long = " ".join(f"w{i % 977}" for i in range(1_100_000))  # over 4 MB
    docs = [(None, None, None, None), (None, "no id", "en", "s"), (1, "", "en", "s"), (2, "a b\nc d", "de", None), (2, "a b\nc d", "de", None), (3, long, "en", "s"), (2**63 - 1, "last id here", "en", "t")]
    pages = [(None, None, None), (1, "http://a.b/c", "<p>word</p>"), (1, "http://a.b/c", "<p>word</p>"), (2, "", ""), (3, "https://" + "longname" * 200 + ".com/en/", None), (4, "http://x.net/de/1", "y")]
    for kind, some in (("empty", 0), ("odd", None)):
        place = f"{base}/{kind}"
        spark.createDataFrame(docs[:some], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumns(extra).write.parquet(f"{place}/documents.parquet")
        spark.createDataFrame(pages[:some], "page_id long, url string, html string").withColumns({c: v for c, v in extra.items() if c not in ("host",)}).withColumn("host", F.lit("z")).write.parquet(f"{place}/pages.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1)][:some], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
        spark.createDataFrame([(None, "who is it? it is me"), (1, None), (1, "")][:some], "item_id long, text string").withColumn("item", F.lit(1)).write.parquet(f"{place}/benchmark.parquet")
        got = queries.QUERIES[name](spark, place)
        rows = got.collect()
        if kind == "empty" or name == "op1_decontaminate":
            assert rows == []
            continue
        key = "page_id" if name == "op10_urls" else "doc_id"
        ids = [r[key] for r in rows]
        assert sorted(map(repr, ids)) == sorted(repr(r[0]) for r in (pages if name == "op10_urls" else docs))

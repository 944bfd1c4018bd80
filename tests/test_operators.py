"""Hand-made cases: chunker, context documents, tables, functions, inference, incremental runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusframe.functions import text as X
from corpusframe.functions.vectors import parse_vector
from corpusframe.operators import chunking, evidence, inference, ops, retrieval, vectors, visuals
from corpusframe.sources import corpus
from corpusframe.streaming import streams
from plain_forms import chunk_blocks, looks_like_heading, render_context, table_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def block(i, text, page=0, **more):
    return {"page": page, "block_id": f"b{i}", "text": text, "locator": None, "section_heading": None, "force_chunk": False, "boundary": False} | more


def words(n_tokens, mark="w"):
    return (f"{mark} some words, " * n_tokens)[: 4 * n_tokens - 1] + "."


def test_chunker_headings_and_overlap():
    blocks = [block(0, "INTRODUCTION"), block(1, words(150)), block(2, words(20)), block(3, "Methods:"), block(4, words(30))]
    got = chunk_blocks(blocks)
    assert [c["block_ids"] for c in got] == [["b1", "b2"], ["b2", "b4"]]
    assert [c["section_heading"] for c in got] == ["INTRODUCTION", "Methods:"]


def test_chunker_limits():
    hard = chunk_blocks([block(0, words(700)), block(1, words(10))])
    assert [c["block_ids"] for c in hard] == [["b0"], ["b0", "b1"], ["b1"]]  # the overlap counts, and stays at the end
    soft = chunk_blocks([block(0, words(410)), block(1, words(10), page=1)])
    assert [(c["page_start"], c["page_end"]) for c in soft] == [(0, 0), (0, 1)]
    tail = [block(0, words(700))]
    assert len(chunk_blocks(tail)) == 2 and len(chunk_blocks(tail, drop_overlap_tail=True)) == 1


def test_chunker_forced_and_boundary():
    rows = [block(0, words(50)), block(1, "a | b\n1 | 2", force_chunk=True, section_heading="Sheet", locator="f!rows 2-3"), block(2, words(40)), block(3, words(30), boundary=True), block(4, " \x00 ")]
    got = chunk_blocks(rows)
    assert [c["block_ids"] for c in got] == [["b0"], ["b1"], ["b2"], ["b2", "b3"]]
    assert got[1]["locator"] == "f!rows 2-3" and got[1]["section_heading"] == "Sheet"
    assert [c["block_ids"] for c in chunk_blocks(rows, compat=True)][0] == ["b0", "b1", "b2"]


def test_context_document_budget():
    note = lambda q, t, **m: {"sub_query": q, "text": t, "doc_title": "T", "page_start": 1, "page_end": 2, "visual_ids": None} | m
    text = render_context([note("a", "one"), note("", "two", visual_ids=["v"]), note("a", "x" * 500), note("a", "y"), note("b", "three", doc_title=" ")], 250)
    assert text.splitlines()[0].startswith("CONTEXT DOCUMENT")
    assert "## a\n- one" in text and "xxx" not in text and "- y" not in text  # what doesn't fit ends its group
    assert "## Main question\n- two\n  (source: T, p.1-2, 1 figure/table)" in text and "(source: Untitled PDF, p.1-2)" in text
    assert render_context([note("a", "z")], 58).count("\n") == 0


def test_folds_equal_plain_forms(spark):
    """Documents, notes and tables by chance, each held against its rule in plain Python."""
    import numpy as np

    rng = np.random.default_rng(11)
    texts = lambda: rng.choice(["HEAD", "Short title:", " ", "Few words here", words(5), words(int(rng.integers(30, 200))), words(500), words(700)], p=[0.1, 0.05, 0.05, 0.1, 0.2, 0.3, 0.15, 0.05])
    kinds = "library_id string, doc_id string, pos int, page int, block_id string, text string, force_chunk boolean, locator string, section_heading string, boundary boolean"
    docs = {f"d{d}": [("l", f"d{d}", i, i // 4, f"b{i}", str(texts()), bool(rng.random() < 0.1), [None, f"at {i}"][int(rng.integers(2))], [None, "", f"sheet {i}"][int(rng.integers(3))], bool(rng.random() < 0.1)) for i in range(int(rng.integers(1, 40)))] for d in range(60)}
    blocks = spark.createDataFrame([r for rows in docs.values() for r in rows], kinds).repartition(3)
    names = [k.split()[0] for k in kinds.split(", ")]
    for drop, compat in ((False, False), (True, False), (False, True)):
        got = {}
        for r in chunking.chunk_documents(blocks, drop, compat).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r.asDict(recursive=True))
        for doc, rows in docs.items():
            want = chunk_blocks([dict(zip(names, r)) for r in rows], drop, compat)
            assert [{k: c[k] for k in want[0]} for c in got.get(doc, [])] == want, doc
            assert [c["chunk_index"] for c in got.get(doc, [])] == list(range(len(want)))

    fields = ["note_no", "sub_query", "text", "doc_title", "page_start", "page_end", "visual_ids"]
    asked = {q: [(q, i, [None, " ", "a", "b ", "c"][int(rng.integers(5))], [None, " \t", "x" * int(rng.integers(1, 200))][min(2, int(rng.integers(8)))], ["", None, "T"][int(rng.integers(3))], 1, [2, None][int(rng.integers(2))], [None, [], ["v"]][int(rng.integers(3))]) for i in range(12)] for q in range(40)}
    notes = spark.createDataFrame([r for rows in asked.values() for r in rows], "query_id int, note_no int, sub_query string, text string, doc_title string, page_start int, page_end int, visual_ids array<string>")
    for limit in (100, 300, 600, 14_000):
        got = {r.query_id: r.context for r in evidence.context_document(notes, limit).collect()}
        assert got == {q: render_context([dict(zip(fields, r[1:])) for r in rows], limit) for q, rows in asked.items()}

    tables = {d: [(d, 0, 0, str(rng.choice(["a", "b,c", 'q"', " x  y ", " "])), float(rng.integers(0, 60)), float(rng.integers(60, 90)), float(y), float(y + rng.integers(1, 9))) for y in rng.integers(0, 30, int(rng.integers(1, 20)))] for d in range(60)}
    spans = spark.createDataFrame([r for rows in tables.values() for r in rows], "doc_id int, page int, table_no int, text string, x0 double, x1 double, y0 double, y1 double")
    got = {r.doc_id: (r.n_rows, r.csv) for r in visuals.spans_to_table(spans, 3.5, 5.0).collect()}
    keys = ("text", "x0", "x1", "y0", "y1")
    clean = {d: [dict(zip(keys, (" ".join(r[3].split()), *r[4:]))) for r in rows if r[3].strip()] for d, rows in tables.items()}
    assert got == {d: table_of(rows, 3.5, 5.0) for d, rows in clean.items() if rows}


def test_functions(spark):
    assert one(spark, X.clean_text(F.lit(" a\u00a0\x00 b\n"))) == "a b"
    assert one(spark, X.keywords(F.lit("The quick brown-fox and the THE 12 x_1y"))) == ["quick", "brown-fox", "x_1y"]
    assert one(spark, X.ensure_extension(F.lit("A.PDF"), F.lit("application/pdf"))) == "A.PDF"
    assert one(spark, X.slugify(F.lit("--A b!C"))) == "a-b-c"
    assert one(spark, X.pretty_title(F.lit("  "))) == "Document"
    assert one(spark, X.drive_id(F.lit(None).cast("string"), F.lit("abcdefghijk"))) == "abcdefghijk"
    for text, want in (("[1,2]", [1.0, 2.0]), ("(1 2)", [1.0, 2.0]), ("{1, 2.5}", [1.0, 2.5]), ("", None), ("[1,x]", None)):
        assert one(spark, parse_vector(F.lit(text))) == want
    for text, want in (("CHAPTER ONE", True), ("A few words here", True), ("Table 3 of it", False), ("x" * 91, False), ("This is a sentence that ends.", False), ("", False)):
        assert one(spark, X.is_heading(F.lit(text))) is want
        assert looks_like_heading(text) is want


def test_ivf_recall_grows_to_exact(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    chunks = spark.createDataFrame([(f"c{i}", "l", [float(a) for a in v]) for i, v in enumerate(x)], "chunk_id string, library_id string, embedding array<double>")
    chunks = chunks.join(vectors.cluster_library(chunks), ["library_id", "chunk_id"]).cache()
    queries = spark.createDataFrame([(i, "l", [float(a) for a in rng.normal(size=8)]) for i in range(10)], "query_id int, library_id string, embedding array<double>")
    exact = {(r.query_id, r.chunk_id) for r in vectors.vector_topk(queries, chunks, 5).collect()}
    centers = vectors.centroids(chunks)
    recall = []
    for nprobe in (1, 5, 1000):
        got = {(r.query_id, r.chunk_id) for r in vectors.vector_topk_ivf(queries, chunks, centers, nprobe, 5).collect()}
        recall.append(len(exact & got) / len(exact))
    for name, value in {"FEW_QUERIES": 3, "TILE_CHUNKS": 70, "TILE_QUERIES": 4, "CELLS": 100}.items():  # many queries: tiles
        monkeypatch.setattr(vectors, name, value)
    assert {(r.query_id, r.chunk_id) for r in vectors.vector_topk(queries, chunks, 5).collect()} == exact
    assert recall == sorted(recall) and recall[1] > 0.5 and recall[2] == 1


def test_clusters_are_at_rest(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(f"c{i}", f"l{i % 3}", [float(a) for a in rng.normal(size=6)]) for i in range(400)] + [("alone", "l9", [1.0] * 6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, library_id string, embedding array<double>")
    found = {}
    for parts, limit in ((1, 1 << 30), (5, 1 << 30), (5, 600)):  # the last: libraries in turns
        monkeypatch.setattr(vectors, "CENTER_BYTES", limit)
        got = {r.chunk_id: (r.library_id, r.cluster_id) for r in vectors.cluster_library(chunks.repartition(parts)).collect()}
        assert got == (found or got)
        found = got
    assert len(found) == len(rows)
    for library, n in (("l0", 134), ("l9", 1)):
        x = {c: np.array(v) for c, lib, v in rows if lib == library}
        labels = {c: found[c][1] for c in x}
        centers = {k: np.mean([x[c] for c in x if labels[c] == k], 0) for k in set(labels.values())}
        assert len(centers) == min(n, max(8, round(n**0.5)))
        assert all(labels[c] == min(centers, key=lambda k: np.linalg.norm(x[c] - centers[k])) for c in x)
    assert vectors.cluster_library(chunks.limit(0)).count() == 0


def test_fusion_ignores_list_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "", 3)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    score = lambda *r: {(x.chunk_id, x.rrf_score) for x in retrieval.rrf(*r).collect()}
    assert score(a, b) == score(b, a) and len(score(a, b)) == 3


def test_spans_to_table(spark):
    rows = [(1, 0, 0, "a", 0, 10, 10.0, 20.0), (1, 0, 0, "b", 12, 20, 11.0, 21.0), (1, 0, 0, "c", 40, 50, 12.0, 22.0), (1, 0, 0, "d", 0, 9, 30.0, 40.0)]
    spans = spark.createDataFrame([(*r[:4], float(r[4]), float(r[5]), r[6], r[7]) for r in rows], "doc_id int, page int, table_no int, text string, x0 double, x1 double, y0 double, y1 double")
    assert [(r.n_rows, r.csv) for r in visuals.spans_to_table(spans).collect()] == [(2, "a b,c\r\nd\r\n")]


def test_inference_failures_are_rows(spark):
    def client():
        def call(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

        return call

    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, prompt string").coalesce(1)
    got = {r.id: (r.response, r.error) for r in inference.infer(prompts, client).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("", None)}
    calls = spark.createDataFrame([(1, i, "m", "x" * 400) for i in range(4)], "run_id int, call_id int, model string, prompt string")
    prices = spark.createDataFrame([("m", 1e4, 0.0)], "model string, input double, output double")
    assert inference.infer_with_budget(calls, prices, 1.5).count() == 2


def test_thread_cycles_end(spark):
    now = dt.datetime(2024, 1, 1)
    threads = spark.createDataFrame([("a", None, "a", now), ("b", "a", "a", now), ("c", "b", "a", now), ("x", "y", "x", now), ("y", "x", "x", now)], "thread_id string, parent_id string, root_id string, created_at timestamp")
    got = {r.thread_id: r.depth for r in ops.thread_lineage(threads).collect()}
    assert (got["a"], got["b"], got["c"]) == (0, 1, 2) and set(got) == set("abcxy")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, t string, v int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "id int, t string, v int")
    once = ops.upsert(old, new, ["id"], "v")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ops.upsert(once, new, ["id"], "v").collect())) == [(1, "c", 1), (2, "b", 5), (3, "e", 1)]


def test_files_to_blocks(spark):
    docs = spark.createDataFrame([("d", "# Head\n\ntext one\n \n two")], "doc_id string, text string")
    assert [(r.text, r.section_heading) for r in corpus.text_to_blocks(docs, True).orderBy("block_no").collect()] == [("# Head", "Head"), ("text one", None), ("two", None)]
    code = spark.createDataFrame([("d", "f.py", "import x\n\ndef a():\n  pass\nclass B:\n  y = 1\n"), ("e", "g.py", "\n".join(f"l{i}" for i in range(70)))], "doc_id string, title string, text string")
    got = {r.locator: r.section_heading for r in corpus.code_to_blocks(code).collect()}
    assert got == {"f.py:1-2": "import x", "f.py:3-4": "def a():", "f.py:5-6": "class B:", "g.py:1-60": None, "g.py:61-70": None}


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, [[1, 2], []], {"m": (5, "ok")})], "id int, chain array<array<int>>, judges map<string, struct<score:int,verdict:string>>")
    corpus.write_jsonl(rows, str(tmp_path / "r"))
    corpus.write_jsonl(rows, str(tmp_path / "r"), append=True)
    assert [r.judges["m"].score for r in corpus.read_jsonl(spark, str(tmp_path / "r"), rows.schema).collect()] == [5, 5]


def test_ingest_stream(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    first = spark.createDataFrame([("d1", "l", "one\n\ntwo words", 1), ("d2", "l", "three", 1)], streams.DOCUMENT)
    first.coalesce(1).write.json(source)
    streams.ingest_stream(spark, source, target, state).awaitTermination()
    spark.createDataFrame([("d1", "l", "changed it all", 2), ("d2", "l", "old", 0)], streams.DOCUMENT).coalesce(1).write.mode("append").json(source)
    streams.ingest_stream(spark, source, target, state).awaitTermination()
    got = {(r.doc_id, r.text) for r in streams.current_chunks(spark, target).collect()}
    (tmp_path / "replay").mkdir()
    streams.ingest_stream(spark, source, target, str(tmp_path / "replay" / "ckpt")).awaitTermination()  # all files again
    assert got == {(r.doc_id, r.text) for r in streams.current_chunks(spark, target).collect()}
    final = spark.createDataFrame([("d1", "l", "changed it all", 2), ("d2", "l", "three", 1)], streams.DOCUMENT)
    assert got == {(r.doc_id, r.text) for r in streams.chunks_of(final).collect()}


def test_message_and_usage_streams(spark, tmp_path):
    rows = [("m1", "t", "a", dt.datetime(2024, 1, 1)), ("m2", "t", "b", dt.datetime(2024, 1, 2)), ("m1", "t", "c", dt.datetime(2024, 1, 5))]
    frame = spark.createDataFrame(rows, "message_id string, thread_id string, content string, updated_at timestamp")
    frame.write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(frame.schema).json(str(tmp_path / "in"))
    streams.merge_messages_stream(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert {(r.message_id, r.content) for r in streams.current_messages(spark, str(tmp_path / "out")).collect()} == {("m1", "c"), ("m2", "b")}
    daily = streams.usage_stream(stream(), "updated_at", "thread_id")
    daily.writeStream.format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    streamed = spark.table("daily")
    assert {(r.day.day, r.n) for r in streamed.collect()} <= {(1, 1), (2, 1), (5, 1)}
    report = streams.usage_reconcile(frame, streamed, "updated_at", "thread_id").collect()
    assert {(r.day.day, r.n) for r in report} == {(1, 1), (2, 1), (5, 1)} and all(r.late == r.n - r.streamed for r in report)


def test_stall_stream(spark, tmp_path):
    rows = [("a", "running", dt.datetime(2024, 1, 1, 0, 0)), ("b", "done", dt.datetime(2024, 1, 1, 0, 0)), ("c", "queued", dt.datetime(2024, 1, 1, 0, 29))]
    schema = "library_id string, status string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    jobs = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    run = lambda: streams.stall_stream(jobs(), 5).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    run()
    spark.createDataFrame([("d", "done", dt.datetime(2024, 1, 1, 0, 31))], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()
    got = spark.read.schema("library_id string, last_update timestamp, stalled_at timestamp").json(str(tmp_path / "out")).collect()
    assert {(r.library_id, r.last_update, r.stalled_at) for r in got} == {("a", dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, 5))}


def test_stalled_now(spark):
    rows = [("a", "running", dt.datetime(2024, 1, 1, 0, 0)), ("b", "running", dt.datetime(2024, 1, 1, 0, 9)), ("c", "done", dt.datetime(2024, 1, 1))]
    jobs = spark.createDataFrame(rows, "library_id string, status string, ts timestamp")
    assert [r.library_id for r in streams.stalled_now(jobs, "2024-01-01 00:10:00").collect()] == ["a"]


@pytest.mark.parametrize("workers", [1, 3, 64])
def test_batches_differ_only_at_the_end(spark, workers):
    docs = spark.range(50).select(F.lit("l").alias("library_id"), F.col("id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("gdrive_file_id"), F.lit("t").alias("title"))
    sizes = [r["count"] for r in ops.assign_batches(docs, workers).groupBy("batch_index").count().orderBy("batch_index").collect()]
    assert sum(sizes) == 50 and len(set(sizes[:-1])) <= 1

"""Stored and incremental forms: blocked vector search, saved indexes, files, upserts and deletes in place, streams."""

import datetime as dt
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.functions.vectors import parse_vector, parsed_vectors
from corpusframe.operators import common, graph, lexical, vectors, visuals
from corpusframe.operators.ops import upsert
from corpusframe.sources import corpus
from corpusframe.streaming import streams


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def brute_topk(queries, chunks, k):
    out = set()
    for q, lib, org, across, v in queries:
        found = []
        for c, clib, corg, w in chunks:
            if clib == lib and (across or corg == org) and v is not None and w is not None and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                found.append((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9)), 6), c))
        out |= {(q, c, -s) for s, c in sorted(found)[:k]}
    return out


@pytest.mark.parametrize("tiles", [False, True])
def test_blocked_search(spark, tiles, monkeypatch):
    rng = np.random.default_rng(1)
    if tiles:
        for name, value in {"FEW_QUERIES": 2, "TILE_CHUNKS": 30, "TILE_QUERIES": 3, "CELLS": 64}.items():
            monkeypatch.setattr(vectors, name, value)
    vector = lambda: [float(x) for x in rng.integers(-2, 3, 4)]  # noqa: E731 - many ties
    chunks = [(f"c{i:03}", f"l{min(i % 5, 2)}", f"o{i % 2}", vector()) for i in range(200)] + [("none", "l0", "o0", None), ("wide", "l0", "o0", [1.0] * 9), ("zero", "l0", "o0", [0.0] * 4), ("nolib", None, "o0", vector())]
    queries = [(i, f"l{i % 4}", f"o{i % 2}", i % 3 == 0, vector()) for i in range(20)] + [(20, "l0", "o0", True, None), (21, "l0", "o1", True, [1.0] * 9)]
    stored = spark.createDataFrame(chunks, "chunk_id string, library_id string, organization_id string, embedding array<double>").withColumn("owner", F.lit(1))
    asked = spark.createDataFrame(queries, "query_id int, library_id string, organization_id string, cross_org boolean, embedding array<double>")
    got = vectors.vector_topk(asked, stored.repartition(3), 5).collect()
    assert {(r.query_id, r.chunk_id, r.score) for r in got} == brute_topk(queries, chunks, 5)
    assert vectors.vector_topk(asked.limit(0), stored).count() == vectors.vector_topk(asked, stored.limit(0)).count() == 0


def test_many_queries(spark):
    n, m = 200_000, 400
    at = lambda c, i: F.sin(c * (i + 1) * 0.37) + 0.1 * i
    vector = lambda c: F.array(*[at(c, i) for i in range(4)])
    chunks = spark.range(m).select(F.format_string("c%04d", "id").alias("chunk_id"), F.lit("l").alias("library_id"), vector(F.col("id")).alias("embedding"))
    queries = spark.range(n).select(F.col("id").alias("query_id"), F.lit("l").alias("library_id"), vector(F.col("id") + 0.5).alias("embedding"))
    got = vectors.vector_topk(queries, chunks, 1).toPandas().sort_values("query_id")
    x = np.array(chunks.toPandas().sort_values("chunk_id")["embedding"].tolist())
    q = np.array(queries.toPandas().sort_values("query_id")["embedding"].tolist())
    score = np.round(q @ x.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1) + 1e-9), 6)
    assert len(got) == n and (got["score"].to_numpy() == score.max(1)).mean() > 0.9999
    assert (got["chunk_id"].str[1:].astype(int).to_numpy() == score.argmax(1)).mean() > 0.999


def test_stored_clusters(spark, tmp_path):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 16)) * 3
    rows = [(f"c{i}", f"l{i % 2}", [float(a) for a in middle[i % 40] + rng.normal(size=16)]) for i in range(4000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, library_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, f"l{i % 2}", [float(a) for a in middle[i % 40] + rng.normal(size=16)]) for i in range(60)], "query_id int, library_id string, embedding array<double>")
    stored, centers = vectors.save_ivf(chunks, vectors.cluster_library(chunks), str(tmp_path))
    assert stored.count() == 4000 and 80 <= centers.count() <= 2 * 45  # a centre may lose all its chunks
    few = vectors.vector_topk_ivf(queries, stored, centers, 0.2, 5)
    assert "dynamicpruning" in few._jdf.queryExecution().executedPlan().toString()
    exact = {(r.query_id, r.chunk_id) for r in vectors.vector_topk(queries, chunks, 5).collect()}
    recall = len(exact & {(r.query_id, r.chunk_id) for r in few.collect()}) / len(exact)
    probes = vectors._probes(queries, centers, 0.2).groupBy("library_id", "cluster_id").count().withColumnRenamed("count", "asked")
    looked = stored.groupBy("library_id", "cluster_id").count().join(probes, ["library_id", "cluster_id"]).agg(F.sum(F.col("asked") * F.col("count"))).first()[0] / (60 * 2000)
    assert recall >= 0.9 and looked <= 0.4, (recall, looked)
    again = vectors.nearest_center(chunks, centers).join(stored.select("chunk_id", F.col("cluster_id").alias("c")), "chunk_id")
    assert again.filter("cluster_id <> c").count() < 40  # the last round's means, a move later


def test_saved_keyword_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    names = [f"word{i}" for i in range(60)]
    chunks = spark.createDataFrame([(f"c{i}", f"l{i % 3}", " ".join(rng.choice(names, 30)) + " common") for i in range(150)], "chunk_id string, library_id string, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choice(names, 4)) + " common") for i in range(20)], "query_id int, question string")
    path = str(tmp_path / "index")
    index = lexical.save_index(chunks, path, buckets=3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(lexical.bm25_search(queries, chunks, 5))
    assert want and rows(lexical.bm25_topk(queries, index, 5)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lexical.bm25_topk(queries, index, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and len(re.findall(r"Exchange hashpartitioning\(term", plan)) == 1, plan  # the questions' side
    spark.sql(f"DROP TABLE {lexical._table_of(path)}")
    assert rows(lexical.bm25_topk(queries, lexical.open_index(spark, path), 5)) == want
    scoped = queries.withColumn("library_id", F.concat(F.lit("l"), (F.col("query_id") % 4).cast("string")))
    assert rows(lexical.bm25_topk(scoped, index, 5)) == rows(lexical.bm25_search(scoped, chunks, 5))
    assert rows(lexical.search_postings(queries, lexical.postings_of(chunks), 5)) == want
    lexical.save_index(chunks.filter("library_id = 'l0'"), path)  # replaces it
    assert {r.library_id for r in lexical.open_index(spark, path).select("library_id").distinct().collect()} == {"l0"}


def test_csv_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_bytes(b'\n id,"name, full",n\r\n1,"a ""b"", c",2\n\n,,\n2,d,\n' + b"".join(b"%d,row,%d\n" % (i, i) for i in range(3, 103)))
    (tmp_path / "a" / "head.csv").write_text("only,header\n")
    (tmp_path / "a" / "blank.csv").write_text("\n , \n")
    (tmp_path / "a" / "other.txt").write_text("1,2\n")
    for size in ("128m", "100b"):  # the latter: many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = {(r.doc_id, r.block_no): r for r in corpus.csv_files(spark, str(tmp_path / "a")).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert set(got) == {("x.csv", k) for k in range(5)} | {("head.csv", 0)}
        assert got["x.csv", 0].text == "CSV x.csv: columns  id, name, full, n; 102 rows." and got["head.csv", 0].text == "CSV head.csv: columns only, header; 0 rows."
        first = got["x.csv", 1].text.split("\n")
        assert first[:4] == [" id | name, full | n", '1 | a "b", c | 2', "2 | d | ", "3 | row | 3"] and len(first) == 31
        assert got["x.csv", 4].locator == "x.csv!rows 92-103" and got["x.csv", 4].text.endswith("102 | row | 102")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "m.csv").write_text('k,v\n1,"two\nlines"\n2,x')
    got = corpus.csv_files(spark, str(tmp_path / "b"), F.lit("doc"), multi_line=True).orderBy("block_no").collect()
    assert [r.text for r in got] == ["CSV doc: columns k, v; 2 rows.", "k | v\n1 | two\nlines\n2 | x"]


def test_text_code_and_ocr_files(spark, tmp_path):
    for name, text in {"t/a.md": "# Top\n\none", "t/b.txt": "# no heading\n\n\ntwo", "c/f.py": "import x\ndef a():\n  pass\nclass B:\n  y = 1\n", "o/d1/text/0_a.txt": "page 0", "o/d1/table_text/0_t.txt": " table ", "o/d1/figure_text/2_f.txt": "figure", "o/d1/text/x.txt": "no page", "o/d2/text/1_a.txt": " "}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode() + (b"\xff" if name == "o/d1/figure_text/2_f.txt" else b""))
    got = {(r.doc_id, r.block_no): (r.text, r.section_heading) for r in corpus.text_files(spark, str(tmp_path / "t")).collect()}
    assert got == {("a.md", 0): ("# Top", "Top"), ("a.md", 1): ("one", None), ("b.txt", 0): ("# no heading", None), ("b.txt", 1): ("two", None)}
    assert [r.locator for r in corpus.code_files(spark, str(tmp_path / "c")).orderBy("block_no").collect()] == ["f.py:1-1", "f.py:2-3", "f.py:4-5"]
    got = [(r.doc_id, r.page, r.block_no, r.kind, r.text) for r in corpus.ocr_files(spark, str(tmp_path / "o")).orderBy("page", "block_no").collect()]
    assert got == [("d1", 0, 0, "text", "page 0"), ("d1", 0, 1, "table_text", "table"), ("d1", 2, 0, "figure_text", "figure\ufffd")]


def test_upsert_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "library_id string, chunk_id string, text string, v int"
    rows = spark.createDataFrame([(f"l{i % 4}", f"c{i}", f"old {i}", 1) for i in range(20)], schema)
    rows.repartition("library_id").write.partitionBy("library_id").parquet(path)
    before = files_of(path)
    updates = spark.createDataFrame([("l1", "c1", "new", 2), ("l2", "c2", "stale", 0), ("l9", "c99", "first", 1)], schema)
    changed = corpus.write_upsert(spark, path, updates, ["library_id", "chunk_id"], "v")
    assert {r.library_id for r in changed.collect()} == {"l1", "l9"}
    after = files_of(path)
    kept = {f for f in before if "library_id=l1" not in f}
    assert all(after[f] == before[f] for f in kept) and not any("library_id=l1" in f and f in before for f in after)
    want = sorted(map(repr, upsert(rows, updates, ["library_id", "chunk_id"], "v").select("chunk_id", "text", "v").collect()))
    assert sorted(map(repr, spark.read.parquet(path).select("chunk_id", "text", "v").collect())) == want
    assert corpus.write_upsert(spark, path, updates, ["library_id", "chunk_id"], "v").count() == 0 and files_of(path) == after


def test_delete_in_place(spark, tmp_path):
    paths = {name: str(tmp_path / name) for name in ("chunks", "vectors")}
    rows = spark.createDataFrame([(f"l {i % 3}/x", f"d{i}", i) for i in range(9)] + [("lone", "d99", 1)], "library_id string, doc_id string, n int")
    for path in paths.values():
        rows.repartition("library_id").write.partitionBy("library_id").parquet(path)
    before = files_of(paths["chunks"])
    ids = spark.createDataFrame([("d0",), ("d3",), ("d99",), ("absent",), ("d0",)], "doc_id string")
    assert corpus.delete_documents(spark, paths, ids) == {"chunks": 2, "vectors": 2}
    after = files_of(paths["chunks"])
    untouched = {f for f in before if "l 1" in f or "l 2" in f}
    assert untouched and all(after[f] == before[f] for f in untouched)
    for path in paths.values():
        assert {r.doc_id for r in spark.read.parquet(path).collect()} == {f"d{i}" for i in range(9)} - {"d0", "d3"}
    assert corpus.delete_documents(spark, paths, ids) == {"chunks": 0, "vectors": 0} and files_of(paths["chunks"]) == after


def test_deliveries_are_distinct(spark, tmp_path):
    schema = "message_id string, thread_id string, content string, updated_at timestamp, delivered_at timestamp"
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[("m1", "t", "a", at(1), at(10)), ("m1", "t", "a", at(1), at(10, 5))], [("m1", "t", "a", at(1), at(10, 30)), ("m1", "t", "b", at(2), at(10, 31))], [("m2", "t", "late", at(0), at(14))], [("m2", "t", "late", at(0), at(14, 1))], [("m1", "t", "a", at(1), at(15))]]
    read = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        streams.merge_messages_stream(read(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    log = [(r.message_id, r.content, r.n) for r in streams.BatchLog(spark, str(tmp_path / "out")).rows().groupBy("message_id", "content").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sorted(log) == [("m1", "a", 2), ("m1", "b", 1), ("m2", "late", 1)]  # inside the hour once; beyond it again
    assert {(r.message_id, r.content) for r in streams.current_messages(spark, str(tmp_path / "out")).collect()} == {("m1", "b"), ("m2", "late")}


MORE = "and more plain words, which go on until no one takes them for a heading."


def test_ingestion_to_search(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs = lambda rows: spark.createDataFrame(rows, streams.DOCUMENT)
    put = lambda rows: docs(rows).coalesce(1).write.mode("append").json(source)
    first = [(f"d{i}", f"l{i % 2}", f"alpha beta {i} {MORE}\n\ngamma number{i} words {MORE}", 1) for i in range(12)]
    flat = spark.createDataFrame([("l0", 0, [1.0] * 256), ("l0", 1, [-1.0] * 256), ("l1", 0, [0.5] * 256)], "library_id string, cluster_id int, centroid array<double>")
    ingestion = streams.Ingestion(spark, target, centers=flat)
    put(first)
    ingestion.stream(source, state).awaitTermination()
    put([("d1", "l1", f"delta only {MORE}", 2), ("d2", "l0", "", 3), ("d3", "l1", "stale", 0)])
    ingestion.stream(source, state).awaitTermination()
    final = [r for r in first if r[0] not in ("d1", "d2")] + [("d1", "l1", f"delta only {MORE}", 2), ("d2", "l0", "", 3)]
    queries = spark.createDataFrame([(0, "alpha number3"), (1, "delta stale"), (2, "number1")], "query_id int, question string")
    probes = vectors.encode(queries.withColumnRenamed("question", "text")).crossJoin(spark.createDataFrame([("l0",), ("l1",)], "library_id string"))
    batch = ingestion.rows_of(docs(final))
    plain = lambda df: sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())

    def same():
        for kind in ("chunks", "vectors", "postings", "documents"):
            assert plain(ingestion.current(kind)) == plain(batch[kind].select(*ingestion.current(kind).columns)), kind
        assert plain(ingestion.search(queries, 5)) == plain(lexical.bm25_search(queries, batch["chunks"], 5))
        assert plain(ingestion.nearest(probes, 3)) == plain(vectors.vector_topk(probes, batch["vectors"], 3))
        assert plain(ingestion.nearest(probes, 3, 1000)) == plain(ingestion.nearest(probes, 3))

    same()
    assert ingestion.current("chunks").count() == 11 and len(ingestion.search(queries, 5).collect()) == 11
    assert not [r for r in ingestion.search(queries, 5).collect() if r.query_id == 2]  # of a version that was replaced
    assert ingestion.compact() == 1 and ingestion.log("chunks", 1).rows().select("batch").distinct().count() == 1
    same()
    again = streams.Ingestion(spark, target, centers=flat)
    assert again.generation() == 1
    put([("d0", "l0", f"alpha omega {MORE}", 9)])
    again.stream(source, state).awaitTermination()
    assert {r.text for r in again.current("chunks").filter("doc_id = 'd0'").collect()} == {f"alpha omega {MORE}"}
    again.write(docs([first[4]]), 7)  # delivered again after the compaction
    assert plain(again.current("chunks").filter("doc_id = 'd4'")) == plain(batch["chunks"].filter("doc_id = 'd4'").select(*again.current("chunks").columns))


def test_percentiles(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in np.round(rng.normal(size=3000), 1)] + [("b", 1.0), ("c", None), ("d", 1.0), ("d", 2.0), (None, 5.0)]
    frame = spark.createDataFrame(rows, "kind string, x double").repartition(5)
    got = {r.kind: r for r in common.percentiles(frame.filter("kind IS NOT NULL"), ["kind"], "x", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    a = np.array([x for k, x in rows if k == "a"])
    assert set(got) == {"a", "b", "d"} and np.allclose([got["a"].low, got["a"].mid, got["a"].top], np.percentile(a, [10, 50, 100]))
    assert (got["b"].low, got["d"].mid) == (1.0, 1.5)
    boxes = spark.createDataFrame([("Figure", 0.0, 0.0, float(i), 10.0) for i in range(2, 500)], "type string, x1 double, y1 double, x2 double, y2 double")
    exact, near = (visuals.layout_stats(boxes, e).first() for e in (True, False))
    assert abs(exact.p50 - near.p50) <= 10 and exact.n == near.n == 498


def test_hot_names(spark):
    mentions = spark.range(5000).select(F.lit("g").alias("graph_id"), F.format_string("c%05d", F.col("id") % 2500).alias("chunk_id"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "Hot Name").otherwise(F.concat(F.lit("name"), F.col("id") % 7)).alias("name"), F.lit("thing").alias("type"), F.lit("d").alias("description"))
    nodes = {r.key: r for r in graph.resolve_nodes(mentions, ids=10).collect()}
    full = graph.node_chunks(mentions)
    hot = sorted(r.chunk_id for r in full.filter("key = 'hot name'").collect())
    assert nodes["hot name"].mention_count == 1667 and nodes["hot name"].source_chunk_ids == hot[:10] and len(hot) > 1000
    relations = mentions.select("graph_id", "chunk_id", "pos", F.col("name").alias("source"), F.lit("Likes").alias("relation"), F.lit("name1").alias("target"))
    resolved = graph.resolve_nodes(mentions)
    edges = {r.source: r for r in graph.resolve_edges(relations, resolved, ids=3).collect()}
    edge = edges[nodes["hot name"].node_id]
    assert edge.weight == 1667 and edge.source_chunk_ids == hot[:3] and edge.relation == "Likes"
    assert graph.edge_chunks(relations, resolved).agg(F.sum("n")).first()[0] == sum(e.weight for e in edges.values())


def test_vectors_in_other_forms(spark):
    one = lambda text: spark.range(1).select(parse_vector(F.lit(text)).alias("x")).first()[0]
    for text, want in {'{"data": [1, 2.5]}': [1.0, 2.5], '{"vector": {"values": "(1 2)"}}': [1.0, 2.0], '{"other": [1]}': None, '{"value": "x"}': None, " [3] ": [3.0], "1, 2": [1.0, 2.0], "[1,[2]": None, "{}": None}.items():
        assert one(text) == want, text
    rows = spark.createDataFrame([("a", "[1]"), ("a", "?"), ("b", "{1 2}"), ("b", None)], "library_id string, text string")
    assert sorted(str(r.embedding) for r in parsed_vectors(rows, "text").collect()) == ["None", "None", "[1.0, 2.0]", "[1.0]"]
    assert parsed_vectors(rows.limit(0), "text").count() == 0
    broken = rows.union(spark.createDataFrame([("z", "?"), ("z", "[]")], rows.schema))
    with pytest.raises(Exception, match="none could be parsed"):
        parsed_vectors(broken, "text").collect()
    assert len(parsed_vectors(broken, "text").filter("library_id <> 'z'").collect()) == 4


def test_reports_are_whole(spark, tmp_path):
    from corpusframe.operators import evaluation

    report = spark.range(300).select(F.lit("s").alias("section"), F.format_string("i%03d", "id").alias("item"), F.lit("m").alias("metric"), F.when(F.col("id") % 2 == 0, F.col("id") / 4).alias("value"))
    text = evaluation.markdown(report).split("\n")
    assert len(text) == 302 and text[2:4] == ["| s | i000 | m | 0.0 |", "| s | i001 | m | None |"]
    with pytest.raises(ValueError):
        evaluation.markdown(report, most=299)
    evaluation.write_markdown(report, str(tmp_path / "r"))
    lines = [line for f in sorted((tmp_path / "r").glob("part-*")) for line in f.read_text().splitlines()]
    assert [*evaluation.HEAD, *lines] == text

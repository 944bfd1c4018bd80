"""Findings of the fourth round: what queries write to disk, and results at the edges of their new forms."""

import os
import shutil

import pytest

import __spark_entry__  # noqa: F401 - registers
from corpusframe.operators import lexical
from corpusframe.plans import registry
from corpusframe.plans.views import Views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: Queries that search the texts for each question.
SEARCHES = [
    "e2_bm25_topk",
    "f3_hybrid",
    "f4_neighbours",
    "f5_snippets",
    "h10_citation_scores",
    "h20_report",
    "f10_citations",
    "f17_ground",
    "f18_broadened",
    "f1_rank_fusion",
    "f6_union_recall",
    "h8_doc_hit_at_k",
    "f11_evidence_brief",
    "e4_keyword_search",
    "f12_context_document",
    "f13_merge_notes",
    "f2_rerank",
    "f14_visual_cards",
    "j4_notes",
    "f8_with_titles",
    "f9_sources",
    "h7_hit_at_k",
    "h19_ragas_records",
    "h9_hit_report",
]


def written(spark) -> int:
    top = spark.conf.get("spark.checkpoint.dir")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


@pytest.mark.parametrize("name", SEARCHES)
def test_search_keeps_no_index_of_all_words(spark, tmp_path, name):
    """All that is ever written to the shared folder stays below four times the documents' file."""
    place = str(tmp_path / "tables")  # a path of its own: nothing that another test has stored is used again
    shutil.copytree(SF, place)
    before = written(spark)
    assert registry.QUERIES[name](spark, place).count() > 0
    assert written(spark) - before <= 4 * os.path.getsize(f"{place}/documents.parquet")


def test_chunks_made_in_place_are_those_of_the_view(spark, tmp_path):
    text = "\n".join(f"line {i}" if i % 3 else "" for i in range(30))
    rows = [(1, text, "s0"), (2, "\n\n\n", "s0"), (3, None, "s1"), (4, "", "s1"), (5, "\n" * 8 + "late", None), (5, "two\nmore", "s1"), (6, "first", "s2"), (6, text, "s2"), (7, "one", "s2"), (7, "other", "s3"), (None, "a", "s1"), (None, "b", "s1"), (None, "c", None)]
    for some in (rows, rows[:6]):
        documents = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in some], "doc_id long, text string, lang string, source string, n_chars long")
        place = str(tmp_path / str(len(some)))
        documents.write.parquet(f"{place}/documents.parquet")
        v = Views(spark, place)
        assert v.chunks.dtypes == v.v_chunks.dtypes
        plain = lambda df: sorted(repr([*r[:-1], sorted((r[-1] or "").split("\n\n"))]) for r in df.select(v.v_chunks.columns).collect())
        assert plain(v.chunks) == plain(v.v_chunks) and v.chunks.count() > 4


def test_search_in_tasks_is_the_joined_search(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    names = [f"word{i}" for i in range(50)] + ["the", "no", "X_y-1"]
    chunks = [(f"c{i}", f"l{i % 4}" if i % 9 else None, " ".join(rng.choice(names, int(rng.integers(0, 40))))) for i in range(300)]
    kinds = "chunk_id string, library_id string, text string"
    repeated = spark.createDataFrame(chunks + [("twice", "l1", "word1 word2 word1"), ("twice", "l1", "word1 word2 word3")], kinds)
    chunks = spark.createDataFrame(chunks + [("none", "l2", None)], kinds)
    queries = spark.createDataFrame([(i, f"l{i % 5}", " ".join(rng.choice(names, 5))) for i in range(30)] + [(99, "l1", "the")], "query_id int, library_id string, question string")
    for asked in (queries, queries.drop("library_id")):
        search = lambda: sorted(map(tuple, lexical.bm25_search(asked, chunks, 2).collect()))
        with monkeypatch.context() as m:
            m.setattr(lexical, "CELLS", 100)
            few = search()
        assert few == search() and len(few) > 400
        for limit in ("FEW_TERMS", "FEW_COUNTS"):
            with monkeypatch.context() as m:
                m.setattr(lexical, limit, 0)
                assert search() == few
        plain = lambda df: sorted(map(tuple, df.collect()))
        assert plain(lexical.bm25_search(asked, repeated, 2)) == plain(lexical.bm25_topk(asked, lexical.bm25_index(repeated), 2))
    assert lexical.bm25_search(queries.limit(0), chunks, 2).count() == 0 == lexical.bm25_search(queries, chunks.limit(0), 2).count()


def test_many_probes_meet_clusters_in_tiles(spark, monkeypatch):
    """More probed clusters than are sent to every task: the query over one table's vectors on both sides."""
    from corpusframe.operators import vectors

    search = lambda: sorted(map(tuple, registry.QUERIES["d5_vector_topk_ivf"](spark, SF).collect()))
    want = search()
    for name, value in {"FEW_QUERIES": 3, "TILE_CHUNKS": 7, "TILE_QUERIES": 2}.items():
        monkeypatch.setattr(vectors, name, value)
    assert search() == want and len(want) > 10


def test_a_chunk_of_no_organisation_is_nobodys(spark):
    from corpusframe.operators import vectors

    chunks = spark.createDataFrame([(f"c{i}", "l", o, [1.0, float(i)]) for i, o in enumerate(("a", None, "b", "a"))], "chunk_id string, library_id string, organization_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, "l", "a", False, [1.0, 1.0]), (2, "l", None, False, [1.0, 1.0]), (3, "l", None, True, [1.0, 1.0])], "query_id int, library_id string, organization_id string, cross_org boolean, embedding array<double>")
    got = sorted((r.query_id, r.chunk_id) for r in vectors.vector_topk(queries, chunks, 5).collect())
    assert got == [(1, "c0"), (1, "c3"), (3, "c0"), (3, "c1"), (3, "c2"), (3, "c3")]


def test_captions_of_tied_blocks_are_the_same_in_each_run(spark):
    """Blocks of one page that share their number and place, but not their width, in any order of the table."""
    from corpusframe.operators import visuals

    rows = [(1, 0, 1, "text", 0.0, 0.0, 40.0, 10.0, "a"), (1, 0, 2, "text", 0.0, 20.0, 200.0, 30.0, "b"), (1, 0, 2, "text", 0.0, 20.0, 4.0, 30.0, "b"), (1, 0, 3, "text", 0.0, 30.0, 10.0, 40.0, "c")]
    kinds = "doc_id int, page int, block_no int, kind string, x1 double, y1 double, x2 double, y2 double, text string"
    got = []
    for some in (rows, rows[::-1]):
        blocks = spark.createDataFrame(some, kinds).coalesce(1)
        got.append(sorted(map(tuple, visuals.merge_caption(blocks, blocks).collect())))
    assert got[0] == got[1]


def test_postings_of_a_batch_are_not_shuffled(spark, tmp_path, monkeypatch):
    from corpusframe.streaming import streams

    monkeypatch.setattr(lexical, "POSTINGS", 7, raising=False)
    docs = spark.createDataFrame([(f"d{i}", "l", "\n\n".join(f"This word{j % 5} is in a longer sentence that is no heading at all, word{j}-x, {'and so it goes on ' * 20}." for j in range(i))) for i in range(12)], "doc_id string, library_id string, text string").selectExpr("*", "1L AS version")
    rows = streams.Ingestion(spark, str(tmp_path)).rows_of(docs)
    assert "Exchange" not in rows["postings"]._jdf.queryExecution().executedPlan().toString()
    want = lexical.postings_of(rows["chunks"]).join(rows["chunks"].select("chunk_id", "doc_id"), "chunk_id")
    plain = lambda df: sorted(map(tuple, df.select("library_id", "term", "chunk_id", "tf", "length", "doc_id").collect()))
    assert plain(rows["postings"]) == plain(want) and rows["postings"].count() > 50


def test_products_are_made_in_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpusframe.functions.vectors import cosine, dot, l2norm
    from corpusframe.operators import vectors

    kinds = "id long, library_id string, embedding array<float>"
    rows = [(i, f"l{i % 3}" if i % 7 else None, [float(i % 5), 1.0 / (i + 1), -0.5][: 3 if i % 4 else 2] if i % 6 else None) for i in range(60)]
    table = spark.createDataFrame(rows, kinds).repartition(3)
    queries, chunks = table.filter("id % 2 = 0").withColumnRenamed("id", "query_id"), table.select(F.concat(F.lit("c"), "id").alias("chunk_id"), "library_id", "embedding")
    pairs = chunks.join(queries.select("query_id", "library_id", F.col("embedding").alias("q")), "library_id")
    want = pairs.select("query_id", "chunk_id", *[F.round(c, 6).alias(n) for n, c in (("dot", dot(F.col("embedding"), F.col("q"))), ("norm", l2norm(F.col("embedding"))), ("cosine", cosine(F.col("embedding"), F.col("q"))))])
    plain = lambda df: sorted(repr([x + 0.0 if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert plain(vectors.products(queries, chunks)) == plain(want)
    monkeypatch.setattr(vectors, "FEW_QUERIES", 4)
    monkeypatch.setattr(vectors, "CELLS", 80)
    assert plain(vectors.products(queries, chunks)) == plain(want) and vectors.products(queries.limit(0), chunks).count() == 0
    plan = registry.QUERIES["d3_dot_norm_cosine"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan

"""Every registered query that has SQL gives the SQL's rows (DuckDB), on the smallest tables."""

import os
import shutil

import duckdb
import pytest

import __spark_entry__  # noqa: F401 - registers
from corpusframe.plans import registry
from corpusframe.plans.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    result = duck.execute(registry.ORACLE_SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == names
    want = result.fetchall()
    assert want, "the comparison is empty"
    want = sorted(repr([plain(r[at.index(n)]) for n in names]) for r in want)
    got = sorted(repr([plain(r[n]) for n in names]) for r in frame.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["d4_vector_topk", "b5_link_captions", "e2_bm25_topk", "g4_edges", "f3_hybrid"])
def test_no_nested_loops(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_recall_of_probed_clusters(spark):
    """Share of the exact five nearest that the search of the probed clusters finds, over all queries."""
    from corpusframe.operators import vectors
    from corpusframe.plans.retrieval_queries import NPROBE
    from corpusframe.plans.views import Views

    v = Views(spark, SF)
    queries, chunks = v.v_vqueries.drop("organization_id", "cross_org"), v.v_vectors
    exact = {(r.query_id, r.chunk_id) for r in vectors.vector_topk(queries, chunks, 5).collect()}
    found = {(r.query_id, r.chunk_id) for r in vectors.vector_topk_ivf(queries, chunks, vectors.centroids(chunks), NPROBE, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9, len(exact & found) / len(exact)


def test_keyword_index_is_shared_and_made_anew(spark):
    from corpusframe.plans import views

    index = lambda: views.Views(spark, SF).keyword_index
    first = index()
    path = next(p for k, p in views._INDEXES.items() if k[1] == SF)
    assert index().inputFiles() == first.inputFiles()
    shutil.rmtree(path)
    assert index().count() > 0 and next(p for k, p in views._INDEXES.items() if k[1] == SF) != path


def test_recall_of_stored_clusters(spark):
    from corpusframe.operators import vectors
    from corpusframe.plans.views import Views

    v = Views(spark, SF)
    exact = {(r.query_id, r.chunk_id) for r in vectors.vector_topk(v.v_vqueries.drop("organization_id"), v.v_vectors, 5).collect()}
    found = {(r.query_id, r.chunk_id) for r in registry.QUERIES["d5_stored_ivf"](spark, SF).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

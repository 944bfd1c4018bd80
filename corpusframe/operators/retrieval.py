"""Fusion, reranking, expansion and hybrid retrieval for whole tables of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import keywords
from corpusframe.operators.common import first_rows, if_small
from corpusframe.operators.lexical import bm25_search, bm25_topk
from corpusframe.operators.vectors import vector_topk
from corpusframe.sources.checkpoints import cut

NEIGHBOUR_ID = r"^[0-9a-fA-F-]{32,}_c\d{4}$"


def rrf(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists with ``query_id, chunk_id, rank``: ``rrf_score`` and the new ``rank``.

    A chunk's first list and rank break ties, as a stable sort does. Blank ids are dropped.
    """
    lists = [r.select("query_id", "chunk_id", "rank", F.lit(i).alias("list_no")) for i, r in enumerate(ranked)]
    rows = reduce(DataFrame.unionByName, lists).filter(F.coalesce("chunk_id", F.lit("")) != "")
    fused = rows.groupBy("query_id", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf_score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    fused = fused.withColumn("rrf_score", F.round("rrf_score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen", "chunk_id")
    return fused.select("query_id", "chunk_id", "rrf_score", F.row_number().over(order).alias("rank"))


def overlap_score(question, text):
    """The reranker that is shipped: share of the question's distinct keywords that the text's first 1200 characters hold."""
    terms = F.array_distinct(keywords(question))
    body = F.lower(F.substring(text, 1, 1200))
    return F.coalesce(F.round(F.size(F.filter(terms, lambda t: F.contains(body, t))) / F.nullif(F.size(terms), F.lit(0)), 6), F.lit(0.0))


def rerank(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, scorer=overlap_score) -> DataFrame:
    """The first 100 of each query by ``scorer(question, text)``, ties in their old order; without a scorer as they are."""
    head = ranked.filter("rank <= 100")
    if scorer is None:
        return head.filter(F.col("rank") <= k)
    asked = if_small(head.join(if_small(queries.select("query_id", "question")), "query_id"))  # then no text is shuffled
    scored = chunks.select("chunk_id", "text").join(asked, "chunk_id").withColumn("rerank_score", scorer(F.col("question"), F.col("text"))).withColumnRenamed("rank", "old_rank")
    return first_rows(scored, ["query_id"], [F.desc("rerank_score"), F.col("old_rank")], k).select("query_id", "chunk_id", "rerank_score", "old_rank", "rank")


def expand_neighbors(ranked: DataFrame, chunks: DataFrame, window: int = 1, max_add: int = 8) -> DataFrame:
    """Neighbours of ranked chunks, up to ``max_add`` new ones for each query, in rank order, those before first.

    Ids are a document's id and a number of four digits; others have no neighbours. The result has ``query_id,
    chunk_id, add_no, text``; chunks that don't exist count towards nothing.
    """
    ids = ranked.filter(F.col("chunk_id").rlike(NEIGHBOUR_ID))
    offsets = [d for j in range(1, window + 1) for d in (-j, j)]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(d).alias("by")) for i, d in enumerate(offsets)])).alias("s")
    number = F.substring_index("chunk_id", "_c", -1).cast("int")
    near = ids.select("query_id", "rank", F.regexp_extract("chunk_id", r"^(.*)_c\d{4}$", 1).alias("doc"), number.alias("number"), steps).filter("number + s.by >= 0")
    near = near.select("query_id", F.concat("doc", F.lit("_c"), F.lpad((F.col("number") + F.col("s.by")).cast("string"), 4, "0")).alias("chunk_id"), F.struct("rank", "s.step").alias("place"))
    near = near.groupBy("query_id", "chunk_id").agg(F.min("place").alias("place")).join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    wanted = first_rows(near, ["query_id"], [F.col("place"), F.col("chunk_id")], max_add, "add_no")
    return chunks.select("chunk_id", "text").join(if_small(wanted), "chunk_id").select("query_id", "chunk_id", "add_no", "text")


def snippets(ids: DataFrame, chunks: DataFrame, edge: int = 220) -> DataFrame:
    """Text of chunks with the end of the one before and the beginning of the one after. All chunks are gone through twice."""
    core = chunks.select("doc_id", "chunk_index", "chunk_id", "text").join(if_small(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")
    core = cut(core)  # no more than is asked for
    places = core.select("doc_id", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")).distinct()
    side = cut(chunks.join(if_small(places), ["doc_id", "chunk_index"], "left_semi").select("doc_id", "chunk_index", F.expr(f"left(text, {edge})").alias("head"), F.expr(f"right(text, {edge})").alias("tail")))
    before = side.select("doc_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("tail").alias("before"))
    after = side.select("doc_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("head").alias("after"))
    return core.join(before, ["doc_id", "chunk_index"], "left").join(after, ["doc_id", "chunk_index"], "left").select("chunk_id", "before", "text", "after")


def union_recall(results: DataFrame) -> DataFrame:
    """``question_id, sub_no, rank, chunk_id``: the first row of each chunk over all sub-questions; null ids all stay."""
    first = Window.partitionBy("question_id", "chunk_id").orderBy("sub_no", "rank")
    return results.withColumn("turn", F.row_number().over(first)).filter("turn = 1 OR chunk_id IS NULL").drop("turn")


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 5, vectors: DataFrame | None = None, vector_queries: DataFrame | None = None, scorer=overlap_score, index: DataFrame | None = None) -> DataFrame:
    """Vector search (40, with neighbours) and keyword search (40), fused, reranked, the best ``k`` of each query.

    Without vectors, keyword search stands alone; without a saved ``index`` it reads the texts.
    """
    lexical = (bm25_search(queries, chunks, 10) if index is None else bm25_topk(queries, index, 10)).filter("rank <= 40")
    lists = [lexical]
    if vectors is not None:
        near = cut(vector_topk(vector_queries, vectors, 40))  # used twice
        more = expand_neighbors(near, chunks).select("query_id", "chunk_id", (F.col("add_no") + 40).alias("rank"))
        lists.insert(0, near.select("query_id", "chunk_id", "rank").unionByName(more))
    return rerank(rrf(*lists), queries, chunks, k, scorer)

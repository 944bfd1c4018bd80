"""Keyword search: a BM25 index per library, a substring fallback, and the choice between them.

Few questions search the texts themselves: of each chunk the words that a question has are kept, as numbers, and scored where
they are, so no posting is shuffled. An index can be saved for many searches: a table bucketed by term (and by a salt, so that
a common term's postings are several tasks'). A search then shuffles its own terms only and never the postings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import keywords
from corpusframe.operators.common import first_rows, if_small
from corpusframe.sources.checkpoints import cut

K1, B = 1.2, 0.75
SALTS = 8  # parts of a term's postings in a saved index
BUCKET_POSTINGS = 4_000_000
#: Terms of all questions, and terms of all libraries, up to which they are sent to every task; more are joined.
FEW_TERMS, FEW_COUNTS = 200_000, 2_000_000
CELLS = 1 << 22  # scores that are held at once
POSTINGS = 100_000  # that leave a task at once


def bm25_index(chunks: DataFrame) -> DataFrame:
    """``library_id, term, chunk_id, weight``: the inverted index, one row per posting, weights ready to add up.

    Statistics are per library. Save it partitioned by library or bucketed by term: a query then reads its terms only.
    """
    terms = chunks.select("library_id", "chunk_id", keywords(F.col("text"), 1_000_000).alias("terms"))
    sized = terms.withColumn("length", F.size("terms").cast("long"))
    stats = sized.groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    postings = sized.select("library_id", "chunk_id", "length", F.explode("terms").alias("term")).groupBy("library_id", "term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    return _weighed(postings, stats)


def _weighed(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """Postings with BM25 weights. ``stats`` has a row for each library: Spark broadcasts it where its size allows."""
    df = postings.groupBy("library_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return postings.join(df, ["library_id", "term"]).join(stats, "library_id").select("library_id", "term", "chunk_id", weight.alias("weight"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, library_id, term``: distinct keywords; queries without ``library_id`` search all libraries."""
    scope = ["library_id"] if "library_id" in queries.columns else []
    return queries.select("query_id", *scope, F.explode(F.array_distinct(keywords(F.col("question")))).alias("term"))


def postings_of(chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``library_id, term, chunk_id, tf, length``; an empty term stands for the chunk itself. With ``asked`` (``term``) only
    those terms: chunks meet them before anything is shuffled, so common words that nobody asks for never move."""
    sized = chunks.select("library_id", "chunk_id", keywords(F.col("text"), 1_000_000).alias("terms")).withColumn("length", F.size("terms").cast("long"))
    every = sized.select("library_id", "chunk_id", "length", F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    met = every if asked is None else every.join(asked, "term")
    return met.groupBy("library_id", "term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def postings_in_place(chunks: DataFrame) -> DataFrame:
    """``postings_of`` of chunks with a ``doc_id``, which postings have too, and ids of their own: each chunk's terms are counted
    in its row, so nothing is shuffled and a chunk's postings stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            size = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = terms.flatten().dictionary_encode()  # the empty term of the chunk itself is among them
            words = max(1, len(flat.dictionary))
            cell, tf = np.unique(np.repeat(np.arange(len(size)), size) * words + flat.indices.to_numpy(), return_counts=True)
            row, word = np.divmod(cell, words)
            for a in range(0, len(row), POSTINGS):
                at, term = pa.array(row[a : a + POSTINGS]), pa.array(word[a : a + POSTINGS])
                out = [batch.column("library_id").take(at), flat.dictionary.take(term), batch.column("chunk_id").take(at), pa.array(tf[a : a + POSTINGS]), pa.array(size[row[a : a + POSTINGS]] - 1), batch.column("doc_id").take(at)]
                yield pa.RecordBatch.from_arrays(out, ["library_id", "term", "chunk_id", "tf", "length", "doc_id"])

    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("library_id", "chunk_id", "doc_id")}
    rows = chunks.select("library_id", "chunk_id", "doc_id", F.concat(F.array(F.lit("")), keywords(F.col("text"), 1_000_000)).alias("terms"))
    return rows.mapInArrow(run, f"library_id {kind['library_id']}, term string, chunk_id {kind['chunk_id']}, tf long, length long, doc_id {kind['doc_id']}")


def _asked(queries: DataFrame) -> DataFrame:
    terms = query_terms(queries).select("term").distinct()
    return if_small(terms.union(terms.sparkSession.range(1).select(F.lit("").alias("term"))))


def search_postings(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``bm25_topk`` over ``postings_of``, of which only asked terms are looked at; statistics are those of the postings
    as they are now, so rows may come and go between searches."""
    return _search(queries, postings.join(_asked(queries), "term", "left_semi"), k)


def _search(queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    counted = cut(asked)
    return bm25_topk(queries, _weighed(counted.filter("term <> ''"), _stats(counted)), k)


def _stats(postings: DataFrame) -> DataFrame:
    """Number and mean length of each library's chunks, from the rows of the chunks themselves."""
    return postings.filter("term = ''").groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``bm25_topk`` without an index: texts are read once, and of all chunks only lengths are kept, and postings of terms
    that a query has. With ``FEW_TERMS`` at most these are numbers, kept by chunk and scored in tasks; see ``_scored``."""
    asked = query_terms(queries).limit(FEW_TERMS + 1).toArrow()
    if len(asked) <= FEW_TERMS:
        words = pc.unique(asked.column("term"))
        met = cut(_met(chunks.filter("library_id IS NOT NULL"), words))
        sizes = met.groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
        key = ["library_id", "chunk_id"]
        if not met.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # one id in several rows is one chunk
            met = cut(met.groupBy(*key).agg(F.max("length").alias("length"), F.array_sort(F.flatten(F.collect_list("codes"))).alias("codes")))
        counts = met.select("library_id", F.explode(F.array_distinct("codes")).alias("code")).groupBy("library_id", "code").agg(F.count(F.lit(1)).alias("df"))
        known = counts.join(sizes, "library_id").limit(FEW_COUNTS + 1).toArrow()
        if len(known) <= FEW_COUNTS:
            most = max(20, 4 * k)
            return cut(first_rows(_scored(queries, met, asked, words, known, most), ["query_id"], [F.desc("score"), F.col("chunk_id")], most))
    return _search(queries, postings_of(chunks, _asked(queries)), k)


def _met(chunks: DataFrame, words: pa.Array) -> DataFrame:
    """``library_id, chunk_id, length, codes``: places in ``words`` of those that a chunk has, in order, as often as it has them."""
    shipped = chunks.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            length = terms.value_lengths().to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(terms.flatten(), value_set=shipped.value), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), length)[code >= 0]
            code = code[code >= 0]
            code = code[np.lexsort((code, row))]
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(length))))).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(ends), pa.array(code, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("library_id"), batch.column("chunk_id"), pa.array(length, pa.int64()), codes], ["library_id", "chunk_id", "length", "codes"])

    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("library_id", "chunk_id")}
    rows = chunks.select("library_id", "chunk_id", keywords(F.col("text"), 1_000_000).alias("terms"))
    return rows.mapInArrow(run, f"library_id {kind['library_id']}, chunk_id {kind['chunk_id']}, length long, codes array<int>")


class Best:
    """The ``k`` best chunks of each of ``n`` queries, as scores come by: a bounded heap for each query."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)  # the k-th score so far
        self.held, self.size = [], 0

    def add(self, query: np.ndarray, score: np.ndarray, rows: np.ndarray, ids: pa.Array, libraries: pa.Array) -> None:
        good = np.flatnonzero(score >= self.least[query])
        at = pa.array(rows[good])
        self.held.append(pa.table({"q": query[good], "score": score[good], "chunk_id": ids.take(at), "library_id": libraries.take(at)}))
        self.size += len(good)
        if self.size > 4 * self.k * len(self.least) + CELLS // 8:
            self.held = [self.best()]
            self.size = len(self.held[0])

    def best(self) -> pa.Table:
        """``q, score, chunk_id, library_id``: no more than ``k`` rows a query; of equal scores the smaller id first."""
        rows = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        q = rows.column("q").to_numpy()
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        full = np.flatnonzero(place == self.k - 1)
        self.least[q[full]] = rows.column("score").to_numpy()[full]
        return rows.take(pa.array(np.flatnonzero(place < self.k)))


def _scored(queries: DataFrame, met: DataFrame, asked: pa.Table, words: pa.Array, known: pa.Table, most: int) -> DataFrame:
    """``query_id, chunk_id, library_id, score``: up to ``most`` chunks of each query from each task.

    ``met`` as of ``_met``, ``asked`` the terms of the queries, ``known`` the counts of ``words`` in each library.
    """
    ids = pc.unique(asked.column("query_id"))
    who = pc.index_in(asked.column("query_id"), value_set=ids).to_numpy().astype(np.int64)
    code = pc.index_in(asked.column("term"), value_set=words).to_numpy().astype(np.int64)
    scope = np.array(asked.column("library_id").to_pylist(), object) if "library_id" in asked.column_names else None
    order = np.lexsort((known.column("code").to_numpy(), np.array(known.column("library_id").to_pylist(), object).astype(str)))
    known = known.take(pa.array(order))
    n, df = known.column("n").to_numpy(), known.column("df").to_numpy()
    names, idf = known.column("library_id").to_pylist(), np.log(1 + (n - df + 0.5) / (df + 0.5))
    cuts = np.flatnonzero(np.array([i == 0 or names[i] != names[i - 1] for i in range(len(names))], bool)).tolist()
    code_of, mean = known.column("code").to_numpy(), known.column("mean_length").to_numpy()
    libraries = {names[a]: (code_of[a:b], idf[a:b], float(mean[a])) for a, b in zip(cuts, [*cuts[1:], len(names)])}
    shipped = met.sparkSession.sparkContext.broadcast((ids, who, code, scope, len(words), libraries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, who, code, scope, n_words, libraries = shipped.value
        order = np.lexsort((who, code))
        found, lists = Best(len(ids), most), {}

        def askers(library):
            """First place of each word's queries, and the queries; of queries that name a library its own."""
            name = library if scope is not None else None
            if name not in lists:
                mine = order if scope is None else order[scope[order] == library]
                lists[name] = np.searchsorted(code[mine], np.arange(n_words + 1)), who[mine]
            return lists[name]

        for batch in batches:
            name, coded = batch.column("library_id"), batch.column("library_id").dictionary_encode()
            length, codes = batch.column("length").to_numpy(), batch.column("codes")
            size, flat = codes.value_lengths().to_numpy(), codes.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(size)))
            place = coded.indices.to_numpy()
            for which, library in enumerate(coded.dictionary.to_pylist()):
                if library not in libraries:
                    continue
                (in_library, idf, mean), (first, queries_of) = libraries[library], askers(library)
                rows, step = np.flatnonzero(place == which), max(1, CELLS // len(ids))
                for a in range(0, len(rows), step):
                    mine = rows[a : a + step]
                    own = np.repeat(np.arange(len(mine)), size[mine])
                    at = np.repeat(ends[mine], size[mine]) + np.arange(len(own)) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
                    cell, tf = np.unique(own * n_words + flat[at], return_counts=True)
                    row, word = np.divmod(cell, n_words)
                    weight = idf[np.searchsorted(in_library, word)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[mine][row] / mean))
                    many = first[word + 1] - first[word]
                    query = queries_of[np.repeat(first[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    score = np.bincount(np.repeat(row, many) * len(ids) + query, np.repeat(weight, many), len(mine) * len(ids))
                    hit = np.flatnonzero(score)  # every weight is above zero
                    if len(hit):
                        found.add(hit % len(ids), np.round(score[hit], 6), mine[hit // len(ids)], batch.column("chunk_id"), name)
        if found.held:
            best = found.best()
            yield from pa.table({"query_id": pa.chunked_array([ids]).take(best.column("q")), "chunk_id": best.column("chunk_id"), "library_id": best.column("library_id"), "score": best.column("score")}).to_batches()

    kind = [f"{c} {f.schema[c].dataType.simpleString()}" for c, f in (("query_id", queries), ("chunk_id", met), ("library_id", met))]
    return met.mapInArrow(run, ", ".join([*kind, "score double"]))


def bm25_topk(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, library_id, score, rank``: up to ``max(20, 4k)`` chunks of each query.

    ``index``: ``bm25_index`` or a saved one, which is met in its buckets.
    """
    terms = query_terms(queries)
    on = ["term"]
    if "salt" in index.columns:
        terms, on = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"]
    if "library_id" in terms.columns:  # not a key of the join: buckets have only the term
        hits = index.join(terms.withColumnRenamed("library_id", "asked"), on).filter("library_id = asked")
    else:
        hits = index.join(terms, on)
    scored = hits.groupBy("query_id", "chunk_id", "library_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return first_rows(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], max(20, 4 * k))


def _table_of(path: str) -> str:
    return f"keyword_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def save_index(chunks: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """``bm25_index`` of ``chunks`` as a bucketed table under ``path``, which it replaces; see ``open_index``.

    A bucket has about ``BUCKET_POSTINGS`` postings where ``buckets`` doesn't say otherwise.
    """
    spark = chunks.sparkSession
    counted = cut(postings_of(chunks))  # texts are read once
    rows = _weighed(counted.filter("term <> ''"), _stats(counted)).withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    buckets = buckets or min(10_000, max(4, -(-counted.count() // BUCKET_POSTINGS)))
    writer = rows.repartition(buckets, "term", "salt").write.mode("overwrite").bucketBy(buckets, "term", "salt").sortBy("term", "salt")
    writer.option("path", f"{path}/postings").saveAsTable(_table_of(path))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/about")
    return spark.table(_table_of(path))


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index that ``save_index`` wrote under ``path``, in this or another session."""
    name = _table_of(path)
    if not spark.catalog.tableExists(name):
        columns = spark.read.parquet(f"{path}/postings").schema
        buckets = spark.read.parquet(f"{path}/about").first()[0]
        kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in columns)
        spark.sql(f"CREATE TABLE {name} ({kinds}) USING parquet CLUSTERED BY (term, salt) SORTED BY (term, salt) INTO {buckets} BUCKETS LOCATION '{path}/postings'")
    return spark.table(name)


def ilike_search(queries: DataFrame, chunks: DataFrame, k: int, newest: str = "updated_at") -> DataFrame:
    """Chunks that contain one of the first four keywords: per library the newest ``max(40, 8k)``, of the first eight
    libraries, score 0.2, then ``k`` of them. ``queries``: ``query_id, library_id, question``."""
    wanted = queries.select("query_id", "library_id", F.slice(keywords(F.col("question")), 1, 4).alias("terms"))
    eight = Window.partitionBy("query_id").orderBy("library_id")
    wanted = wanted.withColumn("turn", F.dense_rank().over(eight)).filter("turn <= 8")
    found = chunks.join(if_small(wanted), "library_id").filter(F.exists("terms", lambda t: F.contains(F.lower("text"), t)))
    found = first_rows(found, ["query_id", "library_id"], [F.desc(newest), F.col("chunk_id")], max(40, 8 * k), "place")
    out = first_rows(found, ["query_id"], [F.col("turn"), F.col("place")], k)
    return out.select("query_id", "chunk_id", "library_id", F.lit(0.2).alias("score"), "rank")


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int, newest: str = "updated_at", scoped: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """BM25 results; for queries that have none, the substring search in the libraries that ``scoped`` (or ``queries``) has.
    With a saved ``index``, texts are read for the latter only."""
    ranked = bm25_search(queries, chunks, k) if index is None else cut(bm25_topk(queries, index, k))
    missed = (queries if scoped is None else scoped).join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    return ranked.unionByName(ilike_search(missed, chunks, k, newest))

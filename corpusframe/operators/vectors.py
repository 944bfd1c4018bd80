"""Vector search and clusters over chunk vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.vectors import cosine
from corpusframe.operators.common import first_rows
from corpusframe.sources.checkpoints import cut

DIMENSIONS = 256


def hashed_bag_of_words(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The encoder that is shipped: signed word hashes, normalised. It claims no understanding of language."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            row[h % dimensions] += 1 if h & 0x8000_0000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def encode(df: DataFrame, text_col: str = "text", encoder: Callable[[], Callable] | None = None, role: str = "passage", instruction: str = "", batch: int = 256) -> DataFrame:
    """``df`` with ``embedding``; rows of empty text are dropped. ``encoder()`` is called once in each task and returns
    a function of a list of texts. Queries get ``instruction`` in front."""
    prefix = instruction if role == "query" else ""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder() if encoder else hashed_bag_of_words
        for part in parts:
            for lo in range(0, len(part), batch):
                piece = part.iloc[lo : lo + batch].copy()
                piece["embedding"] = list(model([prefix + t for t in piece[text_col]]))
                yield piece

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "embedding")
    return df.drop("embedding").filter(F.trim(F.col(text_col)) != "").mapInPandas(run, f"{kinds}, embedding array<float>")


def api_k(k):
    """``k`` as the public search allows it: from 1 to 20."""
    return max(1, min(20, int(k)))


#: Queries that are sent to every task, where they are no more than that; others meet the chunks in tiles.
FEW_QUERIES, FEW_BYTES = 20_000, 64 << 20
TILE_CHUNKS = TILE_QUERIES = 20_000  # sides of a tile
CELLS = 1 << 22  # scores that are held at once


def _rows_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: row numbers and vectors, in double, of an array column. Rows without a vector are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lists = column.take(pa.array(valid))
    width = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.concatenate(([0], np.cumsum(width)))[:-1]
    out = {}
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        out[w] = (valid[rows], values[first[rows][:, None] + np.arange(w)])
    return out


def _place(values: pa.Array, among: pa.Array, missing: int) -> np.ndarray:
    """Where each value stands in ``among``; ``missing`` for nulls and others."""
    place = pc.fill_null(pc.index_in(values, value_set=among), missing)
    return np.where(pc.is_valid(values).to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False), missing)


class Nearest:
    """The ``k`` best chunks of each of some queries, as blocks of chunks come by: a bounded heap for each query.

    ``queries``: ``query_id, library_id, key, own, across, embedding``; chunks that have the same key are looked at.
    """

    def __init__(self, queries: pa.Table, k: int):
        self.k, self.queries = k, queries.select(["query_id", "library_id"])
        self.least = np.full(len(queries), -np.inf)  # the k-th score so far
        self.held, self.size = [], 0
        self.groups = {}  # (key, width): row numbers, vectors, norms
        keys = np.array(queries.column("key").to_pylist(), object)
        self.owners = pc.unique(queries.column("own"))
        self.own = _place(queries.column("own"), self.owners, -1)
        self.across = queries.column("across").to_numpy()
        for width, (rows, vectors) in _rows_of(queries.column("embedding")).items():
            order = np.argsort(keys[rows].astype(str), kind="stable")
            rows, vectors = rows[order], vectors[order]
            cuts = np.flatnonzero(np.concatenate(([True], keys[rows][1:] != keys[rows][:-1])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
                self.groups[keys[rows[a]], width] = rows[a:b], vectors[a:b], np.sqrt((vectors[a:b] ** 2).sum(1))

    def look(self, ids: pa.Array, keys: pa.Array, owners: pa.Array, embeddings: pa.Array) -> None:
        coded = keys.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        owners = _place(owners, self.owners, -2)  # nobody's and unknown ones are no query's own
        for width, (rows, vectors) in _rows_of(embeddings).items():
            norms = np.sqrt((vectors**2).sum(1))
            for c in np.unique(code[rows]).tolist():
                if (names[c], width) in self.groups:
                    mine = np.flatnonzero(code[rows] == c)
                    self._block(*self.groups[names[c], width], ids, owners, rows[mine], vectors[mine], norms[mine])

    def _block(self, asked, vectors, norms, ids, owners, rows, stored, lengths) -> None:
        step = max(1, CELLS // len(rows))
        for a in range(0, len(asked), step):
            own = asked[a : a + step]
            score = vectors[a : a + step] @ stored.T / (norms[a : a + step, None] * lengths + 1e-9)
            score[np.isnan(score)] = -np.inf
            if not self.across[own].all():
                score[~(self.across[own, None] | (self.own[own, None] == owners[rows]))] = -np.inf
            floor = self.least[own]
            if len(rows) > self.k:
                floor = np.maximum(floor, np.round(np.partition(score, len(rows) - self.k, axis=1)[:, len(rows) - self.k], 6))
            query, chunk = np.nonzero((score >= floor[:, None] - 1e-6) & (score > -np.inf))  # then by what counts, the rounded score
            rounded = np.round(score[query, chunk], 6)
            good = rounded >= floor[query]
            query, chunk = query[good], chunk[good]
            self.held.append(pa.table({"q": own[query], "score": rounded[good], "chunk_id": ids.take(pa.array(rows[chunk]))}))
            self.size += len(query)
            if self.size > 4 * self.k * len(self.least) + CELLS // 8:
                self.held = [self.best()]
                self.size = len(self.held[0])

    def best(self) -> pa.Table:
        """``q, score, chunk_id``: no more than ``k`` rows a query; of equal scores the smaller id first."""
        if not self.held:
            return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "chunk_id": pa.array([], pa.string())})
        rows = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        q = rows.column("q").to_numpy()
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        full = np.flatnonzero(place == self.k - 1)
        self.least[q[full]] = rows.column("score").to_numpy()[full]
        return rows.take(pa.array(np.flatnonzero(place < self.k)))

    def rows(self) -> pa.Table:
        """``query_id, chunk_id, library_id, score``."""
        best = self.best()
        asked = self.queries.take(best.column("q"))
        return pa.table({"query_id": asked.column("query_id"), "chunk_id": best.column("chunk_id"), "library_id": asked.column("library_id"), "score": best.column("score")})


def _tiles(df: DataFrame, rows: int) -> DataFrame:
    """``key, tiles``. Cut: the tiles of both sides are joined to each, whose columns would else be those of two frames."""
    return cut(df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("tiles")))


def _in_tiles(df: DataFrame, mine: DataFrame, theirs: DataFrame, number: str, other_number: str, by: str) -> DataFrame:
    """``df`` with its tile by a hash of ``by``, once for each tile of the other side under the same key."""
    sized = df.join(mine.withColumnRenamed("tiles", "_mine"), "key").join(theirs.withColumnRenamed("tiles", "_theirs"), "key")
    return sized.withColumn(number, F.pmod(F.xxhash64(by), F.col("_mine")).cast("int")).withColumn(other_number, F.explode(F.sequence(F.lit(0), F.col("_theirs") - 1))).drop("_mine", "_theirs")


def _nearest(wanted: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, library_id, score``: for each row of ``wanted`` up to ``k`` chunks from each task or tile.

    Pairs never become rows. Few queries go to all tasks and ``stored`` isn't shuffled. Others are dealt into tiles of
    (key, part of the chunks, part of the queries), so neither a large library nor a large set of queries meets in one
    task; a side moves as often as the other has parts.
    """
    wanted, stored = wanted.select("query_id", "library_id", "key", "own", "across", "embedding"), stored.select("chunk_id", "key", "owner", "embedding")
    kinds = [f"query_id {wanted.schema['query_id'].dataType.simpleString()}", f"chunk_id {stored.schema['chunk_id'].dataType.simpleString()}", f"library_id {wanted.schema['library_id'].dataType.simpleString()}", "score double"]
    few = wanted.limit(FEW_QUERIES + 1).toArrow()
    if len(few) <= FEW_QUERIES and few.nbytes <= FEW_BYTES:
        shipped = wanted.sparkSession.sparkContext.broadcast(few)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Nearest(shipped.value, k)
            for batch in batches:
                found.look(*[batch.column(c) for c in ("chunk_id", "key", "owner", "embedding")])
            yield from found.rows().to_batches()

        return stored.mapInArrow(run, ", ".join(kinds))

    def meet(asked: pa.Table, chunks: pa.Table) -> pa.Table:
        found = Nearest(asked, k)
        if len(asked) and len(chunks):
            for part in chunks.combine_chunks().to_batches(max_chunksize=4096):
                found.look(*[part.column(c) for c in ("chunk_id", "key", "owner", "embedding")])
        return found.rows()

    tile, queries, chunks = ["key", "_chunks", "_queries"], _tiles(wanted, TILE_QUERIES), _tiles(stored, TILE_CHUNKS)
    asked = _in_tiles(wanted, queries, chunks, "_queries", "_chunks", "query_id").groupBy(*tile)
    return asked.cogroup(_in_tiles(stored, chunks, queries, "_chunks", "_queries", "chunk_id").groupBy(*tile)).applyInArrow(meet, ", ".join(kinds))


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, chunk_id, library_id, score, rank``: the ``k`` nearest chunks of each query's libraries by cosine.

    Where both sides have ``organization_id``, a query sees its own organisation's chunks only, unless it is ``cross_org``.
    Exact, as products of blocks of vectors in tasks. Rows without a vector, and vectors of another width than the query's,
    aren't found; of equal scores (to six places) the smaller chunk_id is first.
    """
    scope = {"organization_id"} <= set(queries.columns) & set(chunks.columns)
    own = [F.col("organization_id").cast("string").alias("own" if side else "owner") if scope else F.lit("").alias("own" if side else "owner") for side in (True, False)]
    across = F.coalesce("cross_org", F.lit(False)) if scope and "cross_org" in queries.columns else F.lit(False)
    key = F.col("library_id").cast("string").alias("key")
    wanted = queries.filter("library_id IS NOT NULL").select("query_id", "library_id", key, own[0], across.alias("across"), "embedding")
    stored = chunks.filter("library_id IS NOT NULL").select("chunk_id", key, own[1], "embedding")
    return first_rows(_nearest(wanted, stored, k), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def products(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_id, dot, norm, cosine`` to six places: each query with each chunk of its library; ``norm`` is the chunk's.

    All pairs are the result, so work grows with both tables. Memory doesn't: queries go to all tasks in slices of
    ``FEW_QUERIES`` and ``FEW_BYTES`` at most, chunks aren't shuffled, and pairs leave in pieces. Vectors of two widths have
    no product, and one that is missing has no norm either.
    """
    wanted = queries.filter("library_id IS NOT NULL").select("query_id", F.col("library_id").cast("string").alias("key"), "embedding")
    stored = chunks.filter("library_id IS NOT NULL").select("chunk_id", F.col("library_id").cast("string").alias("key"), "embedding")
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding") * 8 + 64), F.lit(0))).first()
    slices = max(1, -(-n // FEW_QUERIES), -(-size // FEW_BYTES))
    kinds = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, chunk_id {stored.schema['chunk_id'].dataType.simpleString()}, dot double, norm double, cosine double"
    parts = [wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i) if slices > 1 else wanted for i in range(slices)]
    return reduce(DataFrame.unionByName, [stored.mapInArrow(_multiplied(part), kinds) for part in parts])


def _multiplied(wanted: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does in ``products`` with the queries ``query_id, key, embedding``."""
    shipped = wanted.sparkSession.sparkContext.broadcast(wanted.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value.combine_chunks()
        ids, vectors = pa.concat_arrays(asked.column("query_id").chunks) if len(asked) else None, _rows_of(asked.column("embedding")) if len(asked) else {}
        names, groups = np.array(asked.column("key").to_pylist(), object), {}
        for name in set(names):
            groups[name] = np.flatnonzero(names == name)
        for batch in batches:
            keys, stored = np.array(batch.column("key").to_pylist(), object), _rows_of(batch.column("embedding"))
            norm = np.full(len(keys), np.nan)
            for rows, x in stored.values():
                norm[rows] = np.sqrt((x**2).sum(1))
            known = np.zeros(len(keys), bool)
            for rows, _ in stored.values():
                known[rows] = True
            for name in set(keys):
                if name not in groups:
                    continue
                mine, theirs = np.flatnonzero(keys == name), groups[name]
                place = np.full(len(keys), -1)
                place[mine] = np.arange(len(mine))
                step = max(1, CELLS // 8 // len(mine))
                for a in range(0, len(theirs), step):
                    part = theirs[a : a + step]
                    dot, length, met = np.zeros((len(part), len(mine))), np.zeros(len(part)), np.zeros((len(part), len(mine)), bool)
                    for width, (rows, x) in stored.items():
                        own = np.flatnonzero(place[rows] >= 0)
                        q_rows, q = vectors.get(width, (np.empty(0, np.int64), None))
                        lo, hi = np.searchsorted(q_rows, part), np.searchsorted(q_rows, part, "right")
                        have = np.flatnonzero(hi > lo)
                        if len(own) and len(have):
                            at = np.ix_(have, place[rows[own]])
                            v = q[lo[have]]
                            dot[at], met[at], length[have] = v @ x[own].T, True, np.sqrt((v**2).sum(1))
                    cosine = dot / (length[:, None] * norm[mine] + 1e-9)
                    many = lambda x: np.round(x, 6).ravel()
                    gone, n = ~met.ravel(), len(part)
                    out = [ids.take(pa.array(np.repeat(part, len(mine)))), batch.column("chunk_id").take(pa.array(np.tile(mine, n)))]
                    out += [pa.array(many(dot), mask=gone), pa.array(np.tile(np.round(norm[mine], 6), n), mask=np.tile(~known[mine], n)), pa.array(many(cosine), mask=gone)]
                    yield pa.RecordBatch.from_arrays(out, ["query_id", "chunk_id", "dot", "norm", "cosine"])

    return run


def centroids(chunks: DataFrame) -> DataFrame:
    """``library_id, cluster_id, size, centroid``: mean vector of each cluster, summed dimension by dimension."""
    size = chunks.groupBy("library_id", "cluster_id").agg(F.count(F.lit(1)).alias("size"))
    parts = chunks.select("library_id", "cluster_id", F.posexplode("embedding").alias("dim", "x"))
    means = parts.groupBy("library_id", "cluster_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"])
    return means.groupBy("library_id", "cluster_id").agg(vector.alias("centroid")).join(size, ["library_id", "cluster_id"])


def cluster_stats(chunks: DataFrame) -> DataFrame:
    """Size of each cluster and mean and largest distance of its chunks to its centroid."""
    known = chunks.join(centroids(chunks), ["library_id", "cluster_id"])  # few rows: Spark broadcasts them where it may
    gap = F.sqrt(F.aggregate(F.zip_with("embedding", "centroid", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x))
    return known.groupBy("library_id", "cluster_id").agg(F.first("size").alias("size"), F.round(F.avg(gap), 6).alias("mean_distance"), F.round(F.max(gap), 6).alias("max_distance"))


def nearest_center(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``points`` with the ``cluster_id`` of the nearest centre of their library (50 at most), null where it has none."""
    listed = centers.groupBy("library_id").agg(F.collect_list(F.struct("cluster_id", "centroid")).alias("_centers"))
    gap = lambda c: F.aggregate(F.zip_with("embedding", c["centroid"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_centers", lambda c: F.struct(gap(c).alias("gap"), c["cluster_id"].alias("cluster_id"))))
    return points.join(listed, "library_id", "left").withColumn("cluster_id", best["cluster_id"]).drop("_centers")


def _probes(queries: DataFrame, centers: DataFrame, nprobe: int | float) -> DataFrame:
    """``query_id, library_id, cluster_id, embedding, probe``: each query's nearest centres of its library."""
    near = queries.join(centers, "library_id").select("query_id", "library_id", "cluster_id", "embedding", cosine(F.col("embedding"), F.col("centroid")).alias("near"))
    if isinstance(nprobe, int):
        return first_rows(near, ["query_id", "library_id"], [F.desc("near"), F.col("cluster_id")], nprobe, "probe").drop("near")
    own = Window.partitionBy("query_id", "library_id")
    placed = near.withColumn("probe", F.row_number().over(own.orderBy(F.desc("near"), "cluster_id"))).withColumn("of", F.count(F.lit(1)).over(own))
    return placed.filter(F.col("probe") <= F.ceil(F.col("of") * nprobe)).drop("near", "of")


def vector_topk_ivf(queries: DataFrame, chunks: DataFrame, centers: DataFrame, nprobe: int | float, k: int = 5) -> DataFrame:
    """Like ``vector_topk``, looking only into each query's ``nprobe`` nearest clusters (a float: that share of a library's
    clusters). ``chunks`` have a ``cluster_id``.

    If ``chunks`` are a table that ``save_ivf`` wrote, only the folders of probed clusters are read. Organisations aren't
    looked at.
    """
    probes = cut(_probes(queries, centers, nprobe))
    key = lambda: F.concat_ws("\u0000", "library_id", "cluster_id").alias("key")
    wanted = probes.select("query_id", "library_id", key(), F.lit("").alias("own"), F.lit(True).alias("across"), "embedding")
    read = chunks.join(probes.filter("probe > 0").select("library_id", "cluster_id").distinct(), ["library_id", "cluster_id"], "left_semi")
    found = _nearest(wanted, read.select("chunk_id", key(), F.lit("").alias("owner"), "embedding"), k)
    return first_rows(found, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def save_ivf(chunks: DataFrame, clusters: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes the vectors as ``{path}/vectors``, a folder for each library and cluster, and the mean vector of each cluster
    as ``{path}/centers``; both as they are read again. ``clusters``: ``library_id, chunk_id, cluster_id``.

    A large cluster is written by several tasks, by a salt of the chunk.
    """
    spark = chunks.sparkSession
    known = chunks.select("library_id", "chunk_id", "embedding").join(clusters.select("library_id", "chunk_id", "cluster_id"), ["library_id", "chunk_id"])
    known.repartition("library_id", "cluster_id", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).write.mode("overwrite").partitionBy("library_id", "cluster_id").parquet(f"{path}/vectors")
    stored = spark.read.schema(known.schema).parquet(f"{path}/vectors")
    centroids(stored).write.mode("overwrite").parquet(f"{path}/centers")
    return stored, spark.read.parquet(f"{path}/centers")


def choose_k(n):
    """Clusters for ``n`` chunks: the rounded root, between 8 and 50, and no more than there are chunks."""
    return F.least(F.greatest(F.least(F.bround(F.sqrt(n)), F.lit(50)), F.lit(8)), n).cast("long")


CENTER_BYTES = 64 << 20  # centres that are on the driver and in a broadcast at once


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1) - 2 * x @ centers.T).argmin(1)


def _assigned(points: DataFrame, centers) -> DataFrame:
    """``library_id, chunk_id, cluster_id``: the nearest centre of the chunk's library."""
    kind = points.schema["chunk_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for library, mine in part.groupby("library_id"):
                labels = nearest(np.stack(mine["embedding"].to_numpy()).astype(np.float64), centers.value[library])
                yield mine[["library_id", "chunk_id"]].assign(cluster_id=labels.astype(np.int32))

    return points.mapInPandas(run, f"library_id string, chunk_id {kind}, cluster_id int")


def _sums(points: DataFrame, centers) -> DataFrame:
    """``library_id, cluster_id, n, total``: how many chunks are nearest to each centre, and their sum. Tasks add up first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = {}, {}
        for part in parts:
            for library, mine in part.groupby("library_id"):
                x, c = np.stack(mine["embedding"].to_numpy()).astype(np.float64), centers.value[library]
                labels = nearest(x, c)
                n[library] = n.get(library, 0) + np.bincount(labels, minlength=len(c))
                total.setdefault(library, np.zeros(c.shape))
                np.add.at(total[library], labels, x)
        for library, size in n.items():
            full = np.flatnonzero(size)
            yield pd.DataFrame({"library_id": library, "cluster_id": full.astype(np.int32), "n": size[full], "total": list(total[library][full])})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[:1].assign(n=pdf["n"].sum(), total=[np.sum(np.stack(pdf["total"].to_numpy()), 0)])

    schema = "library_id string, cluster_id int, n long, total array<double>"
    return points.mapInPandas(run, schema).groupBy("library_id", "cluster_id").applyInPandas(merge, schema)  # a row a task


def cluster_library(chunks: DataFrame, seed: int = 42, rounds: int = 200) -> DataFrame:
    """``library_id, chunk_id, cluster_id`` by k-means within each library, whatever its size.

    Lloyd's rounds go over all libraries at once: chunks stay where they are, the centres (50 a library at most) are
    broadcast, and tasks send sums. Libraries are taken in as many turns as keep the centres under ``CENTER_BYTES``. The
    first centres are chunks in the order of a seeded hash; a centre that loses all chunks stays. Rounds end when no centre
    moves (by a billionth), at the latest after ``rounds``.
    """
    points = cut(chunks.select("library_id", "chunk_id", "embedding"))
    sizes = points.groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).withColumn("k", choose_k(F.col("n")))
    turns = -(-(sizes.agg(F.sum(F.col("k") * F.col("width") * 8)).first()[0] or 0) // CENTER_BYTES) or 1
    order = [F.xxhash64(F.lit(seed), F.col("chunk_id")), F.col("chunk_id")]
    first = first_rows(points, ["library_id"], order, 50).join(sizes, "library_id").filter(F.col("rank") <= F.col("k"))
    context, out = points.sparkSession.sparkContext, None
    for turn in range(turns):
        now = F.pmod(F.xxhash64("library_id"), F.lit(turns)) == turn
        mine, centers = points.filter(now), {}
        for r in first.filter(now).select("library_id", "embedding").orderBy("library_id", "rank").collect():
            centers.setdefault(r["library_id"], []).append(r["embedding"])
        centers = {k: np.array(v, np.float64) for k, v in centers.items()}
        for _ in range(rounds):
            shipped, moved = context.broadcast(centers), 0.0
            centers = {k: v.copy() for k, v in centers.items()}
            sums = _sums(mine, shipped).toArrow()  # as large as the centres, at most
            totals = _rows_of(sums.column("total"))
            for rows, vectors in totals.values():
                for row, total in zip(rows.tolist(), vectors):
                    library, cluster = sums.column("library_id")[row].as_py(), sums.column("cluster_id")[row].as_py()
                    new = total / sums.column("n")[row].as_py()
                    moved = max(moved, float(np.abs(new - centers[library][cluster]).max()))
                    centers[library][cluster] = new
            shipped.unpersist()
            if moved <= 1e-9:
                break
        part = _assigned(mine, context.broadcast(centers))
        out = part if out is None else out.unionByName(part)
    return out


def diversify(ranked: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """Round robin over clusters in the order in which they first appear; unclustered chunks are a cluster of their own.

    ``ranked``: ``query_id, chunk_id, rank``. Queries none of whose chunks is clustered keep their order.
    """
    known = ranked.join(clusters.select("chunk_id", "cluster_id"), "chunk_id", "left").withColumn("bucket", F.coalesce(F.col("cluster_id").cast("string"), F.lit("")))
    turn = F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("rank"))
    seen = F.min("rank").over(Window.partitionBy("query_id", "bucket"))
    out = known.withColumn("turn", turn).withColumn("seen", seen)
    return first_rows(out, ["query_id"], [F.col("turn"), F.col("seen")], k, "new_rank").select("query_id", "chunk_id", "cluster_id", "rank", "new_rank")

"""N-gram Jaccard join: which documents' shingle sets overlap by a given share, and the groups they form.

The overlap of two sets is an entry of the product of the document-by-shingle incidence matrix with its transpose. The
product is taken shingle by shingle over the rarest shingles of each set only (two sets that reach the similarity must
share one of those), in blocks of the sets that meet: overlap counts are accumulated row by row, and pairs whose count
cannot reach the bound given by their sizes are discarded. What is left is decided on the whole sets.

Equal sets are one node. Posting lists of large groups are not multiplied out: first every member meets only the most
popular sets of about its size in its lists; members that prove linked are one group from then on, and only pairs of
different groups meet in the product. So a group of n near copies costs about n pairs, yet no link between different
groups is lost.

"Rarest" goes by an order of all shingles: hashed buckets that are frequent in some task come last, then by hash. Any
order gives the same result; this one keeps shared passages out of the posting lists. The table of frequent buckets has
``HEAT_BUCKETS`` bytes, whatever the corpus.

Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import LOWER, cut, gram_hashes, hash_spans, mix, signed, slices, word_spans
from corpusframe.llm.graph_components import components

HEAT_BUCKETS = 1 << 22
#: Ids that are broadcast to find their texts without a shuffle; with more, the join shuffles.
BROADCAST_IDS = 1_000_000
TILE_ROWS = 2_000  # sets of a block whose products one task takes
PIECE_BYTES = 1 << 20  # of text whose shingles a task makes at once, some 20 times that in memory; pairs have two of them
HELD_ROWS = 100_000  # rows of a list that wait for its end


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``k`` words are one shingle, no words are none."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    grams = gram_hashes(words, k)
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        elif hi > lo:
            yield gram_hashes(words[lo:hi], int(hi - lo), seed=1000 + int(hi - lo))
        else:
            yield np.empty(0, np.uint64)


def set_hash(shingles: np.ndarray) -> int:
    """Depends on the elements only; reads as a signed 64-bit value."""
    total = np.add.reduce(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64) + np.uint64(len(shingles))
    return int(signed(mix(np.array([total])))[0])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, node, n`` for every row, and rows ``bucket, heat`` of the buckets that are frequent in a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counts, total, seen, id_type = np.zeros(HEAT_BUCKETS, np.int32), 0, set(), pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for lo, hi, data, offsets in slices(batch.column(1), PIECE_BYTES):
                nodes, sizes = [], []
                for shingles in shingle_sets(data, offsets, k):
                    node = set_hash(shingles)
                    nodes.append(node)
                    sizes.append(len(shingles))
                    if len(shingles) and node not in seen:
                        seen.add(node)
                        np.add.at(counts, (shingles & np.uint64(HEAT_BUCKETS - 1)).astype(np.int64), 1)
                        total += len(shingles)
                m = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, m), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], ["doc_id", "node", "n", "bucket", "heat"])
        mean = total / HEAT_BUCKETS
        hot = np.flatnonzero(counts > mean + 8 * mean**0.5 + 8)
        for lo in range(0, len(hot), 100_000):
            part = hot[lo : lo + 100_000]
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], ["doc_id", "node", "n", "bucket", "heat"])

    return docs.mapInArrow(run, f"doc_id {kind}, node long, n long, bucket long, heat long")


def _heat_levels(profile: DataFrame) -> np.ndarray:
    """Level of each bucket, as powers of two of the heat: ``HEAT_BUCKETS`` bytes, however large the corpus."""
    found = profile.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("heat").alias("heat")).toArrow()
    levels = np.zeros(HEAT_BUCKETS, np.int8)
    if len(found):
        levels[found["bucket"].to_numpy()] = np.floor(np.log2(found["heat"].to_numpy())).astype(np.int8)
    return levels


def _postings(docs: DataFrame, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """``gram, node, n``: the first shingles of each set in the order of heat and hash. A task gives a set once."""
    shipped = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        table, seen = shipped.value, set()
        for batch in batches:
            for lo, _, data, offsets in slices(batch.column(1), PIECE_BYTES):
                grams, nodes, sizes = [], [], []
                for i, shingles in enumerate(shingle_sets(data, offsets, k)):
                    n = len(shingles)
                    if not n or not batch.column(0)[lo + i].is_valid:
                        continue
                    node = set_hash(shingles)
                    if node in seen:
                        continue
                    seen.add(node)
                    warm = table[(shingles & np.uint64(HEAT_BUCKETS - 1)).astype(np.int64)]
                    if warm.any():
                        shingles = shingles[np.argsort(warm, kind="stable")]
                    grams.append(shingles[: prefix_size(n, percent)])
                    nodes.append(node)
                    sizes.append(n)
                if grams:
                    each = [len(g) for g in grams]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(grams))), pa.array(np.repeat(np.array(nodes, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["gram", "node", "n"])

    return docs.mapInArrow(run, "gram long, node long, n int")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """Postings of the grams that several sets share: ``gram, level, node, n``, in this order within partitions.

    Levels are classes of sizes; sets that reach the similarity differ by one level at most. A task goes through its
    sorted lists and holds one batch, whatever a list's length.
    """

    def run(batches):
        held, before = None, False  # last row, and whether the one before it is of the same list
        for batch in batches:
            cols = _columns(batch)
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1])  # several tasks may give a set
            cols = [c[new] for c in cols]
            same = np.concatenate(([before], cols[0][1:] == cols[0][:-1]))
            keep = np.flatnonzero(same[:-1] | same[1:])
            held, before = [c[-1:] for c in cols], bool(same[-1])
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["gram", "level", "node", "n"])
        if before:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["gram", "level", "node", "n"])

    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int").alias("level")
    sorted_rows = rows.select("gram", level, "node", "n").repartition("gram").sortWithinPartitions("gram", "level", "node")
    return sorted_rows.mapInArrow(run, "gram long, level int, node long, n int")


def _popular(shared: DataFrame) -> DataFrame:
    """``node, popular``: the sizes of a set's lists added up. A size of over ``HELD_ROWS`` counts as that."""

    def emit(nodes, sizes):
        node, at = np.unique(nodes, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.bincount(at, sizes).astype(np.int64))], ["node", "size"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            gram, node = (batch.column(k).to_numpy() for k in (0, 2))
            if not len(gram):
                continue
            edge = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            ends = np.append(edge[1:], len(gram))
            if gram[0] != last:
                if held:
                    yield emit(np.concatenate(held), np.full(sum(map(len, held)), min(size, HELD_ROWS)))
                held, size, last = [], 0, gram[0]
            held.append(node[: ends[0]])
            size += int(ends[0])
            if len(edge) > 1:
                yield emit(np.concatenate(held), np.full(sum(map(len, held)), min(size, HELD_ROWS)))
                each = (ends - edge)[1:-1]
                if len(each):
                    yield emit(node[edge[1] : edge[-1]], np.repeat(np.minimum(each, HELD_ROWS), each))
                held, size, last = [node[edge[-1] :]], len(gram) - int(edge[-1]), gram[-1]
            if size > HELD_ROWS and held:
                yield emit(np.concatenate(held), np.full(sum(map(len, held)), HELD_ROWS))
                held = []
        if held:
            yield emit(np.concatenate(held), np.full(sum(map(len, held)), min(size, HELD_ROWS)))

    return shared.mapInArrow(run, "node long, size long").groupBy("node").agg(F.sum("size").alias("popular"))


def _star(shared: DataFrame, percent: int) -> DataFrame:
    """``a, b``: every set with the sets that stand first in most of its lists, of its own level and the one below.

    Popular sets stand first, those in long lists: the text from which near copies were made, as a rule, which they all
    find nearly everywhere. Which pairs are tried here is no matter of correctness.
    """

    def run(batches):
        last = [np.empty(0, np.int64)] * 4  # gram, level, first set and its size of up to two sublists that came before
        for batch in batches:
            gram, level, node, n = _columns(batch)
            if not len(gram):
                continue
            edge = np.ones(len(gram), bool)
            edge[1:] = (gram[1:] != gram[:-1]) | (level[1:] != level[:-1])
            if len(last[0]) and (gram[0], level[0]) == (last[0][-1], last[1][-1]):
                edge[0] = False
            at = np.flatnonzero(edge)
            lists = [np.concatenate((x, y[at])) for x, y in zip(last, (gram, level, node, n))]
            own = np.cumsum(edge) + len(last[0]) - 1
            below = np.maximum(own - 1, 0)
            is_below = (own > 0) & (lists[0][below] == gram) & (lists[1][below] == level - 1)
            for mine, of in ((True, own), (False, below)):
                pivot, size = lists[2][of], lists[3][of]
                fits = (pivot != node) & (100 * np.minimum(n, size).astype(np.int64) >= percent * np.maximum(n, size).astype(np.int64))
                pick = np.flatnonzero(fits if mine else fits & is_below)
                if len(pick):
                    yield pa.RecordBatch.from_arrays([pa.array(node[pick]), pa.array(n[pick]), pa.array(np.full(len(pick), mine)), pa.array(pivot[pick])], ["node", "n", "own", "pivot"])
            last = [x[-2:] for x in lists]

    known = shared.join(_popular(shared).hint("merge"), "node").select("gram", "level", "node", "n", "popular")
    dealt = known.repartition("gram").sortWithinPartitions("gram", "level", F.desc("popular"), "node").drop("popular")
    met = dealt.mapInArrow(run, "node long, n int, own boolean, pivot long").groupBy("node", "n", "own", "pivot").agg(F.count(F.lit(1)).alias("times"))
    met = met.filter(F.col("times") * 300 >= F.col("n") * (100 - percent))  # else hardly alike: left to the product
    best = met.groupBy("node", "own").agg(F.max(F.struct("times", "pivot")).alias("m"))
    return best.select(F.least("node", "m.pivot").alias("a"), F.greatest("node", "m.pivot").alias("b")).distinct()


def _mixed(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``gram, node, n, group, pivot``: postings of lists in which several groups meet; ``pivot`` is the list's first set.

    A list of one group is known as such at its end. Up to ``HELD_ROWS`` of its rows wait for that; a longer one passes
    as if it were mixed, which costs work and changes nothing else.
    """
    names = ["gram", "node", "n", "group", "pivot"]

    def emit(cols, pivots):
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(pivots)], names)

    def run(batches):
        held, size, gram, group, pivot, mixed = [], 0, None, None, None, False
        for batch in batches:
            cols = _columns(batch)
            if not len(cols[0]):
                continue
            edge = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
            ends = np.concatenate((edge[1:], [len(cols[0])]))
            if cols[0][0] != gram:  # the list held has ended
                held, size, mixed, gram, group, pivot = [], 0, False, cols[0][0], cols[3][0], cols[1][0]
            # the batch's first list, which may go on from the batch before
            part = [c[: ends[0]] for c in cols]
            held.append(part)
            size += len(part[0])
            mixed = mixed or part[3][-1] != group or size > HELD_ROWS
            if mixed:
                for h in held:
                    yield emit(h, np.full(len(h[0]), pivot))
                held = []
            if len(edge) > 1:
                first = np.repeat(edge[1:-1], (ends - edge)[1:-1])  # lists that begin and end here
                body = slice(edge[1], edge[-1])
                keep = np.repeat(cols[3][edge[1:-1]] != cols[3][ends[1:-1] - 1], (ends - edge)[1:-1])
                if keep.any():
                    yield emit([c[body][keep] for c in cols], cols[1][first][keep])
                held, gram, group, pivot = [[c[edge[-1] :] for c in cols]], cols[0][edge[-1]], cols[3][edge[-1]], cols[1][edge[-1]]
                size, mixed = len(held[0][0]), bool(held[0][3][-1] != group)
                if mixed:
                    yield emit(held[0], np.full(size, pivot))
                    held = []

    known = shared.join(groups.hint("merge"), "node", "left").select("gram", "node", "n", F.coalesce("component", "node").alias("group"))
    dealt = known.repartition("gram").sortWithinPartitions("gram", "group", "node")
    return dealt.mapInArrow(run, "gram long, node long, n int, group long, pivot long")


def _block_pairs(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of sets of different groups that may still link, from products over the postings.

    Two sets of different groups meet only in lists of several groups; no other list is looked at. Lists are dealt out
    by their first set, so that lists with the same members meet: a block is all sets of such lists, each with its grams
    of all lists. In a block, the product of incidence matrices gives overlaps row by row; pairs below the bound given
    by their sizes are discarded. Blocks of more than ``TILE_ROWS`` sets are split into pairs of tiles.
    """
    mixed = cut(_mixed(shared, groups))
    nodes = mixed.groupBy("node").agg(F.first("n").alias("n"), F.first("group").alias("group"), F.array_sort(F.collect_list("gram")).alias("grams"))
    members = cut(mixed.select("pivot", "node").distinct())
    sizes = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.least(j, tile) * F.col("tiles") + F.greatest(j, tile))
    placed = members.join(sizes.hint("merge"), "pivot").select("pivot", "node", F.explode(tiles).alias("tile"))

    def product(nodes: list, n: list, marks: list, grams: list) -> tuple[np.ndarray, np.ndarray]:
        nodes, n, name = np.array(nodes, np.int64), np.array(n, np.int64), np.array(marks, np.int64)
        if len(nodes) < 2 or (name == name[0]).all():
            return nodes[:0], nodes[:0]
        rest = -(-percent * n // 100) - 1  # shingles behind the first ones
        each = np.array([len(g) for g in grams])
        values = np.concatenate(grams)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(nodes)), each)[order]
        names, number = np.unique(name, return_inverse=True)
        largest = int(np.bincount(number).argmax())
        done, a, b = np.zeros(len(nodes), bool), [], []
        for i in np.flatnonzero(number != largest):
            lo, hi = np.searchsorted(values, grams[i], "left"), np.searchsorted(values, grams[i], "right")
            size = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
            both = np.bincount(owner[at], minlength=len(nodes))
            done[i] = True
            need = -(-percent * (n + n[i]) // (100 + percent))
            ok = (both > 0) & ~done & (name != name[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (both + np.maximum(rest, rest[i]) >= need)
            j = np.flatnonzero(ok)
            a.append(np.full(len(j), nodes[i]))
            b.append(nodes[j])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        at, held = None, ([], [], [], [])
        for batch in batches:
            pivot, tiles, nodes, n, marks = (batch.column(c).to_pylist() for c in range(5))
            for i in range(batch.num_rows):
                if (pivot[i], tiles[i]) != at:
                    a, b = product(*held)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    at, held = (pivot[i], tiles[i]), ([], [], [], [])
                for column, value in zip(held, (nodes[i], n[i], marks[i], batch.column(5)[i].values.to_numpy())):
                    column.append(value)
        a, b = product(*held)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = placed.join(nodes.select("node", "n", "group", "grams").hint("merge"), "node")
    dealt = rows.select("pivot", "tile", "node", "n", "group", "grams").repartition("pivot", "tile").sortWithinPartitions("pivot", "tile", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _texts(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, text``. A doc_id may have several texts: those whose set isn't the node are left out by the caller."""
    wanted = cut(nodes.join(classes, "node").select("node", "doc_id"))
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(wanted) if small else wanted, "doc_id").select("node", "text")


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``a, b``, distinct pairs in a cut table, whose whole sets reach the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(nodes, docs, classes)

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, sets in _pair_sets(batch, k):
                for i, (x, y) in zip(range(lo, hi), sets):
                    if set_hash(x) != a[i] or set_hash(y) != b[i]:  # a doc_id may have several texts
                        continue
                    both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    if both * 100 >= (len(x) + len(y) - both) * percent:
                        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 1]), pa.array(b[i : i + 1])], ["a", "b"])

    # texts move rather than sets of hashes: they are smaller, and compress
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    return cut(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct())


def _pair_sets(batch: pa.RecordBatch, k: int):
    """Shingle sets of both texts of each row, in pieces of rows."""
    for lo, hi, data, offsets in slices(batch.column(2), PIECE_BYTES):
        right = (s for _, _, r_data, r_offsets in slices(batch.column(3).slice(lo, hi - lo), PIECE_BYTES) for s in shingle_sets(r_data, r_offsets, k))
        yield lo, hi, zip(shingle_sets(data, offsets, k), right)


def jaccard_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``doc_id, text``.

    Two documents link when ``100 * intersection >= percent * union``; equal ids are one document. Empty or null texts
    link with nothing. A null doc_id takes part in nothing and its component is null.
    """
    docs = docs.select("doc_id", "text")
    profile = cut(_profile(docs, k))
    levels = _heat_levels(profile)
    rows = profile.filter("bucket IS NULL").select("doc_id", "node", "n")
    classes = cut(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    shared = cut(_shared(_postings(docs, levels, k, percent), percent))
    links = _linked(cut(_star(shared, percent)), docs, classes, k, percent)
    pairs = cut(_block_pairs(shared, components(links), percent).distinct())
    del shared  # its files can go
    rest = _linked(pairs, docs, classes, k, percent)
    # documents with one id and different texts are one node as well
    twice = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    several = rows.filter("n > 0").join(twice, "doc_id").select("a", F.col("node").alias("b"))
    groups = components(links.union(rest).union(several))
    named = classes.join(groups, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("group"))
    smallest = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    known = named.join(smallest, "group").select("node", "component_id")
    out = rows.join(known, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; of rows that share a doc_id one stays.

    Documents without words, and those with a null doc_id, stay.
    """
    groups = jaccard_groups(docs, k, percent)
    gone = groups.filter("doc_id IS NOT NULL AND component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    single = kept.join(twice, "doc_id", "left_semi").withColumn("_turn", F.row_number().over(first)).filter("_turn = 1").drop("_turn")
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(single.select(*docs.columns))


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents``; see ``jaccard_groups`` for odd rows."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, md5_number(array_to_string(ws[k:k+3], ' ')) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.d = w.doc_id GROUP BY 1, 2
"""

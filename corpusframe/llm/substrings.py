"""Substring dedup by suffix trees over prefix partitions.

A suffix starts at every word with at least ``window`` words of its document left. Two suffixes repeat each other where
their first ``window`` words agree. The tree of all suffixes is built in parts that fit in memory, each the subtree of the
suffixes that share a prefix, and only from suffixes whose prefix occurs again:

1. Suffixes are sampled: each window is represented by one of its words, its anchor, at which the ``ANCHOR``-word gram with
   the least hash begins. Equal windows have the anchor at the same place, so repeats stay together, and neighbouring
   windows share one: about one suffix in seven stands for all. A suffix that starts at an anchor is filed under its first
   ``ANCHOR`` words. Prefixes that occur once end here.
2. For prefixes that occur again, the words around the anchor are moved. A group is what shares the prefix; where more than
   ``GROUP_ROWS`` suffixes do, prefixes are lengthened to the whole window, at every word that a window starts with. Such
   a group is a leaf: it needs no memory but its first suffix. Of equal leaves a task keeps only the first before they move.
3. A group's subtree is its sorted suffixes with the longest common prefixes of neighbours: inner nodes are runs whose
   common prefixes reach a depth. The words in front of the anchors, read backwards, make a second tree of the same kind.
   A window with k words before its anchor repeats another where both lie below one node of depth ``window - k`` in the
   first tree and one of depth k in the second. All but the first of such windows repeat it; neighbouring windows are
   joined into maximal ranges.

Many groups' trees are built at once in numpy. Words are told apart by their bytes, hashes only deal rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import gram_hashes, hash_spans, mix, signed, slices, table, word_spans

WINDOW, ANCHOR = 20, 8
GROUP_ROWS = 20_000
HOT = 500  # occurrences of a prefix in a slice from which it counts as one of a large group
PLACE_BITS = np.uint64(31)  # words of one slice; a slice is one document or a few MB
NO_ID = 2**63 - 1  # place of a null doc_id in the order of documents, after all others


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, window: int):
    """Runs of suffixes with one anchor: ``(text, anchor word, gram hash, first suffix, suffixes)``, words counted in
    the slice; then first words of texts, word starts and ends, word hashes."""
    starts, ends, first = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    none = np.empty(0, np.int64)
    if len(words) < window:
        return (none, none, np.empty(0, np.uint64), none, none), first, starts, ends, words
    k = min(ANCHOR, window)
    grams = gram_hashes(words, k)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams >> PLACE_BITS << PLACE_BITS) | place, window - k + 1)
    at = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    valid = np.flatnonzero(text[: len(at)] == text[window - 1 :])
    at = at[valid]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (text[valid][1:] != text[valid][:-1]))))
    runs = np.diff(np.concatenate((edge, [len(at)])))
    return (text[valid[edge]], at[edge], grams[at[edge]], valid[edge], runs), first, starts, ends, words


def _anchor_rows(base: DataFrame, window: int) -> DataFrame:
    """``gram, order, code``: sampled suffixes by their prefix; the code is four times the place plus a mark.

    Where a slice has more than ``HOT`` suffixes of one prefix, that prefix is known to occur again and to be of a large
    group. One of them says so to the prefix's other occurrences (mark 1); the others (mark 2) needn't go where these go
    and are dealt out at random.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column(0).to_numpy()
            for lo, hi, data, offsets in slices(batch.column(1)):
                (text, at, gram, _, _), first, *_ = anchors(data, offsets, window)
                _, head, number, count = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
                mark = np.where(count > HOT, 2, 0)[number]
                mark[head[count > HOT]] = 1
                own = order[lo:hi][text]
                route = np.where(mark == 2, mix(own.view(np.uint64) + at.astype(np.uint64)), gram)
                yield pa.RecordBatch.from_arrays([pa.array(signed(route)), pa.array(own), pa.array((at - first[text]) * 4 + mark)], ["gram", "order", "code"])

    return base.select("order", "text").mapInArrow(run, "gram long, order long, code long")


def _repeated(rows: DataFrame) -> DataFrame:
    """``order, code``: places of prefixes that occur again; the code is twice the place, plus one in a large group."""

    def emit(order, code, large):
        return pa.RecordBatch.from_arrays([pa.array(order), pa.array((code >> 2) * 2 + large)], ["order", "code"])

    def run(batches):
        last, held, size = None, [], 0  # rows of the prefix at the end of what was read
        for batch in batches:
            gram, order, code = (c.to_numpy() for c in batch.columns)
            known = code & 3 == 2
            if known.any():
                yield emit(order[known], code[known], 1)
                gram, order, code = gram[~known], order[~known], code[~known]
            weight = np.where(code & 3 == 1, GROUP_ROWS + 1, 1)
            edge = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.empty(0, np.int64)
            ends = np.concatenate((edge[1:], [len(gram)]))
            for k in range(1 if len(edge) and gram[0] == last else 0):  # goes on from the batch before
                size += int(weight[: ends[k]].sum())
                held.append((order[: ends[k]], code[: ends[k]]))
                if size > GROUP_ROWS:  # known to be large: no need to hold it
                    for o, c in held:
                        yield emit(o, c, 1)
                    held = []
                edge, ends = edge[1:], ends[1:]
            if not len(edge):
                continue
            if size > 1:
                for o, c in held:
                    yield emit(o, c, int(size > GROUP_ROWS))
            inner = ends[:-1] - edge[:-1]
            if len(inner):
                total = np.add.reduceat(weight[: ends[-2]], edge[:-1])
                keep, large = np.repeat(total > 1, inner), np.repeat(total > GROUP_ROWS, inner)
                body = slice(edge[0], ends[-2])
                yield emit(order[body][keep], code[body][keep], large[keep].astype(np.int64))
            last, size = gram[edge[-1]], int(weight[edge[-1] :].sum())
            held = [(order[edge[-1] :], code[edge[-1] :])]
        if size > 1:
            for o, c in held:
                yield emit(o, c, int(size > GROUP_ROWS))

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "order long, code long")


#: ``lead``: words in front of the anchor; below 0 for the leaves of large groups
ROWS = "prefix long, order long, text_key long, first int, suffixes int, lead int, words binary"
KINDS = pa.schema([("prefix", pa.int64()), ("order", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("suffixes", pa.int32()), ("lead", pa.int32()), ("words", pa.binary())])


def _suffixes(joined: DataFrame, window: int) -> DataFrame:
    """``ROWS``: runs of windows around an anchor, by the prefix of their group; each word of ``words`` ends in a space.

    Windows of large groups stand alone, without an anchor. Those that a task knows to repeat an earlier one have no words
    and are dealt out at random.
    """

    def run(batches):
        for batch in batches:
            picked = batch.filter(batch.column(3).is_valid())
            if not picked.num_rows:
                continue
            order, key, codes = picked.column(0).to_numpy(), picked.column(1).to_numpy(zero_copy_only=False), picked.column(3)
            parent, flat = codes.value_parent_indices().to_numpy(zero_copy_only=False), codes.flatten().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(picked.column(2)):
                (text, at, gram, begin, count), first, starts, ends, words = anchors(data, offsets, window)
                if not len(text):
                    continue
                a, b = np.searchsorted(parent, (lo, hi))
                wanted = np.sort((parent[a:b] - lo) << 33 | flat[a:b])  # text, place, large
                mine = text << 33 | (at - first[text]) << 1
                found = np.minimum(np.searchsorted(wanted, mine), max(0, len(wanted) - 1))
                hit = wanted[found] >> 1 == mine >> 1 if len(wanted) else np.zeros(len(mine), bool)
                large = hit & (wanted[found] & 1 == 1) if len(wanted) else hit
                # words, each with one space behind it
                size = ends - starts + 1
                place = np.concatenate(([0], np.cumsum(size)))
                body = np.repeat(starts - place[:-1], size) + np.arange(place[-1])
                spaced = data[np.minimum(body, len(data) - 1)]
                spaced[place[1:] - 1] = 32
                raw = spaced.tobytes()
                runs = np.flatnonzero(hit & ~large)
                if len(runs):
                    s, e = begin[runs], begin[runs] + count[runs] - 1 + window
                    yield table(KINDS, signed(gram[runs]), order[lo + text[runs]], key[lo + text[runs]], (s - first[text[runs]]).astype(np.int32), count[runs].astype(np.int32), (at[runs] - s).astype(np.int32), [raw[x:y] for x, y in zip(place[s].tolist(), place[e].tolist())])
                runs = np.flatnonzero(large)
                if len(runs):
                    n = count[runs]
                    s = np.repeat(begin[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    t = np.repeat(text[runs], n)
                    own, at_word = order[lo + t], s - first[t]
                    turn = np.lexsort((at_word, own))  # earliest first
                    s, t, own, at_word = s[turn], t[turn], own[turn], at_word[turn]
                    leaf = [raw[x:y] for x, y in zip(place[s].tolist(), place[s + window].tolist())]
                    number = pa.array(leaf, pa.binary()).dictionary_encode().indices.to_numpy()
                    _, head = np.unique(number, return_index=True)
                    head = head[number]
                    again = (own != own[head]) | (at_word != at_word[head])
                    prefix = np.where(again, mix(own.view(np.uint64) + s.astype(np.uint64)), gram_hashes(words, window, seed=7)[s])
                    yield table(KINDS, signed(prefix), own, key[lo + t], at_word.astype(np.int32), np.ones(len(s), np.int32), np.full(len(s), -1, np.int32), [None if g else x for g, x in zip(again.tolist(), leaf)])

    # doc_id is read along so that the same exchange of texts serves ``without_repeats``
    return joined.select("order", "text_key", "text", "codes", "doc_id").mapInArrow(run, ROWS)


def classes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Which node of ``depth`` or more each suffix is below: suffixes in ``order`` with ``common`` words with the one before."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def tree(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix tree of each group as sorted suffixes and the length of each one's common prefix with the one before.

    ``words``: word numbers of the suffixes, a row each. A suffix array with common prefixes has the tree's inner nodes as
    its runs; -1 marks the first suffix of a group.
    """
    order = np.lexsort((*words.T[::-1], group))
    same = np.ones((len(order), words.shape[1] + 1), bool)
    same[1:, :-1] = words[order[1:]] == words[order[:-1]]
    same[:, -1] = False
    common = same.argmin(1)
    common[np.concatenate(([True], group[order[1:]] != group[order[:-1]]))] = -1
    return order, common


def _subtrees(group, order, first, suffixes, lead, words: pa.Array, window: int):
    """``(row, first window, windows)`` of the windows that an earlier one of the group repeats, in runs."""
    raw = pa.concat_arrays([words.cast(pa.large_binary())])
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    stops = np.flatnonzero(data == 32) + 1
    bounds = np.concatenate(([0], stops))
    row_word = np.searchsorted(bounds, at - at[0])  # first word of each row
    number = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
    anchor = row_word[:-1] + lead
    ahead = anchor[:, None] + np.arange(window)
    right = np.where(ahead < row_word[1:, None], number[np.minimum(ahead, len(number) - 1)], -1)
    span = int(lead.max())
    behind = anchor[:, None] - 1 - np.arange(span)
    left = np.where(behind >= row_word[:-1, None], number[np.maximum(behind, 0)], -1)
    right_order, right_common = tree(group, right)
    left_order, left_common = tree(group, left) if span else (None, None)
    turn = np.lexsort((first + lead, order))
    newer = (order[turn][1:] != order[turn][:-1]) | ((first + lead)[turn][1:] != (first + lead)[turn][:-1])
    rank = np.empty(len(turn), np.int64)
    rank[turn] = np.concatenate(([0], np.cumsum(newer)))
    again = np.zeros((len(lead), int(suffixes.max()) + 1), bool)
    for k in range(span + 1):  # words of the window before its anchor
        row = np.flatnonzero((lead >= k) & (lead - k < suffixes))
        if not len(row):
            continue
        node = classes_at(right_order, right_common, window - k)[row]
        if k:
            node = node * (len(lead) + 1) + classes_at(left_order, left_common, k)[row]
        _, number_of, size = np.unique(node, return_inverse=True, return_counts=True)
        least = np.full(len(size), len(lead), np.int64)
        np.minimum.at(least, number_of, rank[row])
        later = rank[row] > least[number_of]
        again[row[later], lead[row[later]] - k] = True
    edge = np.diff(again.astype(np.int8), axis=1, prepend=0)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, begin, end - begin


def _repeats(rows: DataFrame, window: int) -> DataFrame:
    """``order, text_key, first, suffixes``: runs of windows that an earlier one repeats."""
    schema = pa.schema([("order", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("suffixes", pa.int32())])

    def leaves(batch, state):
        """Leaves of large groups, first ones first: the same words from earlier on make one a repeat."""
        out = []
        for prefix, order, first, words in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 6))):
            if words is not None and prefix != state["prefix"]:
                state["prefix"], state["seen"] = prefix, {}
            out.append(words is None or state["seen"].setdefault(words, (order, first)) < (order, first))
        return batch.filter(pa.array(out, pa.bool_()))

    def trees(batch):
        group, order, key, first, suffixes, lead = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        row, begin, n = _subtrees(group, order, first, suffixes, lead, batch.column(6), window)
        return table(schema, order[row], key[row], (first[row] + begin).astype(np.int32), n.astype(np.int32))

    def run(batches):
        held, state = None, {"prefix": None, "seen": {}}
        for batch in batches:
            leaf = pa.compute.less(batch.column(5), 0)
            if pa.compute.any(leaf).as_py():
                found = leaves(batch.filter(leaf), state)
                yield pa.RecordBatch.from_arrays([found.column(k) for k in (1, 2, 3, 4)], schema=schema)
                batch = batch.filter(pa.compute.invert(leaf))
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks()
                batch = batch.to_batches(max_chunksize=1 << 40)[0] if batch.num_rows else held
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy(zero_copy_only=False)
            end = int(np.searchsorted(group, group[-1], "left"))  # the last group may go on
            held = batch.slice(end)
            if end:
                yield trees(batch.slice(0, end))
        if held is not None and held.num_rows:
            yield trees(held)

    sorted_rows = rows.repartition("prefix").sortWithinPartitions("prefix", "order", "first")
    return sorted_rows.mapInArrow(run, "order long, text_key long, first int, suffixes int")


def _base(docs: DataFrame) -> DataFrame:
    """``doc_id, order, text_key, text``; a text is found again by the two in the middle."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select("doc_id", order.alias("order"), F.xxhash64("text").alias("text_key"), "text")


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``order, text_key, first, suffixes``: maximal runs of windows of a text that start earlier somewhere as well."""
    base = _base(docs)
    places = _repeated(_anchor_rows(base, window)).groupBy("order").agg(F.collect_list("code").alias("codes"))
    return _repeats(_suffixes(base.join(places.hint("shuffle_hash"), "order", "left"), window), window)


def without_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) for every row of ``doc_id, text``.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a smaller doc_id, or
    earlier in the same document. Null and empty texts have no words; ``doc_id`` is an integer, null ids come last. Rows
    that share a doc_id are one document: they don't precede each other at the same start. Kept words are joined by one
    space. An empty table gives no rows; further columns are not looked at.
    """
    base = _base(docs)
    ranges = repeated_ranges(docs, window).groupBy("order").agg(F.collect_list(F.struct("text_key", "first", "suffixes")).alias("ranges"))
    # the same exchange of texts serves this join and the one in repeated_ranges
    joined = base.join(ranges.hint("shuffle_hash"), "order", "left").select("doc_id", "text_key", "text", "ranges")

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for key, text, ranges in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                spans = sorted((r["first"], r["first"] + r["suffixes"] - 1 + window) for r in ranges.as_py() if r["text_key"] == key) if ranges.is_valid else []
                kept, at = [], 0
                for a, b in spans:
                    if a > at:
                        kept += words[at:a]
                    at = max(at, b)
                kept += words[at:]
                left = b" ".join(kept)
                for column, value in zip(out, (n, n - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if keep_text else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return done if keep_text else done.drop("kept_text")


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``documents``; see ``without_repeats`` for odd rows."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, s, md5_number(array_to_string(ws[s:s+19], ' ')) AS g FROM p),
d AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS rn FROM k) WHERE rn > 1),
c AS (SELECT DISTINCT doc_id, s + j AS pos FROM d, range(0, 20) AS t(j)),
l AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
r AS (SELECT l.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
 sha256(coalesce(string_agg(CASE WHEN c.pos IS NULL THEN word END, ' ' ORDER BY l.pos), '')) AS kept_sha256
 FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
 coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""

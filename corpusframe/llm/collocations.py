"""Phrase collocations: phrases of 2 to 5 words that are frequent, and more frequent than their parts would make them.

Phrases are counted by HAT-tries. Every word starts a suffix of up to 5 words of its piece; in a task, suffixes go into a
shallow trie over word ids: an inner node splits by first or second word, and a leaf is a hash container for a range of
them. A container that outgrows ``BURST`` entries bursts into leaves for narrower ranges, or, when it is down to one word,
for ranges of the next word. When a trie outgrows ``ENTRIES``, its largest subtrees are spilled whole, as sorted runs of
(suffix, count). Runs go to prefix partitions, a partition merges all its runs, and the counts of phrases of every length
are then sums over neighbouring suffixes.

What makes this hold at any size:

- A prefix runs to the first word that isn't hot (hot: over 1 / ``HOT`` of all words, so ``HOT`` words at most). So no
  partition has more than a small part of all suffixes in excess of ``GROUP``, however common a word or pair is. Phrases of
  hot words only are in several partitions; their partial counts are summed once more.
- Word ids are places in a list of the most frequent words with ``LISTED`` entries at most, which is broadcast (8 MB of
  hashes). If it holds every frequent word, others can't be in a frequent phrase and cut the piece. Else they get ids of
  their own run, and the run carries their hashes; nothing is lost.
- Runs are binary: columns of bytes, compressed where a run is long.

A word is known by a 64-bit hash of its language and itself; two words with one hash are found and raise an error.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import LOWER, hash_spans, mix, shared_dir, signed, slices, table, word_spans

SHORTEST, LONGEST = 2, 5  # the packing of suffixes below has room for five words
LEAST, TOP, SHARE = 100, 2000, 100
NO_LANG = "und"
BITS = 21  # of a word id
LISTED = 1 << 20
BURST = 1 << 14
ENTRIES = 1 << 20  # of a task's trie
STEP = 1 << 19  # words added to it at once
GROUP = 1 << 20  # suffixes of a prefix partition, about
HOT = 1024
LONG_RUN = 256  # entries from which a run is compressed
ENTRY = LONGEST * 3 + 4  # bytes of one: ids of three bytes, a count of four
WORDS_HELD = 1 << 20  # distinct words of a task, about

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(10, 14)]] = True
IS_WORD = ~BREAKS
IS_WORD[[9, 32]] = False


def words_of(data: np.ndarray, offsets: np.ndarray, salts: np.ndarray):
    """Lower-case bytes, start and end of every word, its hash (``salts``: of each text's language), and whether a piece
    starts with it."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    breaks = np.concatenate((np.zeros(1, np.int32), np.cumsum(BREAKS[data], dtype=np.int32)))
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[starts[1:]] != breaks[ends[:-1]]) | (text[1:] != text[:-1])
    return data, starts, ends, mix(hash_spans(data, starts, ends) ^ salts[text]), new, text


def salted(langs: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of the languages of a batch (null: ``und``), each row's number among them, and each row's salt."""
    coded = langs.fill_null(NO_LANG).dictionary_encode()
    names, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    each = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    return names, number, each[number]


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, key, n`` of all words; ``key`` is the hash that stands for language and word."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def joined(parts):
        lang, word, key, n = ([p[k] for p in parts] for k in range(4))
        distinct, at, number = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
        total = np.bincount(number, np.concatenate(n), len(distinct)).astype(np.int64)
        take = pa.array(at)
        return pa.concat_arrays(lang).take(take), pa.concat_arrays(word).take(take), distinct, total

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            names, number, salts = salted(batch.column(1))
            for lo, hi, data, offsets in slices(batch.column(0)):
                data, starts, ends, key, _, text = words_of(data, offsets, salts[lo:hi])
                distinct, at, n = np.unique(key, return_index=True, return_counts=True)
                if not len(distinct):
                    continue
                raw = data.tobytes()
                word = pa.array([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())], pa.binary()).cast(pa.string())
                parts.append((pa.array(names).take(pa.array(number[lo:hi][text[at]])), word, distinct, n))
                held += len(distinct)
                if held > 4 * WORDS_HELD:
                    parts = [joined(parts)]
                    held = len(parts[0][2])
                    if held > WORDS_HELD:
                        yield table(schema, *parts[0][:2], signed(parts[0][2]), parts[0][3])
                        parts, held = [], 0
        if parts:
            lang, word, key, n = joined(parts)
            yield table(schema, lang, word, signed(key), n)

    rows = docs.select("text", "lang").filter("text IS NOT NULL").mapInArrow(run, "lang string, word string, key long, n long")
    return rows.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


class Container:
    """A hash table of suffixes and counts: two numbers are a suffix, linear probing, all keys of a call at once."""

    def __init__(self, room: int = 1 << 10):
        self.used = 0
        self.high, self.low, self.n = np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(room, np.int64)

    def add(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        if 2 * (self.used + len(high)) > len(self.n):
            grown = Container(1 << (2 * (self.used + len(high))).bit_length())
            grown.add(*self.items())
            self.__dict__.update(grown.__dict__)
        mask = np.uint64(len(self.n) - 1)
        slot = (mix(high ^ mix(low)) & mask).astype(np.int64)
        left = np.arange(len(high))
        while len(left):
            at, h, w = slot[left], high[left], low[left]
            free = np.flatnonzero(self.n[at] == 0)
            if len(free):  # of those that want one free place, one gets it
                _, own = np.unique(at[free], return_index=True)
                took = free[own]
                self.high[at[took]], self.low[at[took]] = h[took], w[took]
                self.used += len(took)
            hit = (self.high[at] == h) & (self.low[at] == w)
            np.add.at(self.n, at[hit], n[left[hit]])
            left = left[~hit]
            slot[left] = (slot[left] + 1) & int(mask)

    def items(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.flatnonzero(self.n)
        return self.high[full], self.low[full], self.n[full]


class Trie:
    """Leaves in order; ``edges`` has the least ``high`` (first and second word) that belongs to each.

    A leaf's path is a range of first words, or one first word and a range of second words, so the inner nodes of the trie
    are what neighbouring edges have in common.
    """

    def __init__(self):
        self.edges, self.leaves = np.zeros(1, np.uint64), [Container()]

    def __len__(self) -> int:
        return sum(leaf.used for leaf in self.leaves)

    def add(self, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        if len(self.leaves) == 1 and len(high) > BURST:  # bursts on the way keep the first container small
            for a in range(0, len(high), BURST):
                self.add(high[a : a + BURST], low[a : a + BURST], n[a : a + BURST])
            return
        leaf = np.searchsorted(self.edges, high, "right") - 1
        order = np.argsort(leaf.astype(np.uint16) if len(self.leaves) < 1 << 16 else leaf, kind="stable")
        high, low, n, leaf = high[order], low[order], n[order], leaf[order]
        starts = np.flatnonzero(np.diff(leaf, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)]):
            self.leaves[leaf[a]].add(high[a:b], low[a:b], n[a:b])
        large = [k for k in np.unique(leaf).tolist() if self.leaves[k].used > BURST]
        for k in reversed(large):
            self.burst(k)

    def burst(self, k: int) -> None:
        """Leaf ``k`` in parts of about a quarter of ``BURST``; cut between first words, or second ones where it has but one."""
        high, low, n = self.leaves[k].items()
        order = np.argsort(high, kind="stable")
        high, low, n = high[order], low[order], n[order]
        first = high >> np.uint64(BITS)
        path = first if first[0] != first[-1] else high  # the words to cut between
        starts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        part = np.concatenate((starts // max(1, BURST // 4), [-1]))
        cuts = starts[np.flatnonzero(np.diff(part, prepend=-1))[:-1]] if len(starts) > 1 else starts
        # a word that fills parts by itself also ends where the next one starts
        big = np.flatnonzero(np.diff(np.append(starts, len(high))) > BURST // 4)
        cuts = np.unique(np.concatenate(([0], cuts, starts[big], starts[np.minimum(big + 1, len(starts) - 1)])))
        if len(cuts) == 1:
            return  # one pair of words: its container grows
        shift = np.uint64(BITS if path is first else 0)
        edges = path[cuts] << shift
        edges[0] = self.edges[k]
        made = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(high)]):
            made.append(Container())
            made[-1].add(high[a:b], low[a:b], n[a:b])
        self.edges = np.concatenate((self.edges[:k], edges, self.edges[k + 1 :]))
        self.leaves[k : k + 1] = made

    def spill(self, keep: int = 0):
        """The largest subtrees, whole, until ``keep`` entries are left; their entries, in order of the leaves."""
        total, gone = len(self), []
        for k in sorted(range(len(self.leaves)), key=lambda k: -self.leaves[k].used):
            if total <= keep:
                break
            total -= self.leaves[k].used
            gone.append(k)
        parts = [self.leaves[k].items() for k in sorted(gone)]
        for k in gone:
            self.leaves[k] = Container()
        return tuple(np.concatenate([p[j] for p in parts]) for j in range(3)) if parts else (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),)


def unpack(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """``(5, n)`` word ids, 0 behind a suffix's end."""
    mask, b = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    return np.stack([high >> b, high & mask, low >> (b + b), (low >> b) & mask, low & mask]).astype(np.uint32)


def prefix_parts(ids: np.ndarray, keys: np.ndarray, hot: int, parts: int) -> np.ndarray:
    """Partition of each suffix: by its words up to the first that isn't hot. Ids up to ``hot`` are hot words."""
    total, on = np.zeros(ids.shape[1], np.uint64), np.ones(ids.shape[1], bool)
    for k in range(LONGEST):
        total = np.where(on, mix(total * np.uint64(31) + keys[k]), total)
        on &= (ids[k] > 0) & (ids[k] <= hot)
    return (total % np.uint64(parts)).astype(np.int64)


def pack_run(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Entries as columns of bytes, compressed if there are many."""
    cells = np.empty((len(n), ENTRY), np.uint8)
    cells[:, : LONGEST * 3] = np.ascontiguousarray(ids.T).astype("<u4").view(np.uint8).reshape(len(n), LONGEST, 4)[:, :, :3].reshape(len(n), -1)
    cells[:, LONGEST * 3 :] = n.astype("<u4").view(np.uint8).reshape(len(n), 4)
    if len(n) < LONG_RUN:
        return cells.tobytes()
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(cells.T).tobytes(), asbytes=True)


def unpack_run(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size < LONG_RUN:
        cells = np.frombuffer(raw, np.uint8).reshape(size, ENTRY)
    else:
        cells = np.frombuffer(pa.Codec("zstd").decompress(raw, size * ENTRY), np.uint8).reshape(ENTRY, size).T
    wide = np.zeros((size, LONGEST, 4), np.uint8)
    wide[:, :, :3] = cells[:, : LONGEST * 3].reshape(size, LONGEST, 3)
    return wide.view("<u4")[:, :, 0].T, np.ascontiguousarray(cells[:, LONGEST * 3 :]).view("<u4")[:, 0].astype(np.int64)


class WordIds:
    """Ids of word hashes: 1 to ``len(listed)`` by the list, above that in order of appearance, until ``clear``."""

    def __init__(self, listed: np.ndarray, complete: bool):
        self.order = np.argsort(listed).astype(np.int64)
        self.sorted, self.listed, self.complete = listed[self.order], listed, complete
        self.clear()

    def clear(self) -> None:
        self.own: dict[int, int] = {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """0: can't be in a frequent phrase."""
        if not len(self.sorted):
            ids = np.zeros(len(keys), np.int64)
        else:
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            ids = np.where(self.sorted[at] == keys, self.order[at] + 1, 0)
        if not self.complete:
            other = np.flatnonzero(ids == 0)
            distinct, number = np.unique(keys[other], return_inverse=True)
            base = len(self.listed) + 1
            named = [self.own.setdefault(k, base + len(self.own)) for k in distinct.tolist()]
            ids[other] = np.array(named, np.int64)[number] if named else 0
        return ids

    def hashes(self) -> np.ndarray:
        """By id."""
        return np.concatenate((np.zeros(1, np.uint64), self.listed, np.fromiter(self.own, np.uint64, len(self.own))))


def suffixes(ids: np.ndarray, new: np.ndarray, longest: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of two words or more that start in the first ``own`` words, packed."""
    start = new.copy()
    start |= ids == 0
    start[1:] |= ids[:-1] == 0
    piece = np.cumsum(start)
    columns = [ids.astype(np.uint64)]
    for k in range(1, LONGEST):
        column = np.zeros(len(ids), np.uint64)
        if k < longest and len(ids) > k:
            same = piece[k:] == piece[:-k]
            column[:-k][same] = columns[0][k:][same]
        columns.append(column)
    some = np.flatnonzero(columns[1][:own])
    b = np.uint64(BITS)
    first, second, third, fourth, fifth = (c[some] for c in columns)
    return first << b | second, (third << b | fourth) << b | fifth


def runs(docs: DataFrame, listed: np.ndarray, complete: bool, hot: int, parts: int, longest: int) -> DataFrame:
    """``part, size, run, other``: sorted runs of counted suffixes; ``other`` has the hashes of a run's own ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(listed)
    schema = pa.schema([("part", pa.int64()), ("size", pa.int64()), ("run", pa.binary()), ("other", pa.binary())])

    def run(batches):
        names, trie = WordIds(shipped.value, complete), Trie()

        def spilled(keep):
            high, low, n = trie.spill(keep)
            ids, hashes = unpack(high, low), names.hashes()
            part = prefix_parts(ids, hashes[ids], hot, parts)
            order = np.lexsort((low, high, part))
            ids, n, part = ids[:, order], n[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            out = [[], [], [], []]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
                some, other = ids[:, a:b], b""
                if not complete:
                    base = len(names.listed) + 1
                    distinct, number = np.unique(some, return_inverse=True)
                    own = np.searchsorted(distinct, base)
                    other = hashes[distinct[own:]].tobytes()
                    distinct[own:] = base + np.arange(len(distinct) - own)
                    some = distinct[number.reshape(some.shape)]
                for column, value in zip(out, (int(part[a]), b - a, pack_run(some, n[a:b]), other)):
                    column.append(value)
            if keep == 0:
                names.clear()
            return table(schema, *out)

        for batch in batches:
            _, _, salts = salted(batch.column(1))
            for lo, hi, data, offsets in slices(batch.column(0)):
                _, _, _, key, new, _ = words_of(data, offsets, salts[lo:hi])
                for a in range(0, len(key), STEP):
                    if len(names.own) + STEP + longest > (1 << BITS) - len(listed) - 1:
                        yield spilled(0)  # ids would run out
                    part = slice(a, a + STEP + longest - 1)
                    high, low = suffixes(names(key[part]), new[part], longest, STEP)
                    trie.add(high, low, np.ones(len(high), np.int64))
                    if len(trie) > ENTRIES:
                        yield spilled(ENTRIES // 2)
        yield spilled(0)

    return docs.select("text", "lang").filter("text IS NOT NULL").mapInArrow(run, "part long, size long, run binary, other binary")


def merged(found: DataFrame, listed: np.ndarray, hot: int, least: int, longest: int) -> DataFrame:
    """``phrase, n``: word hashes of each phrase of 2 to ``longest`` words, and its count in all runs."""
    shipped = found.sparkSession.sparkContext.broadcast(listed)

    def run(group: pa.Table) -> pa.Table:
        base = len(shipped.value) + 1
        ids, n, others, shift = [], [], [], 0
        for size, raw, other in zip(group.column("size").to_pylist(), group.column("run"), group.column("other")):
            some, count = unpack_run(raw.as_buffer(), size)
            others.append(np.frombuffer(other.as_py(), np.uint64))
            ids.append(np.where(some >= base, some + np.uint32(shift), some))
            shift += len(others[-1])
            n.append(count)
        own, number = np.unique(np.concatenate(others), return_inverse=True)
        ids, n = np.concatenate(ids, axis=1), np.concatenate(n)
        if len(own):
            ids = np.where(ids >= base, base + number[np.maximum(ids, base) - base], ids)
        hashes = np.concatenate((np.zeros(1, np.uint64), shipped.value, own))
        bits = int(ids.max(initial=1)).bit_length()
        each = 64 // bits
        packed = []
        for a in range(0, LONGEST, each):
            key = np.zeros(len(n), np.uint64)
            for column in ids[a : a + each]:
                key = key << np.uint64(bits) | column.astype(np.uint64)
            packed.append(key)
        order = np.lexsort(packed[::-1])
        ids, n = ids[:, order], n[order]
        change = np.ones(len(n), bool)
        change[1:] = ids[0, 1:] != ids[0, :-1]
        split = (ids[0] > 0) & (ids[0] <= hot)  # so far only hot words: other partitions have the phrase too
        phrases, sizes, total = [], [], []
        for k in range(1, longest):
            change[1:] |= ids[k, 1:] != ids[k, :-1]
            split = split & (ids[k] > 0) & (ids[k] <= hot)
            starts = np.flatnonzero(change)
            count = np.add.reduceat(n, starts)
            keep = (ids[k, starts] > 0) & ((count >= least) | split[starts])
            phrases.append(hashes[ids[: k + 1, starts[keep]].T].reshape(-1))
            sizes.append(np.full(int(keep.sum()), k + 1))
            total.append(count[keep])
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        phrase = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(phrases))))
        return pa.table({"phrase": phrase, "n": pa.array(np.concatenate(total))})

    counted = found.groupBy("part").applyInArrow(run, "phrase array<long>, n long")
    return counted.groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, listed: int = LISTED) -> DataFrame:
    """``phrase, n`` of all phrases of 2 to ``longest`` words that occur ``least`` times; ``words`` as ``word_counts`` gives.

    To the driver come ``listed`` hashes at most, and three numbers.
    """
    if longest > LONGEST:
        raise ValueError(f"phrases have {LONGEST} words at most")
    total, common = words.agg(F.sum("n"), F.count_if(F.col("n") >= least)).first()
    total = total or 0
    top = words.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(listed).select("key", "n").toArrow()
    keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    hot = int(np.count_nonzero(n * HOT > total))
    parts = max(1, -(-total // GROUP))
    return merged(runs(docs, keys, len(keys) == common, hot, parts, longest), keys, hot, least, longest)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, longest: int = LONGEST, listed: int = LISTED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase of 2 to ``longest`` words has ``a`` occurrences, ``least`` or more; ``l`` and ``r`` are the occurrences of its
    parts at the cut where 1000 a n / (l r) is least. One that a longer phrase with ``share`` percent of its occurrences
    contains is left out. Words don't cross a piece's end (``.,;:!?`` and line breaks). A null text is empty, a null
    language ``und``; repeated rows count again, empty tables give no rows, further columns aren't looked at. Ties go to
    the larger ``a``, then to the phrase's bytes. All texts are read twice and counts are exact.
    """
    docs = docs.select("text", "lang")
    spark = docs.sparkSession
    place = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"

    def kept(frame, name):
        frame.write.parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    words = kept(word_counts(docs), "words")
    if words.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ValueError("two words share a hash")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.filter(F.col("n") >= least)
    found = kept(frequent(docs, words, least, longest, listed), "phrases").withColumnRenamed("n", "a")
    count = found.select("phrase", F.col("a").alias("f")).unionByName(common.select(F.array("key").alias("phrase"), F.col("n").alias("f")))
    part = lambda a, b: F.slice("phrase", a, b)
    size = F.size("phrase")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: part(at, n))))
    covers = found.filter(size > 2).select(F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("phrase").agg(F.max("longer").alias("longer"))
    left = found.join(covers, "phrase", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")

    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumn("front", part(1, F.col("k"))).withColumn("back", part(F.col("k") + 1, size))
    cuts = cuts.join(count.select(F.col("phrase").alias("front"), F.col("f").alias("l")), "front").join(count.select(F.col("phrase").alias("back"), F.col("f").alias("r")), "back")
    cuts = cuts.withColumn("key", F.col("phrase")[0]).join(common.select("key", "lang"), "key").join(totals, "lang")
    exact = F.expr("cast((cast(1000 * cast(a AS decimal(19,0)) AS decimal(22,0)) * cast(n AS decimal(16,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0))) AS long)")
    scored = cuts.withColumn("score", exact).groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r", "lang", "n", "a")).alias("m")).select("phrase", "m.*")

    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top)  # with ties
    text = near.select("phrase", F.posexplode("phrase").alias("at", "key")).join(common.select("key", "word"), "key")
    text = text.groupBy("phrase").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("text"))
    final = near.join(text, "phrase").drop("phrase").withColumnRenamed("text", "phrase")
    final = final.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return final.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
run AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM run GROUP BY lang),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM run),
word AS (SELECT lang, w[i:least(i + 4, len(w))] AS s FROM place),
grams AS (SELECT lang, s[1:k] AS ws, count(*) AS f FROM word, range(1, 6) t(k) WHERE k <= len(s) GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, ws, f AS a FROM grams WHERE len(ws) >= 2),
inside AS (
  SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS longer FROM cand, range(2, 5) t(m), range(1, 5) u(i) WHERE m < len(ws) AND i + m - 1 <= len(ws) GROUP BY ALL),
cut AS (
  SELECT c.lang, c.ws, c.a, k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cand c JOIN total t USING (lang) CROSS JOIN range(1, 5) t2(k)
  JOIN grams x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN grams y ON y.lang = c.lang AND y.ws = c.ws[k + 1:] WHERE k < len(c.ws)),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.ws = b.ws WHERE i.longer IS NULL OR i.longer < b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """``collocations`` of all ``documents``: the first 2000 of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Benchmark decontamination: every passage of every document is a query against a BM25 index of the test items.

The index holds, for each item and term, the term's share of the item's own BM25 score, so a score runs from 0 to 1
whatever the item. All items at or above ``threshold`` are retrieved, by block-max WAND: items stand in blocks of
``BLOCK_ITEMS``; a term's postings are its blocks in ascending order, each with the term's largest share in it (block-max),
and a term has the largest of these as its bound. A passage has a cursor in the postings of each of its terms. Cursors are
sorted by block, and the first block up to which the bounds of their terms reach the threshold is the pivot; cursors
before it skip to it, and only where the block-max shares at the pivot reach the threshold too are the block's items scored.
The steps of all passages of a slice are taken together in numpy.
What is retrieved is verified: enough of the word triples of the item's question and of its answer are in the passage.

Passages are two cells of as many tokens as the longest item has, and start at every cell, so each item that occurs lies
whole in one. The index is built by Spark in shards of at most about ``SHARD_ITEMS`` items and ``SHARD_POSTINGS`` postings,
of items of similar length. Shards stand as rows of a table in the shared folder; as many as ``PASS_BYTES`` hold are
broadcast at a time, and all passages are held against them.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusframe.llm.common import LOWER, cut, gram_hashes, hash_spans, shared_dir, slices, word_spans

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of the item's own score
QUESTION_SHARE = ANSWER_SHARE = 0.5  # of word triples
BLOCK_ITEMS = 4
SHARD_ITEMS, SHARD_POSTINGS = 20_000, 1 << 20
PASS_BYTES = 128 << 20  # of pickled parts of the index that one pass over the texts takes
SLACK = 1e-9  # of a bound, for sums that were rounded
#: tokens: letters and digits, any byte of a non-ASCII character
IS_TOKEN = np.zeros(256, bool)
IS_TOKEN[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, A-Z in lower case, and each text's first token."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_TOKEN)
    return hash_spans(data, starts, ends), first


def tokens_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tokens(raw, np.array([0, len(raw)]))[0]


def question_answer(text: str) -> tuple[str, str]:
    """Question and answer of an item: up to the last question mark and behind it; else the last sentence is the answer;
    else the last third of the words."""
    at = text.rfind("?")
    if 0 < at and tokens_of(text[at:]).size:
        return text[: at + 1], text[at + 1 :]
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if tokens_of(p).size]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) * 2 // 3)
    return " ".join(words[:cut]), " ".join(words[cut:]) or " ".join(words[:cut])


def triples(words: np.ndarray) -> np.ndarray:
    return np.unique(gram_hashes(words, min(3, max(1, len(words)))))


def index_rows(benchmark: DataFrame) -> DataFrame:
    """``item, item_id, text, length, terms: [(term, weight)], total`` with BM25 statistics over all items that have a token.

    Rows that repeat an id and text are one item; ``item`` is its hash, which stands for it while terms are counted.
    """

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = tokens_of(text or "")
                if len(words):
                    term, tf = np.unique(words, return_counts=True)
                    for column, value in zip(out, (ident, len(words), term.view(np.int64), tf)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["item", "length", "term", "tf"])

    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"])
    counted = cut(items.mapInArrow(run, "item long, length long, term array<long>, tf array<long>"))
    n_items, mean = counted.agg(F.count(F.lit(1)), F.avg("length")).first()
    terms = counted.select("item", "length", F.explode(F.arrays_zip("term", "tf")).alias("t")).select("item", "length", "t.term", "t.tf")
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n_items) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    weighed = terms.join(df, "term").withColumn("weight", weight).groupBy("item").agg(F.first("length").alias("length"), F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms"), F.sum("weight").alias("total"))
    return weighed.join(items, "item").select("item", "item_id", "text", "length", "terms", "total")


@dataclass
class Shard:
    """One part of the index, as arrays."""

    ids: list = field(default_factory=list)
    longest: int = 1
    vocabulary: np.ndarray = None  # sorted term hashes
    question: list = field(default_factory=list)  # triple hashes
    answer: list = field(default_factory=list)
    item_terms: list = field(default_factory=list)  # term numbers of each item and their shares
    item_shares: list = field(default_factory=list)
    blocks: int = 0
    post_first: np.ndarray = None  # first posting of each term
    post_key: np.ndarray = None  # term number times blocks plus block, ascending
    post_share: np.ndarray = None  # block-max
    bound: np.ndarray = None  # of each term, over all blocks

    @classmethod
    def build(cls, rows: list) -> Shard:
        rows = sorted(rows, key=lambda r: (r["length"], str(r["item_id"]), r["text"]))
        self = cls(ids=[r["item_id"] for r in rows], longest=max(r["length"] for r in rows))
        self.vocabulary = np.unique(np.array([t["term"] for r in rows for t in r["terms"]], np.int64).view(np.uint64))
        self.blocks = -(-len(rows) // BLOCK_ITEMS)
        keys = []
        for i, r in enumerate(rows):
            number = np.searchsorted(self.vocabulary, np.array([t["term"] for t in r["terms"]], np.int64).view(np.uint64))
            self.item_terms.append(number)
            self.item_shares.append(np.array([t["weight"] for t in r["terms"]]) / r["total"])
            keys.append(number * self.blocks + i // BLOCK_ITEMS)
            for part, text in zip((self.question, self.answer), question_answer(r["text"])):
                part.append(triples(tokens_of(text)))
        self.post_key, number = np.unique(np.concatenate(keys), return_inverse=True)
        self.post_share = np.zeros(len(self.post_key))
        np.maximum.at(self.post_share, number, np.concatenate(self.item_shares))
        self.post_first = np.searchsorted(self.post_key, np.arange(len(self.vocabulary) + 1) * self.blocks)
        self.bound = np.maximum.reduceat(self.post_share, self.post_first[:-1])
        return self

    def candidates(self, passage: np.ndarray, term: np.ndarray, threshold: float):
        """``(passage, block)`` where the sum of block-max shares reaches the threshold, by WAND.

        ``passage, term``: the distinct terms of each passage, in ascending order of passages. A cursor is an entry here.
        """
        threshold -= SLACK
        cursor = self.post_first[term]
        while len(passage):
            block = self.post_key[cursor] - term * self.blocks
            order = np.argsort(passage * self.blocks + block, kind="stable")  # cursors of each passage by their block
            passage, term, cursor, block = passage[order], term[order], cursor[order], block[order]
            edge = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
            number = np.repeat(np.arange(len(edge)), np.diff(np.concatenate((edge, [len(passage)]))))
            reach = np.cumsum(self.bound[term])
            reach -= np.concatenate(([0.0], reach))[edge][number]  # sum of bounds up to each cursor
            far = np.flatnonzero(reach >= threshold)
            first = np.full(len(edge), len(passage))
            np.minimum.at(first, number[far], far)
            alive = first < len(passage)  # a passage without a pivot is done
            pivot = np.where(alive, block[np.minimum(first, len(passage) - 1)], 0)
            keep = alive[number]
            passage, term, cursor, block, number = passage[keep], term[keep], cursor[keep], block[keep], number[keep]
            target = pivot[number]
            behind = np.flatnonzero(block < target)  # these skip to the pivot or behind it
            cursor[behind] = np.searchsorted(self.post_key, term[behind] * self.blocks + target[behind])
            inside = cursor < self.post_first[term + 1]
            passage, term, cursor, number, target = passage[inside], term[inside], cursor[inside], number[inside], target[inside]
            at = self.post_key[cursor] - term * self.blocks == target
            share = np.bincount(number[at], self.post_share[cursor[at]], len(edge))
            found = share >= threshold
            if found.any():
                named = np.zeros(len(edge), np.int64)
                named[number] = passage
                yield from zip(named[found].tolist(), pivot[found].tolist())
            cursor = cursor + at  # on from the pivot
            inside = cursor < self.post_first[term + 1]
            passage, term, cursor = passage[inside], term[inside], cursor[inside]

    def search(self, words: np.ndarray, first: np.ndarray, threshold: float):
        """``(text, first token of the passage, item, score, question share, answer share)`` of all verified matches in
        ``tokens`` of some texts."""
        if not len(words):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == words)
        cells = -(-np.diff(first) // self.longest)
        count = np.maximum(cells - 1, np.minimum(cells, 1))  # passages of each text
        passage_first = np.concatenate(([0], np.cumsum(count)))
        text = np.searchsorted(first, known, "right") - 1
        cell = (known - first[text]) // self.longest
        inside = [cell < count[text], cell > 0]  # a token is in the passages of its cell and of the one before
        size = len(self.vocabulary)
        pairs = np.unique(np.concatenate([(passage_first[text[i]] + cell[i] - back) * size + at[known[i]] for back, i in enumerate(inside)]))
        passage, term = pairs // size, pairs % size
        most = np.bincount(passage, self.bound[term], int(passage_first[-1]))
        some = most[passage] >= threshold - SLACK
        present = np.zeros(size, bool)
        for p, block in self.candidates(passage[some], term[some], threshold):
            i = int(np.searchsorted(passage_first, p, "right")) - 1
            a = int(first[i] + (p - passage_first[i]) * self.longest)
            part = words[a : min(a + 2 * self.longest, int(first[i + 1]))]
            numbers, grams = at[a : a + len(part)], None
            numbers = numbers[self.vocabulary[numbers] == part]
            present[numbers] = True
            for item in range(block * BLOCK_ITEMS, min((block + 1) * BLOCK_ITEMS, len(self.ids))):
                score = float(self.item_shares[item][present[self.item_terms[item]]].sum())
                if score < threshold:
                    continue
                if grams is None:
                    grams = [gram_hashes(part, k) for k in (1, 2, 3)]  # a part of under three words is one gram
                shares = [max(float(np.isin(want[item], g).mean()) for g in grams) for want in (self.question, self.answer)]
                if shares[0] >= QUESTION_SHARE and shares[1] >= ANSWER_SHARE:
                    yield i, a - int(first[i]), item, score, *shares
            present[numbers] = False


def index(benchmark: DataFrame) -> DataFrame:
    """``class, part, shard``: the index in parts, built in tasks.

    Lengths in a class differ by a factor of 4 at most. To the driver come two numbers of each class.
    """
    level = F.floor(F.log(F.greatest(F.lit(1.0), (F.col("length") - 1) / 64.0)) / math.log(4)).cast("int")
    rows = cut(index_rows(benchmark).withColumn("class", level))
    sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("postings")).collect()
    parts = [F.when(F.col("class") == s["class"], max(-(-s["n"] // SHARD_ITEMS), -(-s["postings"] // SHARD_POSTINGS))) for s in sizes]

    def build(rows: pa.Table) -> pa.Table:
        shard = Shard.build(rows.select(["item_id", "text", "length", "terms", "total"]).to_pylist())
        return pa.table({"class": rows["class"][:1], "part": rows["part"][:1], "shard": pa.array([pickle.dumps(shard)], pa.binary())})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.coalesce(*parts, F.lit(1))).cast("int"))
    return cut(dealt.groupBy("class", "part").applyInArrow(build, "class int, part int, shard binary"))


def shards(benchmark: DataFrame):
    """The parts of the index that one pass over the texts takes, broadcast while they are in use, and whether they are the
    last. A pass takes as many parts as have ``PASS_BYTES`` together, and one at least."""
    table = index(benchmark)
    names = table.select("class", "part", F.length("shard").alias("size")).orderBy("class", "part").collect()  # a row for each SHARD_ITEMS items
    passes, room = [], 0
    for n in names:
        if n["size"] > room:
            passes.append([])
            room = PASS_BYTES
        passes[-1].append((n["class"], n["part"]))
        room -= n["size"]
    context = benchmark.sparkSession.sparkContext
    for k, some in enumerate(passes):
        wanted = F.struct("class", "part").isin([F.struct(F.lit(a).alias("class"), F.lit(b).alias("part")) for a, b in some])
        got = table.filter(wanted).orderBy("class", "part").select("shard").collect()
        yield k + 1 == len(passes), context.broadcast([bytes(r[0]) for r in got])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, question_share, answer_share, first_token``: the best passage for each leaked item.

    Whole texts are searched. Null and empty texts, and items without a letter or digit, match nothing. Repeated rows
    give one row; a null doc_id is an id like others here, and so is a null item_id; ids of any type stay exact. Empty tables give no rows; further
    columns are not looked at. What each part of the index finds is written to the shared folder before the next.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    names = ["doc_id", "item_id", "score", "question_share", "answer_share", "first_token"]
    schema = f"{kinds}, score double, question_share double, answer_share double, first_token long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out, place = None, f"{shared_dir(spark)}/leaks-{uuid.uuid4().hex}"
    for last, shipped in shards(benchmark):

        def run(batches, shipped=shipped):
            parts = [pickle.loads(raw) for raw in shipped.value]
            for batch in batches:
                for lo, _, data, offsets in slices(batch.column(1)):
                    words = tokens(data, offsets)
                    found = [(text, token, shard.ids[item], *rest) for shard in parts for text, token, item, *rest in shard.search(*words, threshold)]
                    if found:
                        text, token, ids, score, q, a = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + t for t in text])), pa.array(ids, item_type), *[pa.array(np.round(v, 4), pa.float64()) for v in (score, q, a)], pa.array(token, pa.int64())], names)

        part = docs.mapInArrow(run, schema)
        if last:
            out = part if out is None else spark.read.schema(schema).parquet(place).unionByName(part)
        else:
            part.write.mode("append").parquet(place)
            shipped.unpersist()
            out = docs
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "question_share", "answer_share", (-F.col("first_token")).alias("back"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.score", "m.question_share", "m.answer_share", (-F.col("m.back")).alias("first_token"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, all columns as they were; see ``leaks`` for odd rows, all of which stay
    here. Nothing is shuffled. With several parts of the index, what one has left is cut before the next."""
    for last, shipped in shards(benchmark):

        def run(batches, shipped=shipped):
            parts = [pickle.loads(raw) for raw in shipped.value]
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in slices(batch.column("text")):
                    words = tokens(data, offsets)
                    for shard in parts:
                        for hit in shard.search(*words, threshold):
                            keep[lo + hit[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = cut(docs)
            shipped.unpersist()
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """``leaks`` of all items of ``benchmark`` in all ``documents``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

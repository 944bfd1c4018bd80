"""Mixing sources to target weights.

Words of each source are packed, in a fixed order, into blocks of ``BLOCK`` words. Every source gets a number of
block slots in proportion to its target. The slots are spread over output shards by multinomial draws conditioned on
those totals (each shard draws from what is left), so totals come out exactly. The k-th slot of a source takes the
block at the k-th place of a pseudorandom permutation of the source's block indices; slots and blocks meet in an
equi-join on (source, block).

Skew: a source may hold a third of all rows. Word offsets are therefore running sums within (source, salt), and only
the totals of those parts are summed per source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import cut, word_count

BLOCK = 256
SHARD_SLOTS = 4096
CAP = 3  # times a source's size that its target may reach
SALTED_ROWS = 4096  # rows of a (source, salt) part, about
SEED = 20
#: A source's rank decides its weight; all sources' counts are needed together to share out the excess. They are
#: brought to the driver only up to this number, which bounds what tasks get with the job.
MAX_SOURCES = 100_000


def targets(sizes: list[float], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``cap`` times its size and the excess goes to the others by weight."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def draw(rng: np.random.Generator, quota: np.ndarray, n: int) -> np.ndarray:
    """``n`` draws by multinomial from what is left of each quota, never more than is left."""
    left, out = quota.copy(), np.zeros_like(quota)
    while n > 0:
        got = np.minimum(rng.multinomial(n, left / left.sum()), left)
        out += got
        left -= got
        n -= int(got.sum())
    return out


def shard_counts(shard: int, shards: int, quota: np.ndarray, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard, and in all shards before it.

    The range of shards is halved again and again; each half draws its slots from its parent's, seeded by its place in
    the tree. So any shard is computed alone, in log(shards) draws, and all agree.
    """
    lo, hi, before = 0, shards, np.zeros_like(quota)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = min(mid * SHARD_SLOTS, slots) - min(lo * SHARD_SLOTS, slots)
        left = draw(np.random.default_rng([seed, lo, hi]), quota, n)
        if shard < mid:
            quota, hi = left, mid
        else:
            before, quota, lo = before + left, quota - left, mid
    return quota, before


def permute(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place ``k`` of a pseudorandom permutation of ``range(n)``: a four-round Feistel network, walked until inside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & (2**64 - 1))
            f = (b + key) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[todo] = x = a << np.uint64(half) | b
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("order_hash", F.xxhash64("source", "text", *[c for c in ("lang", "n_chars") if c in docs.columns]))


def place(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[dict]]:
    """Documents with ``size, source_no, offset`` (words before theirs in their source), and the table of sources.

    The order within a source is by salt, then doc_id, then a hash of the row, so equal rows may change places freely.
    """
    sized = docs if "size" in docs.columns else with_size(docs)
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(SALTED_ROWS)))
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).withColumn("salts", salts.cast("int")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: group them first")
    # code point order: Python compares str by code point; null last
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [1 + i % 3 for i in range(len(sources))]
    goal = targets([r["words"] for r in sources], weights, sum(r["words"] for r in sources))
    table = [{"source": r["source"], "source_no": i, "n": r["n"], "source_size": r["words"], "target": goal[i], "salts": r["salts"]} for i, r in enumerate(sources)]
    spark = docs.sparkSession
    small = spark.createDataFrame([(t["source"], t["source_no"], t["source_size"], t["target"], t["salts"]) for t in table], "source_key string, source_no int, source_size long, target double, salts int")
    known = sized.join(F.broadcast(small), sized["source"].eqNullSafe(small["source_key"])).drop("source_key")
    known = known.withColumn("salt", F.pmod(F.xxhash64("doc_id", "order_hash"), F.col("salts")).cast("int"))
    part = Window.partitionBy("source_no", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "order_hash")
    known = known.withColumn("within", F.sum("size").over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    return known, table


def place_offsets(known: DataFrame) -> DataFrame:
    """Adds ``offset``: words of the source before the document. The parts' totals are few: rows / SALTED_ROWS."""
    totals = known.groupBy("source_no", "salt").agg(F.sum("size").alias("part_words"))
    run = Window.partitionBy("source_no").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("part_offset", F.sum("part_words").over(run) - F.col("part_words")).drop("part_words")
    return known.join(totals.hint("merge"), ["source_no", "salt"]).withColumn("offset", F.col("part_offset") + F.col("within")).drop("part_offset", "within", "salt", "salts")


def slot_uses(spark, table: list[dict], block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``source_no, block_no, uses``: how many of all output slots take each block."""
    words = np.array([t["source_size"] for t in table], np.int64)
    blocks = -(-words // block)
    quota = np.array([round(t["target"] * int(b) / t["source_size"]) if t["source_size"] else 0 for t, b in zip(table, blocks)], np.int64)
    slots = int(quota.sum())
    shards = max(1, -(-slots // SHARD_SLOTS))

    def run(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                counts, before = shard_counts(int(shard), shards, quota, slots, seed)
                for s in np.flatnonzero(counts):
                    k = np.arange(before[s], before[s] + counts[s])
                    got = np.empty(len(k), np.int64)
                    for epoch in np.unique(k // blocks[s]):
                        now = k // blocks[s] == epoch
                        got[now] = permute(k[now] % blocks[s], int(blocks[s]), seed * 1_000_003 + int(s) * 101 + int(epoch))
                    at, n = np.unique(got, return_counts=True)
                    yield pd.DataFrame({"source_no": np.full(len(at), s, np.int32), "block_no": at, "n": n.astype(np.int64)})

    drawn = spark.range(0, shards, 1, min(shards, 10_000)).mapInPandas(run, "source_no int, block_no long, n long")
    return drawn.groupBy("source_no", "block_no").agg(F.sum("n").alias("uses"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Documents with ``size, source_size, target, offset, pieces``; a piece is (first word, words, uses).

    First words are counted within the document. Pieces that no slot takes are left out; a document of no words, or
    with none taken, has an empty list. Rows that repeat stay apart. Null text has size 0; null source is a source.
    """
    known, table = place(docs, block)
    known = place_offsets(known)
    if not table:
        return known.withColumn("pieces", F.array().cast("array<struct<first:long,words:long,uses:long>>"))
    last = F.greatest(F.col("offset"), F.col("offset") + F.col("size") - 1)
    spans = known.select("source_no", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor(last / block))).alias("block_no")).filter("size > 0")
    start = F.greatest(F.col("offset"), F.col("block_no") * block)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block_no") + 1) * block)
    uses = slot_uses(docs.sparkSession, table, block, seed)
    # both sides grow with the corpus: never broadcast, however well they compress
    taken = spans.join(uses.hint("merge"), ["source_no", "block_no"]).select("source_no", "offset", F.struct((start - F.col("offset")).alias("first"), (end - start).alias("words"), F.col("uses").alias("uses")).alias("piece"))
    # (source_no, offset) names a document of at least one word
    taken = taken.groupBy("source_no", "offset").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    empty = F.array().cast("array<struct<first:long,words:long,uses:long>>")
    out = known.join(taken.hint("merge"), ["source_no", "offset"], "left")
    return out.withColumn("pieces", F.when((F.col("size") > 0) & F.col("pieces").isNotNull(), F.col("pieces")).otherwise(empty))


def taken_words():
    return F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"] * p["uses"])


def mix_table(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``documents``; see ``mix`` for odd rows."""
    # texts are read once; what is kept of them is a size and a hash
    sized = cut(with_size(docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))).drop("text"))
    return mix(sized, block, seed).select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixture as documents: copy c of a document holds the pieces that at least c slots take.

    A document that no slot takes goes; one whose pieces are all taken twice comes twice. Pieces are cut from the text as it
    stands, each with the white space behind it (and in front of the first word), so lines and spacing stay. Null and
    empty texts have no words and go. Null ids and sources are values like others; equal rows count as often as they come.
    """
    kept = ["doc_id", "text", "lang", "source", "n_chars"]
    sized = with_size(docs.select(*kept))
    mixed = mix(cut(sized.select("doc_id", "source", "size", "order_hash")), block, seed)
    most = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: F.greatest(a, p["uses"]))
    mixed = mixed.select(F.col("doc_id").alias("id"), F.col("order_hash").alias("hash"), "pieces", most.alias("most")).filter("most > 0")
    # texts move once, to the pieces of their document; rows that are equal in all columns share one text
    texts = sized.groupBy("doc_id", "order_hash").agg(F.any_value(F.struct("text", "lang", "source")).alias("d"))
    joined = texts.join(mixed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("order_hash") == F.col("hash")))
    joined = joined.withColumn("all_words", F.regexp_extract_all("d.text", F.lit(r"((?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)))

    def copy(number):
        chosen = F.transform(F.filter("pieces", lambda p: p["uses"] >= number), lambda p: F.slice("all_words", (p["first"] + 1).cast("int"), p["words"].cast("int")))
        return F.array_join(F.flatten(chosen), "")

    text = F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("most")), copy)).alias("text")
    return joined.select("doc_id", text, "d.lang", "d.source").withColumn("n_chars", F.length("text").cast("long")).select(*kept)


def op7_mix(spark, sf_dir: str) -> DataFrame:
    """``mix_table`` of all ``documents``."""
    return mix_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))

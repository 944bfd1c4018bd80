"""Importance resampling towards a target: word n-grams in hashed buckets, whose CRCs come from prefix CRCs.

A document is taken in its separator-normalised form: its words in lower case, one space between them. It is scanned once
and the running CRC at every byte kept. The CRC-32 of any stretch then follows from the two prefixes at its ends: the CRC
of the front one is shifted over the stretch, which is a linear map over GF(2), and cancelled from the other. So n-grams
of every length cost two look-ups and one shift each, however long they are.

The scan runs over all bytes of a slice in numpy: blocks of ``BLOCK`` bytes are lanes that advance together, and block
starts are then carried forward by doubling, with shifts over 1, 2, 4 ... blocks. Shifts are tables for each byte of a CRC.

Two scans of the texts are made: one counts buckets (rows of ``BUCKETS`` at most from each task), one weighs documents with
the gains of the buckets. Texts don't move, and only narrow rows are kept. Scores are whole numbers within ``MOST`` of
zero, so their counts fit a small table, from which ranks start; only documents near the top are sorted.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import LOWER, shared_dir, slices, word_spans

BUCKETS, SHORTEST, LONGEST = 10_000, 1, 1  # n-grams of so many words
SEED, PERCENT, MIN_WORDS = "2024", 10, 20
BLOCK = 64  # bytes of a lane
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected
#: Gains are below 1000 ln(2^128), noise is between -3,131 and 22,877: a bound of all scores.
MOST = 120_000
COARSE = 512  # scores that share a partition of the running sums
#: words: letters and digits after lower-casing, and any byte of a non-ASCII character
IS_WORD = np.zeros(256, bool)
IS_WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


@functools.cache
def byte_table() -> np.ndarray:
    """A CRC's low byte to what eight shifts make of it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of CRCs, given as a table for each of their bytes: ``(4, 256)``."""
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def zero_byte() -> np.ndarray:
    """The map that a zero byte makes of a CRC: a shift by eight."""
    each = np.arange(256, dtype=np.uint32)
    return np.stack([byte_table(), *[np.left_shift(each, 8 * (k - 1)) for k in (1, 2, 3)]]).astype(np.uint32)


@functools.cache
def short_shifts() -> np.ndarray:
    """Shifts over 0 to ``BLOCK`` bytes."""
    each = np.arange(256, dtype=np.uint32)
    out = [np.stack([np.left_shift(each, 8 * k) for k in range(4)])]
    for _ in range(BLOCK):
        out.append(apply(zero_byte(), out[-1]))
    return np.stack(out)


@functools.cache
def long_shift(k: int) -> np.ndarray:
    """The shift over ``2 ** k`` blocks."""
    if k == 0:
        return short_shifts()[BLOCK]
    half = long_shift(k - 1)
    return apply(half, half)


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as ``size`` says."""
    part, whole = size % BLOCK, size // BLOCK
    tables = short_shifts()
    out = tables[part, 0, crc & 255] ^ tables[part, 1, (crc >> 8) & 255] ^ tables[part, 2, (crc >> 16) & 255] ^ tables[part, 3, crc >> 24]
    for k in range(int(whole.max(initial=0)).bit_length()):
        on = np.flatnonzero((whole >> k) & 1)
        out[on] = apply(long_shift(k), out[on])
    return out


def prefix_crcs(data: np.ndarray) -> np.ndarray:
    """Running CRCs, from zero and without the final complement, in front of every byte and behind the last."""
    n = len(data)
    lanes = -(-n // BLOCK) or 1
    padded = np.zeros(lanes * BLOCK, np.uint8)
    padded[:n] = data
    padded = padded.reshape(lanes, BLOCK)
    table, state = byte_table(), np.zeros(lanes, np.uint32)
    local = np.empty((lanes, BLOCK), np.uint32)
    for k in range(BLOCK):
        state = table[(state ^ padded[:, k]) & 255] ^ (state >> 8)
        local[:, k] = state
    ends = local[:, -1].copy()  # of everything up to each block's end, after the doubling
    for k in range((lanes - 1).bit_length()):
        ends[1 << k :] ^= apply(long_shift(k), ends[: -(1 << k)])
    for k in range(BLOCK):
        local[1:, k] ^= apply(short_shifts()[k + 1], ends[:-1])
    return np.concatenate((np.zeros(1, np.uint32), local.reshape(-1)[:n]))


def span_crcs(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch: the front prefix is shifted over it and cancelled; then the usual start and complement."""
    ones = np.uint32(0xFFFFFFFF)
    return prefix[ends] ^ shifted(prefix[starts] ^ ones, ends - starts) ^ ones


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text in lower case with a space behind each; start and end of every word there; first words."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens + 1)))[:-1]
    flat = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[at + lens] = False
    flat[inside] = data[IS_WORD[data]]
    return flat, at, at + lens, first


def features(data: np.ndarray, offsets: np.ndarray, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each n-gram, and the words of each text."""
    flat, starts, ends, first = normalised(data, offsets)
    prefix = prefix_crcs(flat)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, found = [], []
    for n in range(shortest, longest + 1):
        at = np.arange(len(starts) - n + 1)
        at = at[text[at] == text[at + n - 1]] if len(at) else at
        rows.append(text[at])
        found.append(span_crcs(prefix, starts[at], ends[at + n - 1]).astype(np.int64) % buckets)
    return np.concatenate(rows), np.concatenate(found), np.diff(first)


def bucket_counts(texts: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: the n-grams of all whole texts (null: none) in each bucket that has some."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), 1 << 20):
                n += np.bincount(features(data, offsets, shortest, longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket 1000 times the logarithm of its share in the target against its share here, one added to each count."""
    n = np.zeros((2, buckets), np.int64)
    for k, texts in enumerate((docs, target)):
        got = bucket_counts(texts, shortest, longest, buckets).toArrow()  # ``buckets`` rows at most
        n[k, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    here, there = n.astype(float)
    return np.floor(1000 * np.log((there + 1) * (here.sum() + buckets) / ((here + 1) * (there.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """A Gumbel variable of the id, in thousandths; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains of a document's n-grams."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shipped.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), 1 << 20):
                text, bucket, words = features(data, offsets, shortest, longest, len(gain))
                n = np.bincount(text, minlength=hi - lo)
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, text, gain[bucket])
                arrays = (words, n, total // np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(a, pa.int64()) for a in arrays]], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` (with ``score`` and ``fits``) and ``rank``: the place of the best ``percent`` of the rows that fit.

    Scores lie within ``MOST``, so ``tally`` has 240,000 rows at most, whatever the input. Ranks inside one score go by
    doc_id; noise comes from a hash of it, so no score holds more than a small part of all documents.
    """
    tally = scored.filter("fits").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.floor(F.col("score") / COARSE))
    level = tally.groupBy("level").agg(F.sum("n").alias("n"))  # 500 rows at most
    before = level.withColumn("above", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("level"))) - F.col("n"))
    total = level.agg(F.floor(F.sum("n") * percent / 100).alias("drawn"))
    inner = F.sum("n").over(Window.partitionBy("level").orderBy(F.desc("score"))) - F.col("n")
    offset = tally.withColumn("inner", inner).join(F.broadcast(before.select("level", "above")), "level").join(F.broadcast(total))
    offset = offset.select("score", (F.col("inner") + F.col("above")).alias("offset"), "drawn").filter("offset < drawn")
    near = scored.filter("fits").join(F.broadcast(offset), "score")
    place = F.col("offset") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    near = near.withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))).select(*scored.columns, "rank")
    rest = scored.join(F.broadcast(offset.withColumn("fits", F.lit(True)).select("score", "fits")), ["score", "fits"], "left_anti")
    return near.unionByName(rest.select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where a row isn't drawn.

    Drawn without replacement in proportion to the weights' exponentials, by Gumbel noise of the id; ties go to the smaller
    id, null last. Of rows that repeat an id each is a document of its own. Null and empty texts have no n-gram and weigh
    0; documents under ``min_words`` words are never drawn. Empty tables give no rows, an empty target weighs by rarity in
    ``docs`` alone. Columns besides ``doc_id`` and ``text`` aren't looked at.
    """
    gain = gains(docs, target, shortest, longest, buckets)
    scored = weights(docs, gain, shortest, longest).select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("fits"))
    place = f"{shared_dir(docs.sparkSession)}/scores-{uuid.uuid4().hex}"
    scored.write.parquet(place)  # narrow; read three times, and texts are not scanned again
    return ranked(docs.sparkSession.read.parquet(place), percent).drop("fits").select("doc_id", "n_features", "weight", "score", "rank")


#: ``crc`` has a row for each distinct word and byte of it; a byte's table entry is eight shifts, as in ``byte_table``.
ORACLE_SQL = r"""
WITH RECURSIVE table8(b, k, c) AS (
  SELECT range::UINTEGER, 0, range::UINTEGER FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM table8 WHERE k < 8),
entry AS (SELECT b, c FROM table8 WHERE k = 8),
low AS (
  SELECT 0 AS target, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
word AS (SELECT target, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low),
crc(w, h, i, c) AS (
  SELECT w, hex(w), 0, 4294967295::UINTEGER FROM (SELECT DISTINCT w FROM word)
  UNION ALL
  SELECT w, h, i + 1, xor(entry.c, crc.c >> 8) FROM crc JOIN entry ON entry.b = xor(crc.c & 255, ('0x' || substr(h, 2 * i + 1, 2))::UINTEGER) WHERE 2 * i < length(h)),
hashed AS (SELECT w, xor(c, 4294967295::UINTEGER) % 10000 AS bucket FROM crc WHERE 2 * i = length(h)),
counted AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM word JOIN hashed USING (w) GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counted),
gain AS (SELECT bucket, floor(1000 * ln((c.t + 1.0::DOUBLE) * (total.s + 10000) / ((c.s + 1.0::DOUBLE) * (total.t + 10000))))::BIGINT AS g FROM counted c, total),
weighed AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM word JOIN hashed USING (w) JOIN gain USING (bucket) WHERE target = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::UINTEGER::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM drawn) THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""


def op11_importance(spark, sf_dir: str) -> DataFrame:
    """``resample`` of all ``documents`` towards ``benchmark``: single words, 10,000 buckets, 10 % of documents of 20 words."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of ``WIDTH`` bytes slide over the whole text, each filter's answers are max-pooled within
overlapping chunks, and the chunks are combined (largest and mean answer of each filter) into one probability.

The network is fitted in one task on a bounded sample of labelled texts: ``SAMPLE_ROWS`` rows in the order of a hash,
as far as ``SAMPLE_BYTES`` go, each text whole. Scoring is per row, without a shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import slices

STRIDE, TAPS, DIM, FILTERS = 2, 4, 8, 16
WIDTH = STRIDE * TAPS
CELL = 128  # filter places in half a chunk: chunks are two cells and overlap by one
PIECE_CELLS = 256  # cells whose answers are held at once (64 KB of text); only their maxima stay
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 12 << 20
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 8
PIECES = 0.25  # share of good texts shown as a piece
THRESHOLD = 0.7


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in whole cells, filled up with zero bytes; the first cell and the cells of each text."""
    sizes = np.diff(offsets)
    places = -(-sizes // STRIDE)
    places = np.maximum(places, 1)
    cells = -(-places // CELL)
    first = np.concatenate(([0], np.cumsum(cells)))
    padded = np.zeros((first[-1] * CELL + TAPS) * STRIDE, np.uint8)
    for k, at in enumerate(first[:-1] * CELL * STRIDE):
        padded[at : at + sizes[k]] = data[offsets[k] : offsets[k + 1]]
    return padded, first[:-1], cells


class Network:
    def __init__(self, parameters: dict | None = None):
        rng = np.random.default_rng(SEED)
        self.p = parameters or {
            "embed": rng.normal(0, 0.5, (257, DIM)).astype(np.float32),
            "conv": rng.normal(0, (WIDTH * DIM) ** -0.5, (TAPS, STRIDE * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def pooled(self, padded: np.ndarray, first: np.ndarray, counts: np.ndarray, argmax: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest answer of each filter in each cell, not below zero, and where it stands. What a filter reaches behind a
        text's last cell counts as zero bytes: the next text is none of its.

        Answers take some 200 bytes for each byte of text, so they are made for ``PIECE_CELLS`` cells at a time.
        """
        table = self.p["embed"][:256].copy()
        table[0] = 0
        conv = self.p["conv"].transpose(1, 0, 2).reshape(STRIDE * DIM, TAPS * FILTERS)
        cells, last = int(counts.sum()), first + counts - 1
        most = np.empty((cells, FILTERS), conv.dtype)
        where = np.empty((cells, FILTERS), np.uint8) if argmax else None
        for lo in range(0, cells, PIECE_CELLS):
            hi = min(lo + PIECE_CELLS, cells)
            n = (hi - lo) * CELL
            part = padded[lo * CELL * STRIDE : (hi * CELL + TAPS) * STRIDE]
            y = table[part].reshape(-1, STRIDE * DIM) @ conv
            z = y[:n, :FILTERS] + self.p["bias"]
            stop = (last[slice(*np.searchsorted(last, (lo, hi)))] - lo + 1) * CELL
            for j in range(1, TAPS):
                out = (stop[:, None] - np.arange(1, j + 1)).ravel()
                without = z[out]
                z += y[j : j + n, j * FILTERS : (j + 1) * FILTERS]
                z[out] = without
            z = z.reshape(hi - lo, CELL, FILTERS)
            most[lo:hi] = np.maximum(z.max(1), 0)
            if argmax:
                where[lo:hi] = z.argmax(1)
        return most, where

    def combine(self, cell: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of each text, and for each chunk the cell its answer comes from."""
        index = np.arange(len(cell), dtype=np.int32)
        last = np.zeros(len(cell), bool)
        last[first + counts - 1] = True
        follow = np.where(last, index, index + 1)
        use = np.where(cell >= cell[follow], index[:, None], follow[:, None])  # chunk k is cells k and k + 1
        chunk = np.take_along_axis(cell, use, 0)
        most = np.maximum.reduceat(chunk, first, 0)
        mean = np.add.reduceat(chunk, first, 0) / counts[:, None]
        return np.concatenate((most, mean), 1), use, chunk

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        padded, first, counts = layout(data, offsets)
        cell, _ = self.pooled(padded, first, counts)
        features, _, _ = self.combine(cell, first, counts)
        logit = features @ self.p["out"] + self.p["out_bias"]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def gradient(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
        padded, first, counts = layout(data, offsets)
        cell, where = self.pooled(padded, first, counts, True)
        features, use, chunk = self.combine(cell, first, counts)
        p = 1 / (1 + np.exp(-np.clip(features @ self.p["out"] + self.p["out_bias"], -30, 30)))
        d = ((p - labels) * weights / len(labels)).astype(np.float32)
        g = {"out": features.T @ d + 1e-4 * self.p["out"], "out_bias": np.array([d.sum()], np.float32)}
        df = d[:, None] * self.p["out"]
        doc = np.repeat(np.arange(len(counts)), counts)
        dchunk = df[doc, FILTERS:] / counts[doc][:, None]
        is_most = chunk == features[doc, :FILTERS]
        seen = np.add.reduceat(is_most.astype(np.float32), first, 0)
        dchunk += np.where(is_most, df[doc, :FILTERS] / seen[doc], 0)
        dcell = np.zeros_like(cell)
        np.add.at(dcell, (use, np.arange(FILTERS)[None, :]), dchunk)
        dcell[cell <= 0] = 0
        at, f = np.nonzero(dcell)
        v = dcell[at, f]
        byte = (at * CELL + where[at, f])[:, None] * STRIDE + np.arange(WIDTH)
        codes = np.where(byte < ((first + counts)[doc[at]] * CELL * STRIDE)[:, None], padded[byte], 0)
        vectors = self.p["embed"][codes] * (codes > 0)[:, :, None]
        conv = self.p["conv"].transpose(2, 0, 1).reshape(FILTERS, WIDTH, DIM)
        gconv = np.zeros_like(conv)
        np.add.at(gconv, f, vectors * v[:, None, None])
        g["conv"] = gconv.reshape(FILTERS, TAPS, STRIDE * DIM).transpose(1, 2, 0)
        g["bias"] = np.bincount(f, v, FILTERS).astype(np.float32)
        back = conv[f] * v[:, None, None]
        g["embed"] = np.stack([np.bincount(codes.ravel(), back[:, :, k].ravel(), 257) for k in range(DIM)], 1).astype(np.float32)
        g["embed"][0] = 0
        return g


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> Network:
    """Adam on the log loss, both classes weighing the same in total. Without both classes the score is constant.

    Good texts are now and then shown as a short piece of themselves, so that shortness alone counts for nothing.
    """
    net, y = Network(), np.array(labels, np.float32)
    n, ones = len(y), float(y.sum()) if len(labels) else 0.0
    if not 0 < ones < n:
        net.p["out_bias"][:] = np.log((ones + 1) / (n - ones + 1)) if n else 0
        return net
    weight = np.where(y == 1, n / 2 / ones, n / 2 / (n - ones)).astype(np.float32)
    rng = np.random.default_rng(SEED)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-n // BATCH)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo : lo + BATCH]
            parts = [texts[i] for i in pick]
            for k in np.flatnonzero((y[pick] == 1) & (rng.random(len(pick)) < PIECES)):
                size = int(rng.integers(8, 256))
                at = int(rng.integers(0, max(1, len(parts[k]) - size)))
                parts[k] = parts[k][at : at + size]
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in parts]))).astype(np.int64)
            g = net.gradient(np.frombuffer(b"".join(parts), np.uint8), offsets, y[pick], weight[pick])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for k, grad in g.items():
                m[k] += 0.1 * (grad - m[k])
                s[k] += 0.001 * (grad * grad - s[k])
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> dict:
    """Parameters fitted on labelled texts whose ``crc32(doc_id) % 4`` isn't 2.

    The sample is the labelled ids in the order of a hash, ``rows`` at most: its broadcast is bounded by that. The task
    that fits reads them in this order and keeps no more than ``limit`` bytes of text (but one text at least). Null text
    is empty text; labels without a quality or an id, and texts without a label, teach nothing. Of labels that repeat an
    id the least counts; rows that repeat a labelled id are all shown.
    """
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("turn", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, use, full = 0, [], False
        for b in batches:
            for text, quality in zip(b.column(2), b.column(3).to_pylist()):
                raw = text.as_py().encode() if not full else b""
                full = full or bool(use) and size + len(raw) > limit
                if not full:
                    size += len(raw)
                    use.append((raw, int(quality == 1)))
        net = fit([t for t, _ in use], [y for _, y in use])
        out = io.BytesIO()
        np.savez(out, **net.p)
        yield pa.RecordBatch.from_pydict({"parameters": pa.array([out.getvalue()], pa.binary())})

    got = sample.repartition(1).sortWithinPartitions("turn", "doc_id", "text", "quality").mapInArrow(run, "parameters binary").collect()
    if not got:
        return fit([], []).p
    with np.load(io.BytesIO(bytes(got[0][0]))) as z:
        return {k: z[k] for k in z.files}


def score(docs: DataFrame, parameters: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of the whole text; null is empty text, which has a score as well.

    Every row has its own score, repeated ones too; a column of ``docs`` called ``name`` is replaced. Nothing is shuffled
    and memory doesn't depend on a text's filters: some three times the longest text.
    """
    docs = docs.drop(name)

    def run(batches):
        net = Network(parameters)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(text_col), 1 << 20):
                value = np.round(net.score(data, offsets), 6)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], [*part.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{name}` double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``documents``, null and empty texts and null ids too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    parameters = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, parameters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

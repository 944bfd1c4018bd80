"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of ``SPAN`` lines decides which lines end a chunk, so boundaries move with the text: lines
put in front of a passage don't change the boundaries inside it. From every line a chunk runs to the next boundary, and to
every line one runs from the boundary before. So a repeated passage that has one boundary behind its first line is covered
whole, wherever it stands: chunks from its first line on, and chunks up to its last one. With ``DIVISOR`` 16, 15 of 16
lines are boundaries, so 15 of 16 passages of two lines are found, 255 of 256 of three lines, nearly all longer ones.

Chunks have two lines at least and ``MAX_LINES`` at most. Those that occur again anywhere are removed, all but the first,
after their bytes were compared. Only hashes of chunks are counted, with partial sums; bytes move for chunks that occur
again, and of equal ones a task sends one. A chunk that a third of all documents share is one key of such sums and one
side of a join that Spark can split.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import cut, gram_hashes, hash_spans, mix, shared_dir, signed, slices, table

SPAN = 2  # lines in the rolling hash
DIVISOR = 16  # of so many lines all but one end a chunk
MAX_LINES = 8  # longest chunk; longer runs without a boundary are equal lines, one in 16 of such
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the polynomial hash of a chunk's lines; odd
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
NO_ID = 2**63 - 1  # place of a null doc_id in the order of documents, after all others


def _base(docs: DataFrame) -> DataFrame:
    """``doc_id, order, text_key, text``; a text is found again by the last but one two."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select("doc_id", order.alias("order"), F.xxhash64("text").alias("text_key"), "text")


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the index of each text's first line (one more at the end)."""
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[inner], starts[~inner] = breaks + 1, offsets[:-1]
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[inner], ends[~inner] = breaks, offsets[1:]
    return starts, ends, first


def boundaries(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each line ends a chunk; a text's first ``SPAN - 1`` lines never do."""
    out = np.zeros(len(hashes), bool)
    out[SPAN - 1 :] = gram_hashes(hashes, SPAN) % np.uint64(DIVISOR) != 0
    for k in range(SPAN - 1):
        out[np.minimum(first[:-1] + k, len(out) - 1)] = False
    return out


def chunks(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every chunk; ``first`` as in ``line_spans``. A text's end counts as a boundary."""
    n = len(hashes)
    line, text = np.arange(n), np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[text], first[text + 1] - 1
    bounds = np.append(np.flatnonzero(boundaries(hashes, first)), n)
    after = np.minimum(np.minimum(bounds[np.searchsorted(bounds, line, "right")], end), line + MAX_LINES - 1)
    at = np.searchsorted(bounds, line, "left") - 1
    before = np.maximum(np.maximum(np.where(at >= 0, bounds[at], 0), begin), line - MAX_LINES + 1)
    on = np.flatnonzero(after > line)
    up = np.flatnonzero((before < line) & (after[before] != line))  # else there already
    return np.concatenate((line[on], before[up])), np.concatenate((after[on], line[up]))


def chunk_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of lines ``a`` to ``b``, from running sums of the line hashes times powers of ``BASE``."""
    power = np.cumprod(np.full(len(hashes) + 1, BASE), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * power[:-1], dtype=np.uint64)))
    back = np.cumprod(np.full(len(hashes) + 1, UNBASE), dtype=np.uint64)
    return mix((sums[b + 1] - sums[a]) * back[a])


def _chunk_rows(base: DataFrame) -> DataFrame:
    """``chunk, order, text_key, first, lines`` of all chunks."""
    schema = pa.schema([("chunk", pa.int64()), ("order", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("lines", pa.int32())])

    def run(batches):
        for batch in batches:
            order, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, data, offsets in slices(batch.column(2)):
                starts, ends, first = line_spans(data, offsets)
                hashes = hash_spans(data, starts, ends)
                a, b = chunks(hashes, first)
                row = np.searchsorted(first, a, "right") - 1
                yield table(schema, signed(chunk_keys(hashes, a, b)), order[lo + row], key[lo + row], (a - first[row]).astype(np.int32), (b - a + 1).astype(np.int32))

    return base.select("order", "text_key", "text").mapInArrow(run, "chunk long, order long, text_key long, first int, lines int")


def _spans(batch: pa.RecordBatch, fields: int):
    """``first row, data, offsets, line starts, line ends, first lines, chunk lines from, to, rest``, by slices of ``doc_id,
    text_key, text, places``: the lines of each chunk in ``places`` that is of the row's text, and its other fields."""
    found = batch.column(3)
    parent, flat = pc.list_parent_indices(found).to_numpy(zero_copy_only=False), found.flatten()
    field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
    mine = field("text_key") == batch.column(1).to_numpy(zero_copy_only=False)[parent]
    parent, at, n = parent[mine], field("first")[mine], field("lines")[mine]
    rest = field("chunk")[mine] if fields > 3 else None
    for lo, hi, data, offsets in slices(batch.column(2)):
        starts, ends, first = line_spans(data, offsets)
        a, b = np.searchsorted(parent, (lo, hi))
        begin = first[parent[a:b] - lo] + at[a:b]
        yield lo, data, offsets, starts, ends, first, begin, begin + n[a:b] - 1, None if rest is None else rest[a:b]


def without_repeated_lines(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` (and ``kept_text``) for every row of ``doc_id, text``.

    A line goes if a chunk of lines holds it that also starts earlier, byte for byte: in a smaller doc_id, or further up.
    So of each line that goes, a copy stays further up. Lines are what line feeds part; null text is one empty line, like
    empty text. ``doc_id`` is an integer; null ids come last. Rows that share a doc_id are one document: they don't precede
    each other at the same line. Chunks of different bytes with one hash stay. Kept lines are joined by line feeds. An
    empty table gives no rows; further columns are not looked at.
    """
    base = _base(docs)
    rows = _chunk_rows(base)
    again = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("order", "first")).alias("head")).filter("n > 1").drop("n")
    placed = rows.join(again.hint("shuffle_hash"), "chunk").select("chunk", "order", "text_key", "first", "lines", (F.struct("order", "first") != F.col("head")).alias("again"))
    place = f"{shared_dir(docs.sparkSession)}/places-{uuid.uuid4().hex}"
    placed.write.parquet(place)  # read three times; smaller than a checkpoint
    places = docs.sparkSession.read.parquet(place)

    def with_places(found, *names):
        listed = found.groupBy("order").agg(F.collect_list(F.struct(*names)).alias("places"))
        return base.join(listed.hint("shuffle_hash"), "order", "left").select("doc_id", "text_key", "text", "places")

    def bodies(batches):
        schema = pa.schema([("chunk", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            for _, data, _, starts, ends, _, a, b, key in _spans(batch, 4):
                for lo in range(0, len(key), 10_000):
                    part = slice(lo, lo + 10_000)
                    yield table(schema, key[part], [data[s:e].tobytes() for s, e in zip(starts[a[part]].tolist(), ends[b[part]].tolist())])

    # chunks whose bytes aren't the same everywhere: none, as good as always
    compared = with_places(places, "text_key", "first", "lines", "chunk").mapInArrow(bodies, "chunk long, body binary")
    clash = compared.groupBy("chunk").agg(F.min("body").alias("least"), F.max("body").alias("most")).filter("least <> most").select("chunk")
    gone = places.filter("again").join(cut(clash).hint("merge"), "chunk", "left_anti")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        schema = pa.schema([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
        for batch in batches:
            for lo, data, offsets, starts, _, first, a, b, _ in _spans(batch, 3):
                edges = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edges, a, 1)
                np.add.at(edges, b + 1, -1)
                gone = np.cumsum(edges) > 0
                before = np.concatenate(([0], np.cumsum(gone)))
                removed = before[first[1:]] - before[first[:-1]]
                raw, kept = data.tobytes(), []
                for k, n in enumerate(removed.tolist()):
                    left = raw[offsets[k] : offsets[k + 1]]
                    if n:
                        left = b"\n".join(x for x, g in zip(left.split(b"\n"), gone[first[k] : first[k + 1]].tolist()) if not g)
                    kept.append(left)
                out = table(schema, np.diff(first), removed, [hashlib.sha256(x).hexdigest() for x in kept], [x.decode() if keep_text else None for x in kept])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(kept)), *out.columns], ["doc_id", *schema.names])

    done = with_places(gone, "text_key", "first", "lines").mapInArrow(run, f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string, kept_text string")
    return done if keep_text else done.drop("kept_text")


def op5_lines(spark, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every row of ``documents``; see ``without_repeated_lines``."""
    return without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))

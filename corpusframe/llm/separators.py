"""Token counts from flat, unindexed token files by a separator scan.

A flat file is one stream of token ids with an end id after each document and nothing else. The end id is the first one
that the tokenizer's vocabulary doesn't use, so no text can hold it. The stream is stored as a table of
fixed-size blocks of bytes; documents begin and end anywhere in them. Each block is searched for the end id by itself,
vectorised; documents that span blocks are stitched by a prefix scan over two numbers of each block.

Whose count it is stands beside the stream: a narrow column has the ids of the documents that end in the block. The scan
doesn't read it; its rows are joined to it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.llm.common import shared_dir
from corpusframe.llm.repair import default_tokenizer, encoder_of

BLOCK_IDS = 1 << 16


def end_of(encoder) -> int:
    """The end id: the first id outside the vocabulary."""
    return encoder.size


def write_flat(docs: DataFrame, path: str, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """``file_no, block_no, width, ids``: a file for each task, its documents in the order in which they are read.

    ``doc_ids`` are those of the documents that end in the block, ``first_doc`` the first one's place in the file. Ids take
    two bytes where the vocabulary and the end id allow, else four. Null text is empty text. Nothing is shuffled.
    """
    source = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, file, block, first = encoder_of(source), TaskContext.get().partitionId(), 0, 0
        width, end = 2 if encoder.size < 1 << 16 else 4, end_of(encoder)
        held, owners = np.empty(0, f"<u{width}"), None

        def row(stream, names):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([width], pa.int32()), pa.array([stream.tobytes()], pa.binary()), pa.array([first], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)], ["file_no", "block_no", "width", "ids", "first_doc", "doc_ids"])

        for batch in batches:
            owners = batch.column(0).slice(0, 0) if owners is None else owners
            for lo, hi, ids, edges in encoder.encode(batch.column(1)):
                ends = edges[1:] + np.arange(1, hi - lo + 1)
                closed = np.full(int(ends[-1]), end, held.dtype)
                inner = np.ones(len(closed), bool)
                inner[ends - 1] = False
                closed[inner] = ids
                held, owners = np.concatenate((held, closed)), pa.concat_arrays([owners, batch.column(0).slice(lo, hi - lo)])
                whole = len(held) // block_ids
                for k in range(whole):
                    stream = held[k * block_ids : (k + 1) * block_ids]
                    n = int(np.count_nonzero(stream == end))
                    yield row(stream, owners.slice(0, n))
                    block, first, owners = block + 1, first + n, owners.slice(n)
                held = held[whole * block_ids :]
        if len(held):
            yield row(held, owners)

    docs.select("doc_id", "text").mapInArrow(run, f"file_no int, block_no long, width int, ids binary, first_doc long, doc_ids array<{kind}>").write.parquet(path)


def scan(blocks: DataFrame, end_id: int) -> DataFrame:
    """``file_no, doc_no, start, n_tokens`` of every document in the files; ``n_tokens`` counts the end id.

    ``start`` and ``doc_no`` count within the file. Ids behind a file's last end id are a document without one and come
    last. Null or empty blocks hold no ids.
    """
    sums = "file_no int, block_no long, n long, ends array<int>"

    def run(batches):
        for batch in batches:
            sizes, offsets, found = [], [0], []
            for width, value in zip(batch.column(2).to_pylist(), batch.column(3)):
                ids = np.frombuffer(value.as_py() or b"", f"<u{width}")
                at = np.flatnonzero(ids == end_id).astype(np.int32)
                sizes.append(len(ids))
                found.append(at)
                offsets.append(offsets[-1] + len(at))
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["file_no", "block_no", "n", "ends"])

    found = blocks.select(F.col("file_no").cast("int"), F.col("block_no").cast("long"), F.col("width").cast("int"), "ids").mapInArrow(run, sums)
    order = Window.partitionBy("file_no").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_end = F.col("base") + F.element_at("ends", -1)
    scanned = found.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    scanned = scanned.withColumn("open", F.coalesce(F.max(F.when(F.size("ends") > 0, last_end + 1)).over(before), F.lit(0)))
    scanned = scanned.withColumn("doc_base", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn("final", F.lead("block_no").over(order).isNull())
    tail_start = F.when(F.size("ends") > 0, last_end + 1).otherwise(F.col("open"))
    tail = scanned.filter(F.col("final") & (F.col("base") + F.col("n") > tail_start)).select("file_no", (F.col("doc_base") + F.size("ends")).cast("long").alias("doc_no"), tail_start.cast("long").alias("start"), (F.col("base") + F.col("n") - tail_start).cast("long").alias("n_tokens"))
    previous = F.transform("ends", lambda e, i: F.when(i == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", i - 1) + 1))
    inner = scanned.select("file_no", "doc_base", "base", F.posexplode(F.arrays_zip(F.col("ends").alias("e"), previous.alias("s"))).alias("i", "d"))
    whole = inner.select("file_no", (F.col("doc_base") + F.col("i")).cast("long").alias("doc_no"), F.col("d.s").cast("long").alias("start"), (F.col("base") + F.col("d.e") + 1 - F.col("d.s")).cast("long").alias("n_tokens"))
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file_no, doc_no, start, n_tokens, doc_id`` of every row of ``docs``, by a scan of the files written of them.

    One row for each row of ``docs``: null and empty texts count 1 (the end id), repeated rows and null ids have rows of
    their own, an empty table none.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/flat-tokens-{uuid.uuid4().hex}"
    source = tokenizer or default_tokenizer()
    write_flat(docs, path, source, block_ids)
    blocks = spark.read.parquet(path)
    owners = blocks.select("file_no", "first_doc", F.posexplode("doc_ids").alias("i", "doc_id")).select("file_no", (F.col("first_doc") + F.col("i")).alias("doc_no"), "doc_id")
    return scan(blocks, end_of(encoder_of(source))).join(owners.hint("shuffle_hash"), ["file_no", "doc_no"]).select("file_no", "doc_no", "start", "n_tokens", "doc_id")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """``file_no, doc_no, start, n_tokens, doc_id`` of every row of ``documents``; see ``token_counts`` for odd rows."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

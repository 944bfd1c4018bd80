"""The same operators on streams: incremental ingestion, message merge, daily counts and stall detection."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusframe.operators.chunking import chunk_documents, link_chunks
from corpusframe.operators.lexical import postings_in_place, search_postings
from corpusframe.operators.vectors import encode, nearest_center, vector_topk, vector_topk_ivf
from corpusframe.sources.checkpoints import cut
from corpusframe.sources.corpus import text_to_blocks

DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("library_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("version", T.LongType())])


def chunks_of(docs: DataFrame) -> DataFrame:
    """Documents as linked chunks, with the version that they come from."""
    blocks = text_to_blocks(docs.select("doc_id", "text")).select("doc_id", F.col("block_no").alias("pos"), F.lit(0).alias("page"), F.format_string("b%04d", "block_no").alias("block_id"), "text")
    known = blocks.join(docs.select("doc_id", "library_id"), "doc_id")
    return link_chunks(chunk_documents(known)).join(docs.select("doc_id", "version"), "doc_id")


class BatchLog:
    """An append-only table of micro-batches, a folder ``batch=N`` for each. A batch that is delivered again writes its own
    folder anew and reads nothing that was written before, so each batch costs its own size, however large the table.

    Readers would go through ever more folders; ``compact`` in ``Ingestion`` starts a new generation of the log.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, batch_id: int) -> DataFrame:
        """One batch, without its number."""
        return self.spark.read.parquet(f"{self.path}/batch={batch_id}")

    def rows(self) -> DataFrame:
        """All rows with their ``batch``."""
        return self.spark.read.option("basePath", self.path).parquet(self.path).withColumn("batch", F.col("batch").cast("long"))


class Ingestion:
    """Documents as chunks, vectors and postings, batch by batch.

    Each kind of row is a log. What a document's newest version has is current, of equal versions the later batch's; a
    document that comes again thereby takes its old chunks, vectors, cluster assignments and postings out of every search.
    ``encoder`` as in ``vectors.encode``; with ``centers`` (``library_id, cluster_id, centroid``) vectors get a cluster.
    """

    KINDS = ("chunks", "vectors", "postings", "documents")  # documents are written last: only then does a batch count
    COMPACTED = -1  # the batch that compacted rows are in; no stream writes it

    def __init__(self, spark: SparkSession, target: str, encoder=None, centers: DataFrame | None = None):
        self.spark, self.target, self.encoder, self.centers = spark, target, encoder, centers
        self._generations(0).mode("ignore").parquet(f"{target}/generations")

    def _generations(self, number: int):
        return self.spark.range(1).select(F.lit(number).alias("generation")).write

    def generation(self) -> int:
        """0 until the first compaction; rows of ``generations`` are committed as a whole."""
        return self.spark.read.parquet(f"{self.target}/generations").agg(F.max("generation")).first()[0]

    def log(self, kind: str, generation: int) -> BatchLog:
        return BatchLog(self.spark, f"{self.target}/generation-{generation}/{kind}")

    def rows_of(self, docs: DataFrame, chunks: DataFrame | None = None) -> dict[str, DataFrame]:
        """All kinds of rows of documents (``DOCUMENT``), as the batch job makes them too. ``chunks`` is computed once, unless
        it is given as stored."""
        chunks = cut(chunks_of(docs)) if chunks is None else chunks
        vectors = encode(chunks.select("doc_id", "library_id", "chunk_id", "text"), "text", self.encoder).drop("text")
        if self.centers is not None:
            vectors = nearest_center(vectors, self.centers)
        postings = postings_in_place(chunks)
        return {"chunks": chunks, "vectors": vectors, "postings": postings, "documents": docs.select("doc_id", "library_id", "version")}

    def write(self, batch: DataFrame, batch_id: int) -> None:
        newest = cut(batch.groupBy("doc_id").agg(F.max_by(F.struct("library_id", "text", "version"), "version").alias("d")).select("doc_id", "d.*"))
        now = self.generation()
        self.log("chunks", now).write(chunks_of(newest), batch_id)
        rows = self.rows_of(newest, self.log("chunks", now).read(batch_id))  # of what is written now
        for kind in self.KINDS[1:]:
            self.log(kind, now).write(rows[kind], batch_id)

    def stream(self, source: str, checkpoint: str) -> StreamingQuery:
        """New files of ``source``, JSON lines of ``DOCUMENT``."""
        documents = self.spark.readStream.schema(DOCUMENT).json(source)
        return documents.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def current(self, kind: str) -> DataFrame:
        """Rows of each document's newest version. A document without text has none but in ``documents``."""
        now = self.generation()
        heads = self.log("documents", now).rows().groupBy("doc_id").agg(F.max_by("batch", F.struct("version", "batch")).alias("batch"))
        return self.log(kind, now).rows().join(heads, ["doc_id", "batch"]).drop("batch")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``bm25_topk`` over the current postings."""
        return search_postings(queries, self.current("postings").drop("doc_id"), k)

    def nearest(self, queries: DataFrame, k: int, nprobe: int | float | None = None) -> DataFrame:
        """``vector_topk`` over the current vectors, or ``vector_topk_ivf`` over their clusters."""
        if nprobe is None:
            return vector_topk(queries, self.current("vectors"), k)
        return vector_topk_ivf(queries, self.current("vectors"), self.centers, nprobe, k)

    def compact(self) -> int:
        """Current rows alone in a new generation, which readers and the next stream then use; no stream may run meanwhile.

        It counts from the row in ``generations`` on, so a compaction that breaks off has no effect. The folder of the old
        generation is the caller's to delete. A batch that is delivered again afterwards still replaces its documents.
        """
        old = self.generation()
        for kind in self.KINDS:
            self.log(kind, old + 1).write(self.current(kind), self.COMPACTED)
        self._generations(old + 1).mode("append").parquet(f"{self.target}/generations")
        return old + 1


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """New files of ``source`` become chunks, vectors and postings; see ``Ingestion``."""
    return Ingestion(spark, target).stream(source, checkpoint)


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Chunks of each document's newest version; of equal versions the later batch counts. One without text has none."""
    return Ingestion(spark, target).current("chunks")


def distinct_deliveries(messages: DataFrame, delivered: str = "delivered_at", delay: str = "1 hour") -> DataFrame:
    """Messages without those that were delivered before, in the same state, within ``delay``.

    Time is that of delivery (now, where there is no such column), so an old message that comes for the first time isn't
    late. State goes as the watermark passes; what is delivered again after that comes through and overwrites itself.
    """
    known = messages if delivered in messages.columns else messages.withColumn(delivered, F.current_timestamp())
    return known.withWatermark(delivered, delay).dropDuplicatesWithinWatermark(["message_id", "updated_at"])


def merge_messages_stream(messages: DataFrame, target: str, checkpoint: str, delivered: str = "delivered_at", delay: str = "1 hour") -> StreamingQuery:
    """A log of messages, ``message_id, thread_id, content, updated_at``; see ``distinct_deliveries``, ``current_messages``."""
    log = BatchLog(messages.sparkSession, target)
    distinct = distinct_deliveries(messages, delivered, delay)
    return distinct.writeStream.foreachBatch(log.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_messages(spark: SparkSession, target: str) -> DataFrame:
    """The newest state of each message; of equal times the later batch's."""
    rows = BatchLog(spark, target).rows()
    rest = [c for c in rows.columns if c not in ("message_id", "batch")]
    return rows.groupBy("message_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "batch")).alias("r")).select("message_id", "r.*")


def usage_stream(events: DataFrame, time: str = "ts", key: str = "library_id") -> DataFrame:
    """``key, day, n`` by day as the watermark, one day behind, passes it. Rows later than that are left out here and
    show in the batch report of the same numbers."""
    counts = events.withWatermark(time, "1 day").groupBy(key, F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.to_date("window.start").alias("day"), "n")


def usage_reconcile(events: DataFrame, streamed: DataFrame, time: str = "ts", key: str = "library_id") -> DataFrame:
    """``key, day, n, streamed, late``: the batch report beside what ``usage_stream`` has given out, and the rows that came
    too late for it (or whose day is still open)."""
    n = events.groupBy(key, F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    seen = streamed.groupBy(key, "day").agg(F.sum("n").alias("streamed"))
    return n.join(seen, [key, "day"], "left").fillna(0, ["streamed"]).withColumn("late", F.col("n") - F.col("streamed"))


def stall_stream(jobs: DataFrame, minutes: int = 5) -> DataFrame:
    """``library_id, last_update, stalled_at`` once a library with work under way has been silent for ``minutes``.

    ``jobs``: ``library_id, status, ts`` with a watermark. State is one timestamp for each library; a timer in event
    time raises the alarm. Needs the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    gap = minutes * 60_000

    class Stall(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "ms long, active boolean")

        def handleInputRows(self, key, rows, timerValues):
            have = self.last.get() if self.last.exists() else None
            newest, active = (have[0], have[1]) if have else (-1, False)
            for pdf in rows:
                pdf = pdf.assign(ms=pdf["ts"].astype("datetime64[ms]").astype("int64")).sort_values("ms")
                if len(pdf) and int(pdf["ms"].iloc[-1]) >= newest:
                    newest, active = int(pdf["ms"].iloc[-1]), bool(pdf["status"].iloc[-1] in ("running", "queued"))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((newest, active))
            if active:
                self.handle.registerTimer(newest + gap)
            yield from ()  # alarms come from timers only

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            newest, active = self.last.get()
            if active:
                yield pd.DataFrame({"library_id": [key[0]], "last_update": [pd.Timestamp(newest, unit="ms")], "stalled_at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

        def close(self) -> None:
            pass

    return jobs.groupBy("library_id").transformWithStateInPandas(Stall(), "library_id string, last_update timestamp, stalled_at timestamp", "Append", "eventTime")


def stalled_now(jobs: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    """The batch report of the same: libraries whose newest job row is active and older than ``minutes``."""
    last = jobs.groupBy("library_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("last_update"))
    return last.filter(F.col("status").isin("running", "queued") & (F.col("last_update") < F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))).select("library_id", "last_update")



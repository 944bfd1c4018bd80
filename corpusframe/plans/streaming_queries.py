"""Registered queries: streams over files that are made of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusframe.plans.registry import query
from corpusframe.sources.checkpoints import shared_dir
from corpusframe.streaming import streams


@query("k3_messages", "SELECT message_id, thread_id, CASE WHEN turn % 2 = 0 THEN 'edited: '||content ELSE content END AS content, created_at + to_minutes(CAST(CASE WHEN turn % 2 = 0 THEN 7 ELSE 0 END AS INTEGER)) AS updated_at, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS written FROM v_messages")
def _(v):
    """Messages as a stream of files: all of them, then all again with edits of some; what came before isn't written again."""
    place = f"{shared_dir(v.spark)}/messages-{uuid.uuid4().hex}"
    schema = "message_id string, thread_id long, content string, updated_at timestamp_ntz"
    first = v.v_messages.select("message_id", "thread_id", "content", F.col("created_at").alias("updated_at"))
    edits = v.v_messages.filter("turn % 2 = 0").select("message_id", "thread_id", F.concat(F.lit("edited: "), "content").alias("content"), F.expr("created_at + INTERVAL 7 MINUTES").alias("updated_at"))
    for rows in (first, first.unionByName(edits)):
        rows.write.mode("append").json(f"{place}/in")
        stream = v.spark.readStream.schema(schema).json(f"{place}/in")
        streams.merge_messages_stream(stream, f"{place}/out", f"{place}/state").awaitTermination()
    written = streams.BatchLog(v.spark, f"{place}/out").rows().groupBy("message_id").agg(F.count(F.lit(1)).alias("written"))
    return streams.current_messages(v.spark, f"{place}/out").join(written, "message_id").select("message_id", "thread_id", "content", "updated_at", "written")

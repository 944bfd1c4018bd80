"""Registered queries: corpus operations and usage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusframe.operators import ops as O  # noqa: E741
from corpusframe.plans.registry import query
from corpusframe.sources import corpus as S
from corpusframe.sources.checkpoints import shared_dir


def listing(v):
    """Two thirds of the stored files, and as many new ones."""
    d = v.v_docs.select("library_id", "gdrive_file_id", "title", "doc_no")
    new = d.select("library_id", F.concat(F.lit("n"), F.col("gdrive_file_id")).alias("gdrive_file_id"), F.expr("CASE WHEN doc_no % 2 = 0 THEN title ELSE concat('new ', title) END").alias("title"))
    return d.filter("doc_no % 3 > 0").select("library_id", "gdrive_file_id", "title").unionByName(new)


LIST = "ls AS (SELECT library_id, gdrive_file_id, title FROM v_docs WHERE doc_no % 3 > 0 UNION ALL SELECT library_id, 'n'||gdrive_file_id, CASE WHEN doc_no % 2 = 0 THEN title ELSE 'new '||title END FROM v_docs)"


@query("a9_upsert", "SELECT doc_id, CASE WHEN doc_no % 3 = 0 THEN 'new' ELSE title END AS title, CASE WHEN doc_no % 3 = 0 THEN 2 ELSE 1 END AS version FROM v_docs")
def _(v):
    old = v.v_docs.select("doc_id", "title", F.lit(1).alias("version"))
    new = v.v_docs.filter("doc_no % 3 = 0").select("doc_id", F.lit("new").alias("title"), F.lit(2).alias("version"))
    return O.upsert(old, new, ["doc_id"], "version")


@query("a10_cascade_delete", "SELECT chunk_id FROM v_chunks WHERE doc_id NOT IN (SELECT doc_id FROM v_docs WHERE doc_no % 4 = 1)")
def _(v):
    return O.delete_documents({"chunks": v.v_chunks.select("doc_id", "chunk_id")}, v.v_docs.filter("doc_no % 4 = 1"))["chunks"].select("chunk_id")


@query("a9_upsert_in_place", "SELECT library_id, doc_id, CASE WHEN doc_no % 3 = 0 AND length(library_id) = 4 THEN 'new' ELSE title END AS title, CASE WHEN doc_no % 3 = 0 AND length(library_id) = 4 THEN 2 ELSE 1 END AS version FROM v_docs")
def _(v):
    """Documents as a stored table; a third of those of some libraries are updated in it, twice."""
    path = f"{shared_dir(v.spark)}/upsert-{uuid.uuid4().hex}"
    rows = v.v_docs.select("library_id", "doc_id", "title", F.lit(1).alias("version"), "doc_no")
    rows.drop("doc_no").repartition("library_id").write.partitionBy("library_id").parquet(path)
    updates = rows.filter("doc_no % 3 = 0 AND length(library_id) = 4").drop("doc_no").withColumns({"title": F.lit("new"), "version": F.lit(2)})
    for _ in range(2):
        S.write_upsert(v.spark, path, updates, ["library_id", "doc_id"], "version")
    return v.spark.read.parquet(path).select("library_id", "doc_id", "title", "version")


@query(
    "a10_delete_in_place",
    """WITH gone AS (SELECT doc_id FROM v_docs WHERE doc_no % 4 = 1 OR library_id = 'src7')
SELECT 'chunks' AS name, library_id, count(*) AS n, min(chunk_id) AS first FROM v_chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY library_id
UNION ALL SELECT 'blocks', library_id, count(*), min(doc_id||block_id) FROM v_blocks WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY library_id""",
)
def _(v):
    """Chunks and blocks as stored tables, from which documents and a whole library go."""
    place = f"{shared_dir(v.spark)}/delete-{uuid.uuid4().hex}"
    tables = {"chunks": v.v_chunks.select("library_id", "doc_id", F.col("chunk_id").alias("key")), "blocks": v.v_blocks.select("library_id", "doc_id", F.concat("doc_id", "block_id").alias("key"))}
    paths = {name: f"{place}/{name}" for name in tables}
    for name, df in tables.items():
        df.repartition("library_id").write.partitionBy("library_id").parquet(paths[name])
    S.delete_documents(v.spark, paths, v.v_docs.filter("doc_no % 4 = 1 OR library_id = 'src7'"))
    left = [v.spark.read.parquet(path).groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).select(F.lit(name).alias("name"), "*") for name, path in paths.items()]
    return left[0].unionByName(left[1])


@query("a11_pending", "SELECT doc_id FROM v_docs WHERE doc_id NOT IN (SELECT doc_id FROM v_chunks WHERE chunk_index > 0)")
def _(v):
    return O.pending(v.v_docs.select("doc_id"), v.v_chunks.filter("chunk_index > 0"))


@query("i1_sync_diff", f"WITH {LIST} SELECT coalesce(l.library_id,d.library_id) AS library_id, coalesce(l.gdrive_file_id,d.gdrive_file_id) AS gdrive_file_id, CASE WHEN d.gdrive_file_id IS NULL THEN 'new' WHEN l.gdrive_file_id IS NULL THEN 'deleted' ELSE 'kept' END AS change FROM (SELECT DISTINCT library_id, gdrive_file_id FROM ls) l FULL JOIN v_docs d ON d.library_id=l.library_id AND d.gdrive_file_id=l.gdrive_file_id")
def _(v):
    return O.sync_diff(listing(v), v.v_docs)


@query(
    "i2_plan_additions",
    f"""WITH {LIST}, f AS (SELECT ls.* FROM ls WHERE NOT EXISTS (SELECT 1 FROM v_docs d WHERE d.library_id=ls.library_id AND d.gdrive_file_id=ls.gdrive_file_id) QUALIFY row_number() OVER (PARTITION BY library_id, title ORDER BY gdrive_file_id) = 1),
t AS (SELECT library_id, title, min(doc_id) AS old_doc_id FROM v_docs GROUP BY 1,2) SELECT f.library_id, gdrive_file_id, f.title, old_doc_id, CASE WHEN old_doc_id IS NULL THEN 'add' ELSE 'replace' END AS action FROM f LEFT JOIN t ON t.library_id=f.library_id AND t.title=f.title""",
)
def _(v):
    return O.plan_additions(listing(v), v.v_docs, True)


@query("i3_assign_batches", "WITH n AS (SELECT doc_id, library_id, row_number() OVER (PARTITION BY library_id ORDER BY gdrive_file_id, title, doc_id) AS rn, count(*) OVER (PARTITION BY library_id) AS n FROM v_docs) SELECT doc_id, floor((rn-1)/ceil(n/least(7,n)))::BIGINT AS batch_index FROM n")
def _(v):
    return O.assign_batches(v.v_docs.select("doc_id", "library_id", "gdrive_file_id", "title"), 7).select("doc_id", "batch_index")


@query("i4_stage_breakdown", "SELECT library_id, stage, count(*) FILTER (status='queued') AS queued, count(*) FILTER (status='running') AS running, count(*) FILTER (status='done') AS done, count(*) FILTER (status='failed') AS failed FROM v_jobs GROUP BY 1,2")
def _(v):
    return O.stage_breakdown(v.v_jobs)


@query("i5_progress", "WITH w(stage,w) AS (VALUES ('sync',15),('text_extraction',20),('image_captioning',15),('chunking',13),('embedding',14)), s AS (SELECT library_id, stage, avg((status='done')::INT) AS f FROM v_jobs GROUP BY 1,2) SELECT library_id, round(least(100, sum(f*w)),2) AS progress FROM s JOIN w USING (stage) GROUP BY 1")
def _(v):
    return O.progress(v.v_jobs)


@query("i5_plain_progress", "SELECT library_id, round(100.0*sum((status='done')::INT)/(count(DISTINCT batch_id)*5),2) AS progress FROM v_bjobs GROUP BY 1")
def _(v):
    return O.plain_progress(v.v_bjobs, 5)


@query("i6_ready_batches", "SELECT library_id, batch_id FROM v_bjobs GROUP BY 1,2 HAVING coalesce(bool_and(status='done') FILTER (stage='text_extraction'),false) AND coalesce(bool_and(status='done') FILTER (stage='image_captioning'),false)")
def _(v):
    return O.ready_batches(v.v_bjobs)


@query("i7_missing_stages", "WITH e(stage,nx) AS (VALUES ('sync','text_extraction'),('text_extraction','chunking'),('image_captioning','chunking'),('chunking','embedding')) SELECT DISTINCT library_id, batch_id, nx AS stage FROM v_bjobs j JOIN e USING (stage) WHERE status='done' AND NOT EXISTS (SELECT 1 FROM v_bjobs k WHERE k.library_id=j.library_id AND k.batch_id=j.batch_id AND k.stage=nx)")
def _(v):
    return O.missing_stages(v.v_bjobs)


@query("i8_library_state", "WITH s(stage,p) AS (VALUES ('sync',1),('text_extraction',3),('image_captioning',4),('chunking',5),('embedding',6)) SELECT library_id, CASE WHEN bool_or(status='failed') THEN 'failed' WHEN bool_and(status='done') THEN 'completed' ELSE 'processing' END AS state, arg_min(stage, p) FILTER (status<>'done') AS next_stage FROM v_jobs JOIN s USING (stage) GROUP BY 1")
def _(v):
    return O.library_state(v.v_jobs)


@query("i9_stale_jobs", "SELECT job_id, library_id, CASE WHEN attempts >= 3 THEN 'fail' ELSE 'requeue' END AS action FROM v_jobs WHERE status='running' AND started_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR")
def _(v):
    return O.stale_jobs(v.v_jobs, "2024-01-20 00:00:00", 3600, 3)


@query("i10_daily_series", "WITH c AS (SELECT library_id, started_at::DATE AS day, count(*) AS n FROM v_jobs GROUP BY 1,2), s AS (SELECT DISTINCT library_id, unnest(generate_series(DATE '2024-01-05', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day FROM v_jobs) SELECT library_id, day, coalesce(n,0) AS n FROM s LEFT JOIN c USING (library_id, day)")
def _(v):
    return O.daily_series(v.v_jobs, "2024-01-05", "2024-02-05")


@query("i11_usage_meter", "SELECT thread_id, count(*) FILTER (role='assistant') AS requests, sum(ceil(length(content)/4.0))::BIGINT AS tokens FROM v_messages WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY 1")
def _(v):
    return O.usage_meter(v.v_messages, "2024-01-10 00:00:00")


@query("i11_library_usage", "WITH d AS (SELECT library_id, count(*) AS documents, sum(file_size_bytes)::BIGINT AS storage_bytes FROM v_docs GROUP BY 1), c AS (SELECT library_id, count(*) AS chunks FROM v_chunks GROUP BY 1), n AS (SELECT substr(graph_id,2) AS library_id, count(DISTINCT name) AS nodes FROM v_mentions GROUP BY 1), e AS (SELECT substr(graph_id,2) AS library_id, count(*) AS edges FROM v_relations GROUP BY 1) SELECT library_id, documents, storage_bytes, coalesce(chunks,0) AS chunks, coalesce(nodes,0) AS nodes, coalesce(edges,0) AS edges FROM d LEFT JOIN c USING (library_id) LEFT JOIN n USING (library_id) LEFT JOIN e USING (library_id)")
def _(v):
    owner = F.substring("graph_id", 2, 1_000).alias("library_id")
    return O.library_usage(v.v_docs, v.v_chunks, v.v_mentions.select(owner, "name").distinct(), v.v_relations.select(owner))


MEMBERS = "me AS (SELECT 'u'||(c_custkey%200) AS user_id, 'o'||(c_custkey%90) AS organization_id, CASE WHEN c_custkey%3=0 THEN 'owner' ELSE 'member' END AS role FROM customer), mb AS (SELECT DISTINCT * FROM me)"


def members(v):
    return v.customer.select(F.concat(F.lit("u"), (F.col("c_custkey") % 200).cast("string")).alias("user_id"), F.concat(F.lit("o"), (F.col("c_custkey") % 90).cast("string")).alias("organization_id"), F.when(F.col("c_custkey") % 3 == 0, "owner").otherwise("member").alias("role")).distinct()


def organizations(v):
    return members(v).select("organization_id").distinct().select("organization_id", F.expr("CASE CAST(substr(organization_id,2) AS INT) % 4 WHEN 0 THEN 'PRO' WHEN 1 THEN 'enterprise' WHEN 2 THEN NULL ELSE 'free' END").alias("plan"))


@query(
    "i12_quota",
    f"""WITH {MEMBERS}, og AS (SELECT DISTINCT organization_id, CASE substr(organization_id,2)::INT%4 WHEN 0 THEN 'pro' WHEN 1 THEN 'enterprise' ELSE 'free' END AS plan FROM mb), us AS (SELECT 'o'||(o_custkey%90) AS organization_id, count(*) AS used FROM orders GROUP BY 1),
j AS (SELECT user_id, plan, CASE plan WHEN 'free' THEN 0 WHEN 'pro' THEN 1 ELSE 2 END AS r, used FROM mb JOIN og USING (organization_id) LEFT JOIN us USING (organization_id) WHERE role='owner'), b AS (SELECT user_id, arg_max(plan, r) AS plan, coalesce(sum(used),0)::BIGINT AS used FROM j GROUP BY 1)
SELECT user_id, plan, used, CASE plan WHEN 'free' THEN 500 WHEN 'pro' THEN 20000 END::BIGINT AS query_limit, coalesce(used >= CASE plan WHEN 'free' THEN 500 WHEN 'pro' THEN 20000 END, false) AS exceeded FROM b""",
)
def _(v):
    usage = v.orders.groupBy(F.concat(F.lit("o"), (F.col("o_custkey") % 90).cast("string")).alias("organization_id")).agg(F.count(F.lit(1)).alias("used"))
    return O.quota(members(v), organizations(v), usage)


@query(
    "i13_visible_libraries",
    f"""WITH {MEMBERS}, lb AS (SELECT DISTINCT 'u'||(s_suppkey%150) AS owner_id, 'l'||s_suppkey AS library_id, 'o'||(s_suppkey%60) AS organization_id FROM supplier), sh AS (SELECT 'o'||((s_suppkey+7)%90) AS organization_id, 'l'||s_suppkey AS library_id FROM supplier), gr AS (SELECT 'u'||(s_suppkey%40) AS user_id, 'l'||s_suppkey AS library_id FROM supplier),
a AS (SELECT owner_id AS user_id, library_id, true AS w FROM lb UNION ALL SELECT user_id, library_id, false FROM mb JOIN lb USING (organization_id) UNION ALL SELECT user_id, library_id, false FROM mb JOIN sh USING (organization_id))
SELECT a.user_id, a.library_id, bool_or(w) OR bool_or(gr.user_id IS NOT NULL) AS can_write FROM a LEFT JOIN gr ON gr.user_id=a.user_id AND gr.library_id=a.library_id WHERE a.user_id IN (SELECT user_id FROM mb) GROUP BY 1,2""",
)
def _(v):
    s = v.supplier
    lib = F.concat(F.lit("l"), F.col("s_suppkey").cast("string")).alias("library_id")
    name = lambda p, e, a: F.concat(F.lit(p), F.expr(e).cast("string")).alias(a)
    libraries = s.select(name("u", "s_suppkey % 150", "owner_id"), lib, name("o", "s_suppkey % 60", "organization_id"))
    shares = s.select(name("o", "(s_suppkey + 7) % 90", "organization_id"), lib)
    return O.visible_libraries(members(v).select("user_id").distinct(), libraries, members(v), shares, s.select(name("u", "s_suppkey % 40", "user_id"), lib))


@query(
    "i14_thread_lineage",
    """WITH RECURSIVE th AS (SELECT DISTINCT thread_id, CASE WHEN thread_id % 5 = 0 THEN NULL ELSE thread_id - 1 END AS parent_id, thread_id - thread_id % 5 AS root_id FROM v_messages),
up(thread_id, root_id, u, depth) AS (SELECT thread_id, root_id, parent_id, 0 FROM th UNION ALL SELECT up.thread_id, up.root_id, th.parent_id, depth+1 FROM up JOIN th ON th.thread_id=up.u WHERE depth < 50), d AS (SELECT thread_id, root_id, max(depth) AS depth FROM up GROUP BY 1,2)
SELECT thread_id, root_id, depth, row_number() OVER (PARTITION BY root_id ORDER BY depth, thread_id) AS position FROM d""",
)
def _(v):
    threads = v.v_messages.groupBy("thread_id").agg(F.min("created_at").alias("created_at")).select("thread_id", F.expr("CASE WHEN thread_id % 5 = 0 THEN NULL ELSE thread_id - 1 END").alias("parent_id"), F.expr("thread_id - thread_id % 5").alias("root_id"), F.lit(0).alias("created_at"))
    return O.thread_lineage(threads)


@query("i15_context_budget", "WITH u AS (SELECT thread_id, turn, sum(ceil(length(content)/4.0)) OVER (PARTITION BY thread_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM v_messages), a AS (SELECT thread_id, max(s)::BIGINT AS tokens, min(turn) FILTER (s > 300) AS compact_from, least(100, round(100*max(s)/300))::INT AS percent FROM u GROUP BY 1) SELECT *, CASE WHEN percent >= 90 THEN 'critical' WHEN percent >= 75 THEN 'warn' ELSE 'ok' END AS state FROM a")
def _(v):
    return O.context_budget(v.v_messages, 300)


@query("i16_message_sources", "SELECT message_id, count(d.doc_id) AS n, coalesce(string_agg(d.title, '|' ORDER BY d.doc_no DESC), '') AS titles FROM v_messages m LEFT JOIN v_docs d ON d.doc_no % 400 = m.thread_id AND m.turn = 1 GROUP BY 1")
def _(v):
    links = v.v_docs.select(F.concat((F.col("doc_no") % 400).cast("string"), F.lit("-1")).alias("message_id"), F.col("doc_no").alias("score"), F.lit("c").alias("chunk_id"), "doc_id")
    out = O.messages_with_sources(v.v_messages.select("message_id"), links, v.v_docs)
    return out.select("message_id", F.size("sources").cast("long").alias("n"), F.array_join(F.transform("sources", lambda s: s["title"]), "|").alias("titles"))


@query("i17_filter_logs", "SELECT job_id, stage, status, row_number() OVER (PARTITION BY stage ORDER BY CASE status WHEN 'failed' THEN 1 WHEN 'running' THEN 2 WHEN 'queued' THEN 3 ELSE 4 END, started_at DESC, job_id) AS rank FROM v_jobs WHERE contains(lower(concat_ws(' ', stage, status, library_id)), 'src1') QUALIFY rank <= 20")
def _(v):
    return O.filter_logs(v.v_jobs, text=" SRC1").select("job_id", "stage", "status", "rank")


@query("i18_busy_libraries", "SELECT library_id, count(*) AS count FROM v_jobs WHERE status IN ('running','queued') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _(v):
    return O.busy_libraries(v.v_jobs)


@query("i19_search_libraries", "SELECT doc_id FROM v_docs WHERE contains(lower(concat_ws(' ', title, library_id, language, doc_type)), 'src1 en')")
def _(v):
    return O.search_libraries(v.v_docs.select("doc_id", F.col("title").alias("name"), F.col("library_id").alias("source"), F.col("language").alias("status"), F.col("doc_type").alias("stage")), "SRC1 en ").select("doc_id")


@query("i20_rows_to_series", "WITH r AS (SELECT c_nationkey AS table_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS row_no, c_name, c_custkey FROM customer) SELECT 't'||table_id AS table_id, row_no::INT AS row_no, unnest(['name','id','none']) AS \"column\", unnest([c_name, c_custkey::VARCHAR, NULL]) AS value FROM r")
def _(v):
    rows = v.customer.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: F.array(r["c_name"], r["c_custkey"].cast("string"))).alias("rows"))
    return O.rows_to_series(rows.select(F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("table_id"), F.array(*map(F.lit, ("name", "id", "none"))).alias("columns"), "rows"))


@query(
    "i21_validate_fields",
    """WITH c AS (SELECT p_brand, list(DISTINCT w) AS cols FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size % 4 = 0) GROUP BY 1)
SELECT p_partkey AS spec_id, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(coalesce(cols, []), x)))), ',') AS missing FROM part LEFT JOIN c USING (p_brand)""",
)
def _(v):
    """The words of a part's name as fields, those of its brand's parts of some sizes as the table's columns."""
    words = v.part.filter("p_size % 4 = 0").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).groupBy("p_brand").agg(F.collect_set("w").alias("columns"))
    specs = v.part.select(F.col("p_partkey").alias("spec_id"), "p_brand", F.split("p_name", " ").alias("fields")).join(words, "p_brand", "left")
    return O.validate_fields(specs.withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))).withColumn("missing", F.array_join("missing", ","))


@query("i22_stage_backlog", "SELECT stage, count(*) AS waiting, count(DISTINCT library_id) AS libraries FROM v_jobs WHERE status IN ('queued','running') GROUP BY 1")
def _(v):
    return O.stage_backlog(v.v_jobs)


@query("i23_recent_threads", "WITH l AS (SELECT thread_id, thread_id % 3 AS scope, arg_max(left(content,140), (created_at,turn)) AS snippet, max(created_at) AS u FROM v_messages GROUP BY 1,2) SELECT thread_id, scope, snippet, row_number() OVER (PARTITION BY scope ORDER BY u DESC, thread_id) AS rank FROM l QUALIFY rank <= 80")
def _(v):
    threads = v.v_messages.select("thread_id", (F.col("thread_id") % 3).alias("scope")).distinct()
    return O.recent_threads(v.v_messages, threads).select("thread_id", "scope", "snippet", "rank")


@query("i24_member_directory", f"WITH {MEMBERS} SELECT user_id, organization_id, role, s_name AS name FROM mb LEFT JOIN supplier ON 'u'||s_suppkey = user_id WHERE organization_id IN (SELECT organization_id FROM mb WHERE user_id='u7')")
def _(v):
    profiles = v.supplier.select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("user_id"), F.col("s_name").alias("name"))
    return O.member_directory(members(v), profiles, "u7").select("user_id", "organization_id", "role", "name")


@query("i25_notifications", "WITH r AS (SELECT user_id, event_id AS notice_id, ts FROM events WHERE event_type IN ('view','click') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 40), s AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type='purchase' GROUP BY 1) SELECT user_id, count(*) AS items, count(*) FILTER (seen IS NULL OR ts > seen) AS unread FROM r LEFT JOIN s USING (user_id) GROUP BY 1")
def _(v):
    n = v.events.select("user_id", F.col("event_id").alias("notice_id"), F.col("ts").alias("created_at"), "event_type")
    seen = v.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return O.notification_feed(n.filter("event_type = 'view'"), n.filter("event_type = 'click'"), seen)

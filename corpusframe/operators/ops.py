"""Corpus operations and usage: sync plans, batches, progress, readiness, quotas, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import text_of, usage_tokens
from corpusframe.operators.common import first_rows, if_small, numbered
from corpusframe.sources.checkpoints import cut

# Stages in order and their weights in the progress bar.
STAGES = {"sync": 15, "layout_parser": 15, "text_extraction": 20, "image_captioning": 15, "chunking": 13, "embedding": 14, "clustering": 8}
# States of a job, and the order in which one hides another.
STATUSES = ("queued", "running", "done", "failed")
STATUS_ORDER = ("failed", "running", "queued", "done", "canceled")
# Stage -> the stages whose work must be done before it.
EDGES = (("sync", "text_extraction"), ("text_extraction", "chunking"), ("image_captioning", "chunking"), ("chunking", "embedding"))
# Plan -> rank, monthly queries, stored bytes; null is without limit.
PLANS = (("free", 0, 500, 1 << 30), ("pro", 1, 20_000, 50 << 30), ("enterprise", 2, None, None))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """One row for each key, the last by ``order_col``; updates win ties. One shuffle."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(order_col, "_new")).alias("r")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*target.columns)


def delete_documents(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without rows of the given documents."""
    ids = doc_ids.select("doc_id").distinct()
    return {name: df.join(ids, "doc_id", "left_anti") for name, df in tables.items()}


def pending(docs: DataFrame, done: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Documents whose artefact, known by ``keys``, isn't there yet."""
    return docs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def sync_diff(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """``library_id, gdrive_file_id, change``: new, kept or deleted."""
    a = listing.select("library_id", "gdrive_file_id", F.lit(True).alias("listed")).distinct()
    b = docs.select("library_id", "gdrive_file_id", F.lit(True).alias("stored")).distinct()
    change = F.when(F.col("stored").isNull(), "new").when(F.col("listed").isNull(), "deleted").otherwise("kept")
    return a.join(b, ["library_id", "gdrive_file_id"], "full_outer").select("library_id", "gdrive_file_id", change.alias("change"))


def plan_additions(listing: DataFrame, docs: DataFrame, replace: bool = False) -> DataFrame:
    """What to do with listed files whose id is unknown: ``add``, or for a known title ``skip`` or ``replace``; of equal
    titles in the listing the first by id is taken."""
    fresh = listing.join(docs.select("library_id", "gdrive_file_id"), ["library_id", "gdrive_file_id"], "left_anti")
    once = first_rows(fresh, ["library_id", "title"], [F.col("gdrive_file_id")], 1, "_turn").drop("_turn")
    titles = docs.groupBy("library_id", "title").agg(F.min("doc_id").alias("old_doc_id"))
    action = F.when(F.col("old_doc_id").isNull(), "add").otherwise("replace" if replace else "skip")
    return once.join(titles, ["library_id", "title"], "left").select("library_id", "gdrive_file_id", "title", "old_doc_id", action.alias("action"))


def assign_batches(docs: DataFrame, workers: int, most: int = 64, start: DataFrame | None = None) -> DataFrame:
    """``batch_index`` of each document: contiguous batches of a library by external id (nulls last) and title.

    ``start`` has the highest index so far of libraries that go on: ``library_id, batch_index``.
    """
    order = [F.col("gdrive_file_id").asc_nulls_last(), F.col("title"), F.col("doc_id")]
    rows = numbered(docs, ["library_id"], order, "_at").join(docs.groupBy("library_id").agg(F.count(F.lit(1)).alias("_n")), "library_id")
    size = F.ceil(F.col("_n") / F.least(F.lit(min(workers, most)), F.col("_n")))
    index = F.floor((F.col("_at") - 1) / size).cast("long")
    if start is not None:
        rows = rows.join(if_small(start.select("library_id", F.col("batch_index").alias("_last"))), "library_id", "left")
        index = index + F.coalesce(F.col("_last") + 1, F.lit(0))
    return rows.withColumn("batch_index", index).drop("_at", "_n", "_last")


def stage_breakdown(jobs: DataFrame) -> DataFrame:
    """``library_id, stage`` with a count for each status; unknown statuses count as queued."""
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("queued")
    return jobs.withColumn("_status", status).groupBy("library_id", "stage").pivot("_status", list(STATUSES)).count().fillna(0, list(STATUSES))


def progress(jobs: DataFrame, stages: dict[str, int] = STAGES) -> DataFrame:
    """``library_id, progress``: shares done of the stages, weighed, from 0 to 100."""
    total = sum(stages.values())
    weights = F.create_map(*[F.lit(x) for s, w in stages.items() for x in (s, 100.0 * w / total)])
    each = jobs.filter(F.col("stage").isin(*stages)).groupBy("library_id", "stage").agg(F.avg((F.col("status") == "done").cast("int")).alias("share"))
    return each.groupBy("library_id").agg(F.round(F.least(F.lit(100.0), F.sum(F.col("share") * weights[F.col("stage")])), 2).alias("progress"))


def plain_progress(jobs: DataFrame, stages: int) -> DataFrame:
    """``library_id, progress``: jobs done of those that its batches need, one for each stage; from 0 to 100."""
    done = F.count_if(F.col("status") == "done")
    return jobs.groupBy("library_id").agg(F.round(100.0 * done / (F.count_distinct("batch_id") * stages), 2).alias("progress"))


def ready_batches(jobs: DataFrame, needs=("text_extraction", "image_captioning")) -> DataFrame:
    """``library_id, batch_id`` of batches all of whose jobs in each of ``needs`` are done."""
    done = [F.coalesce(F.bool_and(F.when(F.col("stage") == s, F.col("status") == "done")), F.lit(False)) for s in needs]
    ready = done[0]
    for d in done[1:]:
        ready = ready & d
    return jobs.groupBy("library_id", "batch_id").agg(ready.alias("ready")).filter("ready").drop("ready")


def missing_stages(jobs: DataFrame, edges=EDGES) -> DataFrame:
    """``library_id, batch_id, stage``: work that is due, since a stage before it is done, and has no job."""
    table = F.broadcast(jobs.sparkSession.createDataFrame(list(edges), "stage string, next string"))
    due = jobs.filter("status = 'done'").join(table, "stage").select("library_id", "batch_id", F.col("next").alias("stage")).distinct()
    return due.join(jobs.select("library_id", "batch_id", "stage"), ["library_id", "batch_id", "stage"], "left_anti")


def library_state(jobs: DataFrame, stages=tuple(STAGES)) -> DataFrame:
    """``library_id, state, next_stage``: failed, completed or processing; the earliest stage with work left."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    open_place = F.min(F.when(F.col("status") != "done", place))
    state = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_and(F.col("status") == "done"), "completed").otherwise("processing")
    rows = jobs.filter(F.col("stage").isin(*stages)).groupBy("library_id").agg(state.alias("state"), open_place.alias("p"))
    return rows.select("library_id", "state", F.get(F.array(*map(F.lit, stages)), F.col("p").cast("int") - 1).alias("next_stage"))


def stale_jobs(jobs: DataFrame, now, stale_seconds: int, max_attempts: int) -> DataFrame:
    """``job_id, action``: running jobs older than the cut-off go back to the queue, or fail after ``max_attempts``."""
    old = F.col("started_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(stale_seconds))
    return jobs.filter((F.col("status") == "running") & old).select("job_id", "library_id", F.when(F.col("attempts") >= max_attempts, "fail").otherwise("requeue").alias("action"))


def daily_series(events: DataFrame, start: str, end: str, key: str = "library_id", time: str = "started_at") -> DataFrame:
    """``key, day, n`` for every day of the range, zeros included."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    spine = events.select(key).distinct().select(key, days)
    counts = events.groupBy(key, F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, [key, "day"], "left").fillna(0, ["n"])


def usage_meter(messages: DataFrame, since) -> DataFrame:
    """``requests, tokens`` per thread since a time: assistant messages and their estimated tokens."""
    recent = messages.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return recent.groupBy("thread_id").agg(F.count_if(F.col("role") == "assistant").alias("requests"), F.sum(usage_tokens(F.col("content"))).alias("tokens"))


def library_usage(docs: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``library_id, documents, storage_bytes, chunks, nodes, edges``: what each library with documents holds."""
    out = docs.groupBy("library_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("file_size_bytes").alias("storage_bytes"))
    for name, rows in (("chunks", chunks), ("nodes", nodes), ("edges", edges)):
        out = out.join(rows.groupBy("library_id").agg(F.count(F.lit(1)).alias(name)), "library_id", "left")
    return out.fillna(0, ["chunks", "nodes", "edges"])


def quota(members: DataFrame, organizations: DataFrame, usage: DataFrame) -> DataFrame:
    """``user_id, plan, used, query_limit, exceeded``: a user's own organisations share one pool, the highest plan counts.

    ``members``: ``user_id, organization_id, role``; ``organizations``: ``organization_id, plan``; ``usage``:
    ``organization_id, used``.
    """
    plans = F.broadcast(members.sparkSession.createDataFrame(list(PLANS), "plan string, plan_rank int, query_limit long, storage_limit long"))
    plan = F.when(F.lower(text_of(F.col("plan"))).isin(*[p[0] for p in PLANS]), F.lower("plan")).otherwise("free")
    owned = members.filter("role = 'owner'").join(organizations.withColumn("plan", plan), "organization_id").join(plans, "plan").join(usage, "organization_id", "left")
    best = owned.groupBy("user_id").agg(F.max_by(F.struct("plan", "query_limit"), "plan_rank").alias("p"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"))
    return best.select("user_id", F.col("p.plan").alias("plan"), "used", F.col("p.query_limit").alias("query_limit"), F.coalesce(F.col("used") >= F.col("p.query_limit"), F.lit(False)).alias("exceeded"))


def visible_libraries(users: DataFrame, libraries: DataFrame, members: DataFrame, shares: DataFrame, grants: DataFrame) -> DataFrame:
    """``user_id, library_id, can_write``: own libraries, those of the user's organisations, those shared with them."""
    own = libraries.select(F.col("owner_id").alias("user_id"), "library_id", F.lit(True).alias("w"))
    team = members.join(libraries, "organization_id").select("user_id", "library_id", F.lit(False).alias("w"))
    shared = members.join(shares, "organization_id").select("user_id", "library_id", F.lit(False).alias("w"))
    granted = grants.select("user_id", "library_id", F.lit(True).alias("g"))
    every = own.unionByName(team).unionByName(shared).groupBy("user_id", "library_id").agg(F.bool_or("w").alias("w"))
    return every.join(users.select("user_id"), "user_id", "left_semi").join(granted, ["user_id", "library_id"], "left").select("user_id", "library_id", (F.col("w") | F.coalesce("g", F.lit(False))).alias("can_write"))


def thread_lineage(threads: DataFrame, cap: int = 50) -> DataFrame:
    """``thread_id, root_id, depth, position``: depth below the root along parents, cycles end it; roots by id.

    ``threads``: ``thread_id, parent_id, root_id, created_at``. Each round climbs one step for all threads at once.
    """
    link = threads.select(F.col("thread_id").alias("up"), F.col("parent_id").alias("next"))
    now = threads.select("thread_id", F.coalesce("root_id", "thread_id").alias("root_id"), "created_at", F.col("parent_id").alias("up"), F.lit(0).alias("depth"), F.array("thread_id").alias("seen"))
    done = None
    for _ in range(cap):
        ended = (F.col("up").isNull()) | F.array_contains("seen", F.col("up")) | F.col("next_missing")
        step = now.join(link.withColumn("found", F.lit(True)), "up", "left").withColumn("next_missing", F.col("found").isNull())
        finished = step.filter(ended).select("thread_id", "root_id", "created_at", "depth")
        done = finished if done is None else done.unionByName(finished)
        now = step.filter(~ended).select("thread_id", "root_id", "created_at", F.col("next").alias("up"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("up")).alias("seen"))
        now = cut(now)
        if now.isEmpty():
            break
    else:
        done = done.unionByName(now.select("thread_id", "root_id", "created_at", "depth"))
    order = Window.partitionBy("root_id").orderBy("depth", "created_at", "thread_id")
    return done.select("thread_id", "root_id", "depth", F.row_number().over(order).alias("position"))


def context_budget(messages: DataFrame, budget: int = 9_000) -> DataFrame:
    """``thread_id, tokens, percent, state, compact_from``: tokens of a thread against its budget; the first turn past it."""
    run = Window.partitionBy("thread_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = messages.withColumn("upto", F.sum(usage_tokens(F.col("content"))).over(run))
    rows = summed.groupBy("thread_id").agg(F.max("upto").alias("tokens"), F.min(F.when(F.col("upto") > budget, F.col("turn"))).alias("compact_from"))
    percent = F.least(F.lit(100), F.round(100 * F.col("tokens") / budget)).cast("int")
    return rows.withColumn("percent", percent).withColumn("state", F.when(F.col("percent") >= 90, "critical").when(F.col("percent") >= 75, "warn").otherwise("ok"))


def messages_with_sources(messages: DataFrame, sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Messages with an array of their sources, titles filled in; messages without sources have an empty one."""
    named = sources.join(docs.select("doc_id", "title"), "doc_id", "left")
    fields = F.struct("score", "chunk_id", "doc_id", F.coalesce("title", F.lit("Document")).alias("title"))
    grouped = named.groupBy("message_id").agg(F.sort_array(F.collect_list(fields), asc=False).alias("sources"))
    joined = messages.join(grouped, "message_id", "left")
    kind = grouped.schema["sources"].dataType
    return joined.withColumn("sources", F.coalesce("sources", F.array().cast(kind)))


def filter_logs(logs: DataFrame, status: str | None = None, library: str | None = None, text: str = "", per_stage: int = 20) -> DataFrame:
    """Per stage the first rows by status (failed first) and age (newest first) of those that fit."""
    rows = logs
    if status:
        rows = rows.filter(F.col("status") == status)
    if library:
        rows = rows.filter(F.col("library_id") == library)
    if text.strip():
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "stage", "status", "library_id")), F.lit(text.strip().lower())))
    place = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    return first_rows(rows, ["stage"], [place, F.desc("started_at"), F.col("job_id")], per_stage)


def busy_libraries(logs: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` libraries with most work under way."""
    return logs.filter(F.col("status").isin("running", "queued")).groupBy("library_id").count().orderBy(F.desc("count"), "library_id").limit(n)


def search_libraries(libraries: DataFrame, text: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "name", "source", "status", "stage"))
    return libraries.filter(F.contains(hay, F.lit(text.strip().lower())))


def stage_backlog(jobs: DataFrame) -> DataFrame:
    """``stage, waiting, libraries``: queued and running jobs and in how many libraries."""
    return jobs.filter(F.col("status").isin("queued", "running")).groupBy("stage").agg(F.count(F.lit(1)).alias("waiting"), F.count_distinct("library_id").alias("libraries"))


def recent_threads(messages: DataFrame, threads: DataFrame, text: str = "", n: int = 80) -> DataFrame:
    """The newest ``n`` threads of each scope with the start of their last message. ``threads``: ``thread_id, scope``."""
    last = messages.groupBy("thread_id").agg(F.max_by(F.left("content", F.lit(140)), F.struct("created_at", "turn")).alias("snippet"), F.max("created_at").alias("updated_at"))
    rows = threads.join(last, "thread_id")
    if text.strip():
        rows = rows.filter(F.contains(F.lower("snippet"), F.lit(text.strip().lower())))
    return first_rows(rows, ["scope"], [F.desc("updated_at"), F.col("thread_id")], n)


def member_directory(members: DataFrame, profiles: DataFrame, caller: str) -> DataFrame:
    """Members, with names, of the organisations that the caller belongs to."""
    mine = members.filter(F.col("user_id") == caller).select("organization_id")
    return members.join(mine, "organization_id", "left_semi").join(profiles, "user_id", "left")


def notification_feed(received: DataFrame, accepted: DataFrame, seen: DataFrame, n: int = 40) -> DataFrame:
    """``user_id, items, unread``: of the newest ``n`` notices of both kinds, how many are newer than last seen."""
    rows = received.select("user_id", "notice_id", "created_at").unionByName(accepted.select("user_id", "notice_id", "created_at"))
    newest = first_rows(rows, ["user_id"], [F.desc("created_at"), F.col("notice_id")], n)
    return newest.join(seen, "user_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("last_seen").isNull() | (F.col("created_at") > F.col("last_seen"))).alias("unread"))


def rows_to_series(tables: DataFrame) -> DataFrame:
    """``table_id, row_no, column, value`` of ``table_id, columns, rows``; missing cells are null."""
    rows = tables.select("table_id", "columns", F.posexplode("rows").alias("row_no", "row"))
    return rows.select("table_id", "row_no", F.posexplode("columns").alias("i", "column"), "row").select("table_id", "row_no", "column", F.get("row", F.col("i")).alias("value"))


def validate_fields(specs: DataFrame) -> DataFrame:
    """``spec_id, missing``: fields that a chart names and its table doesn't have."""
    return specs.select("spec_id", F.array_sort(F.array_except("fields", "columns")).alias("missing"))

"""From ranked rows to bounded, attributed evidence: sources, citations, budgets, markers, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import clean_text, text_of
from corpusframe.operators.common import first_rows, if_small, ordered_join
from corpusframe.operators.retrieval import union_recall

# Mode -> critic rounds, sub-queries, breadth, answer tokens, detail.
MODES = {"low": (0, 0, 1.0, 1600, "concise"), "medium": (1, 2, 1.25, 3200, "balanced"), "high": (2, 4, 1.5, 5500, "comprehensive")}
# Classes of questions that look wider.
COMPLEX = ("MULTI_HOP", "COMPARISON", "AGGREGATION", "MULTI_ENTITY")


def plan_knobs(df: DataFrame, max_k: int = 20) -> DataFrame:
    """``query_id, mode, query_class, k`` with the mode's numbers and the breadth of retrieval; unknown modes are medium."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(m, *v) for m, v in MODES.items()], "mode string, critic_rounds int, sub_queries int, breadth double, answer_tokens int, detail string"))
    mode = F.lower(F.trim(text_of(F.col("mode"))))
    known = df.withColumn("mode", F.when(mode.isin(*MODES), mode).otherwise("medium")).join(table, "mode")
    wide = F.col("query_class").isin(*COMPLEX)
    return known.select("query_id", "mode", "query_class", "critic_rounds", "sub_queries", "answer_tokens", "detail", F.when(wide, F.least(F.lit(max_k), F.floor(F.col("k") * F.col("breadth")))).otherwise(F.col("k")).cast("long").alias("breadth_k"))


def with_titles(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows with their document's title, null where unknown."""
    return rows.join(docs.select("doc_id", F.col("title").alias("doc_title")), "doc_id", "left")


def sources(rows: DataFrame, limit: int = 20) -> DataFrame:
    """``query_id, source_no, …``: rows deduplicated by chunk, or by document and pages, in rank order."""
    key = F.coalesce("chunk_id", F.concat_ws(":", "doc_id", F.col("page_start").cast("string"), F.col("page_end").cast("string")))
    once = first_rows(rows.withColumn("key", key), ["query_id", "key"], [F.col("rank")], 1, "turn")
    return first_rows(once.drop("turn", "key"), ["query_id"], [F.col("rank")], limit, "source_no")


def number_citations(rows: DataFrame, limit: int = 12) -> DataFrame:
    """``query_id, doc_id, n``: distinct documents numbered in the order in which they first appear."""
    first = rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first_rank"))
    return first_rows(first, ["query_id"], [F.col("first_rank"), F.col("doc_id")], limit, "n").select("query_id", "doc_id", "n")


def evidence_brief(rows: DataFrame, max_chars: int = 14_000, cut: int = 1_200) -> DataFrame:
    """``query_id, n_rows, brief``: numbered passages in rank order up to the first that would pass ``max_chars``.

    ``rows``: ``query_id, rank, doc_title, page_start, page_end, text``. The running length only grows, so the rows
    before the first overflow are those whose running length fits.
    """
    header = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("doc_title", F.lit("Untitled")), F.lit(" p."), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    blocks = rows.withColumn("block", F.concat(header, F.lit("\n"), F.substring(F.trim(text_of(F.col("text"))), 1, cut)))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = blocks.withColumn("used", F.sum(F.length("block") + 2).over(run)).filter(F.col("used") <= max_chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda r: r["block"]), "\n\n")
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"), joined.alias("brief"))


TITLE = "CONTEXT DOCUMENT (distilled, source-anchored evidence):"  # fixed value


def context_document(notes: DataFrame, max_chars: int = 14_000) -> DataFrame:
    """``query_id, context`` of ``query_id, note_no, sub_query, text, doc_title, page_start, page_end, visual_ids``.

    A question's notes stand under their sub-questions, first seen first. A note that doesn't fit ends its group, a heading
    that doesn't fit ends all. What fits depends on what was left out before: a fold over the groups of a question and over
    the notes of a group, as SQL expressions.
    """
    bare = lambda c: F.regexp_replace(text_of(F.col(c)), r"(?U)^\s+|\s+$", "")
    named = lambda c, other: F.when(bare(c) == "", other).otherwise(bare(c))
    pages = F.concat(F.lit(", p."), F.coalesce(F.col("page_start").cast("string"), F.lit("None")), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("None")))
    visuals = F.when(F.size("visual_ids") > 0, F.concat(F.lit(", "), F.size("visual_ids").cast("string"), F.lit(" figure/table"))).otherwise("")
    line = F.when(bare("text") != "", F.concat(F.lit("- "), bare("text"), F.lit("\n  (source: "), named("doc_title", "Untitled PDF"), pages, visuals, F.lit(")")))
    lines = notes.select("query_id", "note_no", named("sub_query", "Main question").alias("name"), line.alias("line"))
    groups = lines.groupBy("query_id", "name").agg(F.min("note_no").alias("first"), F.array_sort(F.collect_list(F.struct("note_no", "line"))).alias("notes"))
    listed = groups.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", "name", "notes"))).alias("groups"))
    state = "struct<left:int,on:boolean,text:string>"  # characters left, whether more may come, what there is

    def note(s, n):
        fits = s["on"] & n["line"].isNotNull() & (F.length(n["line"]) + 1 <= s["left"])
        on = s["on"] & (n["line"].isNull() | fits)
        return F.struct(F.when(fits, s["left"] - F.length(n["line"]) - 1).otherwise(s["left"]).alias("left"), on.alias("on"), F.when(fits, F.concat(s["text"], F.lit("\n"), n["line"])).otherwise(s["text"]).alias("text")).cast(state)

    def group(s, g):
        heading = F.concat(F.lit("\n## "), g["name"])
        fits = s["on"] & (F.length(heading) <= s["left"])
        opened = F.struct((s["left"] - F.length(heading)).alias("left"), F.lit(True).alias("on"), F.concat(s["text"], F.lit("\n"), heading).alias("text")).cast(state)
        filled = F.aggregate(g["notes"], opened, note, lambda x: x.withField("on", F.lit(True)))
        return F.when(fits, filled).otherwise(s.withField("on", F.lit(False))).cast(state)

    start = F.struct(F.lit(max_chars - len(TITLE)).alias("left"), F.lit(True).alias("on"), F.lit(TITLE).alias("text")).cast(state)
    return listed.select("query_id", F.aggregate("groups", start, group, lambda s: s["text"]).alias("context"))


def merge_notes(notes: DataFrame) -> DataFrame:
    """The first of the notes of a question that agree in chunk and, but for case and spacing, in text."""
    keyed = notes.withColumn("key", F.lower(clean_text(F.col("text"))))
    return first_rows(keyed, ["query_id", "chunk_id", "key"], [F.col("note_no")], 1, "turn").drop("turn", "key")


def chunk_visual_cards(rows: DataFrame, manifest: DataFrame, limit: int = 12) -> DataFrame:
    """``query_id, visual_id, visual_key, caption, card_no``: visuals of ranked chunks, first seen, that have an image.

    ``rows``: ``query_id, rank, visual_ids, visual_keys``; ``manifest``: ``visual_id, caption_text, short_caption``.
    """
    pairs = rows.select("query_id", "rank", F.posexplode(F.arrays_zip(F.col("visual_ids").alias("id"), F.col("visual_keys").alias("key"))).alias("pos", "v"))
    pairs = pairs.filter(F.coalesce("v.key", F.lit("")) != "")
    first = pairs.groupBy("query_id", F.col("v.id").alias("visual_id")).agg(F.min(F.struct("rank", "pos", "v.key")).alias("m"))
    cards = first.join(manifest, "visual_id", "left").withColumn("caption", F.coalesce(F.nullif("caption_text", F.lit("")), "short_caption", F.lit("")))
    return first_rows(cards, ["query_id"], [F.col("m.rank"), F.col("m.pos"), F.col("visual_id")], limit, "card_no").select("query_id", "visual_id", F.col("m.key").alias("visual_key"), "caption", "card_no")


def _strip(answer: Column, wrong: Column, before: str) -> Column:
    return F.aggregate(wrong, answer, lambda t, m: F.replace(t, F.concat(F.lit(before), m, F.lit("]]")), F.lit("")))


def resolve_markers(answers: DataFrame, cites: DataFrame, visuals: DataFrame, max_visuals: int = 3) -> DataFrame:
    """``query_id, answer, citations, visuals``: markers that name something known, the others taken out of the answer.

    ``[[CITE:n]]`` counts if ``cites`` (``query_id, n``) has n; ``[[VISUAL:id]]`` if ``visuals`` (``query_id,
    visual_id``) has it and fewer than ``max_visuals`` came before. Citations are sorted, visuals in order.
    """
    found = answers.select("query_id", "answer", F.regexp_extract_all("answer", F.lit(r"\[\[CITE:([^\]]+)\]\]"), F.lit(1)).alias("cs"), F.regexp_extract_all("answer", F.lit(r"\[\[VISUAL:([^\]]+)\]\]"), F.lit(1)).alias("vs"))
    known_c = cites.groupBy("query_id").agg(F.collect_set(F.col("n").cast("string")).alias("kc"))
    known_v = visuals.groupBy("query_id").agg(F.collect_set("visual_id").alias("kv"))
    rows = found.join(known_c, "query_id", "left").join(known_v, "query_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("kc", F.coalesce("kc", none)).withColumn("kv", F.coalesce("kv", none))
    valid_v = F.slice(F.array_distinct(F.filter(F.transform("vs", lambda x: F.trim(x)), lambda x: F.array_contains("kv", x))), 1, max_visuals)
    valid_c = F.array_sort(F.transform(F.array_distinct(F.filter(F.transform("cs", lambda x: F.trim(x)), lambda x: F.array_contains("kc", x))), lambda x: x.cast("int")))
    rows = rows.withColumn("ok_v", valid_v).withColumn("ok_c", valid_c)
    wrong_v = F.filter("vs", lambda x: ~F.array_contains("ok_v", F.trim(x)))
    wrong_c = F.filter("cs", lambda x: ~F.array_contains("kc", F.trim(x)))
    return rows.select("query_id", F.trim(_strip(_strip(F.col("answer"), wrong_v, "[[VISUAL:"), wrong_c, "[[CITE:")).alias("answer"), F.col("ok_c").alias("citations"), F.col("ok_v").alias("visuals"))


def parse_answer_flags(answer: Column) -> tuple[Column, Column]:
    """The answer without its closing ``SOURCES_USED: yes|no`` line and inline ``(Source: …)`` remarks, and the flag.

    A missing flag counts as used.
    """
    t = F.trim(text_of(answer))
    flag = F.lower(F.regexp_extract(t, r"(?im)^\s*SOURCES_USED\s*:\s*(yes|no)\s*$", 1))
    cleaned = F.regexp_replace(t, r"(?im)^\s*SOURCES_USED\s*:\s*(yes|no)\s*$", "")
    cleaned = F.regexp_replace(cleaned, r"(?i)[ \t]*\(sources?:[^)]*\)", "")
    return F.trim(F.regexp_replace(cleaned, r"^\s+|\s+$", "")), flag != "no"


def ground(df: DataFrame, min_conf: float = 0.0) -> DataFrame:
    """``grounded, confidence, abstained`` of ``sources_used, n_citations, n_sources, grade, max_score``."""
    grounded = F.col("sources_used") | (F.col("n_citations") > 0)
    confidence = F.round(F.coalesce("grade", F.greatest(F.lit(0.0), F.coalesce("max_score", F.lit(0.0)))), 4)
    forced = F.lit(min_conf > 0) & (confidence < min_conf)
    kept = F.when(grounded, F.col("n_sources")).otherwise(0)
    return df.withColumn("grounded", grounded).withColumn("confidence", confidence).withColumn("abstained", forced | (kept == 0))


def weak_evidence(df: DataFrame, least: float = 0.45, factor: float = 1.5) -> DataFrame:
    """Questions to ask again with more rows, ``query_id, k``: graded insufficient, or below ``least``. No cap on k."""
    return df.filter(~F.coalesce("sufficient", F.lit(True)) | (F.col("confidence") < least)).select("query_id", F.floor(F.col("k") * factor).cast("long").alias("k"))


def broadened(flagged: DataFrame, queries: DataFrame, search) -> DataFrame:
    """The recall of flagged questions anew: ``search(queries)`` gives ``query_id, sub_no, chunk_id, rank``, of which each
    question gets its larger ``k``, every chunk once. Questions that aren't flagged are not searched."""
    again = search(queries.join(flagged.select("query_id"), "query_id", "left_semi"))
    kept = again.join(flagged, "query_id").filter("rank <= k").select(F.col("query_id").alias("question_id"), "sub_no", "rank", "chunk_id")
    return union_recall(kept)


def library_documents(chunks: DataFrame, max_docs: int = 60, max_chunks: int = 400, max_rows: int = 20_000) -> DataFrame:
    """``library_id, doc_id, n_chunks, text, truncated``: whole documents of a library in id order, chunks in order."""
    rows = first_rows(chunks, ["library_id"], [F.col("doc_id"), F.col("chunk_index")], max_rows, "row_no")
    numbered = rows.withColumn("doc_no", F.dense_rank().over(Window.partitionBy("library_id").orderBy("doc_id"))).withColumn("chunk_no", F.row_number().over(Window.partitionBy("library_id", "doc_id").orderBy("chunk_index")))
    kept = numbered.filter((F.col("doc_no") <= max_docs) & (F.col("chunk_no") <= max_chunks))
    size = chunks.groupBy("library_id").agg(F.count_distinct("doc_id").alias("n_docs"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda c: c["text"]), "\n\n")
    docs = kept.groupBy("library_id", "doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), text.alias("text"))
    return docs.join(if_small(size), "library_id").withColumn("truncated", F.col("n_docs") > max_docs).drop("n_docs")


def doc_windows(docs: DataFrame, size: int = 24_000, limit: int = 8) -> DataFrame:
    """``doc_id, window_no, text``: the first ``limit`` windows of ``size`` characters."""
    count = F.least(F.lit(limit), F.ceil(F.length("text") / size)).cast("int")
    return docs.filter(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("window_no")).select("doc_id", "window_no", F.substr("text", F.col("window_no") * size + 1, F.lit(size)).alias("text"))


def combine_summaries(summaries: DataFrame) -> DataFrame:
    """``query_id, combined``: ``[i] title`` and summary, in the order of titles without regard to case."""
    numbered = summaries.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.lower("title"), "doc_id")))
    lines = numbered.withColumn("combined", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("summary")))
    return ordered_join(lines, ["query_id"], "i", "combined", "\n\n")


def conversation_prefix(messages: DataFrame, turns: int = 8, cut: int = 400) -> DataFrame:
    """``thread_id, prefix``: the last turns in order; answers of the assistant are cut."""
    recent = first_rows(messages, ["thread_id"], [F.desc("turn")], turns, "age")
    content = F.trim(text_of(F.col("content")))
    short = F.when((F.col("role") == "assistant") & (F.length(content) > cut), F.concat(F.rtrim(F.substring(content, 1, cut)), F.lit(" …"))).otherwise(content)
    lines = recent.filter(content != "").withColumn("prefix", F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), short))
    return ordered_join(lines, ["thread_id"], "turn", "prefix", "\n").select("thread_id", F.concat(F.lit("RECENT_TURNS:\n"), F.col("prefix")).alias("prefix"))

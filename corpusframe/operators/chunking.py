"""From text blocks to chunks: reading order, boundaries, the structured chunker, ids and visuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import clean_text, is_heading
from corpusframe.functions.vectors import dot
from corpusframe.operators.common import first_rows

TARGET, MOST, LEAST = 400, 650, 120  # tokens


def reading_order(blocks: DataFrame) -> DataFrame:
    """``pos`` of each block in its document: by page, top and left; blocks without a box come last on their page."""
    boxed = F.coalesce(F.size("bbox"), F.lit(-1)) == 4
    far = F.lit(1_000_000.0)
    order = Window.partitionBy("doc_id").orderBy("page", F.when(boxed, F.get("bbox", F.lit(1))).otherwise(far), F.when(boxed, F.get("bbox", F.lit(0))).otherwise(far), "block_no")
    return blocks.withColumn("pos", F.row_number().over(order) - 1)


def semantic_boundaries(blocks: DataFrame, threshold: float = 0.25) -> DataFrame:
    """``boundary``: a block whose vector, of length one, is unlike the one before it."""
    before = F.lag("embedding").over(Window.partitionBy("doc_id").orderBy("pos"))
    return blocks.withColumn("boundary", F.coalesce(dot(F.col("embedding"), before) < threshold, F.lit(False)))


_SPAN = "struct<first:int,last:int,heading:string>"
#: What the chunker knows between two blocks: the open chunk's first and last block, blocks, characters, characters of the
#: last block, blocks that aren't overlap; the heading; the next block's number; chunks that are closed.
_STATE = f"struct<first:int,last:int,n:int,chars:int,tail:int,fresh:int,heading:string,next:int,out:array<{_SPAN}>>"


def _spans(blocks, drop_overlap_tail: bool):
    """Chunks of ``blocks`` (``text, page, head, force, boundary, turns, section_heading``) as runs of the blocks that are
    no headings, by number: the rule of ``chunk_documents`` as one SQL ``aggregate``."""
    none = F.array().cast(f"array<{_SPAN}>")
    span = lambda first, last, heading: F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), heading.cast("string").alias("heading")))
    size = lambda chars: F.greatest(F.lit(1), F.floor(chars / 4))

    def step(s, b):
        length, at, full = F.length(b["text"]), s["next"], s["n"] > 0
        own = lambda test, x, y: F.when(test, x).otherwise(y)
        # a block that stands alone
        heading = F.coalesce(F.nullif(b["section_heading"], F.lit("")), s["heading"])
        alone = {"first": at, "last": at, "n": F.lit(0), "chars": F.lit(0), "tail": F.lit(0), "fresh": F.lit(0), "heading": heading, "next": at + 1, "out": F.concat(s["out"], own(full, span(s["first"], s["last"], s["heading"]), none), span(at, at, heading))}
        # a heading
        shut = full & (size(s["chars"]) >= LEAST)
        titled = {"first": own(shut, s["last"], s["first"]), "last": s["last"], "n": own(shut, F.lit(1), s["n"]), "chars": own(shut, s["tail"], s["chars"]), "tail": s["tail"], "fresh": own(shut, F.lit(0), s["fresh"]), "heading": b["text"], "next": at, "out": F.concat(s["out"], own(shut, span(s["first"], s["last"], s["heading"]), none))}
        # any other block: what is open closes before it at a boundary, and behind it when it is large enough
        before = b["boundary"] & full
        first = own(before, s["last"], own(full, s["first"], at))
        chars = own(before, s["tail"] + 2, own(full, s["chars"] + 2, F.lit(0))) + length
        behind = (size(chars) >= MOST) | ((size(chars) >= TARGET) & b["turns"])
        plain = {"first": own(behind, at, first), "last": at, "n": own(behind, F.lit(1), own(before, F.lit(1), s["n"]) + 1), "chars": own(behind, length, chars), "tail": length, "fresh": own(behind, F.lit(0), own(before, F.lit(0), s["fresh"]) + 1), "heading": s["heading"], "next": at + 1, "out": F.concat(s["out"], own(before, span(s["first"], s["last"], s["heading"]), none), own(behind, span(first, at, s["heading"]), none))}
        return F.struct(*[own(b["force"], alone[k], own(b["head"], titled[k], plain[k])).alias(k) for k in plain]).cast(_STATE)

    def end(s):
        rest = (s["n"] > 0) & ((s["fresh"] > 0) | F.lit(not drop_overlap_tail))
        return F.concat(s["out"], F.when(rest, span(s["first"], s["last"], s["heading"])).otherwise(none))

    start = F.struct(*[F.lit(0).alias(k) for k in ("first", "last", "n", "chars", "tail", "fresh")], F.lit(None).cast("string").alias("heading"), F.lit(0).alias("next"), none.alias("out")).cast(_STATE)
    return F.aggregate(blocks, start, step, end)


def chunk_documents(blocks: DataFrame, drop_overlap_tail: bool = False, compat: bool = False) -> DataFrame:
    """Chunks of ``doc_id, library_id, pos, page, block_id, text`` and, where there, ``force_chunk, locator,
    section_heading, boundary``. One shuffle, which brings a document's blocks together; nothing moves after it, and all of
    it is SQL expressions.

    A heading closes a chunk of ``LEAST`` tokens or more and heads the next; its own text is in no chunk. A chunk closes
    at ``MOST`` tokens, and at ``TARGET`` where a heading, a boundary or another page follows; its last block begins the
    next one. Blocks marked ``force_chunk`` stand alone. At the end what is open becomes a chunk, even if only the
    overlap is left, unless ``drop_overlap_tail``. ``compat`` ignores the marks that parsers set.
    """
    defaults = {"force_chunk": F.lit(False), "locator": F.lit(None).cast("string"), "section_heading": F.lit(None).cast("string"), "boundary": F.lit(False)}
    for name, value in defaults.items():
        blocks = blocks.withColumn(name, F.coalesce(F.col(name), value) if name in blocks.columns else value)
    if compat:
        blocks = blocks.withColumns({"force_chunk": defaults["force_chunk"], "locator": defaults["locator"]})
    clean = blocks.withColumn("text", clean_text(F.col("text"))).filter("text <> ''").withColumn("head", is_heading(F.col("text")))
    fields = ["pos", F.col("page").cast("long").alias("page"), "block_id", "text", F.col("force_chunk").alias("force"), "locator", "section_heading", "boundary", "head"]
    whole = clean.groupBy("library_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("b"))
    following = lambda i: F.get("b", i + 1)
    turns = lambda x, i: F.coalesce(following(i)["head"] | following(i)["boundary"] | (following(i)["page"] != x["page"]), F.lit(False))
    whole = whole.withColumn("b", F.transform("b", lambda x, i: x.withField("turns", turns(x, i))))
    whole = whole.select("library_id", "doc_id", F.filter("b", lambda x: x["force"] | ~x["head"]).alias("b"), _spans(F.col("b"), drop_overlap_tail).alias("spans"))
    rows = whole.select("library_id", "doc_id", "b", F.posexplode("spans").alias("chunk_index", "s"))
    own = rows.select("library_id", "doc_id", "chunk_index", "s.heading", F.slice("b", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1).alias("b"))
    return own.select("library_id", "doc_id", "chunk_index", F.get("b", F.lit(0))["page"].alias("page_start"), F.element_at("b", -1)["page"].alias("page_end"), F.col("heading").alias("section_heading"), F.get("b", F.lit(0))["locator"].alias("locator"), F.col("b.block_id").alias("block_ids"), F.array_join("b.text", "\n\n").alias("text"))


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk ids ``<doc>_cNNNN`` and those of the chunks before and after."""
    named = chunks.withColumn("chunk_id", F.format_string("%s_c%04d", "doc_id", F.col("chunk_index").cast("int")))
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return named.withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))


def chunk_visuals(chunks: DataFrame, attached: DataFrame) -> DataFrame:
    """``chunk_id, visual_ids``: visuals of a chunk's blocks (``attached``: ``doc_id, block_id, visual_ids``), first seen."""
    blocks = chunks.select("doc_id", "chunk_id", F.posexplode("block_ids").alias("pos", "block_id"))
    seen = blocks.join(attached, ["doc_id", "block_id"]).select("chunk_id", "pos", F.posexplode("visual_ids").alias("i", "visual_id"))
    first = seen.groupBy("chunk_id", "visual_id").agg(F.min(F.struct("pos", "i")).alias("at"))
    return first.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "visual_id"))), lambda r: r["visual_id"]).alias("visual_ids"))


def doc_anchor(blocks: DataFrame, n_blocks: int = 40, n_chars: int = 3_500) -> DataFrame:
    """``doc_id, anchor``: title and the beginning of the text, for a model to place a chunk by."""
    first = first_rows(blocks.select("doc_id", "title", "pos", "text"), ["doc_id", "title"], [F.col("pos"), F.col("text")], n_blocks)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"])
    lead = first.groupBy("doc_id", "title").agg(F.substring(F.array_join(texts, " "), 1, n_chars).alias("lead"))
    title = clean_text(F.col("title"))
    return lead.select("doc_id", F.concat(F.when(title != "", F.concat(title, F.lit("\n"))).otherwise(""), "lead").alias("anchor"))



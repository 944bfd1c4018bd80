"""Layout blocks and visuals: labels, captions, related text, ranking, tables, summaries and statistics.

Blocks are rows of ``doc_id, page, block_no, kind, x1, y1, x2, y2, text``; visuals meet text blocks by page only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import CAPTION, clean_text, is_caption_stop, text_of
from corpusframe.operators.common import first_rows, percentiles

# Labels of text regions and of regions to leave out.
TEXT_LABELS = ("text", "plain text", "title", "section header", "header", "footer", "caption", "footnote", "list", "reference", "references")
IGNORED_LABELS = ("abandon", "ignore", "background")
# Words in a visual's label that tell its kind.
TABLE_WORDS, FORMULA_WORDS, FIGURE_WORDS = ("table",), ("equation", "formula"), ("figure", "image", "graph", "chart", "picture")
PAGE = ["doc_id", "page"]


def norm_text_kind(c: Column) -> Column:
    t = F.lower(F.trim(text_of(c)))
    return F.when(t.isin(*TEXT_LABELS), "text").when(t.isin(*IGNORED_LABELS), "ignore").when(t == "table", "table").when(t.isin("figure", "image", "graph"), "figure").when(t == "", "unknown").otherwise(t)


def norm_visual_kind(c: Column) -> Column:
    t = F.lower(F.trim(text_of(c)))
    any_of = lambda *words: t.rlike("|".join(words))
    return F.when(t.isin(*IGNORED_LABELS) | (t.contains("caption") & any_of("figure", "table")), "ignore").when(any_of(*TABLE_WORDS), "table").when(any_of(*FORMULA_WORDS) | (t == "math"), "formula").when(any_of(*FIGURE_WORDS), "figure").otherwise("other")


def bbox_to_pdf(bbox: Column, scale: Column) -> Column:
    return F.transform(bbox, lambda x: x / F.when(scale <= 0, 1.0).otherwise(scale))


def text_density(blocks: DataFrame, min_chars: int = 20) -> DataFrame:
    """``char_count`` and ``needs_ocr`` of each block, ``page_needs_ocr`` of its page."""
    n = F.length(F.trim(text_of(F.col("text"))))
    rows = blocks.withColumn("char_count", n).withColumn("needs_ocr", n < min_chars)
    return rows.withColumn("page_needs_ocr", F.sum("char_count").over(Window.partitionBy(*PAGE)) < min_chars)


def _pairs(blocks: DataFrame) -> DataFrame:
    """Each figure or table with each text block of its page: an equi-join on the page."""
    text = blocks.filter("kind = 'text'").select(*PAGE, F.col("block_no").alias("t_no"), *[F.col(c).alias("t" + c) for c in ("x1", "y1", "x2", "y2")], F.col("text").alias("t_text"))
    visual = blocks.filter(F.col("kind").isin("figure", "table")).select(*PAGE, "block_no", "kind", "x1", "y1", "x2", "y2")
    return visual.join(text, PAGE)


def link_captions(blocks: DataFrame) -> DataFrame:
    """The nearest text block below each visual (10 above to 200 below) that overlaps it sideways."""
    overlap = F.least("x2", "tx2") - F.greatest("x1", "tx1")
    dy = F.col("ty1") - F.col("y2")
    near = _pairs(blocks).filter((F.trim(text_of(F.col("t_text"))) != "") & (overlap > 0) & dy.between(-10, 200))
    best = near.groupBy(*PAGE, "block_no").agg(F.min(F.struct(dy.alias("dy"), "t_no")).alias("m"))
    return best.select(*PAGE, "block_no", F.col("m.t_no").alias("caption_block_no"), F.round(F.greatest(F.lit(0.0), 1 - F.col("m.dy") / 200), 6).alias("score"))


def block_score() -> Column:
    """How far a text block is from a visual: below counts plain, above 1.6 times, and up to 140 for lack of overlap."""
    below, above = F.col("ty1") - F.col("y2"), F.col("y1") - F.col("ty2")
    dy = F.when(below >= 0, below).otherwise(F.abs(above) * 1.6)
    overlap = F.greatest(F.lit(0.0), F.least("x2", "tx2") - F.greatest("x1", "tx1")) / F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    return dy + (1 - overlap) * 140


def related_blocks(blocks: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` text blocks nearest to each visual, ``place`` from 1."""
    scored = _pairs(blocks).withColumn("score", F.round(block_score(), 6))
    return first_rows(scored, [*PAGE, "block_no"], [F.col("score"), F.col("t_no")], n, "place").select(*PAGE, "block_no", "kind", "t_no", "score", "t_text", "place")


def caption_candidates(blocks: DataFrame, n: int = 3) -> DataFrame:
    """Text blocks that begin like a numbered caption, nearest first, and up to eight short mentions near by."""
    text = clean_text(F.col("t_text"))
    pairs = _pairs(blocks).withColumn("t_text", text).withColumn("score", F.round(block_score() - 60, 6))
    captions = first_rows(pairs.filter(F.col("t_text").rlike(CAPTION)), [*PAGE, "block_no"], [F.col("score"), F.col("t_no")], n, "place")
    return captions.select(*PAGE, "block_no", "kind", "t_no", "score", "t_text", "place")


def mentions(blocks: DataFrame, n: int = 8) -> DataFrame:
    """Short blocks of a visual's page that speak of figures or tables, in block order."""
    text = clean_text(F.col("t_text"))
    pairs = _pairs(blocks).withColumn("t_text", text).filter(F.lower("t_text").rlike("fig|table") & (F.length("t_text") <= 300))
    return first_rows(pairs, [*PAGE, "block_no"], [F.col("t_no")], n, "place").select(*PAGE, "block_no", "kind", "t_text", "place")


def reference_number(kind: Column, text: Column) -> Column:
    """Number of the figure or table that a text names; empty without one."""
    return F.when(kind == "table", F.regexp_extract(text, r"(?i)\btable\s*(\d+)\b", 1)).otherwise(F.regexp_extract(text, r"(?i)\bfig(?:\.|ure)?\s*(\d+)\b", 1))


def choose_caption(candidates: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Of a visual's candidates the one whose number is mentioned first, else the nearest."""
    named = mentioned.withColumn("number", reference_number(F.col("kind"), F.col("t_text"))).filter("number <> ''").groupBy(*PAGE, "block_no", "number").agg(F.min("place").alias("mention"))
    rows = candidates.withColumn("number", reference_number(F.col("kind"), F.col("t_text"))).join(named, [*PAGE, "block_no", "number"], "left")
    best = F.min(F.struct(F.coalesce("mention", F.lit(1_000_000)).alias("a"), F.col("place").alias("b"), F.col("t_no").alias("t_no"), F.col("t_text").alias("caption"))).alias("m")
    return rows.groupBy(*PAGE, "block_no").agg(best).select(*PAGE, "block_no", F.col("m.t_no").alias("caption_block_no"), "m.caption")


def merge_caption(blocks: DataFrame, starts: DataFrame, most: int = 4) -> DataFrame:
    """Captions that go on: up to three following blocks, each close below the one before, overlapping it by a quarter,
    and neither a new caption nor a heading. ``starts``: ``doc_id, page, block_no`` of first blocks."""
    order = Window.partitionBy(*PAGE).orderBy("y1", "x1", "block_no", "x2", "y2", "c")  # blocks of one number and place: the same in each run
    rows = blocks.filter("kind = 'text'").withColumn("c", clean_text(F.col("text"))).filter("c <> ''")
    box = F.struct("c", "x1", "y1", "x2", "y2")
    for j in range(1, most):
        rows = rows.withColumn(f"n{j}", F.lead(box, j).over(order))
    text, before, goes = F.col("c"), box, F.lit(True)
    for j in range(1, most):
        now = F.col(f"n{j}")
        dy = now["y1"] - before["y2"]
        overlap = F.greatest(F.lit(0.0), F.least(before["x2"], now["x2"]) - F.greatest(before["x1"], now["x1"])) / F.greatest(F.lit(1.0), before["x2"] - before["x1"])
        goes = goes & F.coalesce(~now["c"].rlike(CAPTION) & ~is_caption_stop(now["c"]) & dy.between(-2, 80) & (overlap >= 0.25), F.lit(False))
        text = F.concat_ws(" ", text, F.when(goes, now["c"]))
        before = now
    return rows.withColumn("caption", text).join(starts.select(*PAGE, "block_no"), [*PAGE, "block_no"], "left_semi").select(*PAGE, "block_no", "caption")


def cross_page_caption(visuals: DataFrame, blocks: DataFrame, top: float = 220.0) -> DataFrame:
    """For visuals without a caption, the first caption-like block at the top of the next page."""
    text = blocks.filter((F.col("kind") == "text") & (F.col("y1") <= top)).select("doc_id", (F.col("page") - 1).alias("page"), F.col("block_no").alias("t_no"), clean_text(F.col("text")).alias("caption"))
    rows = visuals.select(*PAGE, "block_no", "kind").join(text, PAGE).filter((F.col("caption") != "") & (F.col("caption").rlike(CAPTION) | (reference_number(F.col("kind"), F.col("caption")) != "")))
    return rows.groupBy(*PAGE, "block_no").agg(F.min_by("caption", "t_no").alias("caption"))


def caption_near(blocks: DataFrame) -> DataFrame:
    """The best text block for a visual: nearness, less 60 for a caption's beginning, 20 for naming the kind; 800 at most."""
    pairs = _pairs(blocks).withColumn("c", clean_text(F.col("t_text"))).filter("c <> ''")
    score = block_score() - F.when(F.col("c").rlike(CAPTION), 60).otherwise(0) - F.when(F.contains(F.lower("c"), F.col("kind")), 20).otherwise(0)
    near = pairs.withColumn("score", F.round(score, 6)).filter("score <= 800")
    return near.groupBy(*PAGE, "block_no").agg(F.min(F.struct("score", "t_no", "c")).alias("m")).select(*PAGE, "block_no", "m.score", F.col("m.c").alias("caption"))


def doc_profile(blocks: DataFrame, layout: DataFrame, pages: int = 5) -> DataFrame:
    """``doc_id, profile`` from the first pages: scanned (few characters), financial_report (few mentions, many large
    visuals), else digital_text_rich. ``layout`` has raw labels in ``type``."""
    first = lambda df: df.withColumn("rank", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))).filter(F.col("rank") <= pages)
    text = first(blocks).groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"), F.sum(F.when(F.col("kind") == "text", F.length(text_of(F.col("text")))).otherwise(0)).alias("chars"), F.count_if((F.col("kind") == "text") & F.lower(text_of(F.col("text"))).rlike("fig|table")).alias("mentions"))
    area = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    big = norm_visual_kind(F.col("type")).isin("figure", "table") & (area >= 35_000)
    each = first(layout).groupBy(*PAGE).agg((F.count_if(big) >= 2).cast("int").alias("large"))
    share = each.groupBy("doc_id").agg(F.avg("large").alias("share"))
    kind = F.when(F.col("chars") / F.greatest(F.lit(1), F.col("n_pages")) < 600, "scanned").when((F.col("mentions") <= 1) & (F.coalesce("share", F.lit(0.0)) >= 0.4), "financial_report").otherwise("digital_text_rich")
    return text.join(share, "doc_id", "left").select("doc_id", kind.alias("profile"))


def importance(kind: Column, width: Column, height: Column) -> Column:
    w, h = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")), F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    middle = (F.col("y1") + F.col("y2")) / 2 / F.greatest(F.lit(1.0), height)
    bonus = F.when(kind == "table", 0.2).when(kind == "figure", 0.1).when(kind == "formula", 0.05).otherwise(0.0)
    place = F.when((middle < 0.1) | (middle > 0.9), -0.15).otherwise(0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 4 * w * h / F.greatest(F.lit(1.0), width * height)) + bonus + place)


def rank_visuals(visuals: DataFrame, width: Column, height: Column, profile: Column, top: int = 5) -> DataFrame:
    """``importance`` of visuals of 2500 square pixels or more; of financial reports the ``top`` of each page from 0.25 on."""
    rows = visuals.filter((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= 2_500).withColumn("importance", F.round(importance(F.col("kind"), width, height), 6)).withColumn("_p", profile)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("importance"), "block_no")))
    return ranked.filter((F.col("_p") != "financial_report") | ((F.col("rank") <= top) & (F.col("importance") >= 0.25))).drop("_p")


def spans_to_table(spans: DataFrame, y_tol: float = 3.5, x_gap: float = 10.0) -> DataFrame:
    """``doc_id, page, table_no, n_rows, csv``: rows of spans near the running mean of their centres, cells by gaps.

    The mean depends on the order: a fold over the spans of a table, a bounded group, gives each the number of its row. Rows
    and cells are then sorts and gaps. All of it is SQL expressions.
    """
    clean = spans.withColumn("text", clean_text(F.col("text"))).filter("text <> ''")
    kinds = [F.col(c).cast("double").alias(c) for c in ("x0", "x1")]
    centre = ((F.col("y0") + F.col("y1")) / 2).cast("double").alias("centre")
    whole = clean.groupBy("doc_id", "page", "table_no").agg(F.array_sort(F.collect_list(F.struct(centre, kinds[0], "text", kinds[1]))).alias("spans"))
    state = "struct<row:int,n:int,total:double,rows:array<int>>"

    def place(s, x):
        same = (s["n"] > 0) & (F.abs(x["centre"] - s["total"] / F.greatest(s["n"], F.lit(1))) <= y_tol)
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(row.alias("row"), F.when(same, s["n"] + 1).otherwise(1).alias("n"), F.when(same, s["total"] + x["centre"]).otherwise(x["centre"]).alias("total"), F.concat(s["rows"], F.array(row)).alias("rows")).cast(state)

    start = F.struct(F.lit(0).alias("row"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("rows")).cast(state)
    numbered = whole.withColumn("rows", F.aggregate("spans", start, place, lambda s: s["rows"]))
    # row, left edge, place in the order before, text, right edge
    sorted_spans = F.array_sort(F.transform("spans", lambda x, i: F.struct(F.get("rows", i).alias("row"), x["x0"].alias("x0"), i.alias("i"), x["text"].alias("text"), x["x1"].alias("x1"))))
    numbered = numbered.withColumn("n_rows", F.array_max("rows").cast("long")).withColumn("spans", sorted_spans)

    def joint(x, i):
        """What stands in front of a span: nothing, the end of a row, of a cell, or a space inside a cell."""
        last = F.get("spans", i - 1)
        return F.when(i == 0, "").when(last["row"] != x["row"], "\x02").when(x["x0"] - last["x1"] >= x_gap, "\x01").otherwise(" ")

    text = F.array_join(F.transform("spans", lambda x, i: F.concat(joint(x, i), F.translate(x["text"], "\x01\x02", ""))), "")
    quoted = lambda c: F.when(c.rlike(r'[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    lines = F.transform(F.split(text, "\x02"), lambda row: F.concat(F.array_join(F.transform(F.split(row, "\x01"), lambda c: quoted(F.trim(c))), ","), F.lit("\r\n")))
    return numbered.select("doc_id", "page", "table_no", "n_rows", F.array_join(lines, "").alias("csv"))


def _len(name: str) -> Column:
    return F.length(F.trim(text_of(F.col(name))))


def needs_ocr() -> Column:
    """Of ``kind, profile, caption_text, table_text, table_csv``: whether reading the picture is worth it."""
    figure = F.when((F.col("profile") == "digital_text_rich") & (_len("caption_text") >= 80), False).when(F.col("profile") == "financial_report", True).otherwise(_len("caption_text") < 40)
    return F.when(F.col("profile") == "scanned", True).when(F.col("kind") == "table", (_len("table_csv") < 120) & (_len("table_text") < 120)).when(F.col("kind") == "formula", _len("table_text") < 25).when(F.col("kind") == "figure", figure).otherwise(False)


def needs_description() -> Column:
    """Whether a model should describe the visual: what is known of it is little."""
    return F.when((F.col("kind") != "figure") & (_len("caption_text") >= 40), False).when(F.col("kind") == "table", (_len("table_csv") < 80) & (_len("table_text") < 120) & (_len("ocr_text") < 80)).when(F.col("kind") == "formula", (_len("table_text") < 25) & (_len("ocr_text") < 25)).otherwise((_len("caption_text") < 40) & (_len("ocr_text") < 80))


def summarize_visual() -> Column:
    """``short_caption, bullets, confidence, sources_used, summary_source`` by rule: caption, table text, OCR, none."""
    caption, title = clean_text(F.col("caption_text")), F.initcap("kind")
    table, ocr = (F.col("kind") == "table") & (text_of(F.col("table_text")) != ""), text_of(F.col("ocr_text")) != ""
    source = F.when(caption != "", "pdf_caption").when(table, "pdf_clip_text").when(ocr, "ocr").otherwise("none")
    short = F.when(caption != "", caption).when(table, "Table (text extracted from PDF)").when(ocr, F.concat(title, F.lit(" (OCR extracted)"))).otherwise(F.concat(title, F.lit(" (no caption found)")))
    head = lambda c: F.substring(clean_text(F.array_join(F.slice(F.filter(F.transform(F.split(text_of(F.col(c)), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3), " ")), 1, 240)
    bullets = F.array_compact(F.array(F.when(text_of(F.col("caption_text")) != "", F.substring(caption, 1, 240)), F.when(table & (F.trim("table_text") != ""), F.concat(F.lit("Table text snippet: "), head("table_text"))), F.when(ocr & (F.trim("ocr_text") != ""), F.concat(F.lit("OCR snippet: "), head("ocr_text")))))
    confidence = F.when(source == "pdf_caption", 0.85).when(source == "none", 0.35).otherwise(0.65)
    return F.struct(short.alias("short_caption"), F.slice(bullets, 1, 6).alias("bullets"), confidence.alias("confidence"), F.when(source == "none", F.array().cast("array<string>")).otherwise(F.array(source)).alias("sources_used"), source.alias("summary_source"))


# What counts as a number and as a unit.
NUMBER = r"(?i)(?<![\w])(\$?\d+(?:[.,]\d+)*(?:%|x|k|m|b)?)(?![\w])"
UNIT = r"(?i)\b(usd|eur|gbp|pkr|rs|inr|million|billion|bn|mm|%|percent)\b"


def check_facts(df: DataFrame, strict: bool = False) -> DataFrame:
    """``violations, confidence, discarded`` of ``output, evidence, confidence``: numbers and units without evidence."""
    extra = lambda p: F.size(F.array_except(F.array_distinct(F.regexp_extract_all(F.lower("output"), F.lit(p), F.lit(1))), F.regexp_extract_all(F.lower("evidence"), F.lit(p), F.lit(1))))
    rows = df.withColumn("violations", extra(NUMBER) + extra(UNIT))
    confidence = F.coalesce("confidence", F.lit(0.5))
    return rows.withColumn("confidence", F.when(F.col("violations") > 0, F.greatest(F.lit(0.1), confidence * 0.65)).otherwise(confidence)).withColumn("discarded", F.lit(strict) & (F.col("violations") > 0))


def visual_snippet(short: Column, bullets: Column, ocr: Column) -> Column:
    lines = F.transform(F.filter(F.transform(F.slice(bullets, 1, 4), lambda b: F.trim(b)), lambda b: b != ""), lambda b: F.concat(F.lit("- "), b))
    s, o = F.trim(text_of(short)), F.trim(text_of(ocr))
    return F.array_join(F.concat(F.array_compact(F.array(F.when(s != "", F.concat(F.lit("[VISUAL] "), s)))), lines, F.array_compact(F.array(F.when(o != "", F.concat(F.lit("OCR: "), F.substring(o, 1, 400)))))), "\n")


def attach_visuals(visuals: DataFrame, n: int = 3) -> DataFrame:
    """``doc_id, block_id, visual_ids``: visuals of ``doc_id, visual_no, visual_id, related`` at their first related blocks."""
    rows = visuals.select("doc_id", "visual_no", "visual_id", F.explode(F.slice("related", 1, n)).alias("block_id"))
    return rows.groupBy("doc_id", "block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("visual_no", "visual_id"))), lambda r: r["visual_id"]).alias("visual_ids"))


def layout_stats(layout: DataFrame, exact: bool = True) -> DataFrame:
    """``kind, n, mean_width, mean_height, mean_area, p10, p50, p90`` of boxes larger than a pixel, percentiles of areas.

    Exact ones are interpolated, see ``percentiles``; else a sketch that tasks merge gives neighbouring areas.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = layout.withColumn("kind", norm_text_kind(F.col("type"))).filter((w > 1) & (h > 1)).withColumn("area", w * h)
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    means = [F.count(F.lit(1)).alias("n"), F.round(F.avg(w), 4).alias("mean_width"), F.round(F.avg(h), 4).alias("mean_height"), F.round(F.avg("area"), 4).alias("mean_area")]
    if not exact:
        return rows.groupBy("kind").agg(*means, *[F.percentile_approx("area", q, 10_000).cast("double").alias(name) for name, q in shares.items()])
    places = percentiles(rows, ["kind"], "area", shares)
    return rows.groupBy("kind").agg(*means).join(places.select("kind", *[F.round(p, 4).alias(p) for p in shares]), "kind")

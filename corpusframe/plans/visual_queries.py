"""Registered queries: layout and visuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.operators import visuals as U
from corpusframe.plans.registry import query

TEXT = "CASE WHEN block_no % 3 = 0 THEN concat('Figure ', block_no, ': on it') WHEN block_no % 3 = 1 THEN concat('see  table ', block_no + 1, ' and figure 3') ELSE 'plain words of a paragraph' END"
LB = f"lb AS (SELECT page_key AS doc_id, 0 AS page, block_no, CASE type WHEN 'plain text' THEN 'text' WHEN 'Table' THEN 'table' ELSE 'figure' END AS kind, x1, y1, x2, y2, regexp_replace({TEXT}, '\\s+', ' ', 'g') AS text FROM v_layout)"
PR = f"""{LB}, pr AS (SELECT v.doc_id, v.block_no, v.kind, v.x1, v.y1, v.x2, v.y2, t.block_no AS t_no, t.text, t.x1 AS tx1, t.y1 AS ty1, t.x2 AS tx2, t.y2 AS ty2,
 CASE WHEN t.y1-v.y2 >= 0 THEN t.y1-v.y2 ELSE abs(v.y1-t.y2)*1.6 END + (1-greatest(0, least(v.x2,t.x2)-greatest(v.x1,t.x1))/greatest(1, v.x2-v.x1))*140 AS s FROM lb v JOIN lb t ON v.doc_id=t.doc_id AND v.kind IN ('figure','table') AND t.kind='text')"""
CAP = "regexp_matches(text, '(?i)^(fig(ure)?|table)\\s*[.:]?\\s*\\d+')"
NUM = "CASE WHEN kind='table' THEN regexp_extract(text,'(?i)\\btable\\s*(\\d+)\\b',1) ELSE regexp_extract(text,'(?i)\\bfig(?:\\.|ure)?\\s*(\\d+)\\b',1) END"
CC = f"{PR}, cc AS (SELECT doc_id, block_no, kind, t_no, text, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY round(s-60,6), t_no) AS place FROM pr WHERE {CAP} QUALIFY place <= 3)"


def layout(v):
    return v.v_layout.select(F.col("page_key").alias("doc_id"), F.lit(0).alias("page"), "block_no", F.when(F.col("type") == "plain text", "text").otherwise(F.lower("type")).alias("kind"), "type", "x1", "y1", "x2", "y2", F.expr(TEXT).alias("text"))


@query("b1_text_kind", "SELECT page_key, block_no, CASE type WHEN 'plain text' THEN 'text' WHEN 'Table' THEN 'table' ELSE 'figure' END AS kind FROM v_layout")
def _(v):
    return v.v_layout.select("page_key", "block_no", U.norm_text_kind(F.col("type")).alias("kind"))


@query("b2_visual_kind", "SELECT page_key, block_no, CASE type WHEN 'plain text' THEN 'other' WHEN 'Table' THEN CASE WHEN block_no % 4 = 0 THEN 'ignore' ELSE 'table' END ELSE 'figure' END AS kind FROM v_layout")
def _(v):
    label = F.when((F.col("type") == "Table") & (F.col("block_no") % 4 == 0), "table_caption").otherwise(F.col("type"))
    return v.v_layout.select("page_key", "block_no", U.norm_visual_kind(label).alias("kind"))


@query("b3_bbox_to_pdf", "SELECT page_key, block_no, x1/2.0 AS x1, y1/2.0 AS y1, round(x2/2.0,6) AS x2, y2/2.0 AS y2 FROM v_layout")
def _(v):
    box = U.bbox_to_pdf(F.array("x1", "y1", "x2", "y2"), F.lit(2.0))
    return v.v_layout.select("page_key", "block_no", box.alias("box")).select("page_key", "block_no", *[F.round(F.col("box")[k], 6).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("b4_text_density", "SELECT doc_id, block_no, length(trim(text)) AS char_count, length(trim(text)) < 20 AS needs_ocr, sum(length(trim(text))) OVER (PARTITION BY doc_id, page) < 20 AS page_needs_ocr FROM v_blocks")
def _(v):
    return U.text_density(v.v_blocks).select("doc_id", "block_no", "char_count", "needs_ocr", "page_needs_ocr")


@query("b5_link_captions", f"WITH {PR} SELECT doc_id, block_no, arg_min(t_no, (ty1-y2, t_no)) AS caption_block_no, round(greatest(0, 1-min(ty1-y2)/200),6) AS score FROM pr WHERE least(x2,tx2)-greatest(x1,tx1) > 0 AND ty1-y2 BETWEEN -10 AND 200 GROUP BY 1,2")
def _(v):
    return U.link_captions(layout(v)).drop("page")


@query("b6_related_blocks", f"WITH {PR} SELECT doc_id, block_no, t_no, round(s,6) AS score, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY round(s,6), t_no) AS place FROM pr QUALIFY place <= 3")
def _(v):
    return U.related_blocks(layout(v)).select("doc_id", "block_no", "t_no", "score", "place")


@query("b7_caption_candidates", f"WITH {CC} SELECT doc_id, block_no, t_no, text, place FROM cc")
def _(v):
    return U.caption_candidates(layout(v)).select("doc_id", "block_no", "t_no", F.col("t_text").alias("text"), "place")


@query("b8_choose_caption", f"WITH {CC}, mm AS (SELECT doc_id, block_no, kind, text, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY t_no) AS place FROM pr WHERE regexp_matches(lower(text),'fig|table') QUALIFY place <= 8), nm AS (SELECT doc_id, block_no, {NUM} AS number, min(place) AS m FROM mm GROUP BY 1,2,3), c2 AS (SELECT cc.*, {NUM} AS number FROM cc) SELECT c2.doc_id, c2.block_no, arg_min(t_no, (coalesce(CASE WHEN c2.number <> '' THEN m END, 1000000), place)) AS caption_block_no FROM c2 LEFT JOIN nm ON nm.doc_id=c2.doc_id AND nm.block_no=c2.block_no AND nm.number=c2.number GROUP BY 1,2")
def _(v):
    return U.choose_caption(U.caption_candidates(layout(v)), U.mentions(layout(v))).select("doc_id", "block_no", "caption_block_no")


@query(
    "b9_merge_caption",
    f"""WITH {LB}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, block_no) AS rn FROM lb WHERE kind='text'),
g AS (SELECT a.doc_id, a.rn, b.text, {CAP.replace('text','b.text',1)} OR b.y1-a.y2 NOT BETWEEN -2 AND 80 OR greatest(0,least(a.x2,b.x2)-greatest(a.x1,b.x1))/greatest(1,a.x2-a.x1) < 0.25 AS stop FROM o a JOIN o b ON a.doc_id=b.doc_id AND b.rn=a.rn+1)
SELECT o.doc_id, o.block_no, concat_ws(' ', o.text, CASE WHEN NOT g1.stop THEN g1.text END, CASE WHEN NOT g1.stop AND NOT g2.stop THEN g2.text END, CASE WHEN NOT g1.stop AND NOT g2.stop AND NOT g3.stop THEN g3.text END) AS caption FROM o LEFT JOIN g g1 ON g1.doc_id=o.doc_id AND g1.rn=o.rn LEFT JOIN g g2 ON g2.doc_id=o.doc_id AND g2.rn=o.rn+1 LEFT JOIN g g3 ON g3.doc_id=o.doc_id AND g3.rn=o.rn+2""",
)
def _(v):
    b = layout(v)
    return U.merge_caption(b, b).drop("page")


@query("b10_cross_page", f"WITH {LB}, p AS (SELECT *, doc_id // 8 AS d, doc_id % 8 AS pg FROM lb) SELECT a.d AS doc_id, a.pg AS page, a.block_no, arg_min(b.text, b.block_no) AS caption FROM p a JOIN p b ON a.d=b.d AND b.pg=a.pg+1 AND b.kind='text' AND b.y1 <= 220 AND a.kind <> 'text' WHERE {CAP.replace('text','b.text',1)} OR (CASE WHEN a.kind='table' THEN regexp_extract(b.text,'(?i)\\btable\\s*(\\d+)\\b',1) ELSE regexp_extract(b.text,'(?i)\\bfig(?:\\.|ure)?\\s*(\\d+)\\b',1) END) <> '' GROUP BY 1,2,3")
def _(v):
    b = layout(v).withColumn("page", (F.col("doc_id") % 8).cast("int")).withColumn("doc_id", F.expr("doc_id div 8"))
    return U.cross_page_caption(b.filter("kind <> 'text'"), b)


@query("b11_caption_near", f"WITH {PR}, s AS (SELECT *, round(s - CASE WHEN {CAP} THEN 60 ELSE 0 END - CASE WHEN contains(lower(text), kind) THEN 20 ELSE 0 END, 6) AS sc FROM pr) SELECT doc_id, block_no, min(sc) AS score, arg_min(text, (sc, t_no)) AS caption FROM s WHERE sc <= 800 GROUP BY 1,2")
def _(v):
    return U.caption_near(layout(v)).drop("page")


@query(
    "b12_doc_profile",
    f"""WITH {LB}, p AS (SELECT *, doc_id // 8 AS d, doc_id % 8 AS pg FROM lb), f AS (SELECT *, dense_rank() OVER (PARTITION BY d ORDER BY pg) AS r FROM p QUALIFY r <= 5),
t AS (SELECT d, count(DISTINCT pg) AS n, sum(CASE WHEN kind='text' THEN length(text)*CASE WHEN d%2=0 THEN 9 ELSE 1 END ELSE 0 END) AS ch, count(*) FILTER (kind='text' AND regexp_matches(lower(text),'fig|table') AND d%4>0) AS m FROM f GROUP BY 1),
g AS (SELECT d, avg(l) AS sh FROM (SELECT d, pg, (count(*) FILTER (kind<>'text' AND (x2-x1)*(y2-y1)*10 >= 35000) >= 2)::INT AS l FROM f GROUP BY 1,2) GROUP BY 1)
SELECT t.d AS doc_id, CASE WHEN ch/greatest(1,n) < 600 THEN 'scanned' WHEN m <= 1 AND coalesce(sh,0) >= 0.4 THEN 'financial_report' ELSE 'digital_text_rich' END AS profile FROM t LEFT JOIN g USING (d)""",
)
def _(v):
    b = layout(v).withColumn("page", (F.col("doc_id") % 8).cast("int")).withColumn("doc_id", F.expr("doc_id div 8"))
    text = F.regexp_replace("text", r"\s+", " ")
    text = F.when(F.col("doc_id") % 4 == 0, F.translate(text, "fFtT", "....")).otherwise(text)
    long = b.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.repeat(text, F.lit(9))).otherwise(text))
    return U.doc_profile(long, b.withColumn("y2", F.col("y1") + (F.col("y2") - F.col("y1")) * 10))


@query("b13_rank_visuals", f"WITH {LB}, i AS (SELECT *, round(greatest(0, least(1, 4*greatest(1,x2-x1)*greatest(1,y2-y1)/800000.0::DOUBLE)+CASE kind WHEN 'table' THEN 0.2 ELSE 0.1 END+CASE WHEN (y1+y2)/2/1000 < 0.1 OR (y1+y2)/2/1000 > 0.9 THEN -0.15 ELSE 0.05 END),6) AS importance FROM lb WHERE kind <> 'text' AND (x2-x1)*(y2-y1) >= 2500), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, block_no) AS rank FROM i) SELECT doc_id, block_no, importance, rank FROM r WHERE doc_id % 2 = 0 OR (rank <= 5 AND importance >= 0.25)")
def _(v):
    profile = F.when(F.col("doc_id") % 2 == 0, "scanned").otherwise("financial_report")
    return U.rank_visuals(layout(v).filter("kind <> 'text'"), F.lit(800.0), F.lit(1000.0), profile).select("doc_id", "block_no", "importance", "rank")


@query(
    "b14_spans_to_table",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS doc_id, l_linestatus||l_returnflag AS text, l_linenumber*40.0::DOUBLE AS x0, l_linenumber*40.0::DOUBLE + l_quantity AS x1, (l_suppkey % 9)*2.0::DOUBLE + 4 AS centre FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY centre, x0, text, x1) AS i FROM s),
m(doc_id, i, n, total, row) AS (
 SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::BIGINT FROM o
 UNION ALL
 SELECT doc_id, i, CASE WHEN same THEN n + 1 ELSE 1 END, CASE WHEN same THEN total ELSE 0 END + centre, CASE WHEN same THEN row ELSE row + 1 END
 FROM (SELECT m.doc_id, o.i, m.n, m.total, m.row, o.centre, m.n > 0 AND abs(o.centre - m.total / greatest(m.n, 1)) <= 3.5 AS same FROM m JOIN o ON o.doc_id = m.doc_id AND o.i = m.i + 1)),
j AS (SELECT o.doc_id, m.row, o.x0, o.i, CASE WHEN lag(o.x1) OVER w IS NULL THEN '' WHEN o.x0 - lag(o.x1) OVER w >= 10 THEN ',' ELSE ' ' END||o.text AS t FROM o JOIN m USING (doc_id, i) WINDOW w AS (PARTITION BY o.doc_id, m.row ORDER BY o.x0, o.i)),
l AS (SELECT doc_id, row, string_agg(t, '' ORDER BY x0, i)||chr(13)||chr(10) AS line FROM j GROUP BY 1, 2)
SELECT doc_id, 0 AS page, 0 AS table_no, max(row) AS n_rows, string_agg(line, '' ORDER BY row) AS csv FROM l GROUP BY 1""",
)
def _(v):
    spans = v.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("table_no"), F.concat("l_linestatus", "l_returnflag").alias("text"), (F.col("l_linenumber") * 40.0).alias("x0"), (F.col("l_linenumber") * 40.0 + F.col("l_quantity")).alias("x1"), (F.col("l_suppkey") % 9 * 2.0).alias("y0"), (F.col("l_suppkey") % 9 * 2.0 + 8).alias("y1"))
    return U.spans_to_table(spans)


RT = "SELECT page_key, block_no, CASE block_no % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'formula' END AS kind, CASE page_key % 3 WHEN 0 THEN 'scanned' WHEN 1 THEN 'digital_text_rich' ELSE 'financial_report' END AS profile, repeat('c', CAST(x1 AS INT) % 100) AS caption_text, repeat('t', CAST(y1 AS INT) % 130) AS table_text, repeat('v', CAST(x2 AS INT) % 130) AS table_csv, repeat('o', CAST(y2 AS INT) % 90) AS ocr_text FROM "


@query(
    "b15_routing",
    f"""WITH r AS ({RT} v_layout), l AS (SELECT *, length(caption_text) AS c, length(table_text) AS t, length(table_csv) AS v, length(ocr_text) AS o FROM r)
SELECT page_key, block_no, CASE WHEN profile='scanned' THEN true WHEN kind='table' THEN v < 120 AND t < 120 WHEN kind='formula' THEN t < 25 WHEN profile='digital_text_rich' AND c >= 80 THEN false WHEN profile='financial_report' THEN true ELSE c < 40 END AS ocr,
 CASE WHEN kind <> 'figure' AND c >= 40 THEN false WHEN kind='table' THEN v < 80 AND t < 120 AND o < 80 WHEN kind='formula' THEN t < 25 AND o < 25 ELSE c < 40 AND o < 80 END AS describe FROM l""",
)
def _(v):
    rows = v.spark.sql(RT + "{layout}", layout=v.v_layout)
    return rows.select("page_key", "block_no", U.needs_ocr().alias("ocr"), U.needs_description().alias("describe"))


@query(
    "b16_summary",
    """SELECT page_key, block_no, CASE WHEN block_no%4=0 THEN 'cap '||block_no WHEN block_no%4=1 THEN 'Table (text extracted from PDF)' WHEN block_no%4=2 THEN 'Table (OCR extracted)' ELSE 'Table (no caption found)' END AS short_caption, CASE WHEN block_no%4=0 THEN 0.85 WHEN block_no%4=3 THEN 0.35 ELSE 0.65 END::DOUBLE AS confidence,
 CASE WHEN block_no%4=0 THEN 'cap '||block_no WHEN block_no%4=1 THEN 'Table text snippet: a b c' WHEN block_no%4=2 THEN 'OCR snippet: o p' ELSE '' END AS bullets FROM v_layout""",
)
def _(v):
    n = F.col("block_no") % 4
    rows = v.v_layout.select("page_key", "block_no", F.lit("table").alias("kind"), F.when(n == 0, F.concat(F.lit("cap  "), "block_no")).alias("caption_text"), F.when(n == 1, "a\n\n b\nc\nd").alias("table_text"), F.when(n == 2, "o\np").alias("ocr_text"))
    return rows.withColumn("s", U.summarize_visual()).select("page_key", "block_no", "s.short_caption", "s.confidence", F.array_join("s.bullets", "|").alias("bullets"))


@query(
    "b17_check_facts",
    """WITH r AS (SELECT l_orderkey, l_linenumber, [CAST(l_quantity AS BIGINT)::VARCHAR, l_linenumber||'%', '$'||l_suppkey] AS said, [CAST(l_partkey % 50 AS BIGINT)::VARCHAR, CAST(round(l_discount*100) AS BIGINT)||'%', '$'||l_partkey % 10] AS known, l_returnflag FROM lineitem),
n AS (SELECT *, len(list_filter(said, lambda x: NOT list_contains(known, x))) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS violations FROM r)
SELECT l_orderkey, l_linenumber, violations::INT AS violations, CASE WHEN violations > 0 THEN 0.52 ELSE 0.8 END::DOUBLE AS confidence FROM n""",
)
def _(v):
    """Numbers of each line of an order, held against other numbers of it."""
    whole = lambda c: c.cast("long").cast("string")
    output = F.concat(F.lit("We sold "), whole(F.col("l_quantity")), F.lit(" at "), F.col("l_linenumber").cast("string"), F.lit("% for $"), F.col("l_suppkey").cast("string"), F.lit(" USD"))
    evidence = F.concat(F.lit("It was "), whole(F.col("l_partkey") % 50), F.lit(" with "), whole(F.round(F.col("l_discount") * 100)), F.lit("% and $"), (F.col("l_partkey") % 10).cast("string"), F.when(F.col("l_returnflag") == "R", " eur").otherwise(" usd"), F.lit(" percent %"))
    rows = v.lineitem.select("l_orderkey", "l_linenumber", output.alias("output"), evidence.alias("evidence"), F.lit(0.8).alias("confidence"))
    return U.check_facts(rows).select("l_orderkey", "l_linenumber", "violations", F.round("confidence", 6).alias("confidence"))


@query("b18_snippet", "SELECT doc_id, block_no, '[VISUAL] '||trim(left(text,10))||chr(10)||'- a'||chr(10)||'- b'||chr(10)||'OCR: '||left(trim(text),400) AS snippet FROM v_blocks WHERE trim(text) <> ''")
def _(v):
    bullets = F.array(*map(F.lit, ("a", " ", "b ", "", "e")))
    return v.v_blocks.filter("trim(text) <> ''").select("doc_id", "block_no", U.visual_snippet(F.left("text", F.lit(10)), bullets, F.col("text")).alias("snippet"))


@query("b19_attach_visuals", f"WITH {PR}, r AS (SELECT doc_id, block_no, t_no, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY round(s,6), t_no) AS place FROM pr QUALIFY place <= 3) SELECT doc_id, t_no AS block_id, string_agg(block_no::VARCHAR, ',' ORDER BY block_no) AS visual_ids FROM r GROUP BY 1,2")
def _(v):
    related = U.related_blocks(layout(v), 5).groupBy("doc_id", "block_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "t_no"))), lambda r: r["t_no"]).alias("related"))
    out = U.attach_visuals(related.select("doc_id", F.col("block_no").alias("visual_no"), F.col("block_no").cast("string").alias("visual_id"), "related"))
    return out.withColumn("visual_ids", F.array_join("visual_ids", ","))


@query("b20_layout_stats", f"WITH {LB}, a AS (SELECT kind, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area FROM lb WHERE x2-x1 > 1 AND y2-y1 > 1) SELECT kind, count(*) AS n, round(avg(w),4) AS mean_width, round(avg(h),4) AS mean_height, round(avg(area),4) AS mean_area, round(quantile_cont(area,0.1),4) AS p10, round(quantile_cont(area,0.5),4) AS p50, round(quantile_cont(area,0.9),4) AS p90 FROM a GROUP BY 1")
def _(v):
    return U.layout_stats(v.v_layout)

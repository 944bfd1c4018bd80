"""Registered queries: sources, text functions and chunking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusframe.functions import text as X
from corpusframe.operators import chunking as C
from corpusframe.plans.registry import query
from corpusframe.sources import corpus as S
from corpusframe.sources.checkpoints import shared_dir
from corpusframe.streaming import streams

CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def blocks(v):
    return v.v_blocks.select("library_id", "doc_id", "block_no", F.col("block_no").alias("pos"), "page", "block_id", "text")


@query("a1_corpus_scan", "SELECT doc_id, source AS library_id, n_chars FROM documents WHERE source IN ('src0','src3')")
def _(v):
    return S.read_corpus(v.spark, f"{v.sf_dir}/documents.parquet", ["src0", "src3"], "source").select("doc_id", F.col("source").alias("library_id"), "n_chars")


@query(
    "a2_csv_to_blocks",
    """WITH g AS (SELECT doc_id, (rn-1)//30 AS g, count(*) AS n, string_agg(line, chr(10) ORDER BY rn) AS b FROM v_table_rows GROUP BY 1,2)
SELECT doc_id, (g+1)::BIGINT AS block_no, doc_id||'!rows '||(g*30+2)||'-'||(g*30+1+n) AS locator, 'id | name | segment'||chr(10)||b AS text, true AS force_chunk FROM g
UNION ALL SELECT doc_id, 0, doc_id, 'CSV '||doc_id||': columns id, name, segment; '||count(*)||' rows.', false FROM v_table_rows GROUP BY doc_id""",
)
def _(v):
    return S.csv_to_blocks(v.v_table_rows, F.lit("id | name | segment"), F.col("doc_id"))


@query("a3_text_to_blocks", "WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.'||chr(10)||chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: x <> '') AS ps FROM v_docs) SELECT doc_id, unnest(range(len(ps)))::INT AS block_no, unnest(ps) AS text FROM p")
def _(v):
    return S.text_to_blocks(v.v_docs.withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))).select("doc_id", "block_no", "text")


@query(
    "a4_code_to_blocks",
    r"""WITH l AS (SELECT doc_id, t.n-1 AS ln, CASE WHEN (t.n-1) % 5 = 3 THEN 'def '||t.x ELSE t.x END AS x FROM v_docs, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) WITH ORDINALITY AS t(x,n)),
f AS (SELECT *, (ln % 5 = 3)::INT AS s, sum((ln % 5 = 3)::INT) OVER (PARTITION BY doc_id) AS d, sum((ln % 5 = 3)::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS u FROM l),
g AS (SELECT *, CASE WHEN d >= 2 THEN u ELSE ln // 60 END AS seg FROM f)
SELECT doc_id, doc_id||':'||(min(ln)+1)||'-'||(max(ln)+1) AS locator, regexp_replace(string_agg(x, chr(10) ORDER BY ln), '^\s+|\s+$', '', 'g') AS text FROM g GROUP BY doc_id, seg HAVING regexp_replace(string_agg(x, chr(10) ORDER BY ln), '^\s+|\s+$', '', 'g') <> ''""",
)
def _(v):
    marked = F.array_join(F.transform(F.split(F.regexp_replace("text", r"\n$", ""), "\n"), lambda x, i: F.when(i % 5 == 3, F.concat(F.lit("def "), x)).otherwise(x)), "\n")
    return S.code_to_blocks(v.v_docs.select("doc_id", F.col("doc_id").alias("title"), marked.alias("text"))).select("doc_id", "locator", "text")


def written(v, name: str) -> str:
    """A new folder for files that a query writes and reads again."""
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "a2_csv_files",
    """WITH r AS (SELECT 'nation'||c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, c_custkey||' | '||c_name||', "'||c_mktsegment||'" | '||c_mktsegment AS line FROM customer),
g AS (SELECT doc_id, (rn-1)//30 AS g, count(*) AS n, string_agg(line, chr(10) ORDER BY rn) AS b FROM r GROUP BY 1,2)
SELECT doc_id, (g+1)::BIGINT AS block_no, doc_id||'!rows '||(g*30+2)||'-'||(g*30+1+n) AS locator, 'c_custkey | label | c_mktsegment'||chr(10)||b AS text, true AS force_chunk FROM g
UNION ALL SELECT doc_id, 0, doc_id, 'CSV '||doc_id||': columns c_custkey, label, c_mktsegment; '||count(*)||' rows.', false FROM r GROUP BY doc_id""",
)
def _(v):
    """Customers as CSV files, one for each nation, with commas and quotes in a field; read again in splits."""
    path = written(v, "csv-files")
    rows = v.customer.select("c_nationkey", "c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"), "c_mktsegment")
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").write.partitionBy("c_nationkey").option("header", True).option("escape", '"').csv(path)
    return S.csv_files(v.spark, path, F.concat(F.lit("nation"), F.regexp_extract("path", r"c_nationkey=(\d+)", 1)))


@query("a3_text_files", """WITH p AS (SELECT item_id AS doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.'||chr(10)||chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: x <> '') AS ps FROM benchmark)
SELECT doc_id, unnest(range(len(ps)))::INT AS block_no, unnest(ps) AS text FROM p""")
def _(v):
    """Benchmark items as text files, one each."""
    path = written(v, "text-files")
    v.benchmark.select("item_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    return S.text_files(v.spark, path, F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long")).select("doc_id", "block_no", "text")


@query(
    "a4_code_files",
    r"""WITH l AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ln, CASE WHEN p_size % 5 = 3 THEN 'def p'||p_partkey||'():' ELSE '    '||p_name END AS x, (p_size % 5 = 3)::INT AS s FROM part),
f AS (SELECT *, sum(s) OVER (PARTITION BY p_brand) AS d, sum(s) OVER (PARTITION BY p_brand ORDER BY ln) AS u FROM l),
g AS (SELECT *, CASE WHEN d >= 2 THEN u ELSE ln // 60 END AS seg FROM f)
SELECT p_brand AS doc_id, p_brand||':'||(min(ln)+1)||'-'||(max(ln)+1) AS locator, regexp_replace(string_agg(x, chr(10) ORDER BY ln), '^\s+|\s+$', '', 'g') AS text FROM g GROUP BY p_brand, seg""",
)
def _(v):
    """Parts as source files, one for each brand."""
    path = written(v, "code-files")
    line = F.when(F.col("p_size") % 5 == 3, F.concat(F.lit("def p"), F.col("p_partkey").cast("string"), F.lit("():"))).otherwise(F.concat(F.lit("    "), "p_name"))
    lines = v.part.select("p_brand", "p_partkey", line.alias("value")).repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey")
    lines.drop("p_partkey").write.partitionBy("p_brand").text(path)
    brand = F.replace(F.regexp_extract("path", r"p_brand=([^/]+)", 1), F.lit("%23"), F.lit("#"))
    return S.code_files(v.spark, path, brand).select("doc_id", "locator", "text")


@query("a5_infer_schema", "SELECT 't' AS table_id, unnest(['amount','day','name']) AS \"column\", unnest(['number','date','string']) AS dtype, least(50000, max(o_orderkey))::BIGINT AS n_rows, max(o_orderkey) > 50000 AS truncated FROM orders")
def _(v):
    cells = v.orders.select(F.lit("t").alias("table_id"), (F.col("o_orderkey") - 1).alias("row_no"), F.explode(F.array(F.struct(F.lit("amount").alias("column"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("value")), F.struct(F.lit("day").alias("column"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")), F.struct(F.lit("name").alias("column"), F.col("o_orderstatus").alias("value")))).alias("c")).select("table_id", "row_no", "c.*")
    return S.infer_table_schema(cells)


@query(
    "a6_route_format",
    r"""WITH n AS (SELECT doc_no, lower(split_part(title,' ',1)||'.'||substr(split_part(title,' ',2),1,1)) AS name, CASE language WHEN 'en' THEN 'x/y' WHEN 'fr' THEN 'text/plain' WHEN 'de' THEN 'application/vnd.ms-excel' ELSE 'text/csv' END AS mime FROM v_docs)
SELECT doc_no, CASE WHEN contains(mime,'csv') THEN 'csv' WHEN contains(mime,'ms-excel') THEN 'xlsx' WHEN regexp_matches(name, '\.(c|h|r|m)$') THEN 'code' WHEN starts_with(mime,'text/plain') THEN 'text' END AS parser FROM n""",
)
def _(v):
    """Names from the first words of the documents, types from their languages."""
    words = F.split("title", " ")
    name = F.concat(F.get(words, F.lit(0)), F.lit("."), F.substring(F.coalesce(F.get(words, F.lit(1)), F.lit("")), 1, 1))
    mime = F.when(F.col("language") == "en", "x/y").when(F.col("language") == "fr", "Text/Plain").when(F.col("language") == "de", "application/vnd.ms-excel").otherwise("text/CSV")
    return v.v_docs.select("doc_no", X.route_format(name, mime).alias("parser"))


@query(
    "a7_ocr_pages",
    """SELECT doc_id, page::INT AS page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY block_no % 3, block_id) - 1)::INT AS block_no,
 CASE block_no % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table_text' ELSE 'figure_text' END AS kind, trim(text) AS text FROM v_blocks WHERE trim(text) <> ''""",
)
def _(v):
    kind = F.expr("CASE block_no % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table_text' ELSE 'figure_text' END")
    return S.assemble_ocr_pages(v.v_blocks.select(F.concat(F.lit("ocr/"), "doc_id", F.lit("/"), kind, F.lit("/"), "page", F.lit("_"), "block_id", F.lit(".txt")).alias("path"), "text"))


@query("a12_names", "SELECT doc_no, regexp_replace(title,'[/\\\\]','_','g') AS safe, title||CASE WHEN doc_no % 2 = 0 THEN '.pdf' ELSE '' END AS named, regexp_replace(lower(regexp_replace(title,'[^\\p{L}\\p{N}]','-','g')),'^-+|-+$','','g') AS slug FROM v_docs")
def _(v):
    mime = F.when(F.col("doc_no") % 2 == 0, "application/pdf").otherwise("x/y")
    return v.v_docs.select("doc_no", X.safe_name(F.col("title")).alias("safe"), X.ensure_extension(F.col("title"), mime).alias("named"), X.slugify(F.col("title")).alias("slug"))


@query(
    "a13_titles",
    r"""WITH r AS (SELECT doc_no, library_id, trim('in/'||CASE WHEN doc_no % 2 = 0 THEN doc_no||'_00abcdef_' ELSE doc_no||'-' END||replace(title, ' ', CASE WHEN doc_no % 3 = 0 THEN '__' ELSE '_' END)||'.txt') AS t FROM v_docs),
a AS (SELECT *, regexp_replace(regexp_extract(t, '([^/]*)$', 1), '(?i)\.[a-z0-9]{2,4}$', '') AS b FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(b, '(?i)^\d+[_-][0-9a-f]{6,}[_-]', ''), '^\d+[_-]', '') AS d FROM a),
e AS (SELECT *, trim(regexp_replace(replace(regexp_replace(d, '__+', ' — ', 'g'), '_', ' '), '\s+', ' ', 'g')) AS f FROM c)
SELECT doc_no, CASE WHEN f = '' THEN 'Document' ELSE f END AS title, CASE WHEN doc_no % 2 = 0 THEN 'abcdefghij'||doc_no ELSE library_id||'_0123456789' END AS drive_id FROM e""",
)
def _(v):
    """File names made of the documents' first words."""
    front = F.when(F.col("doc_no") % 2 == 0, F.concat(F.col("doc_no").cast("string"), F.lit("_00abcdef_"))).otherwise(F.concat(F.col("doc_no").cast("string"), F.lit("-")))
    raw = F.concat(F.lit("in/"), front, F.replace("title", F.lit(" "), F.when(F.col("doc_no") % 3 == 0, "__").otherwise("_")), F.lit(".txt"))
    url = F.when(F.col("doc_no") % 2 == 0, F.concat(F.lit("https://drive.google.com/file/d/abcdefghij"), F.col("doc_no").cast("string"), F.lit("/view"))).otherwise(F.concat(F.lit("x?id="), "library_id", F.lit("_0123456789")))
    return v.v_docs.select("doc_no", X.pretty_title(raw).alias("title"), X.drive_id(F.lit(""), url).alias("drive_id"))


@query("c1_clean_text", f"SELECT doc_no, {CLEAN} AS text FROM v_docs")
def _(v):
    return v.v_docs.select("doc_no", X.clean_text(F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit(" \t")))).alias("text"))


@query("c2_tokens", "SELECT doc_id, block_no, greatest(1, length(text)//4)::INT AS approx, ceil(length(text)/4.0)::BIGINT AS usage FROM v_blocks")
def _(v):
    return v.v_blocks.select("doc_id", "block_no", X.approx_tokens(F.col("text")).alias("approx"), X.usage_tokens(F.col("text")).alias("usage"))


HEADING = f"""(length({CLEAN}) > 0 AND length({CLEAN}) <= 90 AND NOT ({CLEAN} LIKE '%.' AND length({CLEAN}) > 25) AND ((upper({CLEAN}) = {CLEAN} AND regexp_matches({CLEAN}, '\\p{{L}}') AND length({CLEAN}) <= 60) OR ({CLEAN} LIKE '%:' AND length({CLEAN}) <= 70)
 OR (len(string_split({CLEAN},' ')) <= 8 AND len(list_filter(string_split({CLEAN},' '), lambda w: regexp_matches(w,'^\\p{{L}}'))) >= greatest(1, len(string_split({CLEAN},' '))-1) AND NOT regexp_matches(lower({CLEAN}), '^(table|figure|fig) '))))"""


@query("c3_is_heading", f"WITH b AS (SELECT doc_id, block_no, replace(text,'ß','s') AS text FROM v_blocks) SELECT doc_id, block_no, {HEADING} AS heading FROM b")
def _(v):
    return v.v_blocks.select("doc_id", "block_no", X.is_heading(F.replace("text", F.lit("ß"), F.lit("s"))).alias("heading"))


@query("c4_is_caption_stop", "WITH b AS (SELECT doc_id, block_no, trim(replace(text,'ß','s')) AS t FROM v_blocks) SELECT doc_id, block_no, length(t) > 0 AND ((length(t) <= 40 AND upper(t) = t AND regexp_matches(t,'\\p{L}')) OR (length(t) <= 25 AND t LIKE '%:')) AS stop FROM b")
def _(v):
    return v.v_blocks.select("doc_id", "block_no", X.is_caption_stop(F.replace("text", F.lit("ß"), F.lit("s"))).alias("stop"))


@query("c5_reading_order", "SELECT page_key AS doc_id, block_no, row_number() OVER (PARTITION BY page_key ORDER BY CASE WHEN block_no % 4 = 0 THEN 1000000 ELSE y1 END, CASE WHEN block_no % 4 = 0 THEN 1000000 ELSE x1 END, block_no)-1 AS pos FROM v_layout")
def _(v):
    rows = v.v_layout.select(F.col("page_key").alias("doc_id"), "block_no", F.lit(0).alias("page"), F.when(F.col("block_no") % 4 != 0, F.array("x1", "y1", "x2", "y2")).alias("bbox"))
    return C.reading_order(rows).select("doc_id", "block_no", "pos")


#: The chunker as a recursion over the blocks of a document, ``b``: library_id, doc_id, block_no, page, block_id, text.
CHUNKER = f"""c AS (SELECT library_id, doc_id, block_no, page, block_id, {CLEAN} AS text, {HEADING} AS head FROM b WHERE {CLEAN} <> ''),
x AS (SELECT *, row_number() OVER w AS i, coalesce(lead(head) OVER w OR lead(page) OVER w <> page, false) AS turns, sum(CASE WHEN head THEN 0 ELSE 1 END) OVER w - 1 AS ord, length(text) AS len, count(*) OVER (PARTITION BY doc_id) AS n_blocks FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
m(doc_id, i, f, l, n, chars, tail, heading, ef, el, eh) AS (
 SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM x
 UNION ALL
 SELECT doc_id, i, CASE WHEN head THEN CASE WHEN shut THEN l ELSE f END WHEN behind THEN ord ELSE nf END, CASE WHEN head THEN l ELSE ord END, CASE WHEN head THEN CASE WHEN shut THEN 1 ELSE n END WHEN behind THEN 1 ELSE n + 1 END,
  CASE WHEN head THEN CASE WHEN shut THEN tail ELSE chars END WHEN behind THEN len ELSE nc END, CASE WHEN head THEN tail ELSE len END, CASE WHEN head THEN text ELSE heading END,
  CASE WHEN head THEN CASE WHEN shut THEN f END WHEN behind THEN nf END, CASE WHEN head THEN l ELSE ord END, heading
 FROM (SELECT *, n > 0 AND greatest(1, chars // 4) >= 120 AS shut, greatest(1, nc // 4) >= 650 OR (greatest(1, nc // 4) >= 400 AND turns) AS behind
  FROM (SELECT m.doc_id, x.i, m.f, m.l, m.n, m.chars, m.tail, m.heading, x.head, x.text, x.ord, x.len, x.turns, CASE WHEN m.n > 0 THEN m.f ELSE x.ord END AS nf, CASE WHEN m.n > 0 THEN m.chars + 2 ELSE 0 END + x.len AS nc FROM m JOIN x ON x.doc_id = m.doc_id AND x.i = m.i + 1))),
e AS (SELECT doc_id, i, 0 AS last, ef AS f, el AS l, eh AS heading FROM m WHERE ef IS NOT NULL UNION ALL SELECT m.doc_id, m.i, 1, m.f, m.l, m.heading FROM m JOIN (SELECT doc_id, max(i) AS i FROM m GROUP BY 1) USING (doc_id, i) WHERE n > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, last) - 1 AS chunk_index FROM e),
t AS (SELECT library_id, k.doc_id, chunk_index, arg_min(page, ord) AS page_start, arg_max(page, ord) AS page_end, any_value(heading) AS section_heading, string_agg(block_id, ',' ORDER BY ord) AS block_ids, string_agg(text, chr(10)||chr(10) ORDER BY ord) AS text FROM k JOIN x ON x.doc_id = k.doc_id AND NOT x.head AND x.ord BETWEEN k.f AND k.l GROUP BY ALL)
SELECT library_id, doc_id, chunk_index::INT AS chunk_index, page_start, page_end, section_heading, block_ids, text, doc_id||'_c'||lpad(chunk_index::VARCHAR,4,'0') AS chunk_id, lag(doc_id||'_c'||lpad(chunk_index::VARCHAR,4,'0')) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev_chunk_id, lead(doc_id||'_c'||lpad(chunk_index::VARCHAR,4,'0')) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS next_chunk_id FROM t"""


@query("c6_chunk_documents", f"WITH RECURSIVE b AS (SELECT library_id, doc_id, block_no, page, block_id, replace(text,'ß','s') AS text FROM v_blocks),\n{CHUNKER}")
def _(v):
    plain = blocks(v).withColumn("text", F.replace("text", F.lit("ß"), F.lit("s")))
    return C.link_chunks(C.chunk_documents(plain)).withColumn("block_ids", F.array_join("block_ids", ",")).drop("locator")


@query(
    "k1_ingest",
    f"""WITH RECURSIVE d AS (SELECT library_id, doc_id, regexp_split_to_array(replace(replace(CASE WHEN doc_no % 5 = 0 THEN substr(text, 1, 700) ELSE text END, 'ß', 's'), '. ', '.'||chr(10)||chr(10)), '\\n\\s*\\n') AS raw FROM v_docs),
q AS (SELECT library_id, doc_id, list_filter(list_transform(raw, lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: x <> '') AS ps FROM d),
b AS (SELECT library_id, doc_id, unnest(range(len(ps))) AS block_no, 0::BIGINT AS page, 'b'||lpad(unnest(range(len(ps)))::VARCHAR,4,'0') AS block_id, unnest(ps) AS text FROM q),
{CHUNKER.replace("SELECT library_id, doc_id, chunk_index::INT", "SELECT CASE WHEN doc_id IN (SELECT doc_id FROM v_docs WHERE doc_no % 5 = 0) THEN 2 ELSE 1 END::BIGINT AS version, library_id, doc_id, chunk_index::INT")}""",
)
def _(v):
    """Documents that come as files of JSON lines, a fifth of them a second time with another text, taken in by a stream."""
    place = f"{shared_dir(v.spark)}/ingest-{uuid.uuid4().hex}"
    text = F.replace(F.replace("text", F.lit("ß"), F.lit("s")), F.lit(". "), F.lit(".\n\n"))
    docs = lambda text, version: v.v_docs.select("doc_id", "library_id", text.alias("text"), F.lit(version).cast("long").alias("version"), "doc_no")
    stream = lambda: streams.ingest_stream(v.spark, f"{place}/in", f"{place}/out", f"{place}/state").awaitTermination()
    docs(text, 1).drop("doc_no").write.option("compression", "gzip").json(f"{place}/in")
    stream()
    again = docs(F.replace(F.replace(F.substring("text", 1, 700), F.lit("ß"), F.lit("s")), F.lit(". "), F.lit(".\n\n")), 2).filter("doc_no % 5 = 0").drop("doc_no")
    again.write.mode("append").option("compression", "gzip").json(f"{place}/in")
    stream()
    return streams.current_chunks(v.spark, f"{place}/out").withColumn("block_ids", F.array_join("block_ids", ",")).drop("locator")


@query("c8_semantic_boundaries", "WITH b AS (SELECT vec_id, label AS doc_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, coalesce(list_dot_product(e, p) < 0.25, false) AS boundary FROM b")
def _(v):
    return C.semantic_boundaries(v.embeddings.select("vec_id", F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), "embedding")).select("vec_id", "boundary")


@query("c9_context_prefix", "SELECT chunk_id, CASE WHEN chunk_index % 3 = 0 THEN '' ELSE 'Document: '||library_id||' | ' END||'Pages: '||(page_start+1)||CASE WHEN chunk_index % 2 = 0 THEN '' ELSE '-'||(page_end+2) END AS prefix FROM v_chunks")
def _(v):
    return v.v_chunks.select("chunk_id", X.context_prefix(F.when(F.col("chunk_index") % 3 != 0, F.col("library_id")), F.lit(None).cast("string"), F.col("page_start"), F.col("page_end") + F.col("chunk_index") % 2).alias("prefix"))


@query("c10_embedding_text", "SELECT chunk_id, library_id||chr(10)||chr(10)||text||chr(10)||chr(10)||'a'||chr(10)||chr(10)||'b' AS embedding_text FROM v_chunks")
def _(v):
    return v.v_chunks.select("chunk_id", X.embedding_text(F.col("library_id"), F.col("text"), F.array(F.lit("a"), F.lit("b"))).alias("embedding_text"))


@query("c11_link_chunks", "SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM v_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def _(v):
    return C.link_chunks(v.v_chunks.select("doc_id", "chunk_index")).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@query("c12_chunk_visuals", "WITH s AS (SELECT doc_id||'_c'||lpad(page::VARCHAR,4,'0') AS chunk_id, unnest([block_no//2, block_no//3]) AS v, unnest([block_no*2, block_no*2+1]) AS o FROM v_blocks), f AS (SELECT chunk_id, v, min(o) AS o FROM s GROUP BY 1,2) SELECT chunk_id, string_agg(v::VARCHAR, ',' ORDER BY o) AS visual_ids FROM f GROUP BY 1")
def _(v):
    b = v.v_blocks
    chunks = b.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block_id"))), lambda x: x["block_id"]).alias("block_ids")).select("doc_id", F.format_string("%s_c%04d", "doc_id", F.col("page").cast("int")).alias("chunk_id"), "block_ids")
    attached = b.select("doc_id", "block_id", F.array(F.floor(F.col("block_no") / 2), F.floor(F.col("block_no") / 3)).alias("visual_ids"))
    return C.chunk_visuals(chunks, attached).select("chunk_id", F.array_join(F.transform("visual_ids", lambda x: x.cast("string")), ",").alias("visual_ids"))


@query("c13_doc_anchor", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS rn FROM v_blocks QUALIFY rn <= 40) SELECT doc_id, 'T '||doc_id||chr(10)||left(string_agg(text, ' ' ORDER BY block_no), 3500) AS anchor FROM r GROUP BY 1")
def _(v):
    return C.doc_anchor(blocks(v).withColumn("title", F.concat(F.lit("T "), "doc_id")))

"""Reading and writing corpora: library scans, nested logs, files as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.functions.text import text_of
from corpusframe.operators.common import first_rows
from corpusframe.operators.ops import upsert
from corpusframe.sources.checkpoints import cut

# Fixed value: how a definition begins.
DEFINITION = r"^\s*(export\s+)?(default\s+)?(async\s+)?(def|class|function|func|fn|interface|type|struct|enum|impl|module|public|private|protected|static|const\s+\w+\s*=\s*(async\s*)?\()\b"


def read_corpus(spark: SparkSession, path: str, library_ids: list[str] | None = None, key: str = "library_id") -> DataFrame:
    """Documents of the chosen libraries; where files are partitioned by ``key``, other libraries aren't read, else the
    filter is pushed into the scan."""
    df = spark.read.parquet(path)
    return df if library_ids is None else df.filter(F.col(key).isin(library_ids))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_upsert(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order_col: str, partition: str = "library_id") -> DataFrame:
    """Merges ``updates`` into the table at ``path``; returns the partitions that changed, as ``partition``.

    Only partitions that ``updates`` name are read, and of these only the ones whose rows changed are written, each once.
    So running the same updates again writes nothing. A row that moves to another partition stays in the old one: there the
    key has to hold ``partition``, or the row be deleted first.
    """
    touched = updates.select(partition).distinct()
    old = spark.read.parquet(path).join(touched, partition, "left_semi")
    merged = cut(upsert(old, updates, keys, order_col))
    state = lambda df: df.groupBy(partition).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("mark"))
    changed = cut(state(merged).join(state(old.select(*merged.columns)), [partition, "n", "mark"], "left_anti").select(partition))
    rows = merged.join(changed, partition, "left_semi")
    rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return changed


def delete_documents(spark: SparkSession, paths: dict[str, str], doc_ids: DataFrame, partition: str = "library_id") -> dict[str, int]:
    """Deletes the documents from all derived tables, ``name -> path``, and says how many partitions of each were written.

    A partition without one of the documents stays as it is, files and all; so a second run writes nothing. Partitions that
    lose rows are written once by a dynamic overwrite; of one that loses all, an empty file stays.
    """
    gone, written = cut(doc_ids.select("doc_id").distinct()), {}
    for name, path in paths.items():
        table = spark.read.parquet(path)
        folder = F.regexp_replace("_metadata.file_path", "/[^/]+$", "")
        hit = cut(table.select(partition, "doc_id", folder.alias("folder")).join(gone, "doc_id", "left_semi").select(partition, "folder").distinct())
        kept = cut(table.join(hit.select(partition).distinct(), partition, "left_semi").join(gone, "doc_id", "left_anti"))
        kept.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        for row in hit.join(kept.select(partition).distinct(), partition, "left_anti").collect():  # a row a partition
            kept.drop(partition).limit(0).write.mode("overwrite").parquet(row["folder"])
        written[name] = hit.count()
    return written


def _path() -> Column:
    """The path of a row's file, as the file system has it."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def file_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, block, seq, line`` of all files under ``path``: lines of one split (``block``: where it starts) ascend by ``seq``.

    Large files are split, so that no task reads a whole one; see ``numbered_lines``.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return lines.select(_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def numbered_lines(lines: DataFrame, name: str = "rn") -> DataFrame:
    """``path, rn, line``: lines numbered from 1 within their file, in two steps: inside each split, and by the counts of the
    splits before it, a row a split."""
    counts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("seq"))
    return lines.withColumn("_inside", inside).join(counts.select("path", "block", before.alias("_before")), ["path", "block"]).select("path", (F.col("_inside") + F.col("_before")).alias(name), "line")


FIELD = r'("(?:[^"]|"")*"|[^,]*),'
RECORD = r'((?:"(?:[^"]|"")*"|[^"\n])*)\n'


def csv_cells(line: Column) -> Column:
    """Fields of a CSV record; quotes around a field go, doubled ones inside it are one."""
    fields = F.regexp_extract_all(F.concat(F.regexp_replace(line, "\r$", ""), F.lit(",")), F.lit(FIELD), F.lit(1))
    return F.transform(fields, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def csv_files(spark: SparkSession, path: str, name: Column | None = None, multi_line: bool = False, rows_per_block: int = 30) -> DataFrame:
    """``csv_to_blocks`` of every CSV file under ``path``, its first line that isn't blank as the header.

    ``name`` makes a document's name from ``path`` (else: the file's name). Lines are read in splits; with ``multi_line``
    quoted fields may hold line breaks, and a file is read as one row.
    """
    if multi_line:
        whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True)
        records = F.regexp_extract_all(F.concat("value", F.lit("\n")), F.lit(RECORD), F.lit(1))
        lines = whole.select(_path().alias("path"), F.lit(0).alias("block"), F.posexplode(records).alias("seq", "line"))
    else:
        lines = file_lines(spark, path, "*.csv")
    cells = lines.withColumn("cells", csv_cells(F.col("line"))).filter(F.exists("cells", lambda c: F.trim(c) != ""))
    rows = numbered_lines(cells.select("path", "block", "seq", F.array_join("cells", " | ").alias("line")))
    heads = rows.filter("rn = 1").select("path", F.col("line").alias("header"))
    label = F.regexp_extract("path", r"([^/]+)$", 1) if name is None else name
    body = rows.filter("rn > 1").join(heads, "path").select(label.alias("doc_id"), (F.col("rn") - 1).alias("rn"), "line", "header")
    bare = heads.join(rows.filter("rn = 2").select("path"), "path", "left_anti").select(label.alias("doc_id"), F.lit(0).alias("rn"), F.lit(None).cast("string").alias("line"), "header")
    return csv_to_blocks(body.unionByName(bare), None, F.col("doc_id"), rows_per_block, dense=True)


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, title, text``: every file under ``path`` as one row, bytes that aren't UTF-8 replaced."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(_path().alias("path"), F.col("_metadata.file_name").alias("title"), F.col("value").alias("text"))


def text_files(spark: SparkSession, path: str, name: Column | None = None, glob: str = "*") -> DataFrame:
    """``text_to_blocks`` of every file; ``.md`` and ``.markdown`` files have headings. ``name`` as in ``csv_files``."""
    files = whole_files(spark, path, glob).withColumn("doc_id", F.col("title") if name is None else name)
    marked = F.lower("title").rlike(r"\.(md|markdown)$")
    return text_to_blocks(files.filter(marked), True).unionByName(text_to_blocks(files.filter(~marked)))


def code_files(spark: SparkSession, path: str, name: Column | None = None, glob: str = "*", window_lines: int = 60) -> DataFrame:
    """``code_to_blocks`` of every file; locators have the file's name, or ``name``."""
    files = whole_files(spark, path, glob).withColumn("doc_id", F.col("title") if name is None else name)
    return code_to_blocks(files.select("doc_id", F.col("doc_id").alias("title"), "text"), window_lines)


def ocr_files(spark: SparkSession, path: str) -> DataFrame:
    """``assemble_ocr_pages`` of the files under ``path``: ``<doc>/text/<page>_*.txt`` and so on."""
    return assemble_ocr_pages(whole_files(spark, path, "*.txt"))


def csv_to_blocks(rows: DataFrame, header: Column | None, name: Column, rows_per_block: int = 30, dense: bool = False) -> DataFrame:
    """``doc_id, block_no, locator, text, force_chunk``: a summary block, then the header with each run of rows.

    ``rows``: ``doc_id, rn`` (from 1, header not counted) and ``line``; without ``header`` also a column ``header``, and a
    null line stands for a table of no rows. Blank rows are left out before counting, unless ``dense`` says that ``rn``
    counts what stays already.
    """
    rows = rows if header is None else rows.withColumn("header", header)
    kept = rows if dense else rows.filter(F.trim(F.regexp_replace("line", r"\|", "")) != "").withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("rn")))
    grouped = kept.filter("line IS NOT NULL").withColumn("g", F.floor((F.col("rn") - 1) / rows_per_block)).groupBy("doc_id", "g").agg(F.first("header").alias("header"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda r: r["line"]).alias("lines"))
    start = F.col("g") * rows_per_block + 2
    locator = F.concat(name, F.lit("!rows "), start.cast("string"), F.lit("-"), (start + F.col("n") - 1).cast("string"))
    body = grouped.select("doc_id", (F.col("g") + 1).cast("long").alias("block_no"), locator.alias("locator"), F.concat_ws("\n", "header", F.array_join("lines", "\n")).alias("text"), F.lit(True).alias("force_chunk"))
    total = kept.groupBy("doc_id").agg(F.count("line").alias("n"), F.first("header").alias("header"))
    columns = F.array_join(F.filter(F.split("header", r" \| "), lambda c: c != ""), ", ")
    summary = total.select("doc_id", F.lit(0).cast("long").alias("block_no"), name.alias("locator"), F.concat(F.lit("CSV "), name, F.lit(": columns "), columns, F.lit("; "), F.col("n").cast("string"), F.lit(" rows.")).alias("text"), F.lit(False).alias("force_chunk"))
    return summary.unionByName(body)


def text_to_blocks(docs: DataFrame, markdown: bool = False) -> DataFrame:
    """``doc_id, block_no, text, section_heading``: paragraphs between blank lines; Markdown headings head their block."""
    parts = F.filter(F.transform(F.split(text_of(F.col("text")), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("block_no", "text"))
    heading = F.when(F.col("text").startswith("#"), F.substring(F.trim(F.regexp_replace("text", "^#+", "")), 1, 80)) if markdown else F.lit(None).cast("string")
    return rows.withColumn("section_heading", heading)


def code_to_blocks(docs: DataFrame, window_lines: int = 60) -> DataFrame:
    """``doc_id, block_no, locator, section_heading, text`` of ``doc_id, title, text``: cut before definitions where there
    are two or more, else every ``window_lines`` lines. Blocks of blank lines are left out."""
    lines = docs.select("doc_id", "title", F.posexplode(F.split(F.regexp_replace(text_of(F.col("text")), r"\n$", ""), "\n")).alias("line_no", "line"))
    of_doc = Window.partitionBy("doc_id")
    flagged = lines.withColumn("starts", F.col("line").rlike(DEFINITION).cast("int")).withColumn("definitions", F.sum("starts").over(of_doc)).withColumn("n_lines", F.count(F.lit(1)).over(of_doc))
    upto = F.sum("starts").over(of_doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    segment = flagged.withColumn("upto", upto).withColumn("seg", F.when(F.col("definitions") >= 2, F.col("upto")).otherwise(F.floor(F.col("line_no") / window_lines)))
    blocks = segment.groupBy("doc_id", "title", "seg").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.max("definitions").alias("definitions"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]).alias("lines"))
    text = F.regexp_replace(F.array_join("lines", "\n"), r"^\s+|\s+$", "")
    heading = F.when(F.col("definitions") >= 2, F.substring(F.trim(F.get(F.filter("lines", lambda x: F.trim(x) != ""), F.lit(0))), 1, 80))
    locator = F.concat("title", F.lit(":"), (F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string"))
    kept = blocks.select("doc_id", "seg", locator.alias("locator"), heading.alias("section_heading"), text.alias("text")).filter("text <> ''")
    return kept.withColumn("block_no", F.row_number().over(of_doc.orderBy("seg")) - 1).drop("seg")


def infer_table_schema(cells: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """``table_id, column, dtype, n_rows, truncated`` of ``table_id, row_no`` (from 0), ``column, value``.

    Number: every value that isn't blank parses without ``, $ %``. Date: four fifths of the first 20 look like one.
    """
    kept = cells.filter(F.col("row_no") < max_rows)
    v = F.trim(text_of(F.col("value")))
    present = kept.withColumn("v", v)
    number = F.trim(F.regexp_replace("v", "[,$%]", "")).try_cast("double").isNotNull()
    like_date = F.col("v").rlike("[-/:]") & F.col("v").rlike("[0-9]") & (F.length("v") <= 24)
    filled = present.filter("v <> ''")
    # tasks cut to 20 rows of a column before these meet; the rest is plain sums
    dates = first_rows(filled, ["table_id", "column"], [F.col("row_no")], 20).groupBy("table_id", "column").agg(F.count_if(like_date).alias("dates"))
    kinds = filled.groupBy("table_id", "column").agg(F.bool_and(number).alias("numeric"), F.count(F.lit(1)).alias("n")).join(dates, ["table_id", "column"])
    dtype = F.when(F.col("numeric"), "number").when(F.col("dates") >= F.greatest(F.lit(1), F.least(F.col("n"), F.lit(20))) * 0.8, "date").otherwise("string")
    columns = cells.groupBy("table_id", "column").agg(F.max("row_no").alias("last"))
    known = columns.join(kinds, ["table_id", "column"], "left")
    return known.select("table_id", "column", F.coalesce(dtype, F.lit("string")).alias("dtype"), F.least(F.lit(max_rows), F.col("last") + 1).cast("long").alias("n_rows"), (F.col("last") >= max_rows).alias("truncated"))


def cast_table(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Number columns as doubles; all others stay text."""
    return df.select(*[(F.trim(F.regexp_replace(c, "[,$%]", "")).try_cast("double") if schema.get(c) == "number" else F.col(c)).alias(c) for c in df.columns])


KINDS = ("text", "table_text", "figure_text")


def assemble_ocr_pages(files: DataFrame) -> DataFrame:
    """``doc_id, page, block_no, kind, text`` of ``path`` (``…/<doc>/<kind>/<page>_*.txt``) and ``text``: on each page
    text first, then tables, then figures, by file name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("doc_id"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("kind"), name.alias("name"), F.regexp_extract(name, r"^(\d+)_", 1).try_cast("int").alias("page"), F.trim("text").alias("text"))
    rows = rows.filter(F.col("kind").isin(*KINDS) & F.col("page").isNotNull() & (F.col("text") != ""))
    order = Window.partitionBy("doc_id", "page").orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "name")
    return rows.select("doc_id", "page", (F.row_number().over(order) - 1).alias("block_no"), "kind", "text")



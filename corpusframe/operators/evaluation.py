"""Evaluation reports over logs of retrieval, answers and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import text_of
from corpusframe.operators.common import first_rows, if_small

DIMENSIONS = ("hops", "language", "doc_type", "modality")


def doc_type_of(c: Column) -> Column:
    t = F.lower(text_of(c))
    return F.when(t.contains("scan"), "scanned").when(t.contains("slide"), "slides").when(t.contains("html"), "html").otherwise("pdf")


def normalize_queries(single: DataFrame | None, multi: DataFrame | None) -> DataFrame:
    """Single-hop (``uid, question, answer, doc_path, language, doc_type, source_type, reference_page``) and multi-hop
    queries (``source_type`` an array, ``steps`` of ``reference_page``) in one schema. Chains without pages count two hops."""
    parts = []
    common = [text_of(F.col("question")).alias("question"), text_of(F.col("answer")).alias("answer"), text_of(F.col("doc_path")).alias("doc_id"), F.lower(text_of(F.col("language"))).alias("language"), doc_type_of(F.col("doc_type")).alias("doc_type")]
    pages = F.coalesce("reference_page", F.array().cast("array<int>")).alias("evidence_pages")
    if single is not None:
        parts.append(single.select(F.concat(F.lit("single:"), F.col("uid")).alias("query_id"), *common, F.lit(1).alias("hops"), F.lower(F.coalesce("source_type", F.lit("text"))).alias("modality"), pages, F.array().cast("array<array<int>>").alias("evidence_chain")))
    if multi is not None:
        chain = F.filter(F.transform("steps", lambda s: s["reference_page"]), lambda p: F.coalesce(F.size(p), F.lit(0)) > 0)
        parts.append(multi.select(F.concat(F.lit("multi:"), F.col("uid")).alias("query_id"), *common, F.greatest(F.lit(2), F.coalesce(F.size(chain), F.lit(0))).alias("hops"), F.coalesce(F.get("source_type", F.lit(0)), F.lit("text")).alias("modality"), pages, chain.alias("evidence_chain")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def stratified_docs(docs: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` documents in turns over (language, doc_type); the order within a stratum is by a seeded hash."""
    turn = F.sha1(F.concat(F.lit(f"{seed}-"), F.col("doc_id")).cast("binary"))
    picked = first_rows(docs.withColumn("turn", turn), ["language", "doc_type"], [F.col("turn")], n, "rn")
    return picked.orderBy("rn", "language", "doc_type").limit(n).drop("turn")


def quota_docs(docs: DataFrame, n: int, types: list[str], seed: int = 7) -> DataFrame:
    """``n`` split evenly over ``types``, what is left over to the first ones."""
    quota = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(n // len(types) + (i < n % len(types))))])
    turn = F.sha1(F.concat(F.lit(f"{seed}-"), F.col("doc_id")).cast("binary"))
    wanted = docs.filter(F.col("doc_type").isin(*types)).withColumn("turn", turn)
    return first_rows(wanted, ["doc_type"], [F.col("turn")], n // len(types) + 1, "rn").filter(F.col("rn") <= quota[F.col("doc_type")]).drop("turn")


def select_judged(queries: DataFrame, n: int) -> DataFrame:
    """``n`` queries in turns over the numbers of hops, in id order."""
    return first_rows(queries, ["hops"], [F.col("query_id")], n, "rn").orderBy("rn", "hops").limit(n)


def bind_documents(listing: DataFrame, chunks: DataFrame) -> DataFrame:
    """``bench_doc, doc_id`` by the path in a file's title (``0001_path__part.pdf``), of documents that have chunks."""
    bench = F.regexp_replace(F.regexp_extract("title", r"^(?:\d+_)?(.*?)(?:\.[A-Za-z0-9]{2,4})?$", 1), "__", "/")
    return listing.select(bench.alias("bench_doc"), "doc_id").join(chunks.select("doc_id"), "doc_id", "left_semi").select("bench_doc", "doc_id")


def page_set(start: Column, end: Column, offset: int = 0) -> Column:
    """Pages of a span, turned round if need be; none where an end is no number."""
    a, b = start.try_cast("int") + offset, end.try_cast("int") + offset
    return F.when(a.isNotNull() & b.isNotNull(), F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array().cast("array<int>"))


def hit_at_k(rows: DataFrame, ks=(1, 3, 5), offset: int = 0, level: str = "page") -> DataFrame:
    """Adds ``hit@k`` columns to rows with ``doc_id, results, evidence_pages, evidence_chain``; no shuffle.

    Page level: each hop's pages meet the pages of the document in the first k results; null without evidence, false
    without pages. Document level: the document is among them; null for a null document.
    """
    chain = F.filter(F.coalesce("evidence_chain", F.array().cast("array<array<int>>")), lambda h: F.size(h) > 0)
    own = F.coalesce("evidence_pages", F.array().cast("array<int>"))
    evidence = F.when(F.size(chain) > 0, chain).when(F.size(own) > 0, F.array(own)).otherwise(F.array().cast("array<array<int>>"))
    out = rows.withColumn("_evidence", evidence)
    for k in ks:
        top = F.slice("results", 1, k)
        if level == "doc":
            hit = F.when(F.col("doc_id").isNotNull(), F.exists(top, lambda r: F.coalesce(r["bench_doc_id"] == F.col("doc_id"), F.lit(False))))
        else:
            pages = F.flatten(F.transform(F.filter(top, lambda r: r["bench_doc_id"] == F.col("doc_id")), lambda r: page_set(r["page_start"], r["page_end"], offset)))
            hit = F.when(F.size("_evidence") > 0, (F.size(pages) > 0) & F.forall("_evidence", lambda e: F.arrays_overlap(e, pages)))
        out = out.withColumn(f"hit@{k}", hit)
    return out.drop("_evidence")


def hit_report(hits: DataFrame, ks=(1, 3, 5), dimensions=DIMENSIONS) -> DataFrame:
    """``dimension, value, k, hit_rate, n``: overall and by each dimension, in one pass of grouping sets."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit@{k}").alias("hit")) for k in ks])).alias("p")
    flat = hits.select(*[F.coalesce(F.col(d).cast("string"), F.lit("None")).alias(d) for d in dimensions], pairs).select(*dimensions, F.col("p.k").alias("k"), F.col("p.hit").cast("int").alias("hit")).filter("hit IS NOT NULL")
    sets = flat.groupingSets([[F.col("k")], *[[F.col("k"), F.col(d)] for d in dimensions]], F.col("k"), *[F.col(d) for d in dimensions]).agg(F.grouping_id().alias("g"), F.round(F.avg("hit"), 4).alias("hit_rate"), F.count(F.lit(1)).alias("n"))
    ones = (1 << len(dimensions)) - 1
    name, value = F.lit("overall"), F.lit("all")
    for i, d in enumerate(dimensions):
        mine = F.col("g") == (ones ^ (1 << (len(dimensions) - 1 - i)))
        name, value = F.when(mine, d).otherwise(name), F.when(mine, F.col(d)).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "k", "hit_rate", "n")


def citation_scores(rows: DataFrame) -> DataFrame:
    """``precision, recall, with_citations, n`` of ``cited`` and ``evidence`` page arrays; queries without evidence don't
    count, those without citations have no precision and recall 0."""
    both = F.size(F.array_intersect("cited", "evidence"))
    scored = rows.filter(F.size("evidence") > 0).select(F.when(F.size("cited") > 0, both / F.size(F.array_distinct("cited"))).alias("p"), F.when(F.size("cited") > 0, both / F.size(F.array_distinct("evidence"))).otherwise(0.0).alias("r"), (F.size("cited") > 0).cast("int").alias("c"))
    return scored.agg(F.round(F.avg("p"), 4).alias("precision"), F.round(F.avg("r"), 4).alias("recall"), F.coalesce(F.sum("c"), F.lit(0)).alias("with_citations"), F.count(F.lit(1)).alias("n"))


def honesty(rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``quadrant, n, fraction, overconfidence`` of ``hit, abstained, confidence``: hit or miss, attempt or refuse."""
    refused = F.col("abstained") | (F.lit(threshold > 0) & F.coalesce(F.col("confidence") < threshold, F.lit(False)))
    kind = F.concat(F.when(F.col("hit"), "hit").otherwise("miss"), F.when(refused, "_refuse").otherwise("_attempt"))
    counts = rows.filter("hit IS NOT NULL").groupBy(kind.alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("quadrant") == "miss_attempt", F.col("n")).otherwise(0)).alias("over"))
    return counts.join(F.broadcast(total)).select("quadrant", "n", F.round(F.col("n") / F.col("total"), 4).alias("fraction"), F.round(F.col("over") / F.col("total"), 4).alias("overconfidence"))


def latency_summary(log: DataFrame, keys=("endpoint",)) -> DataFrame:
    """``n, mean_ms, p50_ms, p90_ms, p99_ms, per_minute`` of whole milliseconds ``ms``, percentiles by nearest rank.

    Milliseconds are counted first, so what is sorted is the distinct values, not the log.
    """
    keys = list(keys)
    counts = log.filter("ms IS NOT NULL").groupBy(*keys, "ms").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*keys).orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(whole))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) / 100.0 * (F.col("n") - 1)), F.col("ms")))
    mean = F.sum(F.col("ms") * F.col("c")) / F.sum("c")
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.round(mean, 1).alias("mean_ms"), *[at(p).alias(f"p{p}_ms") for p in (50, 90, 99)], F.round(60000.0 / mean, 2).alias("per_minute"))


def parse_judge(content: Column) -> tuple[Column, Column, Column]:
    """Score from 1 to 10, verdict and reason of a judge's answer: its JSON, fenced or among words; where that doesn't
    parse, the first number from 1 to 10; else 1."""
    t = F.trim(text_of(content))
    fenced = F.size(F.split(t, "```")) >= 3
    inner = F.when(fenced, F.regexp_replace(F.get(F.split(t, "```"), F.lit(1)), "^json", "")).otherwise(t)
    body = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.nullif(body, F.lit("")))
    field = F.get_json_object(body, "$.score")
    number = F.when(parsed.isNotNull(), F.when(field.isNull(), 1.0).otherwise(field.try_cast("double"))).when(body == "", 1.0)
    loose = F.regexp_extract(t, r"\b(10|[1-9])\b", 1).try_cast("double")
    score = F.greatest(F.lit(1), F.least(F.lit(10), F.bround(F.coalesce(number, loose, F.lit(1.0))).cast("int")))
    return score, verdict_of(score), F.when(parsed.isNotNull(), F.substring(text_of(F.get_json_object(body, "$.reason")), 1, 300)).otherwise("")


def verdict_of(score: Column) -> Column:
    return F.when(score >= 7, "correct").when(score <= 3, "incorrect").otherwise("partial")


def answer_report(rows: DataFrame) -> DataFrame:
    """``judge, hops, n, correct, partial, incorrect, mean_score`` of ``query_id, hops, judge, score``; null hops: all."""
    share = lambda v: F.round(F.avg((verdict_of(F.col("score")) == v).cast("int")), 4).alias(v)
    return rows.groupingSets([[F.col("judge")], [F.col("judge"), F.col("hops")]], F.col("judge"), F.col("hops")).agg(F.count(F.lit(1)).alias("n"), share("correct"), share("partial"), share("incorrect"), F.round(F.avg("score"), 2).alias("mean_score"))


def judge_agreement(rows: DataFrame) -> DataFrame:
    """``n, agreement``: share of queries on which all judges have one verdict."""
    each = rows.groupBy("query_id").agg((F.count_distinct(verdict_of(F.col("score"))) == 1).cast("int").alias("same"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("same"), 4).alias("agreement"))


def parse_verdict(c: Column) -> Column:
    """One word; INCORRECT is looked for before CORRECT, which it contains."""
    t = F.upper(F.trim(text_of(c)))
    return F.when(t.contains("INCORRECT"), "incorrect").when(t.contains("PARTIAL"), "partial").when(t.contains("CORRECT"), "correct").otherwise("incorrect")


def accuracy(rows: DataFrame) -> DataFrame:
    """``n, strict, lenient`` of ``verdict``; a partial answer is half a lenient one, errors don't count."""
    points = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)
    return rows.filter("verdict <> 'error'").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("verdict") == "correct").cast("int")), 4).alias("strict"), F.round(F.avg(points), 4).alias("lenient"))


def spend_ledger(calls: DataFrame, prices: DataFrame, cap: float) -> DataFrame:
    """Cost of each call, total before it in its run, and whether it may be made: the total before is below ``cap``."""
    priced = calls.join(if_small(prices), "model", "left")
    cost = F.col("in_tokens") / 1_000_000 * F.coalesce("input", F.lit(2.5)) + F.col("out_tokens") / 1_000_000 * F.coalesce("output", F.lit(10.0))
    run = Window.partitionBy("run_id").orderBy("call_id", "in_tokens", "out_tokens", "model").rowsBetween(Window.unboundedPreceding, -1)
    ledger = priced.withColumn("cost", cost).withColumn("before", F.coalesce(F.sum("cost").over(run), F.lit(0.0)))
    return ledger.select("run_id", "call_id", "model", F.round("cost", 7).alias("cost"), F.round("before", 7).alias("before"), (F.round("before", 7) < cap).alias("allowed"))


def ragas_records(rows: DataFrame) -> DataFrame:
    """Records with a question, an answer and at least one context."""
    return rows.withColumn("contexts", F.filter("contexts", lambda c: F.coalesce(c, F.lit("")) != "")).filter((F.size("contexts") > 0) & (F.coalesce("answer", F.lit("")) != "")).select("query_id", "question", "answer", "contexts", "reference")


def build_report(parts: dict[str, DataFrame]) -> DataFrame:
    """``section, item, metric, value``: reports of one line each item, put one below the other."""
    out = None
    for section, df in parts.items():
        labels = [c for c, t in df.dtypes if t == "string"]
        metrics = [c for c in df.columns if c not in labels]
        rows = df.select(F.lit(section).alias("section"), (F.concat_ws("/", *labels) if labels else F.lit("all")).alias("item"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("section", "item", "m.metric", "m.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def markdown(report: DataFrame, most: int = 10_000) -> str:
    """The report as one Markdown text; with more than ``most`` lines an error, see ``write_markdown``."""
    rows = report.orderBy("section", "item", "metric").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the report has more than {most} lines; write_markdown writes it whole")
    return "\n".join([*HEAD, *(f"| {r['section']} | {r['item']} | {r['metric']} | {r['value']} |" for r in rows)])


HEAD = ("| section | item | metric | value |", "|---|---|---|---|")


def write_markdown(report: DataFrame, path: str) -> None:
    """Lines of the report, of any length, as text files in the order of their names; ``HEAD`` goes in front of the first."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("section", "item", "metric", "value")]), F.lit(" |"))
    ordered = report.repartitionByRange("section", "item", "metric").sortWithinPartitions("section", "item", "metric")
    ordered.select(line.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)

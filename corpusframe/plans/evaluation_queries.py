"""Registered queries: evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions.text import quick_match
from corpusframe.operators import evaluation as V
from corpusframe.plans.evidence_queries import ROWS, rows
from corpusframe.plans.registry import query


def results(v):
    """Each question with its results, an evidence document and pages, and dimensions."""
    found = rows(v).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("bench_doc_id"), "page_start", "page_end"))).alias("results"), F.min_by("doc_id", F.struct((F.col("rank") % 4 != 3).cast("int"), "rank")).alias("doc_id"))
    q = v.v_queries.select("query_id", F.expr("1 + query_id % 3").alias("hops"), F.expr("CASE query_id % 2 WHEN 0 THEN 'en' END").alias("language"), F.lit("pdf").alias("doc_type"), F.expr("concat('m', CAST(query_id % 4 AS STRING))").alias("modality"), F.expr("CASE WHEN query_id % 5 = 4 THEN array() ELSE array(0, CAST(query_id % 3 AS INT)) END").cast("array<int>").alias("evidence_pages"), F.expr("CASE WHEN query_id % 5 = 1 THEN array(array(0), array(0, 1)) END").cast("array<array<int>>").alias("evidence_chain"))
    return q.join(found, "query_id", "left")


HITS = f"""{ROWS}, tg AS (SELECT query_id, arg_min(doc_id, (CASE WHEN rank%4<>3 THEN 1 ELSE 0 END, rank)) AS doc_id FROM rw GROUP BY 1),
qs AS (SELECT q.query_id, 1+q.query_id%3 AS hops, CASE WHEN q.query_id%2=0 THEN 'en' END AS language, 'pdf' AS doc_type, 'm'||(q.query_id%4) AS modality, tg.doc_id,
 CASE WHEN q.query_id%5=4 THEN [] WHEN q.query_id%5=1 THEN [[0],[0,1]] ELSE [[0, q.query_id%3]] END AS ev FROM v_queries q LEFT JOIN tg USING (query_id)),
hk AS (SELECT qs.*, k, (SELECT list(page_start) FROM rw WHERE rw.query_id=qs.query_id AND rw.doc_id=qs.doc_id AND rank <= k) AS pages FROM qs, (VALUES (1),(3),(5)) t(k)),
h AS (SELECT query_id, hops, language, doc_type, modality, k, CASE WHEN len(ev) > 0 THEN coalesce(len(pages),0) > 0 AND len(list_filter(ev, lambda e: NOT list_has_any(e, coalesce(pages,[])))) = 0 END AS hit,
 (SELECT count(*) > 0 FROM rw WHERE rw.query_id=hk.query_id AND rw.doc_id=hk.doc_id AND rank <= k) AS doc_hit FROM hk)"""


def hits(v, level="page"):
    return V.hit_at_k(results(v), level=level)


@query("h1_normalize_queries", "SELECT CASE WHEN item_id%2=0 THEN 'single:' ELSE 'multi:' END||item_id AS query_id, 'docs/'||(item_id%7) AS doc_id, CASE item_id%4 WHEN 0 THEN 'scanned' WHEN 1 THEN 'slides' WHEN 2 THEN 'html' ELSE 'pdf' END AS doc_type, CASE WHEN item_id%2=0 THEN 1 ELSE greatest(2, item_id%4) END::INT AS hops, CASE WHEN item_id%2=0 THEN 'text' ELSE 'table' END AS modality FROM benchmark")
def _(v):
    kind = "CASE item_id % 4 WHEN 0 THEN 'Scanned doc' WHEN 1 THEN 'slides' WHEN 2 THEN 'HTML page' ELSE 'x' END AS doc_type"
    base = ["CAST(item_id AS STRING) AS uid", "text AS question", "text AS answer", "concat('docs/', item_id % 7) AS doc_path", "'EN' AS language", kind, "array(1) AS reference_page"]
    single = v.benchmark.filter("item_id % 2 = 0").selectExpr(*base, "'Text' AS source_type")
    multi = v.benchmark.filter("item_id % 2 = 1").selectExpr(*base, "array('table') AS source_type", "transform(sequence(1, 4), i -> named_struct('reference_page', CASE WHEN i <= item_id % 4 THEN array(i) END)) AS steps")
    return V.normalize_queries(single, multi).select("query_id", "doc_id", "doc_type", "hops", "modality")


@query("h2_stratified_docs", "WITH r AS (SELECT doc_id, language, doc_type, row_number() OVER (PARTITION BY language, doc_type ORDER BY sha1('7-'||doc_id)) AS rn FROM v_docs) SELECT * FROM r ORDER BY rn, language, doc_type LIMIT 50")
def _(v):
    return V.stratified_docs(v.v_docs.select("doc_id", "language", "doc_type"), 50)


@query("h3_quota_docs", "SELECT doc_id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY sha1('7-'||doc_id)) AS rn FROM v_docs WHERE doc_type IN ('pdf','html','slides') QUALIFY rn <= CASE doc_type WHEN 'pdf' THEN 7 WHEN 'html' THEN 7 ELSE 6 END")
def _(v):
    return V.quota_docs(v.v_docs.select("doc_id", "doc_type"), 20, ["pdf", "html", "slides"])


@query("h4_select_judged", "WITH r AS (SELECT query_id, hops, row_number() OVER (PARTITION BY hops ORDER BY query_id) AS rn FROM v_judge) SELECT * FROM r ORDER BY rn, hops LIMIT 28")
def _(v):
    return V.select_judged(v.v_judge.select("query_id", "hops"), 28)


@query("h5_bind_documents", "SELECT 'a/'||doc_no AS bench_doc, doc_id FROM v_docs WHERE doc_id IN (SELECT doc_id FROM v_chunks)")
def _(v):
    return V.bind_documents(v.v_docs.select(F.concat(F.lpad("doc_no", 4, "0"), F.lit("_a__"), "doc_no", F.lit(".pdf")).alias("title"), "doc_id"), v.v_chunks)


@query("h6_page_spans", "SELECT chunk_id, array_to_string(range(least(page_start, 3), greatest(page_start, 3)+1), ',') AS pages FROM v_chunks")
def _(v):
    return v.v_chunks.select("chunk_id", F.array_join(V.page_set(F.col("page_start").cast("string"), F.lit(3)), ",").alias("pages"))


@query("h7_hit_at_k", f"WITH {HITS} SELECT query_id, k, hit FROM h")
def _(v):
    return hits(v).select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit@{k}").alias("hit")) for k in (1, 3, 5)])).alias("p")).select("query_id", "p.*")


@query("h8_doc_hit_at_k", f"WITH {HITS} SELECT query_id, k, doc_hit AS hit FROM h WHERE query_id IN (SELECT query_id FROM tg)")
def _(v):
    known = hits(v, "doc").filter("doc_id IS NOT NULL")
    return known.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit@{k}").alias("hit")) for k in (1, 3, 5)])).alias("p")).select("query_id", "p.*")


REPORT = f"""{HITS}, u AS (SELECT 'overall' AS dimension, 'all' AS value, k, hit FROM h UNION ALL SELECT 'hops', hops::VARCHAR, k, hit FROM h UNION ALL SELECT 'language', coalesce(language,'None'), k, hit FROM h UNION ALL SELECT 'doc_type', doc_type, k, hit FROM h UNION ALL SELECT 'modality', modality, k, hit FROM h),
rep AS (SELECT dimension, value, k, round(avg(hit::INT),4) AS hit_rate, count(*) AS n FROM u WHERE hit IS NOT NULL GROUP BY 1,2,3)"""


@query("h9_hit_report", f"WITH {REPORT} SELECT * FROM rep")
def _(v):
    return V.hit_report(hits(v))


CITE = f"{ROWS}, ct AS (SELECT query_id, coalesce(list(page_start) FILTER (rank <= 3 AND rank % 2 = query_id % 2), []) AS cited, CASE WHEN query_id % 5 = 4 THEN [] ELSE [0, 1 + query_id % 3] END AS ev FROM rw GROUP BY 1)"


def cited(v):
    return rows(v).groupBy("query_id").agg(F.collect_list(F.when((F.col("rank") <= 3) & (F.col("rank") % 2 == F.col("query_id") % 2), F.col("page_start"))).alias("cited")).withColumn("evidence", F.expr("CASE WHEN query_id % 5 = 4 THEN array() ELSE array(0L, 1 + query_id % 3) END").cast("array<bigint>"))


H10 = f"WITH {CITE}, s AS (SELECT len(list_intersect(cited, ev)) AS i, len(list_distinct(cited)) AS c, len(ev) AS e FROM ct WHERE len(ev) > 0) SELECT round(avg(CASE WHEN c > 0 THEN i/c END),4) AS precision, round(avg(CASE WHEN c > 0 THEN i/e ELSE 0 END),4) AS recall, sum((c > 0)::INT)::BIGINT AS with_citations, count(*) AS n FROM s"


@query("h10_citation_scores", H10)
def _(v):
    return V.citation_scores(cited(v))


H11 = "WITH r AS (SELECT score_a >= 5 AS hit, score_b <= 2 OR score_b/10.0 < 0.35 AS ref FROM v_judge), c AS (SELECT CASE WHEN hit THEN 'hit' ELSE 'miss' END||CASE WHEN ref THEN '_refuse' ELSE '_attempt' END AS quadrant, count(*) AS n FROM r GROUP BY 1) SELECT quadrant, n, round(n/(SELECT sum(n) FROM c),4) AS fraction, round((SELECT sum(n) FROM c WHERE quadrant='miss_attempt')/(SELECT sum(n) FROM c),4) AS overconfidence FROM c"


@query("h11_honesty", H11)
def _(v):
    return V.honesty(v.v_judge.select((F.col("score_a") >= 5).alias("hit"), (F.col("score_b") <= 2).alias("abstained"), (F.col("score_b") / 10.0).alias("confidence")), 0.35)


H12 = """WITH o AS (SELECT stage AS endpoint, elapsed_ms AS ms, row_number() OVER (PARTITION BY stage ORDER BY elapsed_ms)-1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM v_jobs)
SELECT endpoint, max(n) AS n, round(avg(ms),1) AS mean_ms, max(ms) FILTER (i = round_even(0.5*(n-1),0)) AS p50_ms, max(ms) FILTER (i = round_even(0.9*(n-1),0)) AS p90_ms, max(ms) FILTER (i = round_even(0.99*(n-1),0)) AS p99_ms, round(60000.0/avg(ms),2) AS per_minute FROM o GROUP BY 1"""


@query("h12_latency", H12)
def _(v):
    return V.latency_summary(v.v_jobs.select(F.col("stage").alias("endpoint"), F.col("elapsed_ms").alias("ms")))


@query("h13_parse_judge", "SELECT query_id, CASE query_id%4 WHEN 2 THEN score_a WHEN 3 THEN 1 ELSE score_a END::INT AS score, CASE WHEN query_id%4=3 THEN 'incorrect' WHEN score_a>=7 THEN 'correct' WHEN score_a<=3 THEN 'incorrect' ELSE 'partial' END AS verdict, CASE WHEN query_id%4 IN (0,1) THEN 'r' ELSE '' END AS reason FROM v_judge")
def _(v):
    text = F.expr("CASE query_id % 4 WHEN 0 THEN concat('```json{\"reason\": \"r\", \"score\": ', score_a, '}```') WHEN 1 THEN concat('Sure: {\"score\": ', score_a, '.2, \"reason\": \"r\"} ok') WHEN 2 THEN concat('{score is ', score_a, '} of it') ELSE 'none' END")
    score, verdict, reason = V.parse_judge(text)
    return v.v_judge.select("query_id", score.alias("score"), verdict.alias("verdict"), reason.alias("reason"))


JUDGES = "ju AS (SELECT query_id, hops, 'a' AS judge, score_a AS score FROM v_judge UNION ALL SELECT query_id, hops, 'b', score_b FROM v_judge), jv AS (SELECT *, CASE WHEN score >= 7 THEN 'correct' WHEN score <= 3 THEN 'incorrect' ELSE 'partial' END AS verdict FROM ju)"


def judges(v):
    return v.v_judge.select("query_id", "hops", F.explode(F.array(F.struct(F.lit("a").alias("judge"), F.col("score_a").alias("score")), F.struct(F.lit("b").alias("judge"), F.col("score_b").alias("score")))).alias("j")).select("query_id", "hops", "j.*")


H14 = f"WITH {JUDGES} SELECT judge, hops, count(*) AS n, round(avg((verdict='correct')::INT),4) AS correct, round(avg((verdict='partial')::INT),4) AS partial, round(avg((verdict='incorrect')::INT),4) AS incorrect, round(avg(score),2) AS mean_score FROM jv GROUP BY GROUPING SETS ((judge),(judge,hops))"


@query("h14_answer_report", H14)
def _(v):
    return V.answer_report(judges(v))


@query("h14_judge_agreement", f"WITH {JUDGES}, a AS (SELECT query_id, (count(DISTINCT verdict)=1)::INT AS same FROM jv GROUP BY 1) SELECT count(*) AS n, round(avg(same),4) AS agreement FROM a")
def _(v):
    return V.judge_agreement(judges(v))


@query("h15_quick_match", "WITH q AS (SELECT query_id, trim(lower(question)) AS r, trim(lower(gold)) AS a FROM v_queries), n AS (SELECT query_id, regexp_replace(regexp_replace(r,'[,$%]','','g'),'\\s+',' ','g') AS r, regexp_replace(regexp_replace(a,'[,$%]','','g'),'\\s+',' ','g') AS a FROM q) SELECT query_id, r <> '' AND a <> '' AND (contains(a, r) OR (len(list_filter(string_split(r,' '), lambda p: p<>'')) <= 3 AND len(list_filter(string_split(r,' '), lambda p: p<>'' AND NOT contains(a,p))) = 0)) AS matched FROM n")
def _(v):
    return v.v_queries.select("query_id", quick_match(F.col("question"), F.col("gold")).alias("matched"))


VERDICTS = """SELECT query_id, CASE WHEN contains(r,'INCORRECT') THEN 'incorrect' WHEN contains(r,'PARTIAL') THEN 'partial' WHEN contains(r,'CORRECT') THEN 'correct' ELSE 'incorrect' END AS verdict FROM (
 SELECT l.doc_id AS query_id, upper(substr(d.text,1,20)||CASE WHEN l.toxic = 1 THEN ' partial ' WHEN l.quality = 1 THEN ' Correct, ' ELSE ' in' END||CASE WHEN length(d.text) % 4 = 0 THEN 'correct' ELSE substr(d.text,21,10) END) AS r FROM labels l JOIN documents d USING (doc_id))"""


def verdicts(v):
    """Of words of judges within the texts of the labelled documents."""
    word = F.when(F.col("toxic") == 1, " partial ").when(F.col("quality") == 1, " Correct, ").otherwise(" in")
    answer = F.concat("start", word, "end")
    words = v.documents.select("doc_id", F.substring("text", 1, 20).alias("start"), F.when(F.length("text") % 4 == 0, "correct").otherwise(F.substring("text", 21, 10)).alias("end"))  # whole texts stay
    return v.labels.join(words, "doc_id").select(F.col("doc_id").alias("query_id"), V.parse_verdict(answer).alias("verdict"))


@query("h16_accuracy", f"WITH x AS ({VERDICTS}) SELECT count(*) AS n, round(avg((verdict='correct')::INT),4) AS strict, round(avg(CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END),4) AS lenient FROM x")
def _(v):
    return V.accuracy(verdicts(v))


@query("h17_parse_verdict", VERDICTS)
def _(v):
    return verdicts(v)


@query(
    "h18_spend_ledger",
    "WITH c AS (SELECT *, in_tokens/1000000*CASE WHEN model='model-a' THEN 1::DOUBLE ELSE 2.5::DOUBLE END + out_tokens/1000000*CASE WHEN model='model-a' THEN 4::DOUBLE ELSE 10::DOUBLE END AS cost FROM v_calls), r AS (SELECT run_id, call_id, model, cost, coalesce(sum(cost::DOUBLE) OVER (PARTITION BY run_id ORDER BY call_id, in_tokens, out_tokens, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM c) SELECT run_id, call_id, model, round(cost::DOUBLE,7) AS cost, round(b,7) AS before, round(b,7) < 20 AS allowed FROM r",
)
def _(v):
    return V.spend_ledger(v.v_calls, v.spark.createDataFrame([("model-a", 1.0, 4.0)], "model string, input double, output double"), 20.0)


@query("h19_ragas_records", f"WITH {ROWS} SELECT q.query_id, question, gold AS answer, array_to_string(list(left(rw.text,40) ORDER BY rank),'|') AS contexts, gold AS reference FROM v_queries q JOIN rw ON rw.query_id=q.query_id AND rank <= 3 GROUP BY ALL")
def _(v):
    contexts = rows(v).filter("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.left("text", F.lit(40)).alias("t")))), lambda c: c["t"]).alias("contexts"))
    joined = v.v_queries.join(contexts, "query_id", "left").select("query_id", "question", F.col("gold").alias("answer"), "contexts", F.col("gold").alias("reference"))
    return V.ragas_records(joined).withColumn("contexts", F.array_join("contexts", "|"))


def section(name: str, table: str, item: str, *metrics: str) -> str:
    return f"SELECT '{name}' AS section, {item} AS item, unnest({list(metrics)}) AS metric, unnest([{', '.join(m + '::DOUBLE' for m in metrics)}]) AS value FROM {table}"


SECTIONS = " UNION ALL ".join(
    (
        section("hits", "rep", "dimension||'/'||value", "k", "hit_rate", "n"),
        section("citations", "cit", "'all'", "precision", "recall", "with_citations", "n"),
        section("honesty", "hon", "quadrant", "n", "fraction", "overconfidence"),
        section("latency", "lat", "endpoint", "n", "mean_ms", "p50_ms", "p90_ms", "p99_ms", "per_minute"),
        section("answers", "ans", "concat_ws('/', judge, hops::VARCHAR)", "n", "correct", "partial", "incorrect", "mean_score"),
        section("agreement", "agr", "'all'", "n", "agreement"),
        section("accuracy", "acc", "'all'", "n", "strict", "lenient"),
    )
)
AGREEMENT = f"WITH {JUDGES}, a AS (SELECT query_id, (count(DISTINCT verdict)=1)::INT AS same FROM jv GROUP BY 1) SELECT count(*) AS n, round(avg(same),4) AS agreement FROM a"
ACCURACY = f"WITH x AS ({VERDICTS}) SELECT count(*) AS n, round(avg((verdict='correct')::INT),4) AS strict, round(avg(CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END),4) AS lenient FROM x"


@query("h20_report", f"WITH {REPORT}, cit AS ({H10}), hon AS ({H11}), lat AS ({H12}), ans AS ({H14}), agr AS ({AGREEMENT}), acc AS ({ACCURACY}) {SECTIONS}")
def _(v):
    honest = V.honesty(v.v_judge.select((F.col("score_a") >= 5).alias("hit"), (F.col("score_b") <= 2).alias("abstained"), (F.col("score_b") / 10.0).alias("confidence")), 0.35)
    latency = V.latency_summary(v.v_jobs.select(F.col("stage").alias("endpoint"), F.col("elapsed_ms").alias("ms")))
    answers = V.answer_report(judges(v)).withColumn("hops", F.col("hops").cast("string"))
    parts = {"hits": V.hit_report(hits(v)), "citations": V.citation_scores(cited(v)), "honesty": honest, "latency": latency, "answers": answers, "agreement": V.judge_agreement(judges(v)), "accuracy": V.accuracy(verdicts(v))}
    return V.build_report(parts)

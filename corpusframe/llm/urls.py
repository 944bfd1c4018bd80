"""URL filters: rules on hosts and paths, and host word segmentation with naive Bayes for the rest.

Hosts are concatenated names. A unigram model, counted over the words of all pages, splits each host label and path
piece into its likeliest words (Viterbi); multinomial naive Bayes scores the words. It is fitted on the URLs that a rule
decides and used on those that none does.

Word counts and word weights are tables of any size. Each distinct piece of a URL is split once: its substrings meet the
counts in a join, and Viterbi runs on those found. Weights meet the URLs' words in a join on the word. Only sums and the
set of word lengths go through the driver.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import shared_dir

LETTER = 2.3  # what each letter of an unknown word adds to its cost
EVIDENCE = 2.0  # occurrences that a word is given beforehand, shared out as all words' are: an unknown word weighs nothing
NANO = 10**9  # weights are added as whole billionths, so that the order of rows doesn't matter
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path); a rule fits its host and all subdomains where the path starts with its path
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
PIECE = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for null and for URLs without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Of equally long ones block wins, then order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, rule_verdict``."""
    host, path = host_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, n`` of all words of two letters or more in the pages' text, markup left out."""
    text = F.lower(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>|&[a-z]+;", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).filter(F.length("word") >= 2)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def likeliest_split(name: str, cost: dict[str, float], lengths: list[int], unknown: float) -> list[str]:
    """``name`` in words of the least cost; of equal ones the longest last word. ``lengths``: those of ``cost``'s words."""
    best, back, open_ = [0.0], [0], (math.inf, 0)
    for end in range(1, len(name) + 1):
        open_ = min(open_, (best[end - 1] + unknown - LETTER * (end - 1), end - 1))
        found = (open_[0] + LETTER * end, open_[1])
        for length in lengths:
            if length > end:
                break
            known = cost.get(name[end - length : end])
            if known is not None:
                found = min(found, (best[end - length] + known, end - length))
        best.append(found[0])
        back.append(found[1])
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def url_pieces(urls: DataFrame) -> DataFrame:
    """``host, path, rule_verdict, pages, mark, piece, times``; a number's piece is its length and ``digits``."""

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for k, (host, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                pieces = Counter((mark, f"{len(p)} digits" if p[0].isdigit() else p) for mark, text in (("h:", host), ("p:", path.lower())) for p in PIECE.findall(text))
                rows += [k] * len(pieces)
                found += [(*piece, n) for piece, n in pieces.items()]
            mark, piece, times = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int32())) for c in batch.columns), pa.array(mark, pa.string()), pa.array(piece, pa.string()), pa.array(times, pa.int64())], ["host", "path", "rule_verdict", "pages", "mark", "piece", "times"])

    return urls.select("host", "path", "rule_verdict", "pages").mapInArrow(run, "host string, path string, rule_verdict string, pages long, mark string, piece string, times long")


def segmented(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """``piece, words``: the likeliest split of each distinct ``piece`` by all of ``word, n``."""
    row = counts.agg(F.sum("n").alias("total"), F.collect_set(F.length("word")).alias("lengths")).first()
    unknown, lengths = math.log((row["total"] or 0) + 1), sorted(row["lengths"])

    def substrings(batches):
        for batch in batches:
            out = [[], []]
            for piece in batch.column(0).to_pylist():
                for length in () if piece[0] in "0123456789" else lengths:
                    if length > len(piece):
                        break
                    for word in {piece[k : k + length] for k in range(len(piece) - length + 1)}:
                        out[0].append(piece)
                        out[1].append(word)
                    if len(out[0]) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["piece", "word"])
                        out = [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["piece", "word"])

    def run(batches):
        for batch in batches:
            out = []
            for piece, known in zip(batch.column(0).to_pylist(), batch.column(1)):
                cost = {r["word"]: unknown - math.log(r["n"]) for r in known.as_py() or ()}
                out.append([piece] if piece[0] in "0123456789" else likeliest_split(piece, cost, sorted(set(map(len, cost))), unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["piece", "words"])

    known = pieces.mapInArrow(substrings, "piece string, word string").join(counts.hint("shuffle_hash"), "word")
    known = known.groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return pieces.join(known.hint("shuffle_hash"), "piece", "left").select("piece", "known").mapInArrow(run, "piece string, words array<string>")


def url_words(pages: DataFrame, rules=RULES) -> DataFrame:
    """``host, path, rule_verdict, pages, word, times`` of each distinct URL's words; marks tell host and path apart."""
    spark = pages.sparkSession
    place = f"{shared_dir(spark)}/url-words-{uuid.uuid4().hex}"

    def kept(df, name):
        df.write.parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    counts = kept(word_counts(pages), "counts")
    urls = judged(pages, rules).groupBy("host", "path", "rule_verdict").agg(F.count(F.lit(1)).alias("pages"))
    tokens = kept(url_pieces(urls), "pieces")
    split = segmented(tokens.select("piece").distinct(), counts)
    words = tokens.join(split.hint("shuffle_hash"), "piece").select("host", "path", "rule_verdict", "pages", "mark", "times", F.explode("words").alias("word"))
    return kept(words.withColumn("word", F.concat("mark", "word")).drop("mark"), "words")


def judge_urls(pages: DataFrame, rules=RULES, prior: float | None = 0.0) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every row of ``page_id, url, html``.

    The score, the logarithm of the odds of block, is null where a rule decides; a positive one blocks. ``prior`` is the
    score of a URL without words: even odds unless told, None for the shares of the rules' own verdicts. With even odds the
    words alone decide: how many URLs rules block says nothing about those they don't reach. Null and unparsable URLs have
    no words and get the prior's verdict; where rules gave one verdict only, all undecided ones get that. Null html has no
    words. Rows that repeat have rows of their own, an empty table has none; further columns are not looked at.
    """
    words, found = url_words(pages, rules), judged(pages, rules)
    times = lambda verdict: F.sum(F.when(F.col("rule_verdict") == verdict, F.col("times") * F.col("pages")).otherwise(0))
    table = words.filter("rule_verdict IS NOT NULL").groupBy("word").agg(times("allow").alias("allow"), times("block").alias("block"))
    seen = found.agg(F.count_if(F.col("rule_verdict") == "allow").alias("allow"), F.count_if(F.col("rule_verdict") == "block").alias("block")).first()
    sums = table.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    allow, block = (float(sums[k] or 0) for k in ("allow", "block"))
    if not allow or not block:
        prior, scores = 1.0 if seen["block"] else -1.0, words.select("host", "path", F.lit(0).cast("long").alias("nano")).limit(0)
    else:
        prior = math.log(seen["block"] / seen["allow"]) if prior is None else prior
        rate = lambda n, of: (n + EVIDENCE * of / (allow + block)) / of
        nano = F.round((F.log(rate(F.col("block"), block)) - F.log(rate(F.col("allow"), allow))) * NANO).cast("long")
        open_ = words.filter("rule_verdict IS NULL").join(table.select("word", nano.alias("weight")).hint("shuffle_hash"), "word", "left")
        scores = open_.groupBy("host", "path").agg(F.sum(F.col("times") * F.coalesce("weight", F.lit(0))).alias("nano"))
    total = F.coalesce("nano", F.lit(0)) + F.lit(round(prior * NANO))
    undecided = F.col("rule_verdict").isNull()
    joined = found.join(scores.hint("shuffle_hash"), ["host", "path"], "left")
    return joined.select("page_id", "host", "path", "rule", F.when(~undecided, F.col("rule_verdict")).when(total > 0, "block").otherwise("allow").alias("verdict"), F.when(undecided, F.bround(total / NANO, 6)).alias("block_score"))


def op10_urls(spark, sf_dir: str) -> DataFrame:
    """``judge_urls`` of all ``pages``."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))

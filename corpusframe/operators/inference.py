"""Model calls as one operator, and the clean-up of what models answer as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions.text import clean_text, json_object, text_of
from corpusframe.operators.evaluation import spend_ledger

# Query classes, and those that always retrieve.
CLASSES = ("CHITCHAT", "SPOTLIGHT", "MULTI_HOP", "COMPARISON", "AGGREGATION", "MULTI_ENTITY", "SUMMARY")


def echo_client() -> Callable[[list[str]], list[str]]:
    """The client that is shipped: answers a prompt with a JSON object that holds its length. No model is behind it."""
    return lambda prompts: [f'{{"length": {len(p)}}}' for p in prompts]


def infer(prompts: DataFrame, client: Callable[[], Callable] = echo_client, batch_size: int = 16, concurrency: int | None = None) -> DataFrame:
    """``prompts`` (with ``prompt``) and ``response, error``. ``client()`` is called once in each task and returns a
    function of a list of prompts. A call that fails gives its rows an error and no response; nothing is raised.
    ``concurrency`` bounds how many tasks call at once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for part in parts:
            for lo in range(0, len(part), batch_size):
                piece = part.iloc[lo : lo + batch_size].copy()
                asked = [p or "" for p in piece["prompt"]]
                try:
                    piece["response"], piece["error"] = call(asked), None
                except Exception:
                    answers, errors = [], []
                    for p in asked:
                        try:
                            answers.append(call([p])[0])
                            errors.append(None)
                        except Exception as e:
                            answers.append(None)
                            errors.append(f"{type(e).__name__}: {e}"[:500])
                    piece["response"], piece["error"] = answers, errors
                yield piece

    rows = prompts.repartition(concurrency) if concurrency else prompts
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return rows.mapInPandas(run, f"{kinds}, response string, error string")


def infer_with_budget(prompts: DataFrame, prices: DataFrame, cap: float, client: Callable[[], Callable] = echo_client, answer_tokens: int = 300) -> DataFrame:
    """Calls of ``run_id, call_id, model, prompt`` that the budget allows, by estimated cost in call order."""
    estimated = prompts.withColumn("in_tokens", F.ceil(F.length("prompt") / 4)).withColumn("out_tokens", F.lit(answer_tokens))
    allowed = spend_ledger(estimated.select("run_id", "call_id", "model", "in_tokens", "out_tokens"), prices, cap).filter("allowed").select("run_id", "call_id")
    return infer(prompts.join(allowed, ["run_id", "call_id"], "left_semi"), client)


def _strings(body: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(body, path), "array<string>"), F.array().cast("array<string>"))


def _clean_list(items: Column, n: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: clean_text(x)), lambda x: x != "")), 1, n)


def normalize_plan(plans: DataFrame, n: int = 4) -> DataFrame:
    """``query_id, query_class, needs_retrieval, search_query, sub_queries`` of ``query_id, question, response``.

    Unknown classes are SPOTLIGHT; all but CHITCHAT retrieve; sub-queries differ from each other and the main query.
    """
    body = json_object(F.col("response"))
    given = F.upper(F.trim(text_of(F.get_json_object(body, "$.query_class"))))
    kind = F.when(given.isin(*CLASSES), given).otherwise("SPOTLIGHT")
    main = F.coalesce(F.nullif(clean_text(F.get_json_object(body, "$.search_query")), F.lit("")), F.col("question"))
    rows = plans.select("query_id", kind.alias("query_class"), main.alias("search_query"), _strings(body, "$.sub_queries").alias("subs"))
    differs = F.filter(F.transform("subs", lambda x: clean_text(x)), lambda x: F.lower(x) != F.lower(F.col("search_query")))
    return rows.select("query_id", "query_class", (F.col("query_class") != "CHITCHAT").alias("needs_retrieval"), "search_query", _clean_list(differs, n).alias("sub_queries"))


def attribute_notes(responses: DataFrame, rows: DataFrame, passages: int = 24, cut: int = 1_100) -> DataFrame:
    """``query_id, note_no, text, chunk_id, passage``: notes of ``{"notes": [{"text", "source": "P3"}]}`` with the ranked
    passage that they name; notes that name none are dropped."""
    notes = F.from_json(F.get_json_object(json_object(F.col("response")), "$.notes"), "array<struct<text:string,source:string>>")
    each = responses.select("query_id", F.posexplode(notes).alias("note_no", "note"))
    each = each.select("query_id", "note_no", F.trim("note.text").alias("text"), F.regexp_extract("note.source", r"(?i)^\s*P?(\d+)", 1).try_cast("int").alias("rank")).filter("text <> ''")
    known = rows.filter(F.col("rank") <= passages).select("query_id", "rank", "chunk_id", F.substring("text", 1, cut).alias("passage"))
    return each.join(known, ["query_id", "rank"]).select("query_id", "note_no", "text", "chunk_id", "passage")


def normalize_critic(response: Column, n: int = 4) -> tuple[Column, Column]:
    """Whether an answer is complete, and what is missing: nothing missing is complete, and so is no readable answer."""
    body = json_object(response)
    missing = _clean_list(_strings(body, "$.missing"), n)
    return (F.size(missing) == 0) | body.isNull(), missing


def normalize_grade(response: Column) -> tuple[Column, Column]:
    """Whether evidence suffices and the confidence from 0 to 1; sufficient at 0.5 where the answer can't be read."""
    body = json_object(response)
    enough = F.coalesce(F.get_json_object(body, "$.sufficient").try_cast("boolean"), F.lit(True))
    value = F.coalesce(F.get_json_object(body, "$.confidence").try_cast("double"), F.lit(0.5))
    return enough, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def normalize_faithfulness(response: Column, n: int = 5) -> tuple[Column, Column]:
    body = json_object(response)
    claims = _clean_list(_strings(body, "$.unsupported"), n)
    return F.coalesce(F.get_json_object(body, "$.faithful").try_cast("boolean"), F.size(claims) == 0), claims

"""Registered queries: model answers as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions.text import json_object
from corpusframe.operators import inference as I  # noqa: E741
from corpusframe.operators.vectors import encode
from corpusframe.plans.evidence_queries import ROWS, rows
from corpusframe.plans.registry import query


@query("d1_encode")
def _(v):
    return encode(v.v_chunks.select("chunk_id", "text")).select("chunk_id", F.size("embedding").alias("dim"))


@query("j1_infer", "SELECT chunk_id, '{\"length\": '||length(text)||'}' AS response, NULL::VARCHAR AS error FROM v_chunks")
def _(v):
    return I.infer(v.v_chunks.select("chunk_id", F.col("text").alias("prompt"))).select("chunk_id", "response", "error")


# Model answers here are made of the messages of conversations: their texts, sentences and words as JSON.
CLEAN = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
SENTENCES = f"""s AS (SELECT conv_id, turn, role, text, list_filter(list_transform(string_split(text, '. '), lambda x: {CLEAN("x")}), lambda x: x <> '') AS parts FROM conversations),
d AS (SELECT *, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS ones FROM s)"""


def messages(v, **fields):
    """``conv_id, turn, role, text, response``: the JSON of ``fields``, fenced or within prose."""
    body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "true"})
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" - done.")))
    return v.conversations.select("conv_id", "turn", "role", "text", F.when(F.length("text") % 7 == 0, "no JSON { here").otherwise(fenced).alias("response"))


@query("j2_json_object", "SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE text END AS a FROM conversations")
def _(v):
    return messages(v, a=F.col("text")).select("conv_id", "turn", F.get_json_object(json_object(F.col("response")), "$.a").alias("a"))


@query(
    "j3_plan",
    f"""WITH {SENTENCES}, p AS (SELECT *, CASE WHEN length(text) % 7 = 0 OR len(parts) = 0 THEN 'q' ELSE parts[1] END AS main FROM d)
SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 OR role <> 'user' THEN 'SPOTLIGHT' ELSE 'CHITCHAT' END AS query_class, length(text) % 7 = 0 OR role <> 'user' AS needs_retrieval, main AS search_query,
 CASE WHEN length(text) % 7 = 0 THEN '' ELSE array_to_string(list_filter(ones, lambda x: lower(x) <> lower(main))[1:4], '|') END AS subs FROM p""",
)
def _(v):
    """A message's first sentence as the plan's query, all of its sentences as sub-queries."""
    parts = F.split("text", r"\. ")
    plans = messages(v, query_class=F.when(F.col("role") == "user", " chitchat").otherwise(F.col("role")), search_query=F.get(F.filter(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""), F.lit(0)), sub_queries=parts)
    out = I.normalize_plan(plans.select(F.struct("conv_id", "turn").alias("query_id"), F.lit("q").alias("question"), "response"))
    return out.select("query_id.*", "query_class", "needs_retrieval", "search_query", F.array_join("sub_queries", "|").alias("subs"))


@query("j4_notes", f"WITH {ROWS} SELECT q.query_id, 0 AS note_no, 'x' AS text, rw.chunk_id, left(rw.text,1100) AS passage FROM v_queries q JOIN rw ON rw.query_id=q.query_id AND rw.rank = 1 + q.query_id % 5")
def _(v):
    text = F.expr("concat('{\"notes\": [{\"text\": \" x\", \"source\": \"P', 1 + query_id % 5, '\"}, {\"text\": \"y\", \"source\": \"P99\"}, {\"text\": \" \", \"source\": \"P1\"}]}')")
    return I.attribute_notes(v.v_queries.select("query_id", text.alias("response")), rows(v))


@query(
    "j5_critic",
    f"""WITH {SENTENCES} SELECT conv_id, turn, length(text) % 7 = 0 OR role = 'user' OR len(ones) = 0 AS complete, CASE WHEN length(text) % 7 = 0 OR role = 'user' THEN '' ELSE array_to_string(ones[1:4], '|') END AS missing,
 length(text) % 7 = 0 OR role = 'user' AS sufficient, CASE WHEN length(text) % 7 = 0 THEN 0.5 ELSE least(1.0, length(text) / 500.0) END::DOUBLE AS confidence FROM d""",
)
def _(v):
    """What an assistant's message says is missing; its length is the confidence."""
    answers = messages(v, missing=F.when(F.col("role") != "user", F.split("text", r"\. ")), sufficient=F.col("role") == "user", confidence=F.length("text") / 500)
    complete, missing = I.normalize_critic(F.col("response"))
    enough, confidence = I.normalize_grade(F.col("response"))
    return answers.select("conv_id", "turn", complete.alias("complete"), F.array_join(missing, "|").alias("missing"), enough.alias("sufficient"), confidence.alias("confidence"))


@query(
    "j5_faithfulness",
    f"""WITH {SENTENCES} SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN true WHEN turn % 3 = 0 THEN len(ones) = 0 ELSE role = 'user' END AS faithful, CASE WHEN length(text) % 7 = 0 THEN '' ELSE array_to_string(ones[1:5], '|') END AS unsupported FROM d""",
)
def _(v):
    answers = messages(v, unsupported=F.split("text", r"\. "), faithful=F.when(F.col("turn") % 3 != 0, F.col("role") == "user"))
    faithful, claims = I.normalize_faithfulness(F.col("response"))
    return answers.select("conv_id", "turn", faithful.alias("faithful"), F.array_join(claims, "|").alias("unsupported"))

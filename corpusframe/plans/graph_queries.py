"""Registered queries: knowledge graphs."""

from __future__ import annotations


from pyspark.sql import functions as F

from corpusframe.functions.text import name_key
from corpusframe.operators import graph as G
from corpusframe.plans.registry import query


def key(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', ' ', 'g'), '^(the|a|an) ', ''))"


NODES = f"""nk AS (SELECT *, {key("name")} AS key FROM v_mentions),
no AS (SELECT graph_id, key, sha1(graph_id||'|'||key) AS node_id, arg_min(substr(trim(name),1,160), (chunk_id,pos)) AS name, 'concept' AS type, arg_min(trim(description), (-length(trim(description)),chunk_id,pos)) AS description,
 count(*) AS mention_count, list_sort(list(DISTINCT chunk_id))[1:1000] AS ids FROM nk WHERE length(key) >= 2 GROUP BY 1,2)"""
EDGES = f"""{NODES}, rk AS (SELECT r.graph_id, r.chunk_id, r.pos, a.node_id AS source, b.node_id AS target FROM (SELECT *, {key("source")} AS s, {key("target")} AS t FROM v_relations) r JOIN no a ON a.graph_id=r.graph_id AND a.key=r.s JOIN no b ON b.graph_id=r.graph_id AND b.key=r.t WHERE a.node_id <> b.node_id),
ed AS (SELECT graph_id, source, target, 'follows' AS relation, count(*) AS weight, list_sort(list(DISTINCT chunk_id))[1:1000] AS ids, sha1(graph_id||'|'||source||'|follows|'||target) AS edge_id FROM rk GROUP BY 1,2,3)"""
VIEW = f"""{EDGES}, sn AS (SELECT * FROM no QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY mention_count DESC, node_id) <= 50),
se AS (SELECT * FROM ed WHERE weight >= 1 AND source IN (SELECT node_id FROM sn) AND target IN (SELECT node_id FROM sn) QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, edge_id) <= 5000)"""


def nodes(v):
    return G.resolve_nodes(v.v_mentions)


def edges(v):
    return G.resolve_edges(v.v_relations, nodes(v))


@query("g1_valid_mentions", "SELECT m.chunk_id, m.pos, m.name FROM v_mentions m JOIN v_chunks c USING (chunk_id) WHERE length(trim(c.text)) >= 30 AND trim(m.name) <> ''")
def _(v):
    return G.valid_mentions(v.v_mentions, v.v_chunks).select("chunk_id", "pos", "name")


@query("g2_name_key", f"SELECT chunk_id, pos, {key('description')} AS key FROM v_mentions")
def _(v):
    return v.v_mentions.select("chunk_id", "pos", name_key(F.col("description")).alias("key"))


@query("g3_nodes", f"WITH {NODES} SELECT graph_id, key, node_id, name, type, description, mention_count, array_to_string(ids, ',') AS chunks FROM no")
def _(v):
    return nodes(v).withColumn("chunks", F.array_join("source_chunk_ids", ",")).drop("source_chunk_ids")


@query("g3_node_chunks", f"WITH nk AS (SELECT *, {key('name')} AS key FROM v_mentions) SELECT graph_id, key, sha1(graph_id||'|'||key) AS node_id, chunk_id, count(*) AS n FROM nk WHERE length(key) >= 2 GROUP BY ALL")
def _(v):
    return G.node_chunks(v.v_mentions)


@query("g4_edge_chunks", f"WITH {EDGES} SELECT graph_id, source, target, 'follows' AS relation_key, chunk_id, count(*) AS n FROM rk GROUP BY ALL")
def _(v):
    return G.edge_chunks(v.v_relations, nodes(v))


@query("g4_edges", f"WITH {EDGES} SELECT graph_id, source, target, relation, weight, array_to_string(ids, ',') AS chunks FROM ed")
def _(v):
    return edges(v).select("graph_id", "source", "target", "relation", "weight", F.array_join("source_chunk_ids", ",").alias("chunks"))


@query("g5_graph_view", f"WITH {VIEW} SELECT graph_id, source, target, weight FROM se")
def _(v):
    return G.graph_view(nodes(v), edges(v), 50)[1].select("graph_id", "source", "target", "weight")


@query("g6_node_passages", f"WITH {NODES}, p AS (SELECT node_id, unnest(ids[1:6]) AS chunk_id, unnest(range(len(ids[1:6])))::INT AS passage_no FROM no) SELECT node_id, passage_no, chunk_id, title, c.text FROM p JOIN v_chunks c USING (chunk_id) LEFT JOIN v_docs d ON d.doc_id=c.doc_id")
def _(v):
    return G.node_passages(nodes(v), v.v_chunks, v.v_docs)


@query("g7_graph_summary", f"WITH {EDGES}, mx AS (SELECT graph_id, max(mention_count) AS m FROM no GROUP BY 1) SELECT graph_id, count(*) AS n_nodes, any_value(m) AS most_mentions, round(avg(1+5*sqrt(mention_count/m)),6) AS mean_size, coalesce((SELECT count(*) FROM ed WHERE ed.graph_id=no.graph_id),0) AS n_edges FROM no JOIN mx USING (graph_id) GROUP BY graph_id")
def _(v):
    return G.graph_summary(nodes(v), edges(v))


@query(
    "g8_latest_graph",
    "WITH g AS (SELECT library_id, 'g'||job_id AS graph_id, status, started_at AS created_at FROM v_jobs WHERE status IN ('queued','done')) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY library_id ORDER BY created_at DESC, graph_id DESC) = 1",
)
def _(v):
    return G.latest_graph(v.v_jobs.select("library_id", F.concat(F.lit("g"), F.col("job_id").cast("string")).alias("graph_id"), "status", F.col("started_at").alias("created_at")))

"""Knowledge graphs as two tables: mentions and relations resolved into nodes and weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import name_key, text_of
from corpusframe.operators.common import first_rows, if_small
from corpusframe.sources.checkpoints import cut

# Types that say nothing.
VAGUE_TYPES = ("", "thing", "other")
IDS = 1_000  # chunk ids that a node or an edge lists; ``node_chunks`` and ``edge_chunks`` have all


def valid_mentions(mentions: DataFrame, chunks: DataFrame, least: int = 30) -> DataFrame:
    """Mentions with a name, of chunks of ``least`` characters or more."""
    long_enough = chunks.filter(F.length(F.trim("text")) >= least).select("chunk_id")
    return mentions.filter(F.trim(text_of(F.col("name"))) != "").join(long_enough, "chunk_id", "left_semi")


def _keyed(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("key", name_key(F.col("name"))).filter(F.length("key") >= 2)


def _node_id():
    return F.sha1(F.concat_ws("|", "graph_id", "key").cast("binary"))


def _with_ids(rows: DataFrame, chunks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``rows`` with ``source_chunk_ids``: the ``n`` least of their distinct ``chunks``.

    Tasks cut to ``n`` of a key before anything of it meets, so a name of a third of all mentions is no large row.
    """
    least = first_rows(chunks, keys, [F.col("chunk_id")], n, "_place")
    lists = least.groupBy(*keys).agg(F.array_sort(F.collect_list("chunk_id")).alias("source_chunk_ids"))
    return rows.join(lists, keys)


def node_chunks(mentions: DataFrame) -> DataFrame:
    """``graph_id, key, node_id, chunk_id, n``: every chunk of every node, and its mentions there."""
    return _keyed(mentions).groupBy("graph_id", "key", "chunk_id").agg(F.count(F.lit(1)).alias("n")).select("graph_id", "key", _node_id().alias("node_id"), "chunk_id", "n")


def resolve_nodes(mentions: DataFrame, ids: int = IDS) -> DataFrame:
    """One node for each graph and name key: first name and type, longest description, mentions and first ``ids`` chunks.

    "First" is by chunk and position. The id depends on graph and key only.
    """
    order = F.struct("chunk_id", "pos")
    kind = F.substring(F.lower(F.trim(text_of(F.col("type")))), 1, 40)
    kind = F.when(F.trim(kind) == "", "concept").otherwise(kind)
    rows = _keyed(mentions).withColumn("kind", kind).withColumn("d", F.nullif(F.trim(text_of(F.col("description"))), F.lit("")))
    nodes = rows.groupBy("graph_id", "key").agg(
        F.min_by(F.substring(F.trim("name"), 1, 160), order).alias("name"),
        F.min_by("kind", order).alias("type"),
        F.min_by("d", F.when(F.col("d").isNotNull(), F.struct(-F.length("d"), "chunk_id", "pos"))).alias("description"),
        F.count(F.lit(1)).alias("mention_count"),
    )
    nodes = _with_ids(nodes, node_chunks(mentions).select("graph_id", "key", "chunk_id"), ["graph_id", "key"], ids)
    return nodes.select("graph_id", "key", _node_id().alias("node_id"), "name", F.when(F.col("type").isin(*VAGUE_TYPES), "concept").otherwise(F.col("type")).alias("type"), F.substring("description", 1, 500).alias("description"), "mention_count", "source_chunk_ids")


def _known_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations between known, different nodes. Keys and ids alone are joined; equal relations of a chunk are one row."""
    label = F.substring(F.trim(text_of(F.col("relation"))), 1, 60)
    label = F.when(label == "", "related to").otherwise(label)
    rows = relations.select("graph_id", "chunk_id", "pos", name_key(F.col("source")).alias("s"), name_key(F.col("target")).alias("t"), label.alias("label"))
    rows = rows.groupBy("graph_id", "chunk_id", "s", "t", F.lower("label").alias("relation_key")).agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    ids = nodes.select("graph_id", "key", "node_id")
    return rows.join(ids.withColumnsRenamed({"key": "s", "node_id": "source"}), ["graph_id", "s"]).join(ids.withColumnsRenamed({"key": "t", "node_id": "target"}), ["graph_id", "t"]).filter("source <> target")


EDGE = ["graph_id", "source", "target", "relation_key"]


def edge_chunks(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``graph_id, source, target, relation_key, chunk_id, n``: every chunk of every edge, and its relations there."""
    return _known_relations(relations, nodes).groupBy(*EDGE, "chunk_id").agg(F.sum("n").alias("n"))


def resolve_edges(relations: DataFrame, nodes: DataFrame, ids: int = IDS) -> DataFrame:
    """Edges between known, different nodes: label of the first relation, number of relations, first ``ids`` chunks."""
    known = cut(_known_relations(relations, nodes))
    edges = known.groupBy(*EDGE).agg(F.min_by("label", F.struct("chunk_id", "pos")).alias("relation"), F.sum("n").alias("weight"))
    edges = _with_ids(edges, known.select(*EDGE, "chunk_id").distinct(), EDGE, ids)
    return edges.withColumn("edge_id", F.sha1(F.concat_ws("|", "graph_id", "source", "relation_key", "target").cast("binary")))


def graph_view(nodes: DataFrame, edges: DataFrame, n: int = 200, min_weight: int = 1, max_edges: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """The ``n`` nodes of each graph with most mentions, and the heaviest edges between them."""
    shown = first_rows(nodes, ["graph_id"], [F.desc("mention_count"), F.col("node_id")], min(max(n, 10), 2_000), "place")
    ids = shown.select("graph_id", "node_id")
    both = edges.filter(F.col("weight") >= min_weight).join(ids.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi").join(ids.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi")
    return shown, first_rows(both, ["graph_id"], [F.desc("weight"), F.col("edge_id")], max_edges, "place")


def node_passages(nodes: DataFrame, chunks: DataFrame, docs: DataFrame, n: int = 6) -> DataFrame:
    """``node_id, passage_no, chunk_id, title, text``: the first source chunks of each node."""
    ids = nodes.select("node_id", F.posexplode(F.slice("source_chunk_ids", 1, n)).alias("passage_no", "chunk_id"))
    return ids.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(docs.select("doc_id", "title"), "doc_id", "left").select("node_id", "passage_no", "chunk_id", "title", "text")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, n_nodes, n_edges, most_mentions, mean_size``; a node is shown with size 1 + 5 * sqrt(share of most)."""
    most = nodes.groupBy("graph_id").agg(F.max("mention_count").alias("most_mentions"), F.count(F.lit(1)).alias("n_nodes"))
    sized = nodes.join(if_small(most), "graph_id").groupBy("graph_id").agg(F.first("n_nodes").alias("n_nodes"), F.first("most_mentions").alias("most_mentions"), F.round(F.avg(1 + 5 * F.sqrt(F.col("mention_count") / F.col("most_mentions"))), 6).alias("mean_size"))
    return sized.join(edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges")), "graph_id", "left").fillna(0, ["n_edges"])


def latest_graph(graphs: DataFrame) -> DataFrame:
    """The newest graph of each library among those queued, being built or done."""
    return graphs.filter(F.col("status").isin("queued", "building", "done")).groupBy("library_id").agg(F.max_by(F.struct("graph_id", "status", "created_at"), F.struct("created_at", "graph_id")).alias("g")).select("library_id", "g.*")

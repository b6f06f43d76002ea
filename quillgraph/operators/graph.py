"""Graphs as two tables, nodes and edges, of all documents together: building, metrics, components and queries."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def _provenance(texts: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Rows with their provenance; chunk texts are joined last, to the rows that are left."""
    if texts is None:
        rows = rows.withColumn("source_text", F.lit(None).cast("string"))
    else:
        rows = rows.join(texts.select("document_id", "chunk_id", F.col("text").alias("source_text")), ["document_id", "chunk_id"], "left")
    return rows.withColumn("provenance", F.struct("chunk_id", "start_index", "end_index", "source_text")).drop("source_text")


def build_nodes(resolved: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One node for each name (lower case) and label of a document: the first in the order of clusters."""
    key = ["document_id", F.lower(X.strip(F.col("canonical_name"))).alias("k_name"), X.strip(F.col("canonical_label")).alias("k_label")]
    row = F.struct("canonical_name", "canonical_label", "name", "aliases", "label_counts", "chunk_id", "start_index", "end_index", "member")
    first = resolved.groupBy(*key).agg(F.min_by(row, "member").alias("r")).select("document_id", "r.*")
    nodes = first.select(
        X.node_id(F.col("document_id"), F.col("canonical_label"), F.col("canonical_name")).alias("id"), F.col("canonical_name").alias("name"), F.col("name").alias("original_name"), "aliases",
        F.col("canonical_label").alias("label"), "label_counts", "document_id", F.col("member").alias("ord"), "chunk_id", "start_index", "end_index",
    )
    return _provenance(chunks, nodes)


def build_edges(relations: DataFrame, nodes: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Relations between two nodes, found by name without case and label (any label where the relation has none); no
    loops; the first of each (source, target, type) by name among those that have both nodes."""
    # a node is found under its own label and, as the first of its name, under the empty one: one join a side
    ends = nodes.select(F.col("document_id").alias("d"), F.lower(X.strip(F.col("name"))).alias("k"), F.explode(F.array(F.col("label"), F.lit(""))).alias("l"), F.struct("ord", "id").alias("n"))
    own = F.struct("l", "n")
    ends = ends.groupBy("d", "k").agg(F.collect_set(F.when(F.col("l") != "", own)).alias("labelled"), F.min(F.when(F.col("l") == "", F.col("n"))).alias("any"))
    ends = ends.select("d", "k", F.explode(F.array_append("labelled", F.struct(F.lit("").alias("l"), F.col("any").alias("n")))).alias("e")).select("d", "k", "e.l", "e.n")
    out = relations
    for side in ("source", "target"):
        e = ends.select("d", "k", "l", F.col("n").alias(f"{side}_node"))
        out = out.join(e, (F.col("document_id") == F.col("d")) & (F.lower(X.strip(F.col(side))) == F.col("k")) & (F.coalesce(F.col(f"{side}_label"), F.lit("")) == F.col("l"))).drop("d", "k", "l")
    out = out.where("source_node.id <> target_node.id").withColumn("type", F.upper(X.strip(F.col("type"))))
    kept = [c for c in out.columns if c != "document_id"]
    first = out.groupBy("document_id", F.lower(X.strip(F.col("source"))).alias("s"), F.lower(X.strip(F.col("target"))).alias("t"), F.col("type").alias("y")).agg(F.min_by(F.struct(*kept), "place").alias("r"))
    rows = first.select("document_id", "r.*")
    source, target = F.col("source_node.id"), F.col("target_node.id")
    edges = rows.select(
        X.edge_id(source, F.col("type"), target).alias("id"), source.alias("source"), target.alias("target"), F.col("source").alias("source_name"), F.col("target").alias("target_name"), "source_label", "target_label",
        "type", X.relation_type(F.col("type")).alias("stored_type"), "document_id", "place", "chunk_id", "start_index", "end_index",
    )
    return _provenance(windows, edges)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and relation types of each document; documents with neither have no row."""
    n = nodes.groupBy("document_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("document_id").agg(F.count("*").alias("edges"), F.count_distinct("type").alias("relation_types"))
    return n.join(e, "document_id", "full").na.fill(0)


def both_ways(edges: DataFrame) -> DataFrame:
    """``(document_id, node, neighbor, id, type)``: each edge seen from both ends, in one scan."""
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbor")), F.struct(F.col("target").alias("node"), F.col("source").alias("neighbor")))
    return edges.select("document_id", "id", "type", F.explode(ends).alias("e")).select("document_id", "e.node", "e.neighbor", "id", "type")


def cut(df: DataFrame) -> DataFrame:
    """Write rows to the shared checkpoint folder and go on from there: what is used several times is computed once,
    and a lost executor costs no recomputation.  Without a folder, a local session (as in tests) gets a temporary one; on a
    cluster, whose executors couldn't see that, it is an error."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return df.checkpoint()


def is_local(master: str) -> bool:
    """Whether the executors are threads of the driver."""
    return master == "local" or master.startswith("local[")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(document_id, id, component)``: the smallest node id of each connected component.

    Labels travel along edges and then jump to their label's label, so rounds grow with the logarithm of the longest
    path.  Each round goes to the checkpoint folder; the loop stops when no label changes."""
    links = cut(both_ways(edges).select("document_id", "node", "neighbor").distinct())
    labels = cut(nodes.select("document_id", F.col("id").alias("node"), F.col("id").alias("component")))
    for _ in range(max_rounds):
        near = links.join(labels.select("document_id", F.col("node").alias("neighbor"), "component"), ["document_id", "neighbor"])
        least = near.groupBy("document_id", "node").agg(F.min("component").alias("near"))
        spread = labels.join(least, ["document_id", "node"], "left").withColumn("new", F.least("component", F.coalesce("near", "component")))
        up = spread.select("document_id", F.col("node").alias("new"), F.col("new").alias("up"))
        after = cut(spread.join(up, ["document_id", "new"], "left").select("document_id", "node", F.least("new", F.coalesce("up", "new")).alias("component"), F.col("component").alias("old")))
        changed = after.where("component <> old").limit(1).count()
        labels = after.drop("old")
        if not changed:
            return labels.select("document_id", F.col("node").alias("id"), "component")
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, isolated nodes, mean degree (distinct neighbours), density, components and the largest one."""
    degree = both_ways(edges).groupBy("document_id", "node").agg(F.count_distinct("neighbor").alias("degree"))
    d = nodes.select("document_id", F.col("id").alias("node")).join(degree, ["document_id", "node"], "left").na.fill(0, ["degree"])
    by_doc = d.groupBy("document_id").agg(F.count("*").alias("nodes"), F.count(F.when(F.col("degree") == 0, 1)).alias("isolated_nodes"), F.round(F.avg("degree"), 2).alias("average_degree"))
    sizes = components(nodes, edges).groupBy("document_id", "component").agg(F.count("*").alias("size")).groupBy("document_id").agg(F.count("*").alias("components"), F.max("size").alias("largest_component"))
    n_edges = edges.groupBy("document_id").agg(F.count("*").alias("edges"))
    rows = by_doc.join(n_edges, "document_id", "left").na.fill(0, ["edges"]).join(sizes, "document_id")
    n = F.col("nodes").cast("double")
    density = F.when(n > 1, F.round(2 * F.col("edges") / (n * (n - 1)), 4)).otherwise(0.0)
    return rows.select("document_id", "nodes", "edges", "isolated_nodes", "average_degree", density.alias("density"), "components", "largest_component")


# Queries.  Each works on all documents at once or, after a filter on document_id, on one.


def scoped(table: DataFrame, document_id: int | None) -> DataFrame:
    return table if document_id is None else table.where(F.col("document_id") == document_id)


def lookup(nodes: DataFrame, name: str) -> DataFrame:
    """The first node of each document by label and id with this name, without case."""
    found = nodes.where(F.lower("name") == F.lower(F.lit(name)))
    return found.groupBy("document_id").agg(F.min(F.struct("label", "id", "name")).alias("n")).select("document_id", F.col("n.name").alias("entity_name"), "n.label", "n.id")


def neighborhood(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The looked-up node with its distinct (neighbour, label, relation); one row of nulls if it has none."""
    start = lookup(nodes, name)
    near = start.join(both_ways(edges).select("document_id", F.col("node").alias("id"), "neighbor", "type"), ["document_id", "id"], "left")
    named = nodes.select("document_id", F.col("id").alias("neighbor"), F.col("name").alias("related_entity"), F.col("label").alias("related_label"))
    return near.join(named, ["document_id", "neighbor"], "left").select("document_id", "entity_name", "label", "related_entity", "related_label", F.col("type").alias("relation")).distinct()


def summary(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    rows = neighborhood(nodes, edges, name).groupBy("document_id", "entity_name", "label")
    return rows.agg(F.array_sort(F.collect_set(F.struct("related_entity", "related_label", "relation"))).alias("related_entities"))


def ranking(nodes: DataFrame, edges: DataFrame, score: str = "degree", top: int = 10) -> DataFrame:
    """The ``top`` nodes of each document by incident edges; names break ties, then labels."""
    n = both_ways(edges).groupBy("document_id", F.col("node").alias("id")).agg((F.count_distinct("id") if score == "degree" else F.count("*")).alias(score))
    rows = nodes.select("document_id", "id", F.col("name").alias("entity_name"), "label").join(n, ["document_id", "id"], "left").na.fill(0, [score])
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc(score), "entity_name", "label"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("document_id", "place", "entity_name", "label", score)


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = 3) -> DataFrame:
    """The shortest path of at most ``max_hops`` undirected edges between two names in each document.

    Paths grow from the source only, one join with edges a hop, keep no node twice and end at the target; among equal
    lengths the smallest sequence of node ids, then of types, wins."""
    a, b = lookup(nodes, source), lookup(nodes, target)
    steps = both_ways(edges).groupBy("document_id", "node", "neighbor").agg(F.min("type").alias("type"))
    at = a.join(b.select("document_id", F.col("id").alias("goal"), F.col("entity_name").alias("target"), F.col("label").alias("target_label")), "document_id")
    at = at.where("id <> goal").select("document_id", F.col("entity_name").alias("source"), F.col("label").alias("source_label"), "target", "target_label", "goal", F.array("id").alias("ids"), F.array().cast("array<string>").alias("types"), F.col("id").alias("node"))
    done = None
    for _ in range(max_hops):
        far = at.join(steps, ["document_id", "node"]).where(~F.array_contains("ids", F.col("neighbor")))
        at = far.select(*[c for c in at.columns if c not in ("ids", "types", "node")], F.array_append("ids", F.col("neighbor")).alias("ids"), F.array_append("types", F.col("type")).alias("types"), F.col("neighbor").alias("node"))
        # many paths may reach one node in one number of hops: the smallest goes on
        kept = at.groupBy("document_id", "node").agg(F.min_by(F.struct(*at.columns), F.struct("ids", "types")).alias("r")).select("r.*")
        hit = kept.where("node = goal")
        done = hit if done is None else done.unionByName(hit)
        at = kept.where("node <> goal")
    best = done.groupBy("document_id").agg(F.min_by(F.struct(*done.columns), F.struct(F.size("types"), "ids", "types")).alias("r")).select("r.*")
    edges_of = F.transform(F.col("types"), lambda t, i: F.struct(F.get("ids", i).alias("source"), F.get("ids", i + 1).alias("target"), t.alias("type")))
    return best.select("document_id", "source", "source_label", "target", "target_label", F.col("ids").alias("path_node_ids"), F.col("types").alias("path_relations"), edges_of.alias("path_edges"), F.size("types").alias("path_length"))


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.select("document_id", "type").distinct()


def entities_by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label).select("document_id", F.col("name").alias("entity_name")).distinct()


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as one table of JSON elements for a graph viewer."""
    n = nodes.select("document_id", F.lit("nodes").alias("kind"), "id", F.to_json(F.struct("id", F.col("name").alias("label"), F.col("label").alias("type"), X.colour(F.col("label")).alias("color"))).alias("data"))
    e = edges.select("document_id", F.lit("edges").alias("kind"), "id", F.to_json(F.struct("id", "source", "target", F.col("type").alias("label"))).alias("data"))
    return n.unionByName(e)


def highlighted(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes joined by an edge to chosen nodes ``(document_id, id)``, marked; all others fade."""
    near = both_ways(edges).join(chosen.select("document_id", F.col("id").alias("node")), ["document_id", "node"], "left_semi")
    return near.select("document_id", F.col("neighbor").alias("id")).union(chosen.select("document_id", "id")).distinct()

"""Sinks: the graph store and the tables of documents, logs, sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.graph import cut
from ..plans.reads import may_delete
from .versioned import VersionedTables


def last_rows(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Upsert: of equal keys the last row stays."""
    rest = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(rest, order).alias("r")).select("r.*")


def stored_nodes(nodes: DataFrame) -> DataFrame:
    return last_rows(nodes, ["document_id", "name", "label"])


def stored_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are stored under exactly their names and labels, one for each sanitized type."""
    ends = nodes.select("document_id", "name", "label").distinct()
    out = edges.withColumn("stored_type", X.relation_type(F.col("type")))
    for side in ("source", "target"):
        e = ends.select("document_id", F.col("name").alias(f"{side}_name"), F.col("label").alias(f"{side}_label"))
        out = out.join(e, ["document_id", f"{side}_name", f"{side}_label"], "left_semi")
    return last_rows(out, ["document_id", "source_name", "source_label", "stored_type", "target_name", "target_label"], "place" if "place" in edges.columns else "ord")


class GraphStore(VersionedTables):
    """Nodes and edges of all documents, and the documents themselves, as versioned tables: replacing a document's graph
    writes its new rows and its id, nothing else."""

    def save(self, documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> int:
        return self.replace(documents, nodes=nodes, edges=edges)

    def delete_documents(self, documents: DataFrame) -> DataFrame:
        """Delete documents with all their rows, but not those that are being processed: their ids are returned.  A status
        that changes meanwhile makes a later version, so the deletion fails with a ``Conflict`` and can be tried again."""
        state = self.state()
        wanted = cut(documents.select("document_id").distinct())
        status = self.read("documents", state=state).select("document_id", "status").join(wanted, "document_id", "left_semi")
        busy = cut(status.where(~may_delete(F.col("status"))).select("document_id").distinct())
        self.delete(wanted.join(busy, "document_id", "left_anti"), state)
        return busy


def without_documents(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("document_id"), "document_id", "left_anti")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each document's graph as one JSON text, for clients that want it whole."""
    n = nodes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    return n.join(e, "document_id", "full").select("document_id", F.to_json(F.struct("nodes", "edges")).alias("graph_data"))


def graph_json_parts(nodes: DataFrame, edges: DataFrame, rows: int = 10_000) -> DataFrame:
    """The same in parts for large graphs: ``document_id, kind, part, rows, data`` with a JSON array of at most ``rows``
    nodes or edges each, in order of their ids.  No row holds a whole graph; the parts' numbers are their manifest, and
    parts of a kind, joined, are that array of the whole."""

    def parts(df: DataFrame, kind: str) -> DataFrame:
        each = df.select("document_id", "id", F.to_json(F.struct(*df.columns)).alias("json"))
        place = F.row_number().over(Window.partitionBy("document_id").orderBy("id", "json")) - 1
        each = each.withColumn("place", place).withColumn("part", F.floor(F.col("place") / rows))
        told = F.transform(F.array_sort(F.collect_list(F.struct("place", "json"))), lambda x: x["json"])
        return each.groupBy("document_id", F.lit(kind).alias("kind"), "part").agg(F.count("*").alias("rows"), F.concat(F.lit("["), F.array_join(told, ","), F.lit("]")).alias("data"))

    return parts(nodes, "nodes").unionByName(parts(edges, "edges"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, rows: int = 10_000) -> None:
    """The parts as JSON lines, laid by ranges of document, kind and part, so that a reader takes a document's parts one
    after another."""
    graph_json_parts(nodes, edges, rows).repartitionByRange("document_id", "kind", "part").sortWithinPartitions("document_id", "kind", "part").write.json(path)


def append(table: DataFrame, path: str) -> None:
    """Logs, sessions and messages are append-only."""
    table.write.mode("append").parquet(path)


def log_rows(documents: DataFrame, stage: str, message: str) -> DataFrame:
    return documents.select("document_id", F.lit(stage).alias("stage"), F.lit(message).alias("message"), F.current_timestamp().alias("created_at"))

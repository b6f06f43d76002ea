"""Streaming ingest: new document files become graphs that replace those of the same documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..plans.pipeline import Graphs, process
from ..sources.store import GraphStore
from . import uploads


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """Parquet files of ``document_id, text, created_at`` as they arrive."""
    return spark.readStream.schema("document_id bigint, text string, created_at timestamp").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def replace_batches(store: GraphStore, **options) -> Callable[[DataFrame, int], None]:
    """A batch function for changes of the queue.  The texts to process are stored as ``processing`` documents; then one
    version brings their graphs and, as a change of a few columns, their status and counts, so a text isn't written again.
    A batch that is run again replaces the same documents with the same rows, so a retry does no harm."""

    def run(batch: DataFrame, _: int) -> None:
        waiting = cut(batch.where("status = 'pending'").select("document_id", "text", F.col("at").alias("created_at")))
        if waiting.isEmpty():
            return
        none = F.lit(None).cast("long")
        store.replace(waiting, documents=waiting.withColumns({"status": F.lit("processing"), "nodes": none, "edges": none}))
        graphs: Graphs = process(waiting.select("document_id", "text"), **options)
        nodes, edges = graphs.nodes.drop("provenance"), cut(graphs.edges.drop("provenance", "place"))
        done = waiting.select("document_id", F.lit("complete").alias("status"))
        for name, rows in (("nodes", nodes), ("edges", edges)):
            done = done.join(rows.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left").na.fill(0, [name])
        store.change(waiting, {"nodes": nodes, "edges": edges}, {"documents": done})

    return run


def ingest(stream: DataFrame, store: GraphStore, checkpoint: str, days: int | None = None, **options):
    """Work through what is there (with ``days``: go on, and forget documents unheard of for so long) over ``document_id, text, created_at``.  Uploads pass the queue (:mod:`.uploads`), so the newest of
    a document counts, in whatever order and how often they arrive."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", uploads.STATE_STORE)
    newest = uploads.changes(uploads.events(stream), days)
    writer = newest.writeStream.foreachBatch(replace_batches(store, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if days is None else writer).start()


def stage_counts(logs: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Log rows a stage and window of event time; works on batches and streams."""
    return logs.withWatermark("created_at", late).groupBy(F.window("created_at", width), "stage").agg(F.count("*").alias("rows")).select(F.col("window.start").alias("window_start"), "stage", "rows")

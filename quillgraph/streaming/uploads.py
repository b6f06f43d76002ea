"""The queue of uploads: which text of a document counts, and how far its processing is.

Events of a document come from several places and in any order: uploads of its text, and what its processing tells.  A
stateful operator keyed by document_id keeps, for each document, the newest upload and its status, and passes on what
changes them.  Everything else is derived: the work to do is the passed uploads, the status table the passed changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: An upload has its text and ``at``; an outcome names the upload that it is about by the same ``at``.
EVENTS = "document_id bigint, kind string, at timestamp, text string, error_message string"
CHANGES = "document_id bigint, status string, at timestamp, text string, error_message string"
#: How far a document is; an outcome may only go forward.
RANK = {"pending": 0, "processing": 1, "complete": 2, "error": 2}
#: State with timers needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "at timestamp, sign string, rank int"


def events(uploads: DataFrame) -> DataFrame:
    """``uploads(document_id, text, created_at)`` as events."""
    return uploads.select("document_id", F.lit("upload").alias("kind"), F.col("created_at").alias("at"), "text", F.lit(None).cast("string").alias("error_message"))


def _order(at, text) -> tuple:
    return at, text or ""


class UploadQueue(StatefulProcessor):
    """One document's state: the time and the text's hash of its newest upload, and its rank.

    Of the uploads in a batch and the one before, the newest counts (ties: the larger text); an older one or the same
    again changes nothing.  Outcomes count if they are about the newest upload and go forward, so what an overtaken run
    reports late is dropped, and so is an event that is delivered twice.  With ``days``, a document that nothing has been
    heard of for so long is forgotten by a timer; its next upload counts as new."""

    def __init__(self, days: int | None = None):
        self.keep = None if days is None else days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.newest.get() if self.newest.exists() else None
        at, sign, rank = state if state else (None, None, -1)
        text, changed, outcomes = None, False, []
        for batch in rows:
            for e in batch.itertuples(index=False):
                when = e.at.to_pydatetime()
                if e.kind != "upload":
                    outcomes.append((when, RANK.get(e.kind, -1), e.kind, e.error_message))
                elif at is None or _order(when, _sign(e.text)) > _order(at, sign):
                    at, sign, text, rank, changed = when, _sign(e.text), e.text, 0, True
        out = [(key[0], "pending", at, text, None)] if changed else []
        for when, new, kind, error in sorted(outcomes, key=lambda o: o[:3]):
            if at is not None and when == at and new > rank:
                rank, changed = new, True
                out.append((key[0], kind, at, None, error))
        if changed:
            self.newest.update((at, sign, rank))
        if self.keep is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)
        yield pd.DataFrame(out, columns=["document_id", "status", "at", "text", "error_message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        yield pd.DataFrame([], columns=["document_id", "status", "at", "text", "error_message"])

    def close(self) -> None:
        pass


def _sign(text: str | None) -> str:
    import hashlib

    return hashlib.sha256((text or "").encode()).hexdigest()


def changes(stream: DataFrame, days: int | None = None) -> DataFrame:
    """A stream of events (``EVENTS``) to the stream of what they change (``CHANGES``): a ``pending`` row with the text for
    each upload that is the newest of its document, and a row for each outcome of it.  State is kept by key in the state
    store, some 100 bytes a document; texts pass through and aren't kept.

    ``days`` is for queries that run on: with timers, one that is triggered once (``availableNow``) would never end."""
    return stream.groupBy("document_id").transformWithStateInPandas(UploadQueue(days), CHANGES, "Append", "None" if days is None else "ProcessingTime")


def newest(uploads: DataFrame) -> DataFrame:
    """The same for a table: each document's newest text, ``document_id, text, at``."""
    row = F.struct(F.col("created_at").alias("at"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sign"), "text")
    return uploads.groupBy("document_id").agg(F.max(row).alias("r")).select("document_id", "r.text", "r.at")


def outcomes(spark: SparkSession, documents: DataFrame, kind: str, error: F.Column | None = None) -> DataFrame:
    """``documents(document_id, at)`` as events of one kind of outcome."""
    return documents.select("document_id", F.lit(kind).alias("kind"), "at", F.lit(None).cast("string").alias("text"), (F.lit(None).cast("string") if error is None else error).alias("error_message"))


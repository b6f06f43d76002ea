"""Conversations about a document: sessions and their messages as append-only tables."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import append
from .questions import Engine
from .reads import next_session_title, session_title

SESSIONS = "session_id string, document_id long, user_id long, title string, created_at timestamp"
MESSAGES = "session_id string, turn int, role string, text string, payload string, created_at timestamp"


class Sessions:
    """Sessions of one folder.  ``ask`` stores the question and the answer, with all that the engine found, as two rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was appended yet
            return self.spark.createDataFrame([], schema)

    def sessions(self) -> DataFrame:
        return self._table("sessions", SESSIONS)

    def messages(self, session_id: str) -> DataFrame:
        return self._table("messages", MESSAGES).where(F.col("session_id") == session_id).orderBy("turn")

    def create(self, document_id: int, user_id: int, title: str | None = None) -> str:
        """A session named by the caller or by its number among the user's sessions about the document."""
        mine = self.sessions().where((F.col("document_id") == document_id) & (F.col("user_id") == user_id))
        if title is None:
            named = next_session_title(mine).first()
            title = named.title if named else "Conversation 1"
        now = datetime.now(timezone.utc)
        session_id = f"{document_id}-{user_id}-{now.timestamp():.6f}"
        append(self.spark.createDataFrame([(session_id, document_id, user_id, title, now)], SESSIONS).coalesce(1), f"{self.path}/sessions")
        return session_id

    def ask(self, session_id: str, question: str, engine: Engine) -> dict:
        owner = self.sessions().where(F.col("session_id") == session_id).first()
        if owner is None:
            raise ValueError(f"there is no session {session_id!r}")
        turn = self.messages(session_id).agg(F.coalesce(F.max("turn") + 1, F.lit(0))).first()[0]
        asked, got = datetime.now(timezone.utc), engine.ask(owner.document_id, question)
        rows = [(session_id, turn, "user", question, None, asked), (session_id, turn + 1, "assistant", got["answer"], json.dumps(got, default=str), datetime.now(timezone.utc))]
        append(self.spark.createDataFrame(rows, MESSAGES).coalesce(1), f"{self.path}/messages")
        return got

    def listed(self, document_id: int, user_id: int) -> DataFrame:
        """The user's sessions about a document, the last used first; one without a title takes its first question."""
        mine = self.sessions().where((F.col("document_id") == document_id) & (F.col("user_id") == user_id))
        used = self._table("messages", MESSAGES).groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("created_at").alias("last_at"), F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"].alias("first_question"))
        rows = mine.join(used, "session_id", "left").withColumn("title", session_title(F.col("title"), F.coalesce("first_question", F.lit(""))))
        return rows.select("session_id", "title", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.coalesce("last_at", "created_at").alias("updated_at")).orderBy(F.desc("updated_at"), F.desc("session_id"))

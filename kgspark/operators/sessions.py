"""Analytics over reading sessions: messages, concept states, articles.

Tables: sessions (session_id, created_at, ...), messages (session_id, id, ts,
role, content), changes (session_id, concept_name, explored, confidence, ts, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.sources.keyed import KeyedTable
from kgspark.sources.tables import store

ROLES = ("user", "assistant", "system")


def sessions(table: DataFrame, session_id: object | None = None) -> DataFrame:
    """One session, or all, the newest first."""
    rows = table if session_id is None else table.where(F.col("session_id") == F.lit(session_id))
    return rows.orderBy(F.desc("created_at"), "session_id")


def with_updated_at(table: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds updated_at: the session's start or its last message."""
    last = messages.groupBy("session_id").agg(F.max("ts").alias("last"))
    return table.join(last, "session_id", "left").withColumn("updated_at", F.greatest("created_at", "last")).drop("last")


def last_messages(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each session; place counts from the oldest of them."""
    rows = messages.withColumn("k", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id")))).where(F.col("k") <= n)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "id"))).drop("k")


def context(messages: DataFrame, n: int = 5, cut: int = 100) -> DataFrame:
    """The last messages as one text per session, each cut short."""
    line = F.concat("role", F.lit(": "), F.left("content", F.lit(cut)))
    rows = last_messages(messages, n).select("session_id", "place", line.alias("line"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("context"))


def concept_states(changes: DataFrame) -> DataFrame:
    """State of each concept of a session after all changes.

    explored is the last value, confidence the last that was given, explored_at
    the time of the last change to explored, first_mentioned_at the first time.
    The same aggregates run on a stream.
    """
    return changes.groupBy("session_id", "concept_name").agg(
        F.max_by("explored", "seq").alias("explored"),
        F.max_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("seq"))).alias("confidence"),
        F.max_by("ts", F.when(F.col("explored"), F.col("seq"))).alias("explored_at"),
        F.min("ts").alias("first_mentioned_at"),
    )


def states(table: DataFrame, explored: bool | None = None) -> DataFrame:
    return table if explored is None else table.where(F.col("explored") == explored)


def latest(table: DataFrame, value: str, tier: int | None = None) -> DataFrame:
    """The newest stored text per session, of one tier if given."""
    rows = table if tier is None else table.where(F.col("tier") == tier)
    return rows.groupBy("session_id").agg(F.max_by(value, F.struct("created_at", "id")).alias(value))


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the sessions that go."""
    return {name: df.join(gone.select("session_id"), "session_id", "left_anti") for name, df in tables.items()}


def constraint_violations(messages: DataFrame) -> DataFrame:
    """Ids used twice, unknown roles, missing contents: rule, session_id, n."""
    twice = messages.groupBy("session_id", "id").agg(F.count("*").alias("c")).where("c > 1").groupBy("session_id").agg(F.count("*").alias("n"))
    roles = messages.where(~F.col("role").isin(*ROLES)).groupBy("session_id").agg(F.count("*").alias("n"))
    blank = messages.where(F.col("content").isNull()).groupBy("session_id").agg(F.count("*").alias("n"))
    out = None
    for rule, df in (("unique id", twice), ("role", roles), ("content", blank)):
        rows = df.select(F.lit(rule).alias("rule"), "session_id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def seed_states(changes: DataFrame, concepts: DataFrame, session_id: object) -> DataFrame:
    """The change log with every concept set to unexplored, as loading a graph does.

    ``concepts`` is (name, ts, seq); the new changes come with their sequence.
    """
    seeded = concepts.select(F.lit(session_id).alias("session_id"), F.col("name").alias("concept_name"), F.lit(False).alias("explored"), F.lit(None).cast("double").alias("confidence"), "ts", "seq")
    return changes.unionByName(seeded.select(changes.columns))


class SessionStore:
    """Stored sessions and messages; every write is a batch that is stored once.

    Sessions are (session_id, created_at, updated_at) with further columns,
    messages (session_id, id, ts, role, content).  Messages move their sessions'
    updated_at in the same call, and a call that is repeated, or taken up after
    a failure between the two tables, ends in the same state.
    """

    def __init__(self, sessions: KeyedTable, messages: KeyedTable) -> None:
        self.sessions, self.messages = sessions, messages

    def create(self, rows: DataFrame, batch: str) -> bool:
        """New sessions, not updated later than they were created."""
        return self.sessions.put(rows.withColumn("updated_at", F.col("created_at")), batch)

    def add_messages(self, rows: DataFrame, batch: str) -> bool:
        """Append messages and bring updated_at of their sessions up to them.

        Messages of unknown sessions are stored and change no session.
        """
        new = self.messages.append(rows, batch)
        last = rows.groupBy("session_id").agg(F.max("ts").alias("last"))
        bumped = self.sessions.read().join(last, "session_id").withColumn("updated_at", F.greatest("updated_at", "last")).drop("last")
        return self.sessions.put(store(bumped), batch) or new

    def delete(self, gone: DataFrame, batch: str) -> None:
        """Sessions with all of their messages."""
        for table in (self.messages, self.sessions):
            table.put(table.read().limit(0), batch, keys=gone.select("session_id"))

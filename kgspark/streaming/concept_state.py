"""Concept states kept up to date from a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kgspark.operators.sessions import concept_states


def follow(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``concept_states`` on a stream; ``sink`` gets each batch of new states.

    Changes may come out of order: every value is taken by its sequence number.
    State is one row per session and concept, as in the stored table.
    """
    return concept_states(changes).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).start()

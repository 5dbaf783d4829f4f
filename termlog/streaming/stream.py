"""Structured Streaming into a session: each micro-batch is one transaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .session import Session


def attach(session: Session, stream: DataFrame, relation: str, checkpoint: str, weight: str = "weight", sink: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Feeds a stream of rows, with a column of weights, into a relation: positive weights insert, negative delete.

    sink(changes, batch id) gets each transaction's changes. A batch that Spark repeats after a failure is harmless:
    relations are sets.
    """
    columns = [c for c in stream.columns if c != weight]

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        session.begin()
        if weight in df.columns:
            gone = df.where(f"`{weight}` < 0").select(*columns)
            if not gone.isEmpty():  # insertions alone are appended
                session.delete(relation, gone)
            session.insert(relation, df.where(f"`{weight}` > 0").select(*columns))
        else:
            session.insert(relation, df)
        session.commit()
        df.unpersist()
        if sink is not None:
            sink(session.all_changes(), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

"""Appending streams to tables: one snapshot per micro-batch, each batch at most once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from siltstone.operators.table import Table
from siltstone.operators.updates import Append


#: Before a stream's name: the property that holds the last batch committed.
_KEY = "stream.last-batch."


class _BatchAppend(Append):
    """An append that records which batch it is, and does nothing if that was committed before."""

    def __init__(self, table: Table, stream: str, batch: int) -> None:
        super().__init__(table)
        self.stream, self.batch = stream, batch

    def _apply(self, base):
        return base if committed(base, self.stream, self.batch) else super()._apply(base).with_property(_KEY + self.stream, str(self.batch))

    def _summary(self, files_gone: int, rows_gone: int) -> dict[str, str]:
        return super()._summary(files_gone, rows_gone) | {"stream": self.stream, "batch": str(self.batch)}


def committed(meta, stream: str, batch: int) -> bool:
    """Whether this batch, or a later one, of a stream has been committed. The table's properties tell, even when the snapshot has expired."""
    return int(meta.properties.get(_KEY + stream, -1)) >= batch or any(s.summary.get("stream") == stream and int(s.summary["batch"]) >= batch for s in meta.snapshots)


def append_batches(table: Table, stream: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``; a batch that is run again after a failure isn't appended twice."""

    def run(df: DataFrame, batch: int) -> None:
        table.refresh()
        if not committed(table.metadata, stream, batch):
            change = _BatchAppend(table, stream, batch)
            change.append(df)
            change.commit()

    return run


def append_stream(df: DataFrame, table: Table, stream: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer that appends to a table; start it with the trigger you need."""
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append_batches(table, stream))

"""Changes to a table's rows: append, delete, overwrite, row delta. Each commits one snapshot.

A change is collected first and committed at the end; on conflict it is applied again to the newest
metadata, with the data files it has already written.
"""

from __future__ import annotations

import time
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import ValidationError
from siltstone.functions import predicates as P
from siltstone.operators.scan import Scan
from siltstone.sources import files as FL
from siltstone.sources import manifests as M
from siltstone.sources.commit import commit_with_retry
from siltstone.sources.metadata import ADDED, DELETED, EQUALITY_DELETES, POSITION_DELETES, DataFile, PartitionSpec, Snapshot, TableMetadata, new_snapshot_id
from siltstone.sources.schema import Schema

if TYPE_CHECKING:
    from siltstone.operators.table import Table


class Change:
    """Base: collects files to add and to delete."""

    operation: str | None = None

    def __init__(self, table: Table) -> None:
        self.table = table
        self.added: list[DataFile] = []
        self.added_deletes: list[DataFile] = []
        self.removed: list[str] = []
        self.where: P.Predicate | None = None
        self.schema, self.spec = table.metadata.schema, table.metadata.spec

    def append(self, df: DataFrame, rows_per_file: int | None = None, sort_by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> Change:
        """Write rows; they become visible when the change is committed."""
        self.added += FL.write_files(df, self.table.store, self.schema, self.spec, rows_per_file, sort_by, options)
        return self

    def append_file(self, file: DataFile) -> Change:
        """Add a file that is written already."""
        self.added.append(file)
        return self

    def _entries_removed(self, base: TableMetadata) -> list[tuple[int, DataFile]]:
        """Live files that go: named ones, and those all of whose rows match."""
        if not self.removed and self.where is None:
            return []
        scan = Scan(self.table)
        live = scan.entries()
        test = F.lit(False)
        if self.removed:  # a list of this driver's: joined rather than spelt out in the plan
            named = self.table.spark.createDataFrame([(p,) for p in dict.fromkeys(self.removed)], "removed string")
            live = live.join(F.broadcast(named), F.col("path") == F.col("removed"), "left")
            test = F.col("removed").isNotNull()
        if self.where is not None:
            test = test | P.strict(P.bind(self.where, base.schema))
        found = [(r["sequence"], M.file_of(r)) for r in live.where(test).drop("status", "snapshot_id", "removed").toLocalIterator()]
        missing = set(self.removed) - {f.path for _, f in found}
        if missing:
            raise ValidationError(f"not in the table: {sorted(missing)}")
        return sorted(found, key=lambda x: x[1].path)

    def _name(self, added: int, removed: int) -> str:
        return self.operation or "overwrite"

    def _apply(self, base: TableMetadata) -> TableMetadata:
        gone = self._entries_removed(base)
        if not self.added and not self.added_deletes and not gone:
            return base
        snapshot_id, sequence = new_snapshot_id(), base.last_sequence + 1
        old = M.read_list(self.table.store, base.current.manifest_list) if base.current else []
        rows = [(ADDED, sequence, f) for f in self.added] + [(DELETED, s, f) for s, f in gone]
        new = M.write_manifest(self.table.store, rows, snapshot_id, sequence)
        new += M.write_manifest(self.table.store, [(ADDED, sequence, f) for f in self.added_deletes], snapshot_id, sequence, True)
        return commit_snapshot(self.table, base, [*old, *new], snapshot_id, sequence, self._summary(len(gone), sum(f.record_count for _, f in gone)))

    def _summary(self, files_gone: int, rows_gone: int) -> dict[str, str]:
        added = {"added-data-files": len(self.added), "added-records": sum(f.record_count for f in self.added)}
        deleted = {"deleted-data-files": files_gone, "deleted-records": rows_gone}
        keys = {"append": added, "delete": deleted, "overwrite": added | deleted}[self._kind()]
        return {"operation": self._name(len(self.added), files_gone)} | {k: str(v) for k, v in keys.items()}

    def _kind(self) -> str:
        return "overwrite"

    def commit(self) -> TableMetadata:
        """Commit; nothing happens if nothing was collected or nothing matches."""
        return commit_with_retry(self.table.ops, self._apply)


def commit_snapshot(table: Table, base: TableMetadata, manifests: list[M.Manifest], snapshot_id: int, sequence: int, summary: dict[str, str]) -> TableMetadata:
    """Metadata with one more snapshot that has these manifests."""
    path = M.write_list(table.store, snapshot_id, manifests)
    now = max(table.clock(), base.log[-1][0] if base.log else 0)
    return base.with_snapshot(Snapshot(snapshot_id, now, path, sequence, base.current_snapshot_id, summary, base.current_schema_id))


class Append(Change):
    """Add files; none of the earlier ones change."""

    operation = "append"

    def _kind(self) -> str:
        return "append"


class Delete(Change):
    """Remove whole files by metadata: named ones, or those of whose rows all match a predicate. Files of
    which only some rows match stay as they are (see ``Table.delete_where`` for those)."""

    operation = "delete"

    def delete_file(self, path: str) -> Delete:
        self.removed.append(path)
        return self

    def delete_matching(self, predicate: P.Predicate) -> Delete:
        self.where = predicate if self.where is None else self.where | predicate
        return self

    def _kind(self) -> str:
        return "delete"


class Overwrite(Delete):
    """Remove files as Delete does and add others, in one snapshot."""

    operation = None

    def _name(self, added: int, removed: int) -> str:
        return "overwrite" if added and removed else "append" if added else "delete"

    def _kind(self) -> str:
        return "overwrite"


class RowDelta(Change):
    """Add rows and delete single rows by position or by key; the files they are in stay."""

    def _name(self, added: int, removed: int) -> str:
        return "overwrite" if added else "delete"

    def delete_positions(self, df: DataFrame) -> RowDelta:
        """Rows by ``file_path`` (as in ``_metadata.file_path``) and ``pos`` (``_metadata.row_index``)."""
        schema = Schema.of(("file_path", "string"), ("pos", "bigint"))
        return self._deletes(df.select("file_path", "pos"), schema, POSITION_DELETES, None)

    def delete_equal(self, df: DataFrame) -> RowDelta:
        """Rows of earlier commits that agree with a row of df in its columns (null agrees with null)."""
        ids = tuple(self.schema.need(c).id for c in df.columns)
        schema = Schema(tuple(self.schema.need(c) for c in df.columns), self.schema.schema_id)
        return self._deletes(df, schema, EQUALITY_DELETES, ids)

    def _deletes(self, df: DataFrame, schema: Schema, content: str, ids: tuple[int, ...] | None) -> RowDelta:
        written = FL.write_files(df, self.table.store, schema, PartitionSpec())
        self.added_deletes += [_as_deletes(f, content, ids, self.schema.schema_id) for f in written]
        return self

    def _summary(self, files_gone: int, rows_gone: int) -> dict[str, str]:
        counts = {
            "added-data-files": len(self.added),
            "added-delete-files": len(self.added_deletes),
            "added-records": sum(f.record_count for f in self.added),
            "deleted-records": sum(f.record_count for f in self.added_deletes),
        }
        return {"operation": self._name(len(self.added), 0)} | {k: str(v) for k, v in counts.items()}


def _as_deletes(f: DataFile, content: str, ids: tuple[int, ...] | None, schema_id: int) -> DataFile:
    return DataFile(f.path, f.record_count, f.file_size, 0, schema_id, content, split_offsets=f.split_offsets, equality_ids=ids)


def now_ms() -> int:
    return time.time_ns() // 1_000_000



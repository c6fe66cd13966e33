"""A table: its metadata, its scans, its changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import ValidationError
from siltstone.functions import predicates as P
from siltstone.operators import maintenance
from siltstone.operators.evolve import UpdateSchema, UpdateSpec
from siltstone.operators.scan import Scan
from siltstone.operators.updates import Append, Delete, Overwrite, RowDelta, now_ms
from siltstone.sources import files as FL
from siltstone.sources import manifests as M
from siltstone.sources.commit import TableOps
from siltstone.sources.metadata import PartitionSpec, Snapshot, TableMetadata
from siltstone.sources.schema import Schema
from siltstone.sources.store import HadoopStore, LocalStore


class Table:
    """One writer's or reader's view of a table; ``refresh`` brings it up to date."""

    def __init__(self, spark: SparkSession, name: str, store: LocalStore | HadoopStore, ops: TableOps | None = None, clock: Callable[[], int] = now_ms) -> None:
        self.spark, self.name, self.store, self.clock = spark, name, store, clock
        self.ops = ops or TableOps(store)

    @property
    def metadata(self) -> TableMetadata:
        return self.ops.current

    @property
    def schema(self) -> Schema:
        return self.metadata.schema

    @property
    def spec(self) -> PartitionSpec:
        return self.metadata.spec

    @property
    def current_snapshot(self) -> Snapshot | None:
        return self.metadata.current

    def snapshot(self, snapshot_id: int) -> Snapshot | None:
        return self.metadata.snapshot(snapshot_id)

    @property
    def location(self) -> str:
        return self.metadata.location

    @property
    def metadata_file(self) -> str:
        """The file of the version last read."""
        self.metadata  # noqa: B018 - reads it if need be
        return f"{self.store.uri}/metadata/v{self.ops.version}.metadata.json"

    def refresh(self) -> Table:
        self.ops.refresh()
        return self

    # Reading

    def scan(self) -> Scan:
        return Scan(self)

    def to_df(self, predicate: P.Predicate = P.TRUE) -> DataFrame:
        """The current rows, pruned and filtered by a predicate."""
        return self.scan().filter(predicate).to_df()

    def snapshots(self) -> DataFrame:
        """All snapshots."""
        kind = "snapshot_id long, timestamp_ms long, sequence long, parent_id long, operation string, schema_id int, summary map<string,string>"
        rows = [(s.snapshot_id, s.timestamp_ms, s.sequence, s.parent_id, s.operation, s.schema_id, s.summary) for s in self.metadata.snapshots]
        return self.spark.createDataFrame(rows, kind)

    def history(self) -> DataFrame:
        """Every change of the current snapshot, rollbacks included, in order."""
        return self.spark.createDataFrame([(i, *x) for i, x in enumerate(self.metadata.log)], "position int, timestamp_ms long, snapshot_id long")

    def manifests(self) -> DataFrame:
        """The manifests of the current snapshot."""
        s = self.current_snapshot
        kind = "path string, length long, deletes boolean, spec_id int, sequence long, snapshot_id long, added int, existing int, deleted int, added_rows long, existing_rows long, deleted_rows long"
        return self.spark.createDataFrame([tuple(m.__dict__.values()) for m in (M.read_list(self.store, s.manifest_list) if s else [])], kind)

    def files(self, snapshot_id: int | None = None) -> DataFrame:
        """Live data files of a snapshot with what is known of them."""
        return (self.scan() if snapshot_id is None else self.scan().use_snapshot(snapshot_id)).entries()

    def tree(self) -> str:
        """The metadata tree as text: snapshots, manifests, numbers of entries."""
        m = self.metadata
        lines = [f"{self.name} v{self.ops.version} {m.table_uuid}"]
        for s in m.snapshots:
            lines.append(f"  snapshot {s.snapshot_id} seq {s.sequence} {s.operation}{' (current)' if s.snapshot_id == m.current_snapshot_id else ''}")
            for f in M.read_list(self.store, s.manifest_list):
                lines.append(f"    {f.path} spec {f.spec_id}{' deletes' if f.deletes else ''}: +{f.added} ={f.existing} -{f.deleted}")
        return "\n".join(lines)

    # Writing

    def new_append(self) -> Append:
        return Append(self)

    def append(self, df: DataFrame, **kw) -> TableMetadata:
        """Write rows and commit them."""
        return Append(self).append(df, **kw).commit()

    def new_delete(self) -> Delete:
        return Delete(self)

    def new_overwrite(self) -> Overwrite:
        return Overwrite(self)

    def new_row_delta(self) -> RowDelta:
        return RowDelta(self)

    def delete_where(self, predicate: P.Predicate, mode: str = "strict") -> TableMetadata:
        """Delete matching rows. ``strict``: whole files only, by metadata; files of which some rows match stay whole.
        ``copy_on_write``: such files are written anew without the rows."""
        if mode == "strict":
            return Delete(self).delete_matching(predicate).commit()
        if mode != "copy_on_write":
            raise ValidationError(f"unknown mode {mode}")
        self.refresh()
        scan = self.scan().filter(predicate)
        planned = scan.plan().select("path", "sequence", "schema_id", P.strict(P.bind(predicate, self.schema)).alias("whole")).collect()
        change = Overwrite(self)
        some = [(r.path, r.sequence, r.schema_id) for r in planned if not r.whole]
        deletes = scan.delete_files()
        if some:
            match = F.coalesce(P.over_rows(P.bind(predicate, self.schema), self.schema), F.lit(False))
            change.append(scan.read(some, deletes).where(~match))
        for r in planned:
            change.delete_file(r.path)
        return maintenance.commit_if_deletes_stay(self, change, deletes)

    def rollback(self, snapshot_id: int) -> TableMetadata:
        """Make an earlier snapshot current; nothing is lost. No retry on conflict."""
        base = self.ops.refresh()
        if base is None or base.snapshot(snapshot_id) is None:
            raise ValidationError(f"unknown snapshot {snapshot_id}")
        if base.current_snapshot_id == snapshot_id:
            return base
        new = base.with_current(snapshot_id, max(self.clock(), base.log[-1][0]))
        self.ops.commit(base, new)
        return new

    def update_schema(self) -> UpdateSchema:
        return UpdateSchema(self)

    def update_spec(self) -> UpdateSpec:
        return UpdateSpec(self)

    # Maintenance

    def rewrite_data_files(self, target_bytes: int = maintenance.REWRITE_TARGET, predicate: P.Predicate = P.TRUE) -> maintenance.RewriteResult:
        return maintenance.rewrite_data_files(self, target_bytes, predicate)

    def rewrite_manifests(self) -> tuple[int, int]:
        return maintenance.rewrite_manifests(self)

    def expire_snapshots(self, older_than_ms: int | None = None, retain_last: int = 1, ids: tuple[int, ...] = (), delete_with: Callable[[str], None] | None = None) -> maintenance.ExpireResult:
        return maintenance.expire_snapshots(self, older_than_ms, retain_last, ids, delete_with)

    def remove_orphan_files(self, older_than_ms: int | None = None, delete_with: Callable[[str], None] | None = None) -> list[str]:
        return maintenance.remove_orphan_files(self, older_than_ms, delete_with)

    def with_location(self, location: str) -> TableMetadata:
        """The metadata with another location (for copies of a table)."""
        return replace(self.metadata, location=location)


def external_file(table: Table, name: str) -> FL.DataFile:
    """A Parquet file below the table's folder, written elsewhere with field ids, as a file to append."""
    found = FL.describe(table.spark, table.store, [name], table.schema, table.spec)
    if not found:
        raise ValidationError(f"{name} has no rows")
    return found[0]

"""Maintenance: rewrite small files and manifests, expire snapshots, remove files that nothing refers to."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import batched
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import CommitFailed, ValidationError
from siltstone.functions import predicates as P
from siltstone.operators.updates import Change, Overwrite, commit_snapshot
from siltstone.sources import manifests as M
from siltstone.sources.commit import commit_with_retry
from siltstone.sources.metadata import DELETED, EXISTING, DataFile, Snapshot, TableMetadata, new_snapshot_id

if TYPE_CHECKING:
    from siltstone.operators.table import Table

REWRITE_TARGET = 128 << 20
EXPIRE_AGE_MS = 5 * 86_400_000
ORPHAN_AGE_MS = 3 * 86_400_000
#: The metadata whose files are never orphans.
_VERSION = re.compile(r"^metadata/(v\d+\.metadata\.json|version-hint\.text)$")


@dataclass(frozen=True)
class RewriteResult:
    """Files read and written, and their bytes."""

    rewritten: int
    added: int
    rewritten_bytes: int
    added_bytes: int


class _Rewrite(Overwrite):
    def _name(self, added: int, removed: int) -> str:
        return "rewrite"


def commit_if_deletes_stay(table: Table, change: Change, deletes: list[tuple[int, DataFile]]) -> TableMetadata:
    """Commit rows that were read with these row deletes; an error if others have come meanwhile, which the new files would escape."""
    apply = change._apply

    def checked(base: TableMetadata) -> TableMetadata:
        if [f.path for _, f in table.scan().delete_files()] != [f.path for _, f in deletes]:
            raise ValidationError("row deletes were committed meanwhile")
        return apply(base)

    change._apply = checked  # type: ignore[method-assign]
    return change.commit()


def rewrite_data_files(table: Table, target_bytes: int = REWRITE_TARGET, predicate: P.Predicate = P.TRUE) -> RewriteResult:
    """Write files below the target anew, fewer and larger, by the default spec, with row deletes applied.

    Which files: those live ones that are smaller than the target and may match the predicate; a single file in its
    partition with the default spec and no deletes to apply is left. Files that aren't chosen stay as they are.
    """
    table.refresh()
    scan = table.scan().filter(predicate)
    chosen = scan.plan().where(F.col("file_size") < target_bytes).select("path", "sequence", "schema_id", "file_size", "record_count", "spec_id", F.to_json("partition").alias("tuple")).collect()
    deletes = scan.delete_files()
    if not deletes:
        many: dict[tuple[int, str], int] = {}
        for r in chosen:
            many[r.spec_id, r.tuple] = many.get((r.spec_id, r.tuple), 0) + 1
        chosen = [r for r in chosen if many[r.spec_id, r.tuple] > 1 or r.spec_id != table.spec.spec_id]
    if not chosen:
        return RewriteResult(0, 0, 0, 0)
    size, rows = sum(r.file_size for r in chosen), sum(r.record_count for r in chosen)
    change = _Rewrite(table)
    df = scan.read([(r.path, r.sequence, r.schema_id) for r in chosen], deletes)
    if not table.spec.fields:
        df = df.coalesce(max(1, -(-size // target_bytes)))
    change.append(df, rows_per_file=max(1, rows * target_bytes // max(1, size)))
    for r in chosen:
        change.delete_file(r.path)
    commit_if_deletes_stay(table, change, deletes)
    return RewriteResult(len(chosen), len(change.added), size, sum(f.file_size for f in change.added))


def rewrite_manifests(table: Table) -> tuple[int, int]:
    """Write the live entries of the current snapshot into as few manifests as hold them, by spec and partition; the
    numbers of manifests before and after. Rows, files and the entries' sequence numbers stay as they are, and so do earlier
    snapshots. Planning then reads a number of manifests that follows the number of files, not that of commits.

    Entries pass through the driver a manifest at a time. One data manifest, or one of row deletes, is left alone.
    """
    counts = (0, 0)

    def apply(base: TableMetadata) -> TableMetadata:
        nonlocal counts
        old = M.read_list(table.store, base.current.manifest_list) if base.current else []
        snapshot_id, sequence, new = new_snapshot_id(), base.last_sequence + 1, []
        for deletes in (False, True):
            own = [m for m in old if m.deletes == deletes]
            if len(own) < 2:
                new += own
                continue
            found = M.live(M.entries(table.spark, table.store, base, own, deletes), own)
            rows = found.orderBy("spec_id", F.to_json("partition"), "path").drop("status", "snapshot_id")
            for run in batched(rows.toLocalIterator(), M.MANIFEST_ENTRIES):
                new += M.write_manifest(table.store, [(EXISTING, r["sequence"], M.file_of(r)) for r in run], snapshot_id, sequence, deletes)
        counts = len(old), len(new)
        if [m.path for m in new] == [m.path for m in old]:
            return base
        return commit_snapshot(table, base, new, snapshot_id, sequence, {"operation": "replace", "manifests-replaced": str(len(old)), "manifests-written": str(len(new))})

    commit_with_retry(table.ops, apply)
    return counts


@dataclass(frozen=True)
class ExpireResult:
    """Snapshots that went, and files deleted with them."""

    snapshots: int
    data_files: int
    manifests: int
    manifest_lists: int


def _expired(meta: TableMetadata, older_than_ms: int, retain_last: int, ids: tuple[int, ...]) -> list[Snapshot]:
    """Snapshots to expire. On the current one's line of ancestors the newest ``retain_last`` stay, and those young enough,
    up to the first that is neither; snapshots beside that line go whatever their age."""
    unknown = [i for i in ids if meta.snapshot(i) is None]
    if unknown:
        raise ValidationError(f"unknown snapshots {unknown}")
    kept: set[int] = set()
    at = meta.current
    while at is not None and (len(kept) < retain_last or at.timestamp_ms >= older_than_ms):
        kept.add(at.snapshot_id)
        at = meta.snapshot(at.parent_id)
    kept -= set(ids)
    kept.add(meta.current_snapshot_id)
    return [s for s in meta.snapshots if s.snapshot_id not in kept]


def _referenced(table: Table, meta: TableMetadata, snapshots: list[Snapshot]) -> tuple[set[str], set[str], DataFrame | None]:
    """Manifest lists, manifests, and paths of files that some of the snapshots holds (what it has deleted it doesn't hold)."""
    lists = {s.manifest_list for s in snapshots}
    read = {s.snapshot_id: M.read_list(table.store, s.manifest_list) for s in snapshots}
    found = {m.path: m for own in read.values() for m in own}
    if not found:
        return lists, set(), None
    of = table.spark.createDataFrame([(i, m.path.rsplit("/", 1)[1]) for i, own in read.items() for m in own], "snapshot long, manifest string")
    parts = []
    for deletes in (False, True):
        own = [m for m in found.values() if m.deletes == deletes]
        if own:
            rows = M.entries(table.spark, table.store, meta, own, deletes)
            parts.append(rows.select("path", (F.col("status") == DELETED).alias("gone"), F.col("_metadata.file_name").alias("manifest")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    held = rows.join(of, "manifest").groupBy("snapshot", "path").agg(F.max("gone").alias("gone")).where("NOT gone")
    return lists, set(found), held.select("path").distinct()


def _name_below(table: Table, path: str) -> str | None:
    """A data file's name below the table's folder; None if it lies elsewhere."""
    prefix = f"{table.store.uri}/"
    return path[len(prefix) :] if path.startswith(prefix) else None


def expire_snapshots(table: Table, older_than_ms: int | None = None, retain_last: int = 1, ids: tuple[int, ...] = (), delete_with: Callable[[str], None] | None = None) -> ExpireResult:
    """Forget snapshots, then delete the files that only they held. The metadata is committed first: after a crash in
    between there are orphans, never holes."""
    if retain_last < 1:
        raise ValidationError("at least one snapshot must be retained")
    base = table.ops.refresh()
    limit = table.clock() - EXPIRE_AGE_MS if older_than_ms is None else older_than_ms
    gone = _expired(base, limit, retain_last, ids)
    if not gone:
        return ExpireResult(0, 0, 0, 0)
    out = {s.snapshot_id for s in gone}
    new = replace(base, snapshots=tuple(s for s in base.snapshots if s.snapshot_id not in out), log=tuple(x for x in base.log if x[1] not in out))
    table.ops.commit(base, new)
    drop = delete_with or (lambda name: table.store.delete(name))
    old_lists, old_manifests, old_files = _referenced(table, base, gone)
    lists, manifests, files = _referenced(table, base, list(new.snapshots))
    paths: list[str] = []
    if old_files is not None:
        alone = old_files if files is None else old_files.join(files, "path", "left_anti")
        paths = [n for r in alone.toLocalIterator() if (n := _name_below(table, r.path))]
    for name in [*paths, *sorted(old_manifests - manifests), *sorted(old_lists - lists)]:
        drop(name)
    return ExpireResult(len(gone), len(paths), len(old_manifests - manifests), len(old_lists - lists))


def remove_orphan_files(table: Table, older_than_ms: int | None = None, delete_with: Callable[[str], None] | None = None) -> list[str]:
    """Delete files below the table's folder that no snapshot refers to and that are old enough not to belong to a
    commit under way. Versions of the metadata and the hint are never orphans. Nothing is committed. Returns their names."""
    meta = table.ops.refresh()
    if meta is None:
        raise CommitFailed("there is no table")
    limit = table.clock() - ORPHAN_AGE_MS if older_than_ms is None else older_than_ms
    lists, manifests, files = _referenced(table, meta, list(meta.snapshots))
    old = [n for n, _, t in table.store.list() if t < limit and not _VERSION.match(n) and n not in lists and n not in manifests]
    spark = table.spark
    found = spark.createDataFrame([(n,) for n in old], "name string")
    if files is not None and old:
        prefix = f"{table.store.uri}/"
        held = files.where(F.col("path").startswith(prefix)).select(F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path")).alias("name"))
        found = found.join(held, "name", "left_anti")
    gone = sorted(r.name for r in found.toLocalIterator())
    drop = delete_with or (lambda name: table.store.delete(name))
    for n in gone:
        drop(n)
    return gone

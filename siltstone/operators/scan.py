"""Scans: choose a snapshot, prune files by metadata, read what is left as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import ValidationError
from siltstone.functions import predicates as P
from siltstone.operators import planning
from siltstone.sources import manifests as M
from siltstone.sources.metadata import EQUALITY_DELETES, POSITION_DELETES, DataFile, PartitionSpec, Snapshot
from siltstone.sources.schema import Schema

if TYPE_CHECKING:
    from siltstone.operators.table import Table

_PATH, _POS = "_slt_path", "_slt_pos"


def _plain(path: Column) -> Column:
    """A path without the scheme of local files, which Spark spells with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "/")


def spec_filter(p: P.Predicate, specs: tuple[PartitionSpec, ...], kind_of) -> Column:
    """A bound predicate over entries of mixed specs: each is judged by its own partition fields."""
    out = F.lit(True)
    for spec in specs:
        projected = P.project(p, [(f.field_id, f.source_id, f.transform) for f in spec.fields], kind_of)
        out = F.when(F.col("spec_id") == spec.spec_id, P.over_partition(projected)).otherwise(out)
    return out


@dataclass(frozen=True)
class Scan:
    """An immutable description of a read; every method gives a new one."""

    table: Table
    snapshot_id: int | None = None
    predicate: P.Predicate = P.TRUE

    def use_snapshot(self, snapshot_id: int) -> Scan:
        """Read a certain snapshot; an error if it is unknown or the scan has one already."""
        if self.snapshot_id is not None:
            raise ValidationError("the scan is bound to a snapshot already")
        if self.table.metadata.snapshot(snapshot_id) is None:
            raise ValidationError(f"unknown snapshot {snapshot_id}")
        return replace(self, snapshot_id=snapshot_id)

    def as_of(self, timestamp_ms: int) -> Scan:
        """Read what was current at a time: the last change of the current snapshot not after it."""
        earlier = [s for t, s in self.table.metadata.log if t <= timestamp_ms]
        if not earlier:
            raise ValidationError(f"no snapshot at or before {timestamp_ms}")
        return self.use_snapshot(earlier[-1])

    def filter(self, predicate: P.Predicate) -> Scan:
        """Set the predicate; it takes the place of an earlier one (combine them with &)."""
        return replace(self, predicate=predicate)

    @property
    def snapshot(self) -> Snapshot | None:
        m = self.table.metadata
        return m.current if self.snapshot_id is None else m.snapshot(self.snapshot_id)

    def _bound(self) -> P.Predicate:
        return P.bind(self.predicate, self.table.metadata.schema)

    def _entries(self, deletes: bool) -> DataFrame | None:
        """Live entries of data files or of delete files; None if there are no manifests of them."""
        s = self.snapshot
        found = [m for m in M.read_list(self.table.store, s.manifest_list) if m.deletes == deletes] if s else []
        if not found:
            return None
        return M.live(M.entries(self.table.spark, self.table.store, self.table.metadata, found, deletes), found)

    def entries(self) -> DataFrame:
        """Live data files as a DataFrame of metadata, without the predicate."""
        found = self._entries(False)
        return found if found is not None else self.table.spark.createDataFrame([], M.entry_type(self.table.metadata))

    def _kind(self, field_id: int) -> T.DataType | None:
        return next((f.spark for s in reversed(self.table.metadata.schemas) if (f := s.by_id(field_id))), None)

    def plan(self, partitions: bool = True, metrics: bool = True) -> DataFrame:
        """Live data files that may hold matching rows: by partition values, then by bounds."""
        p, out = self._bound(), self.entries()
        if p == P.TRUE:
            return out
        if partitions:
            out = out.where(spec_filter(p, self.table.metadata.specs, self._kind))
        return out.where(P.inclusive(p)) if metrics else out

    def files(self) -> list[DataFile]:
        """The planned files, by path."""
        return sorted((M.file_of(r) for r in self.plan().drop("status", "snapshot_id", "sequence").toLocalIterator()), key=lambda f: f.path)

    def delete_files(self) -> list[tuple[int, DataFile]]:
        """Live delete files with their sequence numbers."""
        found = self._entries(True)
        if found is None:
            return []
        rows = found.drop("status", "snapshot_id").collect()
        return sorted(((r["sequence"], M.file_of(r)) for r in rows), key=lambda x: (x[0], x[1].path))

    def tasks(self, size: int = planning.SPLIT_SIZE, lookback: int = planning.LOOKBACK, open_cost: int = planning.OPEN_COST) -> list[planning.CombinedTask]:
        """The planned files split and packed."""
        return planning.plan(self.files(), size, lookback, open_cost)

    def to_df(self) -> DataFrame:
        """Matching rows with the current schema's columns: deletes applied, then the predicate row by row.

        The predicate stays an ordinary filter above the scan, so Catalyst pushes it down to Parquet and prunes columns.
        """
        meta, schema = self.table.metadata, self.table.metadata.schema
        planned = [(r.path, r.sequence, r.schema_id) for r in self.plan().select("path", "sequence", "schema_id").toLocalIterator()]
        if not planned:
            return self.table.spark.createDataFrame([], schema.struct())
        rows = self.read(planned, self.delete_files())
        p = self._bound()
        return rows if p == P.TRUE else rows.where(P.over_rows(p, schema))

    def read(self, planned: list[tuple[str, int, int]], deletes: list[tuple[int, DataFile]]) -> DataFrame:
        """Rows of files (path, sequence, schema id) without those that the deletes remove.

        Files are read in groups that share a schema version and the equality deletes that concern them: such a
        delete concerns files of earlier commits only. Position deletes name their rows.
        """
        meta, schema = self.table.metadata, self.table.metadata.schema
        equality = [(s, f) for s, f in deletes if f.content == EQUALITY_DELETES]
        positions = [f.path for _, f in deletes if f.content == POSITION_DELETES]
        steps = sorted({s for s, _ in equality})
        groups: dict[tuple[int, int], list[str]] = {}
        for path, sequence, schema_id in planned:
            groups.setdefault((schema_id, sum(sequence >= s for s in steps)), []).append(path)
        gone = self.table.spark.read.parquet(*positions).select(_plain(F.col("file_path")).alias(_PATH), F.col("pos").alias(_POS)) if positions else None
        parts = []
        for (schema_id, step), paths in sorted(groups.items()):
            later = [(s, f) for s, f in equality if step < len(steps) and s >= steps[step]]
            asked = {i for _, f in later for i in f.equality_ids or ()}
            df = self._read_group(paths, meta.schema_of(schema_id), schema, asked, gone is not None)
            if gone is not None:
                df = df.join(gone, [_PATH, _POS], "left_anti").drop(_PATH, _POS)
            for ids in sorted({f.equality_ids for _, f in later}):
                keys = self._equality([f for _, f in later if f.equality_ids == ids], ids)
                same = reduce(lambda a, b: a & b, (df[self._name(i)].eqNullSafe(keys[f"_eq{i}"]) for i in ids))
                df = df.join(keys, same, "left_anti")
            parts.append(df.select(*(F.col(f"`{f.name}`") for f in schema.fields)))
        return reduce(DataFrame.unionByName, parts)

    def _name(self, field_id: int) -> str:
        f = self.table.metadata.schema.by_id(field_id)
        return f.name if f else f"_slt_field_{field_id}"

    def _read_group(self, paths: list[str], written: Schema, schema: Schema, asked: set[int], positions: bool) -> DataFrame:
        """Files of one schema version under the current names; columns they don't have are null.

        Columns are picked by id: what was renamed is read under its old name, which is also the one that filters
        are pushed down with.
        """
        kept = [f for f in written.fields if schema.by_id(f.id) or f.id in asked]
        source = T.StructType([T.StructField(f.name, f.spark) for f in (kept or written.fields[:1])])
        df = self.table.spark.read.schema(source).parquet(*paths)
        cols = []
        for f in schema.fields:
            old = written.by_id(f.id)
            cols.append((F.col(f"`{old.name}`") if old else F.lit(None)).cast(f.spark).alias(f.name))
        cols += [(F.col(f"`{old.name}`") if (old := written.by_id(i)) else F.lit(None)).alias(self._name(i)) for i in sorted(asked) if not schema.by_id(i)]
        if positions:
            cols += [_plain(F.col("_metadata.file_path")).alias(_PATH), F.col("_metadata.row_index").alias(_POS)]
        return df.select(*cols)

    def _equality(self, files: list[DataFile], ids: tuple[int, ...]) -> DataFrame:
        """Deleted keys as columns _eq<id>."""
        parts = []
        for f in files:
            written = self.table.metadata.schema_of(f.schema_id)
            parts.append(self.table.spark.read.parquet(f.path).select(*(F.col(f"`{written.need(i).name}`").alias(f"_eq{i}") for i in ids)))
        return reduce(DataFrame.unionByName, parts).distinct()



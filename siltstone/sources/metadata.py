"""Table metadata: immutable values on the driver, JSON in the store.

catalog pointer -> TableMetadata -> Snapshot -> manifest list -> manifest -> file entry
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from siltstone.errors import ValidationError
from siltstone.functions.transforms import Transform
from siltstone.sources.schema import Schema

FIRST_FIELD_ID = 1000


@dataclass(frozen=True)
class PartitionField:
    """A partition value: the transform of a source column."""

    field_id: int
    source_id: int
    name: str
    transform: Transform

    def to_json(self) -> dict:
        return {"field-id": self.field_id, "source-id": self.source_id, "name": self.name, "transform": str(self.transform)}

    @staticmethod
    def from_json(d: dict) -> PartitionField:
        return PartitionField(d["field-id"], d["source-id"], d["name"], Transform.parse(d["transform"]))


@dataclass(frozen=True)
class PartitionSpec:
    """The partition fields of one version; none: unpartitioned."""

    fields: tuple[PartitionField, ...] = ()
    spec_id: int = 0

    @staticmethod
    def builder(schema: Schema, spec_id: int = 0) -> SpecBuilder:
        return SpecBuilder(schema, spec_id)

    def describe(self, values: dict[int, object]) -> str:
        """{name=value, ...} of a tuple."""
        return "{" + ", ".join(f"{f.name}={values.get(f.field_id)}" for f in self.fields) + "}"

    def to_json(self) -> dict:
        return {"spec-id": self.spec_id, "fields": [f.to_json() for f in self.fields]}

    @staticmethod
    def from_json(d: dict) -> PartitionSpec:
        return PartitionSpec(tuple(map(PartitionField.from_json, d["fields"])), d["spec-id"])


class SpecBuilder:
    """Collects partition fields of a schema: ``builder.day("ts").bucket("id", 16).build()``."""

    def __init__(self, schema: Schema, spec_id: int = 0) -> None:
        self._schema, self._spec_id, self._fields = schema, spec_id, []

    def add(self, source: str, transform: Transform, name: str | None = None, field_id: int | None = None) -> SpecBuilder:
        """A field with any transform; an error for unknown columns, unsuitable types and names used twice."""
        column = self._schema.need(source)
        transform.check(column.spark)
        name = name or source + transform.suffix
        if any(f.name == name for f in self._fields):
            raise ValidationError(f"partition name {name} is used twice")
        used = [f.field_id for f in self._fields]
        self._fields.append(PartitionField(field_id or max([FIRST_FIELD_ID - 1, *used]) + 1, column.id, name, transform))
        return self

    def identity(self, source: str, name: str | None = None) -> SpecBuilder:
        return self.add(source, Transform("identity"), name)

    def day(self, source: str, name: str | None = None) -> SpecBuilder:
        return self.add(source, Transform("day"), name)

    def hour(self, source: str, name: str | None = None) -> SpecBuilder:
        return self.add(source, Transform("hour"), name)

    def bucket(self, source: str, n: int, name: str | None = None) -> SpecBuilder:
        return self.add(source, Transform("bucket", n), name)

    def truncate(self, source: str, width: int, name: str | None = None) -> SpecBuilder:
        return self.add(source, Transform("truncate", width), name)

    def build(self) -> PartitionSpec:
        return PartitionSpec(tuple(self._fields), self._spec_id)


DATA, POSITION_DELETES, EQUALITY_DELETES = "DATA", "POSITION_DELETES", "EQUALITY_DELETES"


@dataclass(frozen=True)
class DataFile:
    """A file of rows or of deletes, with what is known of its columns by id (bounds in stored form)."""

    path: str
    record_count: int
    file_size: int
    spec_id: int = 0
    schema_id: int = 0
    content: str = DATA
    partition: dict[int, int | float | str | None] = field(default_factory=dict)
    lower: dict[int, int | float | str] = field(default_factory=dict)
    upper: dict[int, int | float | str] = field(default_factory=dict)
    null_counts: dict[int, int] = field(default_factory=dict)
    value_counts: dict[int, int] = field(default_factory=dict)
    split_offsets: tuple[int, ...] | None = None
    equality_ids: tuple[int, ...] | None = None

    def to_json(self) -> dict:
        keyed = lambda m: {str(k): v for k, v in m.items()}
        return {
            "path": self.path,
            "record_count": self.record_count,
            "file_size": self.file_size,
            "spec_id": self.spec_id,
            "schema_id": self.schema_id,
            "content": self.content,
            **{k: keyed(getattr(self, k)) for k in ("partition", "lower", "upper", "null_counts", "value_counts")},
            "split_offsets": list(self.split_offsets) if self.split_offsets else None,
            "equality_ids": list(self.equality_ids) if self.equality_ids else None,
        }

    @staticmethod
    def from_json(d: dict) -> DataFile:
        keyed = lambda m: {int(k): v for k, v in (m or {}).items()}
        return DataFile(
            d["path"], d["record_count"], d["file_size"], d.get("spec_id", 0), d.get("schema_id", 0), d.get("content", DATA),
            *(keyed(d.get(k)) for k in ("partition", "lower", "upper", "null_counts", "value_counts")),
            tuple(d["split_offsets"]) if d.get("split_offsets") else None,
            tuple(d["equality_ids"]) if d.get("equality_ids") else None,
        )


ADDED, EXISTING, DELETED = "ADDED", "EXISTING", "DELETED"


@dataclass(frozen=True)
class Manifest:
    """A file of entries; ``deletes`` tells whether they are delete files."""

    path: str
    length: int
    deletes: bool
    spec_id: int
    sequence: int
    snapshot_id: int
    added: int = 0
    existing: int = 0
    deleted: int = 0
    added_rows: int = 0
    existing_rows: int = 0
    deleted_rows: int = 0


@dataclass(frozen=True)
class Snapshot:
    """A state of the table. ``schema_id`` is recorded for information; reads use the current schema."""

    snapshot_id: int
    timestamp_ms: int
    manifest_list: str
    sequence: int
    parent_id: int | None
    summary: dict[str, str]
    schema_id: int | None = None

    @property
    def operation(self) -> str | None:
        return self.summary.get("operation")


def new_snapshot_id() -> int:
    """A positive 63-bit number."""
    u = uuid.uuid4().int
    return (u >> 64 ^ u) & (1 << 63) - 1


@dataclass(frozen=True)
class TableMetadata:
    """All of a table's metadata as of one version."""

    table_uuid: str
    location: str
    schemas: tuple[Schema, ...]
    specs: tuple[PartitionSpec, ...]
    current_schema_id: int = 0
    default_spec_id: int = 0
    last_sequence: int = 0
    current_snapshot_id: int | None = None
    snapshots: tuple[Snapshot, ...] = ()
    log: tuple[tuple[int, int], ...] = ()  # (timestamp ms, snapshot id) of every change of the current snapshot
    format_version: int = 2
    properties: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> Schema:
        return self.schema_of(self.current_schema_id)

    def schema_of(self, schema_id: int) -> Schema:
        return next(s for s in self.schemas if s.schema_id == schema_id)

    @property
    def spec(self) -> PartitionSpec:
        return self.spec_of(self.default_spec_id)

    def spec_of(self, spec_id: int) -> PartitionSpec:
        found = next((s for s in self.specs if s.spec_id == spec_id), None)
        if found is None:
            raise ValidationError(f"unknown partition spec {spec_id}")
        return found

    def snapshot(self, snapshot_id: int | None) -> Snapshot | None:
        return next((s for s in self.snapshots if s.snapshot_id == snapshot_id), None)

    @property
    def current(self) -> Snapshot | None:
        return self.snapshot(self.current_snapshot_id)

    @property
    def last_column_id(self) -> int:
        """Over all versions: ids aren't used again."""
        return max(s.highest_id for s in self.schemas)

    @property
    def last_partition_id(self) -> int:
        return max([FIRST_FIELD_ID - 1, *(f.field_id for s in self.specs for f in s.fields)])

    def with_snapshot(self, s: Snapshot) -> TableMetadata:
        """The snapshot added and made current."""
        return replace(self, snapshots=(*self.snapshots, s), current_snapshot_id=s.snapshot_id, last_sequence=s.sequence, log=(*self.log, (s.timestamp_ms, s.snapshot_id)))

    def with_current(self, snapshot_id: int, timestamp_ms: int) -> TableMetadata:
        return replace(self, current_snapshot_id=snapshot_id, log=(*self.log, (timestamp_ms, snapshot_id)))

    def with_property(self, key: str, value: str) -> TableMetadata:
        return replace(self, properties=self.properties | {key: value})

    def with_schema(self, schema: Schema) -> TableMetadata:
        schema = replace(schema, schema_id=max(s.schema_id for s in self.schemas) + 1)
        return replace(self, schemas=(*self.schemas, schema), current_schema_id=schema.schema_id)

    def with_spec(self, spec: PartitionSpec) -> TableMetadata:
        spec = replace(spec, spec_id=max(s.spec_id for s in self.specs) + 1)
        return replace(self, specs=(*self.specs, spec), default_spec_id=spec.spec_id)

    def to_json(self) -> str:
        return json.dumps(
            {
                "format-version": self.format_version,
                "table-uuid": self.table_uuid,
                "location": self.location,
                "last-sequence-number": self.last_sequence,
                "current-schema-id": self.current_schema_id,
                "schemas": [s.to_json() for s in self.schemas],
                "default-spec-id": self.default_spec_id,
                "partition-specs": [s.to_json() for s in self.specs],
                "current-snapshot-id": self.current_snapshot_id,
                "snapshots": [s.__dict__ for s in self.snapshots],
                "snapshot-log": [list(x) for x in self.log],
                "properties": self.properties,
            },
            indent=1,
        )

    @staticmethod
    def from_json(text: str) -> TableMetadata:
        """Properties that aren't known are passed over."""
        d = json.loads(text)
        known = Snapshot.__dataclass_fields__
        return TableMetadata(
            d["table-uuid"],
            d["location"],
            tuple(map(Schema.from_json, d["schemas"])),
            tuple(map(PartitionSpec.from_json, d["partition-specs"])),
            d["current-schema-id"],
            d["default-spec-id"],
            d["last-sequence-number"],
            d["current-snapshot-id"],
            tuple(Snapshot(**{k: v for k, v in s.items() if k in known}) for s in d["snapshots"]),
            tuple(tuple(x) for x in d["snapshot-log"]),
            d.get("format-version", 2),
            d.get("properties", {}),
        )

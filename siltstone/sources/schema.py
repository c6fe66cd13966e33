"""Versioned schemas whose columns are known by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.errors import ValidationError

#: Short names that stand for Spark's.
ALIASES = {"long": "bigint", "integer": "int"}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a declared type (any DDL type name)."""
    return T.DataType.fromDDL(ALIASES.get(name, name))


def bound_kind(kind: T.DataType) -> str | None:
    """How bounds of a type are stored: long, double, string; None if it has none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "long"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    return "string" if isinstance(kind, T.StringType) else None


@dataclass(frozen=True)
class Field:
    """A column: its id never changes and is never used again; ``required`` is a declaration only."""

    id: int
    name: str
    type: str
    required: bool = False

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.type)


@dataclass(frozen=True)
class Schema:
    """Columns in order, as of one version."""

    fields: tuple[Field, ...]
    schema_id: int = 0

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names) or len({f.id for f in self.fields}) < len(names):
            raise ValidationError("column names and ids must be unique")

    @staticmethod
    def of(*columns: tuple[str, str] | tuple[str, str, bool], schema_id: int = 0) -> Schema:
        """A schema with the ids 1, 2 ... of (name, type[, required])."""
        return Schema(tuple(Field(i, *c) for i, c in enumerate(columns, 1)), schema_id)

    @staticmethod
    def of_frame(df: DataFrame) -> Schema:
        """The schema of a DataFrame, ids by position."""
        return Schema(tuple(Field(i, f.name, f.dataType.simpleString(), not f.nullable) for i, f in enumerate(df.schema.fields, 1)))

    def by_name(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def by_id(self, field_id: int) -> Field | None:
        return next((f for f in self.fields if f.id == field_id), None)

    def need(self, ref: str | int) -> Field:
        """The column of a name or id; an error if there is none."""
        found = self.by_id(ref) if isinstance(ref, int) else self.by_name(ref)
        if found is None:
            raise ValidationError(f"no column {ref!r}")
        return found

    @property
    def highest_id(self) -> int:
        return max((f.id for f in self.fields), default=0)

    def struct(self) -> T.StructType:
        """As Spark's type; every column can hold nulls and carries its id for Parquet."""
        return T.StructType([T.StructField(f.name, f.spark, True, {"parquet.field.id": f.id}) for f in self.fields])

    def to_json(self) -> dict:
        return {"schema-id": self.schema_id, "fields": [{"id": f.id, "name": f.name, "type": f.type, "required": f.required} for f in self.fields]}

    @staticmethod
    def from_json(d: dict) -> Schema:
        return Schema(tuple(Field(f["id"], f["name"], f["type"], f.get("required", False)) for f in d["fields"]), d["schema-id"])

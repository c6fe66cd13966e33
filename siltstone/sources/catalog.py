"""A catalog of tables in a folder: namespaces are folders, a table is a folder with metadata."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.errors import AlreadyExists, NoSuchTable, ValidationError
from siltstone.operators.table import Table
from siltstone.operators.updates import now_ms
from siltstone.sources.commit import TableOps
from siltstone.sources.metadata import PartitionSpec, TableMetadata
from siltstone.sources.schema import Schema
from siltstone.sources.store import store_for


def parts_of(name: str) -> tuple[str, ...]:
    """The levels of a dotted name, the last being the table; empty levels and null bytes are refused."""
    parts = tuple(name.split("."))
    for p in parts:
        if not p or "\0" in p or "/" in p or p in ("..", "."):
            raise ValidationError(f"not a table name: {name!r}")
    return parts


class Catalog:
    """Tables below a warehouse folder."""

    def __init__(self, spark: SparkSession, warehouse: str, clock: Callable[[], int] = now_ms) -> None:
        self.spark, self.warehouse, self.clock = spark, warehouse.rstrip("/"), clock

    def _location(self, name: str) -> str:
        return "/".join([self.warehouse, *parts_of(name)])

    def _table(self, name: str) -> Table:
        store = store_for(self.spark, self._location(name))
        return Table(self.spark, name, store, TableOps(store), self.clock)

    def create(self, name: str, schema: Schema | DataFrame, spec: PartitionSpec | Callable[[Schema], PartitionSpec] | None = None) -> Table:
        """A new, empty table; AlreadyExists if there is one."""
        schema = Schema.of_frame(schema) if isinstance(schema, DataFrame) else schema
        spec = spec(schema) if callable(spec) else spec or PartitionSpec()
        for f in spec.fields:
            f.transform.check(schema.need(f.source_id).spark)
        table = self._table(name)
        if table.ops.refresh() is not None:
            raise AlreadyExists(name)
        table.ops.create(TableMetadata(str(uuid.uuid4()), self._location(name), (schema,), (spec,), schema.schema_id, spec.spec_id))
        return table

    def load(self, name: str) -> Table:
        """A table as it is now; NoSuchTable if there is none."""
        table = self._table(name)
        if table.ops.refresh() is None:
            raise NoSuchTable(name)
        return table

    def exists(self, name: str) -> bool:
        return self._table(name).ops.refresh() is not None

    def drop(self, name: str) -> bool:
        """Delete a table with all its files; False if there is none."""
        table = self._table(name)
        return table.ops.refresh() is not None and table.store.drop()


def scratch(spark: SparkSession) -> Catalog:
    """A catalog in a new folder that the driver and all executors see: below spark.checkpoint.dir, or,
    where that isn't set, a temporary folder if all is on one machine (master ``local``); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='siltstone-tables-')}"
    return Catalog(spark, f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}")

"""Reading a plan task by task: partition i of the DataFrame is combined task i.

``Scan.to_df`` is the way to read a table; Spark splits and packs for itself there. This reader is for those who
want a plan's own tasks as partitions. Each row group is read once, by the task in whose byte range it begins; columns are
picked by id; row deletes aren't applied here, so a scan that has some is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.errors import ValidationError
from siltstone.functions import predicates as P
from siltstone.operators import planning
from siltstone.operators.scan import Scan
from siltstone.sources.store import LocalStore


def _groups(f: pq.ParquetFile, start: int, length: int) -> list[int]:
    """Row groups that begin in a byte range."""
    out = []
    for g in range(f.metadata.num_row_groups):
        chunks = [f.metadata.row_group(g).column(c) for c in range(f.metadata.row_group(g).num_columns)]
        first = min(c.data_page_offset if c.dictionary_page_offset is None else c.dictionary_page_offset for c in chunks)
        if start <= first < start + length:
            out.append(g)
    return out


def task_df(scan: Scan, size: int = planning.SPLIT_SIZE, lookback: int = planning.LOOKBACK, open_cost: int = planning.OPEN_COST) -> DataFrame:
    """The scan's rows with a partition per combined task. Files without row-group offsets are cut into ranges by ``size``."""
    table = scan.table
    if not isinstance(table.store, LocalStore):
        raise ValidationError("tasks are read from local paths only")
    if scan.delete_files():
        raise ValidationError("the scan has row deletes; read it with to_df")
    schema = table.schema
    names = {s.schema_id: {f.id: f.name for f in s.fields} for s in table.metadata.schemas}
    current = [(f.id, f.name) for f in schema.fields]
    tasks = [[(t.file.path.removeprefix("file://"), names[t.file.schema_id], t.start, t.length) for t in c.tasks] for c in scan.tasks(size, lookback, open_cost)]
    arrow = to_arrow_schema(schema.struct())
    spark = table.spark
    if not tasks:
        return spark.createDataFrame([], schema.struct())
    shared = spark.sparkContext.broadcast(tasks)  # the plan's byte ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                for path, own, start, length in shared.value[i]:
                    with pq.ParquetFile(path) as f:
                        groups = _groups(f, start, length)
                        if not groups:
                            continue
                        held = set(f.schema_arrow.names)
                        columns = [own[k] for k, _ in current if own.get(k) in held]
                        for part in f.iter_batches(row_groups=groups, columns=columns):
                            cols = [part.column(own[k]).cast(arrow.field(n).type) if own.get(k) in held else pa.nulls(part.num_rows, arrow.field(n).type) for k, n in current]
                            yield pa.RecordBatch.from_arrays(cols, names=[n for _, n in current])

    df = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema.struct())
    bound = P.bind(scan.predicate, schema)
    return df if bound == P.TRUE else df.where(P.over_rows(bound, schema))

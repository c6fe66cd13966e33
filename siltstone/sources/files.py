"""Data files: written by Spark so that each holds one partition tuple, and described by their footers."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import ValidationError
from siltstone.functions.transforms import micros
from siltstone.sources.metadata import DATA, DataFile, PartitionSpec
from siltstone.sources.schema import Schema, bound_kind
from siltstone.sources.store import LocalStore

#: With more new files than this, footers are read by tasks rather than on the driver.
DRIVER_FOOTERS = 64
_PART = "_part"


def aligned(df: DataFrame, schema: Schema) -> DataFrame:
    """df with the schema's columns by name, in order and type; absent ones are null, unknown ones an error."""
    unknown = [c for c in df.columns if schema.by_name(c) is None]
    if unknown:
        raise ValidationError(f"columns {unknown} aren't in the table")
    cols = []
    for f in schema.fields:
        value = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        cols.append(value.cast(f.spark).alias(f.name, metadata={"parquet.field.id": f.id}))
    return df.select(*cols)


def partition_columns(schema: Schema, spec: PartitionSpec) -> list[Column]:
    """The partition values of a row."""
    return [f.transform.column(F.col(f"`{schema.need(f.source_id).name}`"), schema.need(f.source_id).spark) for f in spec.fields]


def write_files(
    df: DataFrame,
    store: LocalStore,
    schema: Schema,
    spec: PartitionSpec,
    rows_per_file: int | None = None,
    sort_by: Iterable[str] = (),
    options: dict[str, str] | None = None,
) -> list[DataFile]:
    """Write rows as new Parquet files and describe them; they belong to no snapshot yet.

    Rows are brought together by partition tuple with a rebalancing exchange, which splits a tuple that holds
    much and joins those that hold little, so neither one hot partition nor many small files arise.
    """
    folder = f"data/{uuid.uuid4().hex}"
    out = aligned(df, schema)
    if spec.fields:
        key = F.xxhash64(*partition_columns(schema, spec), *(c.isNull() for c in partition_columns(schema, spec)))
        out = out.withColumn(_PART, key).hint("rebalance", F.col(_PART))
    order = [F.col(_PART)] * bool(spec.fields) + [F.col(f"`{c}`") for c in sort_by]
    if sort_by:
        out = out.sortWithinPartitions(*order)
    writer = out.write.option("compression", "snappy").options(**(options or {}))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if spec.fields:
        writer = writer.partitionBy(_PART)
    with _setting(df.sparkSession, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):  # the old form has no bounds
        writer.parquet(f"{store.uri}/{folder}")
    names = [n for n, _, _ in store.list(folder) if n.endswith(".parquet") and not n.rsplit("/", 1)[1].startswith((".", "_"))]
    return describe(df.sparkSession, store, names, schema, spec)


_SETTING = threading.Lock()
_held: dict[tuple[int, str], list] = {}


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting while files are written; of writers in several threads the last to leave restores it."""
    with _SETTING:
        entry = _held.setdefault((id(spark._jsparkSession), key), [0, None])
        if entry[0] == 0:
            entry[1] = spark.conf.get(key)
            spark.conf.set(key, value)
        entry[0] += 1
    try:
        yield
    finally:
        with _SETTING:
            entry[0] -= 1
            if entry[0] == 0:
                spark.conf.set(key, entry[1])
                del _held[id(spark._jsparkSession), key]


def uri_of(store: LocalStore, name: str) -> str:
    """A file's path as Spark's file metadata spells it (stores refuse roots that would be escaped)."""
    return f"{store.uri}/{name}"


def footer(path: str) -> dict:
    """Row count, size, row-group offsets and per column id bounds and counts, from a Parquet footer.

    A column's bounds are left out unless every row group has them.
    """
    with pq.ParquetFile(path) as f:
        meta, arrow = f.metadata, f.schema_arrow
    ids = {n: int(f.metadata[b"PARQUET:field_id"]) for n in arrow.names if (f := arrow.field(n)).metadata and b"PARQUET:field_id" in f.metadata}
    out: dict = {"rows": meta.num_rows, "offsets": [], "lower": {}, "upper": {}, "nulls": {}, "values": {}}
    broken = set()
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        starts = []
        for c in range(group.num_columns):
            chunk = group.column(c)
            starts.append(chunk.dictionary_page_offset if chunk.dictionary_page_offset is not None else chunk.data_page_offset)
            field_id = ids.get(chunk.path_in_schema)
            if field_id is None:
                continue
            out["values"][field_id] = out["values"].get(field_id, 0) + chunk.num_values
            stats = chunk.statistics
            if stats is None or not stats.has_null_count:
                broken.add((field_id, "n"))
            else:
                out["nulls"][field_id] = out["nulls"].get(field_id, 0) + stats.null_count
            if stats is not None and stats.has_min_max:
                low, high = stats.min_raw, stats.max_raw
                if isinstance(low, bytes):
                    low, high = low.decode("utf-8", "replace"), high.decode("utf-8", "replace")
                out["lower"][field_id] = min(out["lower"].get(field_id, low), low)
                out["upper"][field_id] = max(out["upper"].get(field_id, high), high)
            elif stats is None or not stats.has_null_count or stats.null_count < chunk.num_values:
                broken.add((field_id, "b"))
        out["offsets"].append(min(starts))
    for field_id, what in broken:
        for name in ("nulls",) if what == "n" else ("lower", "upper"):
            out[name].pop(field_id, None)
    return out


def _from_footer(path: str, size: int, uri: str, read: dict, schema: Schema, spec: PartitionSpec, content: str = DATA, equality_ids: tuple[int, ...] | None = None, given: dict | None = None) -> DataFile:
    given = given or {}
    kinds = {f.id: bound_kind(f.spark) for f in schema.fields}
    keep = lambda m: {k: v for k, v in m.items() if kinds.get(k)}
    lower, upper = keep(read["lower"]), keep(read["upper"])
    partition = {}
    for f in spec.fields:
        kind = schema.need(f.source_id).spark
        if f.field_id in given:
            partition[f.field_id] = given[f.field_id]
            continue
        if read["nulls"].get(f.source_id) == read["values"].get(f.source_id):
            partition[f.field_id] = None
            continue
        if f.source_id not in lower:
            raise ValidationError(f"{path}: no bounds of {f.name}'s column, so its partition isn't known")
        value = f.transform.literal(lower[f.source_id], kind)
        if value != f.transform.literal(upper[f.source_id], kind) and f.transform.name != "bucket":
            raise ValidationError(f"{path} holds more than one value of {f.name}")
        partition[f.field_id] = value
    return DataFile(uri, read["rows"], size, spec.spec_id, schema.schema_id, content, partition, lower, upper, read["nulls"], read["values"], tuple(read["offsets"]) or None, equality_ids)


def _from_rows(schema: Schema, spec: PartitionSpec) -> list:
    """Partition fields whose value isn't told by bounds: Parquet has none of long strings, and none that hold for NaN."""
    return [f for f in spec.fields if bound_kind(schema.need(f.source_id).spark) in ("string", "double")]


def _tuple_columns(schema: Schema, spec: PartitionSpec) -> list[Column]:
    """Of a file's rows, the least and the largest value of these fields."""
    out = []
    for f in _from_rows(schema, spec):
        source = schema.need(f.source_id)
        value = f.transform.column(F.col(f"`{source.name}`"), source.spark)
        out += [F.min(value).alias(f"least{f.field_id}"), F.max(value).alias(f"most{f.field_id}")]
    return out


def _given(path: str, row: dict, schema: Schema, spec: PartitionSpec) -> dict:
    out = {}
    for f in _from_rows(schema, spec):
        low, high = row[f"least{f.field_id}"], row[f"most{f.field_id}"]
        if low != high and not (low != low and high != high):  # NaN isn't equal to itself
            raise ValidationError(f"{path} holds more than one value of {f.name}")
        out[f.field_id] = low
    return out


def _tuples(spark: SparkSession, store: LocalStore, names: list[str], schema: Schema, spec: PartitionSpec) -> dict[str, dict]:
    """By file, the values of these fields, from one aggregation over their columns in the new files."""
    if not names or not _from_rows(schema, spec):
        return {}
    df = spark.read.schema(schema.struct()).parquet(*(f"{store.uri}/{n}" for n in names))
    rows = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(*_tuple_columns(schema, spec)).toLocalIterator()
    depths, out = {n.count("/") + 1 for n in names}, {}
    for r in rows:
        tails = ("/".join(r.path.split("/")[-d:]) for d in depths)
        out |= {n: _given(r.path, r.asDict(), schema, spec) for n in tails}
    return out


def describe(spark: SparkSession, store: LocalStore, names: list[str], schema: Schema, spec: PartitionSpec, content: str = DATA, equality_ids: tuple[int, ...] | None = None) -> list[DataFile]:
    """Describe written files. On a local path footers are read, by tasks if there are many; elsewhere Spark aggregates the files."""
    if not isinstance(store, LocalStore):
        return _describe_by_scan(spark, store, names, schema, spec, content, equality_ids)
    root, sizes = store.root, {n: os.path.getsize(f"{store.root}/{n}") for n in names}
    if len(names) <= DRIVER_FOOTERS:
        with ThreadPoolExecutor(8) as pool:
            read = list(pool.map(lambda n: footer(f"{root}/{n}"), names))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(n, json.dumps(footer(f"{root}/{n}"))) for n in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out]), pa.array([j for _, j in out])], names=["name", "footer"])

        frame = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names) // 16 + 1, 2 * spark.sparkContext.defaultParallelism))
        got = {r.name: json.loads(r.footer) for r in frame.mapInArrow(run, "name string, footer string").collect()}
        numbered = lambda m: {int(k): v for k, v in m.items()}
        read = [{k: numbered(v) if isinstance(v, dict) else v for k, v in got[n].items()} for n in names]
    tuples = _tuples(spark, store, names, schema, spec)
    return [_from_footer(n, sizes[n], uri_of(store, n), r, schema, spec, content, equality_ids, tuples.get(n)) for n, r in zip(names, read, strict=True) if r["rows"]]


def _describe_by_scan(spark: SparkSession, store, names: list[str], schema: Schema, spec: PartitionSpec, content: str, equality_ids: tuple[int, ...] | None) -> list[DataFile]:
    """The same by one aggregation over the new files, for stores that only Spark reads."""
    if not names:
        return []
    df = spark.read.schema(schema.struct()).parquet(*(f"{store.uri}/{n}" for n in names))
    aggs = [F.count(F.lit(1)).alias("n"), F.first("_metadata.file_size").alias("size"), *_tuple_columns(schema, spec)]
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"v{f.id}"))
        if bound_kind(f.spark):
            value = micros(c, f.spark) if isinstance(f.spark, (T.TimestampType, T.TimestampNTZType)) else F.unix_date(c).cast("long") if isinstance(f.spark, T.DateType) else c
            aggs += [F.min(value).alias(f"l{f.id}"), F.max(value).alias(f"u{f.id}")]
    out = []
    for r in df.groupBy(F.col("_metadata.file_path").alias("path")).agg(*aggs).toLocalIterator():
        d = r.asDict()
        bounds = {s: {f.id: d[f"{s}{f.id}"] for f in schema.fields if d.get(f"{s}{f.id}") is not None and d[f"{s}{f.id}"] == d[f"{s}{f.id}"]} for s in "lu"}
        both = bounds["l"].keys() & bounds["u"].keys()
        read = {"rows": d["n"], "offsets": [], "lower": {k: bounds["l"][k] for k in both}, "upper": {k: bounds["u"][k] for k in both}, "nulls": {f.id: d["n"] - d[f"v{f.id}"] for f in schema.fields}, "values": {f.id: d["n"] for f in schema.fields}}
        out.append(_from_footer(d["path"], d["size"], d["path"], read, schema, spec, content, equality_ids, _given(d["path"], d, schema, spec)))
    return out

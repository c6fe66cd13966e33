"""The registered queries over the table format, with the DuckDB SQL that checks them.

Each query builds the tables it needs in a new folder and returns rows that depend on the source data only.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import AlreadyExists, CommitFailed, NoSuchTable, SimulatedCrash, ValidationError
from siltstone.functions import predicates as P
from siltstone.functions.bounds import binary_bounds, decode
from siltstone.functions.predicates import col
from siltstone.functions.transforms import Transform
from siltstone.operators.planning import plan, split
from siltstone.operators.table import Table
from siltstone.operators.task_reader import task_df
from siltstone.plans.sql_filters import where
from siltstone.sources.catalog import Catalog, scratch
from siltstone.sources.commit import HINT, TableOps, version_file
from siltstone.sources.metadata import DataFile, PartitionSpec, TableMetadata
from siltstone.sources.raw import anatomy, column_bytes, csv_round_trip, read_merged, row_groups_kept
from siltstone.sources.schema import Schema

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _by_day(s: Schema) -> PartitionSpec:
    return PartitionSpec.builder(s).day("ts").build()


def _filled(spark: SparkSession, df: DataFrame, spec: Callable[[Schema], PartitionSpec] | None = None, name: str = "t") -> Table:
    t = scratch(spark).create(name, df, spec)
    t.append(df)
    return t


def _events(spark: SparkSession, sf_dir: str) -> Table:
    return _filled(spark, _read(spark, sf_dir, "events"), _by_day)


EARLY, LATE = "2024-01-10T00:00:00", "2024-01-20T00:00:00"
RANGE = (col("ts") >= EARLY) & (col("ts") < LATE)
ROWS = "event_id, user_id, event_type, value"
_PICK = ("event_id", "user_id", "event_type", "value")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events partitioned by day, scanned for a range of days and values, counted by type."""
    rows = _events(spark, sf_dir).to_df(RANGE & (col("value") > 50))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# Scans and predicates


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def full_scan_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full scan of a partitioned table, counted by type."""
    return _events(spark, sf_dir).to_df().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts >= '{EARLY}' AND ts < '{LATE}' AND value > 50 GROUP BY event_type")
def pruned_scan_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return entry(spark, sf_dir)


@query(f"SELECT {ROWS} FROM events WHERE ts >= '{EARLY}' AND ts < '{LATE}' AND value > 50")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a range of days above a value."""
    return _events(spark, sf_dir).to_df(RANGE & (col("value") > 50)).select(*_PICK)


@query(f"SELECT {ROWS} FROM events WHERE ts < '{EARLY}' OR ts > '{LATE}'")
def or_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges joined by or."""
    return _events(spark, sf_dir).to_df((col("ts") < EARLY) | (col("ts") > LATE)).select(*_PICK)


@query(f"SELECT {ROWS} FROM events WHERE NOT (ts >= '{EARLY}' AND (ts < '{LATE}' OR value > 90))")
def not_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negated predicate, pushed down to its comparisons."""
    return _events(spark, sf_dir).to_df(~((col("ts") >= EARLY) & ((col("ts") < LATE) | (col("value") > 90)))).select(*_PICK)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'click' AND user_id = 7")
def not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons with = and !=."""
    spec = lambda s: PartitionSpec.builder(s).identity("event_type").bucket("user_id", 4).build()
    return _filled(spark, _read(spark, sf_dir, "events"), spec).to_df((col("event_type") != "click") & (col("user_id") == 7)).select(*_PICK)


@query(f"SELECT count(DISTINCT epoch_us(ts) // 86400000000) AS files FROM events WHERE ts >= '{EARLY}' AND ts < '{LATE}'")
def prune_files_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days' files a range leaves (each day counts once, however many files it has)."""
    return _events(spark, sf_dir).scan().filter(RANGE).plan(metrics=False).select(F.countDistinct("partition.`1000`").alias("files"))


@query("SELECT count(DISTINCT epoch_us(ts) // 86400000000) AS files FROM events WHERE ts < '2024-01-03 00:00:00'")
def projection_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict comparison with midnight leaves the days before only."""
    return _events(spark, sf_dir).scan().filter(col("ts") < "2024-01-03T00:00:00").plan(metrics=False).select(F.countDistinct("partition.`1000`").alias("files"))


@query("""SELECT (SELECT count(DISTINCT epoch_us(ts) // 86400000000) FROM events) AS live,
          (SELECT count(*) FROM (SELECT max(user_id) AS m FROM events GROUP BY epoch_us(ts) // 86400000000) WHERE m > 148) AS by_bounds""")
def metrics_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days left by bounds of a column that isn't partitioned by."""
    scan = _events(spark, sf_dir).scan().filter(col("user_id") > 148)
    day = F.countDistinct("partition.`1000`")
    return scan.entries().select(day.alias("live")).crossJoin(scan.plan().select(day.alias("by_bounds")))


# Transforms


def _transformed(spark: SparkSession, sf_dir: str, table: str, key: str, column: str, t: str) -> DataFrame:
    df = _read(spark, sf_dir, table)
    return df.select(key, Transform.parse(t).column(F.col(column), df.schema[column].dataType).alias("v"))


@query("SELECT event_id, epoch_us(ts) // 86400000000 AS v FROM events")
def day_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of times."""
    return _transformed(spark, sf_dir, "events", "event_id", "ts", "day")


@query("SELECT event_id, epoch_us(ts) // 3600000000 AS v FROM events")
def hour_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of times."""
    return _transformed(spark, sf_dir, "events", "event_id", "ts", "hour")


@query("SELECT event_id, (xor(event_id, event_id >> 32) & 2147483647) % 16 AS v FROM events")
def bucket_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of longs."""
    return _transformed(spark, sf_dir, "events", "event_id", "event_id", "bucket[16]")


@query("SELECT c_custkey, (c_nationkey & 2147483647) % 7 AS v FROM customer")
def bucket_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of integers."""
    return _transformed(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "bucket[7]")


@query("""SELECT c_custkey, (list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 4294967295) & 2147483647) % 16 AS v FROM customer""")
def bucket_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of strings."""
    return _transformed(spark, sf_dir, "customer", "c_custkey", "c_name", "bucket[16]")


@query("SELECT event_id, user_id - ((user_id % 10) + 10) % 10 AS v FROM events")
def truncate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longs down to tens."""
    return _transformed(spark, sf_dir, "events", "event_id", "user_id", "truncate[10]")


@query("SELECT event_id, left(event_type, 3) AS v FROM events")
def truncate_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings cut to three characters."""
    return _transformed(spark, sf_dir, "events", "event_id", "event_type", "truncate[3]")


# Partitioned files and their statistics


@query("SELECT l_returnflag AS p, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
def identity_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition value, from metadata alone."""
    t = _filled(spark, _read(spark, sf_dir, "lineitem"), lambda s: PartitionSpec.builder(s).identity("l_returnflag").build())
    return t.files().groupBy(F.col("partition.`1000`").alias("p")).agg(F.sum("record_count").alias("n"))


@query("""SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS d, CAST(count(*) AS BIGINT) AS n, min(event_id) AS lo, max(event_id) AS hi, min(event_type) AS lo_type, max(value) AS hi_value,
          CAST(count(*) - count(props) AS BIGINT) AS nulls FROM events GROUP BY 1""")
def stats_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and counts per day, from metadata alone."""
    return (
        _events(spark, sf_dir).files().groupBy(F.col("partition.`1000`").alias("d"))
        .agg(F.sum("record_count").alias("n"), F.min("lower.`1`").alias("lo"), F.max("upper.`1`").alias("hi"), F.min("lower.`4`").alias("lo_type"), F.max("upper.`5`").alias("hi_value"), F.sum("null_counts.`6`").alias("nulls"))
    )


# Changes


@query(f"SELECT {ROWS} FROM events WHERE NOT (ts >= '{EARLY}' AND ts < '{LATE}')")
def metadata_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days deleted without reading a row."""
    t = _events(spark, sf_dir)
    t.delete_where(RANGE)
    return t.to_df().select(*_PICK)


@query(f"SELECT {ROWS} FROM events WHERE NOT (ts >= '{EARLY}' AND value > 50)")
def copy_on_write_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single rows deleted by writing their files anew."""
    t = _events(spark, sf_dir)
    t.delete_where((col("ts") >= EARLY) & (col("value") > 50), mode="copy_on_write")
    return t.to_df().select(*_PICK)


@query(f"SELECT event_id, value FROM events WHERE NOT (ts >= '{EARLY}' AND ts < '{LATE}') UNION ALL SELECT event_id, -value FROM events WHERE ts >= '{EARLY}' AND ts < '{LATE}' AND event_type = 'click'")
def overwrite_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days replaced by other rows in one snapshot."""
    t = _events(spark, sf_dir)
    new = _read(spark, sf_dir, "events").where(f"ts >= '{EARLY}' AND ts < '{LATE}' AND event_type = 'click'").withColumn("value", -F.col("value"))
    change = t.new_overwrite()
    change.append(new)
    change.delete_matching(RANGE).commit()
    return t.to_df().select("event_id", "value")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 10 <> 3")
def row_delta_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows deleted by file and position."""
    t = _events(spark, sf_dir)
    paths = [f.path for f in t.scan().files()]
    doomed = spark.read.parquet(*paths).where("event_id % 10 = 3").select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    t.new_row_delta().delete_positions(doomed).commit()
    return t.to_df().select(*_PICK)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE user_id >= 20 UNION ALL SELECT event_id, user_id, event_type, 0.0 FROM events WHERE user_id = 5")
def row_delta_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows deleted by key while others of the same key arrive in the same commit, which stay."""
    t = _events(spark, sf_dir)
    keys = _read(spark, sf_dir, "events").where("user_id < 20").select("user_id").distinct()
    change = t.new_row_delta()
    change.append(_read(spark, sf_dir, "events").where("user_id = 5").withColumn("value", F.lit(0.0)))
    change.delete_equal(keys).commit()
    return t.to_df().select(*_PICK)


# Snapshots


def _two_batches(spark: SparkSession, sf_dir: str, clock: Callable[[], int] | None = None) -> Table:
    df = _read(spark, sf_dir, "events")
    catalog = scratch(spark)
    if clock:
        catalog = Catalog(spark, catalog.warehouse, clock)
    t = catalog.create("t", df, _by_day)
    t.append(df.where(f"ts < '{EARLY}'"))
    t.append(df.where(f"ts >= '{EARLY}'"))
    return t


@query(f"SELECT {ROWS} FROM events WHERE ts < '{EARLY}'")
def time_travel_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as of its first snapshot."""
    t = _two_batches(spark, sf_dir)
    return t.scan().use_snapshot(t.metadata.snapshots[0].snapshot_id).to_df().select(*_PICK)


def _ticking() -> Callable[[], int]:
    ticks = iter(range(1000, 1_000_000, 1000))
    return lambda: next(ticks)


@query(f"SELECT {ROWS} FROM events WHERE ts < '{EARLY}'")
def time_travel_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as of a time between its snapshots."""
    t = _two_batches(spark, sf_dir, _ticking())
    return t.scan().as_of(t.metadata.log[0][0] + 1).to_df().select(*_PICK)


@query(f"SELECT {ROWS} FROM events WHERE ts < '{EARLY}'")
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after going back to its first snapshot."""
    t = _two_batches(spark, sf_dir)
    t.rollback(t.metadata.snapshots[0].snapshot_id)
    return t.to_df().select(*_PICK)


@query("SELECT * FROM (VALUES (1, 'append', '0'), (2, 'append', '1'), (3, 'delete', '1'), (4, 'overwrite', '1')) AS v(sequence, operation, has_parent)")
def snapshots_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of a table's snapshots."""
    t = _two_batches(spark, sf_dir)
    t.delete_where(col("ts") < EARLY)
    change = t.new_overwrite()
    change.append(_read(spark, sf_dir, "events").where(f"ts < '{EARLY}'"))
    change.delete_matching(col("ts") >= LATE).commit()
    return t.snapshots().select(F.col("sequence").cast("int").alias("sequence"), "operation", F.col("parent_id").isNotNull().cast("int").cast("string").alias("has_parent"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def concurrent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers append a part of the rows each at once; both snapshots come about."""
    df = _read(spark, sf_dir, "events")
    catalog = scratch(spark)
    catalog.create("t", df, _by_day)
    failed: list[BaseException] = []

    def write(rest: int) -> None:
        try:
            catalog.load("t").append(df.where(f"coalesce(abs(event_id % 2), 0) = {rest}"))
        except BaseException as e:  # noqa: BLE001 - raised again below
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in (0, 1)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    if failed:
        raise failed[0]
    return catalog.load("t").to_df().select(*_PICK)


# Evolution


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_note FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, 'new' FROM customer WHERE c_custkey % 2 = 1")
def schema_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added between two batches."""
    df = _read(spark, sf_dir, "customer")
    t = _filled(spark, df.where("c_custkey % 2 = 0"))
    t.update_schema().add("c_note", "string").commit()
    t.append(df.where("c_custkey % 2 = 1").withColumn("c_note", F.lit("new")))
    return t.to_df().select("c_custkey", "c_name", "c_note")


@query("SELECT c_custkey, c_name AS c_title FROM customer WHERE c_acctbal > 0")
def schema_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column renamed after its rows were written, and another that takes over a name."""
    df = _read(spark, sf_dir, "customer")
    t = _filled(spark, df)
    t.update_schema().rename("c_name", "c_title").rename("c_acctbal", "c_balance").commit()
    t.update_schema().add("c_acctbal", "double").commit()
    return t.to_df(col("c_balance") > 0).select("c_custkey", "c_title")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def schema_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column deleted after its rows were written."""
    t = _filled(spark, _read(spark, sf_dir, "customer"))
    t.update_schema().delete("c_nationkey").commit()
    return t.to_df().select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query(f"SELECT {ROWS} FROM events WHERE ts >= '2024-01-09 10:00:00' AND ts < '2024-01-12 11:00:00'")
def spec_evolution_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan over files by day and files by hour."""
    df = _read(spark, sf_dir, "events")
    t = _filled(spark, df.where(f"ts < '{EARLY}'"), _by_day)
    t.update_spec().remove("ts_day").add("ts", "hour").commit()
    t.append(df.where(f"ts >= '{EARLY}' AND ts < '2024-01-13'"))
    t.update_spec().remove("ts_hour").commit()
    t.append(df.where("ts >= '2024-01-13'"))
    return t.to_df((col("ts") >= "2024-01-09T10:00:00") & (col("ts") < "2024-01-12T11:00:00")).select(*_PICK)


@query("SELECT c_custkey, length(s) AS n FROM (SELECT c_custkey, (c_custkey % 7) || repeat(c_name, 400) AS s FROM customer) WHERE s >= '2' AND s < '5'")
def truncate_long_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files partitioned by the first character of strings that are too long for bounds."""
    df = _read(spark, sf_dir, "customer").select("c_custkey", F.concat((F.col("c_custkey") % 7).cast("string"), F.repeat("c_name", F.lit(400))).alias("s"))
    t = _filled(spark, df, lambda s: PartitionSpec.builder(s).truncate("s", 1).build())
    return t.to_df((col("s") >= "2") & (col("s") < "5")).select("c_custkey", F.length("s").cast("long").alias("n"))


_ODD = "CASE c_custkey % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN -CAST(0 AS DOUBLE) WHEN 2 THEN NULL ELSE CAST(c_custkey % 5 AS DOUBLE) END"


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {_ODD} AS x FROM customer) WHERE x > 3")
def identity_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files partitioned by numbers among which are NaN (larger than all others), zero and null."""
    df = _read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ODD} AS x")
    t = _filled(spark, df, lambda s: PartitionSpec.builder(s).identity("x").build())
    return t.to_df(col("x") > 3.0).select("c_custkey")


@query("SELECT * FROM (VALUES ('Aa', 1), ('Ab', 2)) AS v(part, files)")
def string_truncate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a range of strings leaves, by their partition."""
    df = spark.createDataFrame([(f"A{c}{i}",) for c in "abcd" for i in range(4)] + [("Abzz",)], "s string")
    t = scratch(spark).create("t", df, lambda s: PartitionSpec.builder(s).truncate("s", 2).build())
    t.append(df.where("s <> 'Abzz'").coalesce(1))
    t.append(df.where("s = 'Abzz'").coalesce(1))
    files = t.scan().filter((col("s") >= "Aa1") & (col("s") < "Ab9")).plan(metrics=False)
    return files.groupBy(F.col(f"partition.`{t.spec.fields[0].field_id}`").alias("part")).agg(F.count(F.lit(1)).cast("int").alias("files"))


@query(f"SELECT {ROWS} FROM events WHERE ts >= '{LATE}'")
def spec_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition field with another name; files of before and after are pruned by it."""
    df = _read(spark, sf_dir, "events")
    t = _filled(spark, df.where(f"ts < '{LATE}'"), _by_day)
    t.update_spec().rename("ts_day", "on_day").commit()
    t.append(df.where(f"ts >= '{LATE}'"))
    return t.to_df(col("ts") >= LATE).select(*_PICK)


# Maintenance


def _many_files(spark: SparkSession, sf_dir: str) -> Table:
    df = _read(spark, sf_dir, "customer")
    t = scratch(spark).create("t", df)
    for k in range(4):
        t.append(df.where(f"c_custkey % 4 = {k}").coalesce(1))
    return t


@query("SELECT c_custkey, c_name, c_acctbal, 4 AS files_before, 1 AS files_after FROM customer")
def compact_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files rewritten as one."""
    t = _many_files(spark, sf_dir)
    done = t.rewrite_data_files()
    left = len(t.scan().files())
    return t.to_df().select("c_custkey", "c_name", "c_acctbal", F.lit(done.rewritten).alias("files_before"), F.lit(left).alias("files_after"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0")
def compact_applies_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row deletes become part of the rewritten files."""
    t = _many_files(spark, sf_dir)
    t.new_row_delta().delete_equal(_read(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select("c_custkey")).commit()
    t.rewrite_data_files()
    return t.to_df().select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, 5 AS before, 1 AS after FROM customer WHERE c_custkey % 4 <> 1")
def manifests_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of five commits, one of which deletes a file, in one manifest."""
    t = _many_files(spark, sf_dir)
    t.new_delete().delete_file(t.files().orderBy("sequence").select("path").collect()[1].path).commit()
    before, after = t.rewrite_manifests()
    return t.to_df().select("c_custkey", "c_name", F.lit(before).alias("before"), F.lit(after).alias("after"))


@query("SELECT c_custkey, c_name, 4 AS expired, 4 AS data_files FROM customer")
def expire_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old snapshots and the files only they hold go; the current rows stay."""
    t = _many_files(spark, sf_dir)
    t.rewrite_data_files()
    done = t.expire_snapshots(older_than_ms=t.clock() + 1)
    return t.to_df().select("c_custkey", "c_name", F.lit(done.snapshots).alias("expired"), F.lit(done.data_files).alias("data_files"))


@query("SELECT c_custkey, c_name, 1 AS orphans FROM customer")
def orphan_cleanup_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that no snapshot refers to goes."""
    t = _many_files(spark, sf_dir)
    t.store.write("data/left-behind.parquet", "not in the table")
    gone = t.remove_orphan_files(older_than_ms=t.clock() + 1000)
    return t.to_df().select("c_custkey", "c_name", F.lit(len([g for g in gone if g.endswith(".parquet")])).alias("orphans"))


# Planning reports and raw files


@query("SELECT * FROM (VALUES (0, 800, 1), (1, 800, 1), (2, 300, 1)) AS v(task, size, files)")
def bin_packing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing with one open bin: the heavier goes out first."""
    tasks = plan([DataFile(f"f{i}", 1, n) for i, n in enumerate((800, 300, 800))], 1000, 1, 0)
    return spark.createDataFrame([(i, t.size, len(t.tasks)) for i, t in enumerate(tasks)], "task int, size int, files int")


@query("SELECT * FROM (VALUES (0, 0, 100), (1, 100, 100), (2, 200, 50), (3, 4, 96), (4, 100, 150)) AS v(task, start, length)")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a fixed size without row-group offsets, row groups with them."""
    tasks = split(DataFile("a", 1, 250), 100) + split(DataFile("b", 1, 250, split_offsets=(4, 100)), 1000)
    return spark.createDataFrame([(i, t.start, t.length) for i, t in enumerate(tasks)], "task int, start int, length int")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV with a header and read back."""
    return csv_round_trip(_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS n_note FROM nation UNION ALL SELECT n_nationkey + 100, n_name, 'v2' FROM nation")
def raw_merge_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files of two schemas read together."""
    v1 = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    v2 = v1.select((F.col("n_nationkey") + 100).cast(v1.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name", F.lit("v2").alias("n_note"))
    return read_merged(spark, [v1, v2]).select("n_nationkey", "n_name", "n_note")


@query("SELECT true AS fewer_groups, true AS fewer_bytes, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id >= (SELECT max(event_id) * 3 // 4 FROM events)")
def row_group_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups and column bytes that a filtered two-column read leaves out."""
    df = _read(spark, sf_dir, "events").orderBy("event_id").coalesce(1)
    t = scratch(spark).create("t", df)
    t.append(df, options={"parquet.block.size": str(32 << 10), "parquet.page.size": str(8 << 10)})
    limit = df.agg(F.max("event_id")).first()[0] * 3 // 4
    kept, groups = row_groups_kept(t, col("event_id") >= limit)
    some, whole = column_bytes(t, ["event_id", "value"]), column_bytes(t)
    n = t.to_df(col("event_id") >= limit).count()
    return spark.createDataFrame([(kept < groups, some < whole, n)], "fewer_groups boolean, fewer_bytes boolean, n long")


# The engine's own queries over scans


@query("SELECT count(*) AS n FROM customer")
def adapter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting all rows of a scan registered as a view."""
    _many_files(spark, sf_dir).to_df().createOrReplaceTempView("slt_customers")
    return spark.sql("SELECT count(*) AS n FROM slt_customers")


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal > 5000")
def adapter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting the rows of a filtered scan."""
    return _many_files(spark, sf_dir).to_df(col("c_acctbal") > 5000.0).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def adapter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping a scan."""
    return _many_files(spark, sf_dir).to_df().groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM customer WHERE c_acctbal > 9000")
def adapter_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a filtered scan."""
    return _many_files(spark, sf_dir).to_df(col("c_acctbal") > 9000.0)


@query("SELECT c_custkey, c_name, 4 AS tasks FROM customer WHERE c_acctbal > 0")
def adapter_task_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan whose partitions are the plan's combined tasks."""
    scan = _many_files(spark, sf_dir).scan().filter(col("c_acctbal") > 0.0)
    df = task_df(scan, size=1 << 20, lookback=1, open_cost=1 << 20)
    return df.select("c_custkey", "c_name", F.lit(df.rdd.getNumPartitions()).alias("tasks"))


@query("SELECT true AS pushed, true AS pruned")
def adapter_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plan of a filtered scan shows: the filter reaches Parquet, and only the columns asked for are read."""
    df = _many_files(spark, sf_dir).to_df(col("c_acctbal") > 5000.0).select("c_custkey")
    text = df._jdf.queryExecution().toString()
    pushed, schema = "GreaterThan(c_acctbal,5000.0)" in text, text.split("ReadSchema: ")[-1].split("\n")[0]
    return spark.createDataFrame([(pushed, "c_custkey" in schema and "c_name" not in schema)], "pushed boolean, pruned boolean")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE ts BETWEEN '2024-01-10' AND '2024-01-12' AND (user_id IN (3, 4, 5) OR value > 90.5) AND event_type LIKE '%c%'")
def adapter_sql_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter given as SQL text: what metadata can judge prunes files, the rest filters rows."""
    return where(_events(spark, sf_dir), "ts BETWEEN '2024-01-10' AND '2024-01-12' AND (user_id IN (3, 4, 5) OR value > 90.5) AND event_type LIKE '%c%'").select(*_PICK)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streaming_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files appended batch by batch, each once."""
    from siltstone.streaming.sink import append_stream

    df = _read(spark, sf_dir, "events")
    catalog = scratch(spark)
    t = catalog.create("t", df, _by_day)
    folder = f"{catalog.warehouse}/stream"
    for k in range(2):
        df.where(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    append_stream(stream, t, "events", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.refresh().to_df().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'a' AS name, 0 AS exists_before, 1 AS exists_after, 1 AS dropped, 0 AS exists_last")
def catalog_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, look up and drop a table."""
    catalog = scratch(spark)
    before = catalog.exists("ns.a")
    catalog.create("ns.a", Schema.of(("id", "long")))
    after, dropped = catalog.exists("ns.a"), catalog.drop("ns.a")
    return spark.createDataFrame([("a", int(before), int(after), int(dropped), int(catalog.exists("ns.a")))], "name string, exists_before int, exists_after int, dropped int, exists_last int")


@query("SELECT c_custkey, c_name, 5 AS version, 5 AS without_hint FROM customer")
def version_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version, found from a hint that lags behind and by listing when there is none."""
    t = _many_files(spark, sf_dir)
    t.store.replace(HINT, "2")
    late = TableOps(t.store)
    late.refresh()
    t.store.delete(HINT)
    t.refresh()
    listed = TableOps(t.store)
    listed.refresh()
    return t.to_df().select("c_custkey", "c_name", F.lit(late.version).alias("version"), F.lit(listed.version).alias("without_hint"))


class _CrashingOnce(TableOps):
    """Fails once when a version is ready to be published."""

    crashed = False

    def before_publish(self) -> None:
        if not self.crashed:
            self.crashed = True
            raise SimulatedCrash("before publishing")


@query(f"SELECT {ROWS}, 1 AS crashed, 0 AS rows_then FROM events")
def crash_before_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit that crashes leaves the table as it was; the next one goes through."""
    df = _read(spark, sf_dir, "events")
    t = scratch(spark).create("t", df, _by_day)
    t.ops = _CrashingOnce(t.store)
    crashed = 0
    try:
        t.append(df)
    except SimulatedCrash:
        crashed = 1
    then = t.refresh().to_df().count()
    t.append(df)
    return t.to_df().select(*_PICK, F.lit(crashed).alias("crashed"), F.lit(then).cast("int").alias("rows_then"))


@query("SELECT 2 AS snapshots, 3 AS manifests, 1 AS current")
def metadata_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots and manifests as the printed tree has them: the second snapshot holds the first one's manifest too."""
    lines = _two_batches(spark, sf_dir).tree().split("\n")[1:]
    seen = [line.startswith("  snapshot ") for line in lines]
    return spark.createDataFrame([(sum(seen), len(seen) - sum(seen), sum(line.endswith("(current)") for line in lines))], "snapshots int, manifests int, current int")


@query("SELECT DISTINCT '{ts_day=' || datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) || '}' AS part FROM events")
def partition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition tuples as text."""
    t = _events(spark, sf_dir)
    return spark.createDataFrame(sorted({(t.spec.describe(f.partition),) for f in t.scan().files()}), "part string")


@query("SELECT c_custkey FROM (SELECT c_custkey, repeat(c_name, 400) AS s FROM customer) WHERE s >= 'Customer#000000010'")
def missing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without bounds of a column (its strings are too long for statistics) stay in the plan."""
    t = _filled(spark, _read(spark, sf_dir, "customer").select("c_custkey", F.repeat("c_name", F.lit(400)).alias("s")))
    return t.to_df(col("s") >= "Customer#000000010").select("c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100 AND c_custkey <= 700")
def widened_and_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer compared with a column of fractions; constants that fold away."""
    t = _filled(spark, _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    return t.to_df(((col("c_acctbal") > 100) & P.TRUE & (col("c_custkey") <= 700)) | P.FALSE)


@query("SELECT * FROM (VALUES ('create twice', 'AlreadyExists'), ('load missing', 'NoSuchTable'), ('stale base', 'CommitFailed'), ('foreign metadata', 'ValidationError'), ('hint without version', 'ValidationError')) AS v(tried, error)")
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and with which error: among it metadata of another table and a hint to a version that isn't there."""
    catalog = scratch(spark)
    a, b = (catalog.create(n, _read(spark, sf_dir, "region")) for n in "ab")
    base = a.metadata
    catalog.load("a").update_schema().add("note", "string").commit()

    def foreign() -> None:
        b.store.replace(version_file(2), a.metadata.to_json())
        b.refresh()

    def without_version() -> None:
        a.store.replace(HINT, "99")
        TableOps(a.store).refresh()

    tried = {
        "create twice": lambda: catalog.create("a", base.schema),
        "load missing": lambda: catalog.load("c"),
        "stale base": lambda: a.ops.commit(base, TableMetadata(base.table_uuid, base.location, base.schemas, base.specs)),
        "foreign metadata": foreign,
        "hint without version": without_version,
    }
    found = []
    for name, f in tried.items():
        try:
            f()
            found.append((name, "none"))
        except (AlreadyExists, CommitFailed, NoSuchTable, ValidationError) as e:
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "tried string, error string")


@query("SELECT 4 AS snapshots, 4 AS different, 4 AS positive, 4 AS hint_follows")
def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a table's snapshots; the hint names the version after as many commits."""
    t = _many_files(spark, sf_dir)
    ids = [s.snapshot_id for s in t.metadata.snapshots]
    hint = int(t.store.read(HINT) or 0) - 1  # version 1 is the empty table
    return spark.createDataFrame([(len(ids), len(set(ids)), sum(i > 0 for i in ids), hint)], "snapshots int, different int, positive int, hint_follows int")


@query("SELECT CAST(count(*) AS BIGINT) AS committed, true AS torn_files_in_folder FROM events")
def torn_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a broken write leaves in the table's folder are no part of the table, unlike in a plain folder of Parquet."""
    df = _read(spark, sf_dir, "events")
    t = _filled(spark, df, _by_day)
    folder = f"{t.store.root}/data"
    df.where("event_id % 2 = 0").write.mode("append").parquet(folder)
    seen = spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(folder).count()
    return t.refresh().to_df().agg(F.count(F.lit(1)).alias("committed")).withColumn("torn_files_in_folder", F.col("committed") < F.lit(seen))


@query("SELECT CAST(count(*) AS BIGINT) AS n, min(event_id) AS lo, max(event_id) AS hi, CAST(count(*) - count(props) AS BIGINT) AS nulls, 6 AS columns FROM events")
def parquet_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bounds, nulls and columns as the footers' column chunks have them."""
    t = _events(spark, sf_dir)
    chunks = [c for f in t.scan().files() for c in anatomy(f.path)]
    ids, props = ([c for c in chunks if c.column == n] for n in ("event_id", "props"))
    row = (sum(c.rows for c in ids), min(c.low for c in ids), max(c.high for c in ids), sum(c.nulls for c in props), len({c.column for c in chunks}))
    return spark.createDataFrame([row], "n long, lo long, hi long, nulls long, columns int")


@query("SELECT DISTINCT event_type AS part FROM events WHERE event_type <> 'click' AND NOT event_type >= 'signup' OR event_type = 'view'")
def exact_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition tuples for which a predicate with != and NOT holds exactly, judged one by one."""
    t = _filled(spark, _read(spark, sf_dir, "events"), lambda s: PartitionSpec.builder(s).identity("event_type").build())
    bound = P.bind((col("event_type") != "click") & ~(col("event_type") >= "signup") | (col("event_type") == "view"), t.schema)
    field = t.spec.fields[0]
    on_tuple = P.project(P.rewrite_not(bound), [(field.field_id, field.source_id, field.transform)], lambda i: t.schema.by_id(i).spark)
    parts = {f.partition[field.field_id] for f in t.scan().files() if P.matches_partition(on_tuple, f.partition)}
    return spark.createDataFrame(sorted((p,) for p in parts), "part string")


_LITTLE = "array_to_string(list_reverse(regexp_extract_all(printf('%016x', {}), '..')), '')"


@query(f"""SELECT {_LITTLE.format('min(event_id)')} AS lo_id, {_LITTLE.format('epoch_us(max(ts))')} AS hi_ts, lower(hex(min(event_type))) AS lo_type, max(value) AS hi_value FROM events""")
def binary_bounds_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of one file in binary form: a long, a time and a string as bytes, a fraction there and back."""
    t = scratch(spark).create("t", df := _read(spark, sf_dir, "events"))
    t.append(df.coalesce(1))
    ((lower, upper),) = (binary_bounds(f, t.schema) for f in t.scan().files())
    at = {f.name: f for f in t.schema.fields}
    row = (lower[at["event_id"].id].hex(), upper[at["ts"].id].hex(), lower[at["event_type"].id].hex(), decode(upper[at["value"].id], at["value"].spark))
    return spark.createDataFrame([row], "lo_id string, hi_ts string, lo_type string, hi_value double")


def queries() -> dict[str, Query]:
    """Every query of this module, by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries."""
    return dict(_SQL)



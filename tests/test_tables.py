"""Tables from end to end: commits, snapshots, pruning, changes, evolution, maintenance."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from siltstone.errors import AlreadyExists, CommitFailed, NoSuchTable, ValidationError
from siltstone.functions.predicates import col
from siltstone.functions.transforms import DAY, HOUR
from siltstone.operators.table import external_file
from siltstone.sources import files as FL
from siltstone.sources.catalog import Catalog, scratch
from siltstone.sources.commit import TableOps
from siltstone.sources.files import footer
from siltstone.sources.metadata import DataFile, PartitionSpec, TableMetadata, new_snapshot_id
from siltstone.sources.schema import Schema
from siltstone.sources.store import LocalStore
from siltstone.streaming.sink import append_batches

D = 20_661
EVENTS = Schema.of(("id", "long", True), ("name", "string", True), ("event_time", "long", True), ("category", "string", True), ("age", "long", True))
USERS = Schema.of(("id", "long"), ("name", "string"), ("age", "long"), ("email", "string"))


@pytest.fixture
def catalog(spark):
    return scratch(spark)


def events(spark, rows):
    return spark.createDataFrame([(i, f"n{i}", d * DAY + h * HOUR, c, a) for i, d, h, c, a in rows], "id long, name string, event_time long, category string, age long")


def by_day(s):
    return PartitionSpec.builder(s).day("event_time").build()


SIX = [[(1, D, 1, "a", 10), (2, D, 2, "a", 25)], [(3, D, 1, "b", 55), (4, D, 2, "b", 70)], [(5, D + 1, 1, "a", 30), (6, D + 1, 2, "a", 45)], [(7, D + 1, 1, "b", 60), (8, D + 1, 2, "b", 80)], [(9, D + 2, 1, "a", 15), (10, D + 2, 2, "a", 35)], [(11, D + 2, 1, "b", 75), (12, D + 2, 2, "b", 90)]]


@pytest.fixture
def six(spark, catalog):
    t = catalog.create("db.events", EVENTS, by_day)
    change = t.new_append()
    for rows in SIX:
        change.append(events(spark, rows).coalesce(1))
    change.commit()
    return t


def ids(df):
    return sorted(r.id for r in df.collect())


# Catalog and commits


def test_catalog(catalog):
    t = catalog.create("a.b.t", USERS)
    assert catalog.exists("a.b.t") and t.current_snapshot is None and t.to_df().count() == 0 and t.scan().files() == []
    assert os.path.exists(f"{t.store.root}/metadata/v1.metadata.json") and t.metadata_file.endswith("v1.metadata.json")
    with pytest.raises(AlreadyExists):
        catalog.create("a.b.t", USERS)
    assert catalog.load("a.b.t").schema == USERS and catalog.drop("a.b.t") and not catalog.drop("a.b.t") and not catalog.exists("a.b.t")
    with pytest.raises(NoSuchTable):
        catalog.load("a.b.t")
    for bad in ("", "a..b", "a.\0", ".a"):
        with pytest.raises(ValidationError):
            catalog.load(bad)


def test_version_discovery(catalog):
    t = catalog.create("t", USERS)
    for n in range(11):
        t.update_schema().add(f"c{n}", "int").commit()
    hint = f"{t.store.root}/metadata/version-hint.text"
    os.unlink(hint)
    assert len(catalog.load("t").schema.fields) == 15  # v12 after v9: by number, not by text
    with open(hint, "w") as f:
        f.write("3")
    assert len(catalog.load("t").schema.fields) == 15
    with open(hint, "w") as f:
        f.write("99")
    with pytest.raises(ValidationError):
        catalog.load("t")


def test_commit_needs_the_version_last_read(spark, catalog):
    catalog.create("t", USERS)
    a, b = catalog.load("t"), catalog.load("t")
    first, second = a.update_schema().add("x", "int"), b.update_schema().add("y", "int")
    first.commit()
    with pytest.raises(CommitFailed):
        second.commit()
    with pytest.raises(CommitFailed):
        a.ops.commit(TableMetadata("u", "l", (USERS,), (PartitionSpec(),)), a.metadata)


def test_publishing_never_replaces(tmp_path):
    store = LocalStore(str(tmp_path))
    store.publish("metadata/v1.metadata.json", "one")
    with pytest.raises(CommitFailed):
        store.publish("metadata/v1.metadata.json", "two")
    assert store.read("metadata/v1.metadata.json") == "one" and [n for n, _, _ in store.list()] == ["metadata/v1.metadata.json"]


class FailsOnce(TableOps):
    """Breaks down once when a version is ready to be published."""

    failed = False

    def before_publish(self) -> None:
        if not self.failed:
            self.failed = True
            raise RuntimeError("power cut")


def test_a_crash_before_publishing_leaves_the_old_version(spark, catalog):
    catalog.create("t", USERS)
    t = catalog.load("t")
    t.ops = FailsOnce(t.store)
    df = spark.createDataFrame([(1, "a", 3, "e")], "id long, name string, age long, email string")
    change = t.new_append().append(df)
    with pytest.raises(RuntimeError):
        change.commit()
    assert catalog.load("t").current_snapshot is None
    change.commit()
    assert catalog.load("t").to_df().count() == 1


def test_both_of_two_writers_come_through(spark, catalog):
    t = catalog.create("t", USERS)
    row = lambda i: spark.createDataFrame([(i, "a", 3, "e")], "id long, name string, age long, email string")
    t.append(row(0))
    a, b = catalog.load("t"), catalog.load("t")
    changes = [a.new_append().append(row(1)), b.new_append().append(row(2))]
    threads = [threading.Thread(target=c.commit) for c in changes]
    [x.start() for x in threads]
    [x.join() for x in threads]
    last = catalog.load("t")
    assert ids(last.to_df()) == [0, 1, 2] and [s.sequence for s in last.metadata.snapshots] == [1, 2, 3]
    assert last.metadata.snapshots[2].parent_id == last.metadata.snapshots[1].snapshot_id


def test_another_tables_metadata_is_refused(catalog):
    t, other = catalog.create("t", USERS), catalog.create("o", USERS)
    t.store.write("metadata/v2.metadata.json", other.metadata.to_json())
    with pytest.raises(ValidationError):
        t.refresh()


def test_metadata_round_trip(six):
    m = six.metadata
    assert TableMetadata.from_json(m.to_json()) == m
    assert 0 <= new_snapshot_id() < 1 << 63
    files = six.scan().files()
    assert [DataFile.from_json(f.to_json()) for f in files] == files
    assert "snapshot" in six.tree() and six.manifests().count() == 1 and six.history().count() == 1


# Pruning


def test_pruning_funnel(six):
    n = lambda p, **kw: six.scan().filter(p).plan(**kw).count()
    day = (col("event_time") >= D * DAY) & (col("event_time") < (D + 1) * DAY)
    both = day & (col("age") > 50)
    assert six.scan().plan().count() == 6
    assert (n(both, metrics=False), n(both)) == (2, 1)
    assert (n(col("age") > 50, metrics=False), n(col("age") > 50)) == (6, 3)
    assert ids(six.to_df(both)) == [3, 4]
    assert six.scan().filter(col("age") > 500).filter(col("age") > 50).plan().count() == 3  # the later one counts


def test_synthetic_files(catalog):
    t = catalog.create("t", EVENTS)
    bounds = [(10, 25), (26, 40), (41, 55), (56, 70), (71, 85), (86, 100), (5, 15), (45, 65), (35, 50), (60, 75)]
    change = t.new_append()
    for i, (lo, hi) in enumerate(bounds, 1):
        change.append_file(DataFile(f"{t.store.uri}/data/{i:03}", 10, 100, lower={5: lo}, upper={5: hi}))
    change.append_file(DataFile(f"{t.store.uri}/data/unknown", 10, 100))
    change.commit()
    kept = [f.path[-3:] for f in t.scan().filter(col("age") > 50).files()]
    assert kept == ["003", "004", "005", "006", "008", "010", "own"]


def test_scan_equals_filter_over_all_rows(spark, catalog):
    df = spark.range(400).selectExpr("id", "if(id % 11 = 0, null, id % 37) a", "if(id % 13 = 0, null, concat('k', id % 5)) s", "if(id % 17 = 0, double('NaN'), id / 7) v", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(id as int)) ts", "date_add(date'1969-12-20', cast(id % 30 as int)) d")
    for spec in (None, lambda s: PartitionSpec.builder(s).identity("s").truncate("a", 10).build(), lambda s: PartitionSpec.builder(s).day("ts").bucket("a", 3).build(), lambda s: PartitionSpec.builder(s).day("d").truncate("s", 2).build()):
        t = catalog.create(f"t{id(spec)}", df, spec)
        t.append(df.where("id < 200"))
        t.append(df.where("id >= 200"))
        for p, sql in [
            (col("a") > 20, "a > 20"), (~(col("a") > 20), "NOT a > 20"), ((col("s") == "k2") | (col("a") < 3), "s = 'k2' OR a < 3"), (col("s") != "k1", "s <> 'k1'"), (col("v") > 40.0, "v > 40"), (~(col("v") <= 40.0), "NOT v <= 40"),
            ((col("ts") >= "2024-01-03T05:00:00") & (col("ts") < "2024-01-07T00:00:00"), "ts >= '2024-01-03 05:00:00' AND ts < '2024-01-07'"), (col("d") <= "1969-12-31", "d <= '1969-12-31'"), (col("d") > "1970-01-02", "d > '1970-01-02'"),
        ]:
            assert ids(t.to_df(p)) == ids(df.where(sql)), (sql, t.spec)


def test_times_with_zone_and_other_types(spark, catalog):
    df = spark.range(50).selectExpr("id", "timestamp_seconds(1704067200 + id * 7200) z", "cast(id as decimal(10,2)) dec", "id % 2 = 0 b", "array(id, id + 1) arr", "named_struct('x', id) st", "encode(cast(id as string), 'utf-8') bin", "cast(id as short) sh", "cast(id as float) f")
    t = catalog.create("t", df, lambda s: PartitionSpec.builder(s).hour("z").build())
    t.append(df)
    assert ids(t.to_df(col("z") < "2024-01-02T00:00:00")) == list(range(12)) and t.scan().filter(col("z") < "2024-01-02T00:00:00").plan().count() == 12
    assert t.to_df().exceptAll(df).count() == 0 and ids(t.to_df((col("sh") < 3) | (col("f") > 47.5))) == [0, 1, 2, 48, 49]


def test_null_partition_values(spark, catalog):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "")], "id long, s string")
    t = catalog.create("t", df, lambda s: PartitionSpec.builder(s).identity("s").build())
    t.append(df)
    assert sorted((f.partition[1000] or repr(f.partition[1000])) for f in t.scan().files()) == ["''", "None", "a"]
    assert ids(t.to_df()) == [1, 2, 3, 4] and ids(t.to_df(col("s") != "a")) == [4]


def test_footer(six):
    f = six.scan().files()[0]
    read = footer(f.path.removeprefix("file://"))
    assert read["rows"] == f.record_count == 2 and read["nulls"] == {i: 0 for i in range(1, 6)} and read["values"][1] == 2
    assert f.lower[5] <= f.upper[5] and f.split_offsets and f.file_size == os.path.getsize(f.path.removeprefix("file://"))


def test_footers_read_by_tasks(spark, catalog, monkeypatch):
    from siltstone.sources import files

    monkeypatch.setattr(files, "DRIVER_FOOTERS", 2)
    t = catalog.create("t", EVENTS, by_day)
    t.append(events(spark, [r for rows in SIX for r in rows]))
    assert ids(t.to_df(col("age") > 50)) == [3, 4, 7, 8, 11, 12] and t.scan().filter(col("age") > 80).plan().count() == 1


def test_description_by_scan_agrees_with_footers(spark, six):
    from siltstone.sources import files

    found = six.scan().files()
    names = [f.path[len(six.store.uri) + 1 :] for f in found]
    base = os.path.basename
    other = {base(f.path) + str(f.partition): f for f in files._describe_by_scan(spark, six.store, names, six.schema, six.spec, "DATA", None)}
    for f in found:
        o = next(x for x in other.values() if x.path.endswith(f.path[len(six.store.uri) :]))
        assert (o.record_count, o.partition, o.lower, o.upper, o.null_counts) == (f.record_count, f.partition, f.lower, f.upper, f.null_counts)


def test_rows_per_file_and_unknown_columns(spark, catalog):
    t = catalog.create("t", USERS)
    df = spark.range(10).selectExpr("id", "'n' name", "id age", "'e' email").coalesce(1)
    t.append(df, rows_per_file=4)
    assert sorted(f.record_count for f in t.scan().files()) == [2, 4, 4]
    with pytest.raises(ValidationError):
        t.append(df.withColumn("other", F.lit(1)))
    t.append(df.select("id"))
    assert t.to_df().where("name IS NULL").count() == 10


# Snapshots


def test_scans_of_one_snapshot_stay(spark, six):
    first = six.current_snapshot.snapshot_id
    scan = six.scan().use_snapshot(first)
    six.append(events(spark, [(99, D, 1, "z", 1)]))
    assert 99 not in ids(scan.to_df()) and 99 in ids(six.to_df())
    with pytest.raises(ValidationError):
        scan.use_snapshot(first)
    with pytest.raises(ValidationError):
        six.scan().use_snapshot(123)


def test_time_travel_follows_rollback(spark):
    ticks = iter(range(1000, 100_000, 1000))
    c = Catalog(spark, scratch(spark).warehouse, lambda: next(ticks))
    t = c.create("t", EVENTS)
    for i in range(3):
        t.append(events(spark, [(i, D, 1, "a", i)]))
    t.rollback(t.metadata.snapshots[0].snapshot_id)
    times = [x[0] for x in t.metadata.log]
    at = lambda ms: ids(t.scan().as_of(ms).to_df())
    assert [at(x) for x in times] == [[0], [0, 1], [0, 1, 2], [0]] and at(times[1] + 1) == [0, 1] and at(10**15) == [0]
    with pytest.raises(ValidationError):
        t.scan().as_of(times[0] - 1)
    with pytest.raises(ValidationError):
        t.rollback(5)
    before = len(t.metadata.log)
    t.rollback(t.current_snapshot.snapshot_id)
    assert len(t.metadata.log) == before and t.snapshots().count() == 3


# Changes


def test_empty_changes_make_no_snapshot(six):
    n = len(six.metadata.snapshots)
    six.new_append().commit()
    six.delete_where(col("age") > 5000)
    assert len(six.metadata.snapshots) == n


def test_metadata_delete_takes_whole_files_only(six):
    six.delete_where(col("age") > 56)  # 55..70 matches partly
    assert ids(six.to_df()) == [1, 2, 3, 4, 5, 6, 9, 10] and six.current_snapshot.summary["deleted-data-files"] == "2"
    six.delete_where(~(col("age") >= 26))
    assert ids(six.to_df()) == [3, 4, 5, 6, 9, 10]
    assert all(os.path.exists(f.path.removeprefix("file://")) for f in six.scan().use_snapshot(six.metadata.snapshots[0].snapshot_id).files())


def test_rows_with_null_are_not_deleted(spark, catalog):
    df = spark.createDataFrame([(1, 50), (2, None)], "id long, age long").coalesce(1)
    t = catalog.create("t", df)
    t.append(df)
    t.delete_where(col("age") > 40)
    assert ids(t.to_df()) == [1, 2]
    t.delete_where(col("age") > 40, mode="copy_on_write")
    assert ids(t.to_df()) == [2]


def test_deleting_a_named_file(six):
    f = six.scan().files()[0]
    six.new_delete().delete_file(f.path).commit()
    assert f.path not in [x.path for x in six.scan().files()] and six.current_snapshot.operation == "delete"
    with pytest.raises(ValidationError):
        six.new_delete().delete_file(f.path).commit()


def test_overwrite_names_what_it_did(spark, six):
    new = lambda i: events(spark, [(i, D, 1, "z", i)])
    c = six.new_overwrite()
    c.append(new(40))
    c.commit()
    d = six.new_overwrite().delete_matching(col("age") > 74)
    d.commit()
    e = six.new_overwrite()
    e.append(new(20))
    e.delete_matching(col("age") == 40).commit()
    assert [s.operation for s in six.metadata.snapshots[1:]] == ["append", "delete", "overwrite"]
    assert ids(six.to_df(col("name") > "n")) == ids(six.to_df()) and 20 in ids(six.to_df()) and 40 not in ids(six.to_df())


def test_row_deltas(spark, six):
    path = next(f.path for f in six.scan().files() if f.lower[5] == 55)
    six.new_row_delta().delete_positions(spark.createDataFrame([(path, 0)], "file_path string, pos long")).commit()
    assert 3 not in ids(six.to_df()) and 4 in ids(six.to_df()) and six.current_snapshot.operation == "delete"
    delta = six.new_row_delta()
    delta.append(events(spark, [(3, D, 1, "again", 1), (50, D, 1, None, 1)]))
    delta.delete_equal(spark.createDataFrame([("b",), (None,)], "category string")).commit()
    assert ids(six.to_df()) == [1, 2, 3, 5, 6, 9, 10, 50] and six.current_snapshot.operation == "overwrite"
    six.new_row_delta().delete_equal(spark.createDataFrame([(None,)], "category string")).commit()
    assert ids(six.to_df()) == [1, 2, 3, 5, 6, 9, 10]  # null agrees with null
    assert len(six.scan().delete_files()) >= 3
    assert ids(six.scan().use_snapshot(six.metadata.snapshots[0].snapshot_id).to_df()) == list(range(1, 13))


def test_equality_delete_on_a_column_that_was_dropped(spark, catalog):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, s string, v int")
    t = catalog.create("t", df)
    t.append(df)
    t.new_row_delta().delete_equal(df.where("v = 5").select("v")).commit()
    t.update_schema().delete("v").rename("s", "u").commit()
    assert [tuple(r) for r in t.to_df().collect()] == [(2, "b")]


# Evolution


def test_schema_evolution(spark, catalog):
    t = catalog.create("u", USERS)
    t.append(spark.createDataFrame([(1, "alice", 30, "alice@demo.com")], "id long, name string, age long, email string"))
    t.update_schema().rename("name", "username").commit()
    t.update_schema().add("address", "string").commit()
    t.append(spark.createDataFrame([(5, "eve", 32, "eve@demo.com", "杭州")], "id long, username string, age long, email string, address string"))
    assert [(r.id, r.username, r.address) for r in t.to_df().orderBy("id").collect()] == [(1, "alice", None), (5, "eve", "杭州")]
    t.update_schema().delete("address").commit()
    t.update_schema().add("address", "int").commit()
    assert t.schema.by_name("address").id == 6 and [r.address for r in t.to_df().collect()] == [None, None]
    assert len(t.metadata.schemas) == 5 and len(t.metadata.snapshots) == 2
    assert ids(t.to_df(col("username") == "alice")) == [1]


def test_a_name_that_is_used_again(spark, catalog):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id long, a int")
    t = catalog.create("t", df)
    t.append(df)
    t.update_schema().rename("a", "b").commit()
    t.update_schema().add("a", "int").commit()
    t.append(spark.createDataFrame([(3, 1, 99)], "id long, b int, a int"))
    assert ids(t.to_df(col("a") > 50)) == [3] and ids(t.to_df(col("b") >= 20)) == [2] and ids(t.to_df(col("a") < 50)) == []


def test_schema_errors(catalog):
    t = catalog.create("t", USERS, lambda s: PartitionSpec.builder(s).bucket("id", 4).build())
    u = t.update_schema
    for bad in (
        lambda: u().add("name", "int"), lambda: u().add("x", "int").add("x", "int"), lambda: u().rename("no", "y"), lambda: u().rename("name", "age"), lambda: u().rename("name", "y").delete("name"),
        lambda: u().delete("name").rename("name", "y"), lambda: u().delete("no"), lambda: u().delete("id"), lambda: u().add("y", "int").rename("name", "y"),
    ):
        with pytest.raises(ValidationError):
            bad()
    u().delete("name").add("name", "int").commit()
    assert t.schema.by_name("name").id == 5


def test_mixed_specs_prune_each_in_its_way(spark, catalog):
    t = catalog.create("t", EVENTS, by_day)
    h = lambda rows: events(spark, rows)
    t.append(h([(1, D, 10, "a", 55), (2, D + 1, 9, "a", 60)]))
    t.append(h([(3, D, 10, "a", 10)]))
    t.update_spec().remove("event_time_day").add("event_time", "hour").commit()
    t.append(h([(4, D, 10, "b", 55), (5, D, 14, "b", 55), (6, D + 1, 9, "b", 55)]))
    p = (col("event_time") >= D * DAY + 10 * HOUR) & (col("event_time") < D * DAY + 11 * HOUR) & (col("age") > 50)
    found = t.scan().filter(p).files()
    assert sorted(v for f in found for v in f.partition.values() if v is not None) == [D, D * 24 + 10] and ids(t.to_df(p)) == [1, 4]
    assert t.spec.fields[0].field_id == 1001 and len(t.metadata.specs) == 2


def test_spec_errors(catalog):
    t = catalog.create("t", EVENTS, by_day)
    u = t.update_spec
    for bad in (lambda: u().add("event_time", "day"), lambda: u().add("age", "identity", "event_time_day"), lambda: u().remove("no"), lambda: u().rename("event_time_day", "x").remove("x"), lambda: u().add("no"), lambda: u().add("name", "day")):
        with pytest.raises(ValidationError):
            bad()
    u().rename("event_time_day", "d").add("age").commit()
    assert [f.name for f in t.spec.fields] == ["d", "age"]


# Maintenance


def test_compaction_keeps_what_it_does_not_choose(spark, catalog):
    t = catalog.create("t", EVENTS)
    for i in range(5):
        t.append(events(spark, [(10 * i + k, D, 1, "a", 10 * i) for k in range(3)]).coalesce(1))
    big = t.scan().files()[0]
    t.delete_where(col("age") == 40)
    done = t.rewrite_data_files(predicate=col("age") < 25)
    assert (done.rewritten, done.added) == (3, 1) and t.current_snapshot.operation == "rewrite"
    assert ids(t.to_df()) == [0, 1, 2, 10, 11, 12, 20, 21, 22, 30, 31, 32]  # the deleted file stays deleted
    assert t.rewrite_data_files(target_bytes=1).rewritten == 0 and big.record_count == 3


def test_compaction_by_partition_applies_deletes(spark, six):
    path = next(f.path for f in six.scan().files() if f.lower[5] == 55)
    six.new_row_delta().delete_positions(spark.createDataFrame([(path, 1)], "file_path string, pos long")).commit()
    six.new_row_delta().delete_equal(spark.createDataFrame([(80,)], "age long")).commit()
    done = six.rewrite_data_files()
    files = six.scan().files()
    assert done.rewritten == 6 and len(files) == 3 and sorted(f.partition[1000] for f in files) == [D, D + 1, D + 2]
    assert ids(six.to_df()) == [1, 2, 3, 5, 6, 7, 9, 10, 11, 12]


def test_compaction_refuses_deletes_it_has_not_seen(spark, six, catalog):
    from siltstone.operators import maintenance

    other = catalog.load("db.events")
    original = maintenance.commit_if_deletes_stay

    def late(table, change, deletes):
        other.new_row_delta().delete_equal(spark.createDataFrame([(1,)], "id long")).commit()
        return original(table, change, deletes)

    maintenance.commit_if_deletes_stay = late
    try:
        with pytest.raises(ValidationError):
            six.rewrite_data_files()
    finally:
        maintenance.commit_if_deletes_stay = original
    assert ids(six.refresh().to_df()) == list(range(2, 13))


def test_expiry(spark):
    ticks = iter(range(1000, 1_000_000, 1000))
    c = Catalog(spark, scratch(spark).warehouse, lambda: next(ticks))
    t = c.create("t", EVENTS)
    for i in range(4):
        t.append(events(spark, [(i, D, 1, "a", i)]).coalesce(1))
    old = {f.path for f in t.scan().files()}
    t.rewrite_data_files()
    assert t.expire_snapshots(older_than_ms=0).snapshots == 0
    asked = []
    done = t.expire_snapshots(older_than_ms=10**12, retain_last=2, delete_with=asked.append)
    assert (done.snapshots, done.data_files) == (3, 0) and ids(t.to_df()) == [0, 1, 2, 3] and asked
    done = t.expire_snapshots(older_than_ms=10**12)
    assert (done.snapshots, done.data_files) == (1, 4) and not any(os.path.exists(p.removeprefix("file://")) for p in old)
    assert ids(t.to_df()) == [0, 1, 2, 3] and len(t.metadata.snapshots) == 1 and len(t.metadata.log) == 1


def test_expiry_of_abandoned_and_named_snapshots(spark, six):
    six.append(events(spark, [(50, D, 1, "a", 1)]))
    first, second = (s.snapshot_id for s in six.metadata.snapshots)
    six.rollback(first)
    done = six.expire_snapshots(older_than_ms=0)  # young, but not on the current line
    assert (done.snapshots, done.data_files) == (1, 1) and ids(six.to_df()) == list(range(1, 13))
    six.append(events(spark, [(51, D, 1, "a", 1)]))
    assert six.expire_snapshots(older_than_ms=0, ids=(first,)).snapshots == 1
    assert six.expire_snapshots(older_than_ms=0, ids=(six.current_snapshot.snapshot_id,)).snapshots == 0
    with pytest.raises(ValidationError):
        six.expire_snapshots(ids=(second,))
    assert ids(six.to_df()) == [*range(1, 13), 51]


def test_orphans(spark, six):
    six.delete_where(col("age") > 74)
    six.store.write("data/lost/x.parquet", "x")
    six.store.write("metadata/lost.metadata.json", "x")
    assert six.remove_orphan_files() == []  # too young
    seen = []
    future = six.clock() + 100_000
    six.remove_orphan_files(future, delete_with=seen.append)
    gone = six.remove_orphan_files(future)
    assert seen == gone and {"data/lost/x.parquet", "metadata/lost.metadata.json"} <= set(gone)
    assert all(n.startswith(("data/lost", "metadata/lost")) or n.endswith((".crc", "_SUCCESS")) for n in gone)
    assert ids(six.to_df()) == list(range(1, 11)) and ids(six.scan().use_snapshot(six.metadata.snapshots[0].snapshot_id).to_df()) == list(range(1, 13))
    assert os.path.exists(f"{six.store.root}/metadata/version-hint.text")


def test_external_file(spark, catalog):
    t = catalog.create("t", USERS)
    df = spark.createDataFrame([(1, "a", 2, "e")], USERS.struct())
    df.coalesce(1).write.parquet(f"{t.store.uri}/data/own")
    name = next(n for n, _, _ in t.store.list("data/own") if n.endswith(".parquet"))
    t.new_append().append_file(external_file(t, name)).commit()
    assert ids(t.to_df(col("age") == 2)) == [1] and ids(t.to_df(col("age") == 3)) == []


def test_stream_batches_are_appended_once(spark, catalog):
    from siltstone.streaming.sink import append_batches

    t = catalog.create("t", USERS)
    run = append_batches(t, "s")
    df = spark.createDataFrame([(1, "a", 2, "e")], "id long, name string, age long, email string")
    run(df, 0)
    run(df, 0)
    run(df, 1)
    assert t.to_df().count() == 2


def test_reading_task_by_task(spark, catalog):
    from siltstone.operators.task_reader import task_df

    df = spark.range(5000).selectExpr("id", "concat('n', id % 7) name", "id % 90 age", "timestamp_seconds(id) z", "timestamp_ntz'2024-01-01' n", "cast(id as decimal(9,1)) d").coalesce(1)
    t = catalog.create("t", df)
    t.append(df, options={"parquet.block.size": str(16 << 10), "parquet.page.size": str(2 << 10)})
    t.update_schema().rename("name", "title").add("extra", "int").commit()
    t.append(df.withColumnRenamed("name", "title").withColumn("extra", F.lit(1)).limit(10))
    for size in (1 << 10, 1 << 14, 1 << 27):
        got = task_df(t.scan(), size, 3, 0)
        assert got.rdd.getNumPartitions() == len(t.scan().tasks(size, 3, 0))
        assert got.count() == 5010 and got.exceptAll(t.to_df()).count() == 0
    assert task_df(t.scan().filter(col("age") > 80)).count() == t.to_df(col("age") > 80).count()
    assert task_df(catalog.create("none", df).scan()).count() == 0
    t.new_row_delta().delete_equal(spark.createDataFrame([(1,)], "id long")).commit()
    with pytest.raises(ValidationError):
        task_df(t.scan())


def test_partitions_that_bounds_do_not_tell(spark, catalog, monkeypatch):
    rows = [(float("nan"), "x" * 6000), (-0.0, "xy" * 3000), (0.0, "y" * 5000), (None, None), (2.5, "short")]
    df = spark.createDataFrame(rows, "d double, s string")
    for i, limit in enumerate((64, 0)):
        monkeypatch.setattr(FL, "DRIVER_FOOTERS", limit)
        t = catalog.create(f"odd{i}", df, lambda s: PartitionSpec.builder(s).truncate("s", 3).identity("d").build())
        t.append(df)
        t.append(df)
        found = t.scan().files()
        trunc, number = (f.field_id for f in t.spec.fields)
        assert {(f.partition[trunc], str(f.partition[number]).lstrip("-")) for f in found} == {("xxx", "nan"), ("xyx", "0.0"), ("yyy", "0.0"), (None, "None"), ("sho", "2.5")}
        assert sorted(len(r.s or "") for r in t.to_df(col("s") < "xyz").collect()) == [5, 5, 6000, 6000, 6000, 6000]
        assert t.to_df(col("d") > 1.0).count() == 4


def test_a_batch_is_not_appended_again_after_its_snapshot_expired(spark, catalog):
    df = spark.createDataFrame([(1,)], "a int")
    t = catalog.create("batches", df)
    write = append_batches(t, "one")
    write(df, 0)
    write(df, 1)
    t.append(df)
    t.expire_snapshots(older_than_ms=2**62)
    write = append_batches(catalog.load("batches"), "one")
    write(df, 0)
    write(df, 1)
    assert catalog.load("batches").to_df().count() == 3
    write(df, 2)
    append_batches(catalog.load("batches"), "other")(df, 0)
    assert catalog.load("batches").to_df().count() == 5


def test_rewritten_manifests_hold_what_the_old_ones_held(spark, catalog, monkeypatch):
    df = spark.range(40).selectExpr("id", "id % 4 as k")
    t = catalog.create("t", df, lambda s: PartitionSpec.builder(s).identity("k").build())
    assert t.rewrite_manifests() == (0, 0)
    t.append(df.where("id < 20"))
    assert t.rewrite_manifests() == (1, 1) and len(t.metadata.snapshots) == 1
    t.new_row_delta().delete_equal(spark.createDataFrame([(3,), (25,)], "id long")).commit()
    t.update_spec().remove("k").commit()
    t.append(df.where("id >= 20"))
    t.new_row_delta().delete_equal(spark.createDataFrame([(4,), (30,)], "id long")).commit()
    t.delete_where(col("k") == 1)
    def rows(df):
        return sorted(r.id for r in df.collect())

    before, old = rows(t.to_df()), [(s.snapshot_id, rows(t.scan().use_snapshot(s.snapshot_id).to_df())) for s in t.metadata.snapshots]
    assert 25 in before and 3 not in before and 30 not in before and 1 not in before
    sequences = {(r.path, r.sequence) for r in t.files().collect()}
    had, has = t.rewrite_manifests()
    assert (had, has) == (5, 3) and t.current_snapshot.operation == "replace"
    assert {(r.path, r.sequence) for r in t.files().collect()} == sequences
    assert rows(t.to_df()) == before and [(i, rows(t.scan().use_snapshot(i).to_df())) for i, _ in old] == old
    t.append(df.where("id = 3"))
    assert rows(t.to_df()) == sorted([*before, 3])
    monkeypatch.setattr("siltstone.sources.manifests.MANIFEST_ENTRIES", 2)
    n = t.files().count()
    _, has = t.rewrite_manifests()
    assert has >= n / 2 and rows(t.to_df()) == sorted([*before, 3])
    t.expire_snapshots(older_than_ms=2**62)
    t.remove_orphan_files(older_than_ms=2**62)
    assert rows(t.refresh().to_df()) == sorted([*before, 3])

"""The store behind Hadoop's file systems, here over a local folder."""

import pytest

from siltstone.errors import CommitFailed
from siltstone.functions.predicates import col
from siltstone.operators.table import Table
from siltstone.sources.commit import TableOps
from siltstone.sources.metadata import PartitionSpec, TableMetadata
from siltstone.sources.schema import Schema
from siltstone.sources.store import HadoopStore, LocalStore, store_for


def test_choice_of_store(spark, tmp_path):
    assert isinstance(store_for(spark, f"file://{tmp_path}"), LocalStore) and isinstance(store_for(spark, str(tmp_path)), LocalStore)


def test_files(spark, tmp_path):
    s = HadoopStore(spark, f"file://{tmp_path}")
    assert s.read("a/b") is None and s.list("a") == [] and not s.exists("a/b")
    s.write("a/b", "é\n")
    assert s.read("a/b") == "é\n" and s.exists("a/b")
    s.publish("m/v1", "one")
    with pytest.raises(CommitFailed):
        s.publish("m/v1", "two")
    s.replace("a/b", "new")
    assert s.read("m/v1") == "one" and s.read("a/b") == "new" and sorted(n for n, _, _ in s.list()) == ["a/b", "m/v1"]
    assert s.delete("a/b") and not s.exists("a/b") and s.drop()


def test_a_table(spark, tmp_path):
    schema = Schema.of(("id", "long"), ("day", "date"), ("s", "string"), ("v", "double"))
    store = HadoopStore(spark, f"file://{tmp_path}/t")
    t = Table(spark, "t", store, TableOps(store))
    t.ops.create(TableMetadata("u", store.uri, (schema,), (PartitionSpec.builder(schema).day("day").bucket("s", 2).build(),)))
    df = spark.range(40).selectExpr("id", "date_add(date'2024-01-01', cast(id % 4 as int)) day", "concat('k', id % 3) s", "id / 2 v")
    t.append(df)
    p = (col("day") >= "2024-01-03") & (col("v") > 5.0)
    assert sorted(r.id for r in t.to_df(p).collect()) == [i for i in range(40) if i % 4 >= 2 and i / 2 > 5]
    assert t.scan().filter(p).plan().count() < t.files().count()
    t.delete_where(col("day") == "2024-01-01")
    t.rewrite_data_files()
    assert t.expire_snapshots(older_than_ms=t.clock() + 1).snapshots > 0
    assert sorted(r.id for r in t.to_df().collect()) == [i for i in range(40) if i % 4]
    assert Table(spark, "t", store, TableOps(store)).refresh().to_df().count() == 30

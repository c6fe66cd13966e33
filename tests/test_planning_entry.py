"""Split and pack plans, raw files, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__
from siltstone.errors import ValidationError
from siltstone.operators.planning import FileTask, pack, plan, split
from siltstone.plans import queries as Q
from siltstone.sources.metadata import DataFile
from siltstone.sources.raw import anatomy, column_bytes
from siltstone.sources.schema import Field, Schema

SF = "/root/testdata/sf0.001"


def test_split():
    f = DataFile("f", 1, 250)
    assert [(t.start, t.length) for t in split(f, 100)] == [(0, 100), (100, 100), (200, 50)]
    assert [(t.start, t.length) for t in split(DataFile("f", 1, 250, split_offsets=(4, 100)), 10)] == [(4, 96), (100, 150)]
    for offsets in ((100, 4), (4, 4), (4, 300)):  # not ascending, or behind the end: ranges
        assert len(split(DataFile("f", 1, 250, split_offsets=offsets), 100)) == 3
    assert split(DataFile("f", 0, 0), 100) == []
    with pytest.raises(ValidationError):
        split(f, 0)


def test_pack():
    packed = lambda xs, target, look: [list(b) for b in pack(xs, target, look, lambda x: x)]
    assert packed([800, 300, 800], 1000, 1) == [[800], [800], [300]]
    assert packed([5, 6, 5, 4], 10, 10) == [[5, 5], [6, 4]]
    assert packed([3, 30, 3], 10, 2) == [[3, 3], [30]] and packed([], 10, 1) == []
    assert packed([5, 5, 5, 5], 10, 1) == [[5, 5], [5, 5]]
    for target, look in ((0, 1), (1, 0)):
        with pytest.raises(ValidationError):
            packed([1], target, look)


def test_plan_weighs_small_splits_as_an_open_file():
    files = [DataFile(f"f{i}", 1, 10) for i in range(6)]
    assert [len(t.tasks) for t in plan(files, 100, 10, 40)] == [2, 2, 2]
    assert plan(files, 100, 10, 0)[0].size == 60 and plan([], 100) == []
    assert plan([DataFile("a", 1, 250)], 100, 10, 0)[0].tasks == (FileTask(DataFile("a", 1, 250), 0, 100),)


def test_schema_rules():
    with pytest.raises(ValidationError):
        Schema.of(("a", "int"), ("a", "int"))
    with pytest.raises(ValidationError):
        Schema((Field(1, "a", "int"), Field(1, "b", "int")))
    s = Schema.of(("a", "long", True), ("b", "array<int>"))
    assert Schema.from_json(s.to_json()) == s and s.need(2).name == "b" and s.highest_id == 2


def test_anatomy(spark):
    t = Q._many_files(spark, SF)
    chunks = anatomy(t.scan().files()[0].path)
    assert {c.column for c in chunks} == {f.name for f in t.schema.fields} and all(c.codec == "SNAPPY" and c.nulls == 0 and c.compressed > 0 for c in chunks)
    assert column_bytes(t, ["c_custkey"]) < column_bytes(t)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"event_type", "n"}


def test_registration():
    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert set(Q.queries()) <= names and set(Q.oracle_sql()) == set(Q.queries()) and sql <= names


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in os.listdir(SF):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{SF}/{p}'")
    got = Q.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want))

"""Transforms as columns and as literals, predicates in their three readings, projections."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import ValidationError
from siltstone.functions import predicates as P
from siltstone.functions.predicates import FALSE, TRUE, And, Compare, Not, Or, col
from siltstone.functions.transforms import DAY, HOUR, Transform, java_hash, stored
from siltstone.sources.metadata import PartitionSpec
from siltstone.sources.schema import Schema

SCHEMA = Schema.of(("id", "long"), ("name", "string"), ("event_time", "long"), ("category", "string"), ("age", "long"))
AGE, TIME = 5, 3
D = 20_661


def projected(p, spec):
    fields = [(f.field_id, f.source_id, f.transform) for f in spec.fields]
    return P.project(P.bind(p, SCHEMA), fields, lambda i: SCHEMA.by_id(i).spark)


def spec():
    return PartitionSpec.builder(SCHEMA)


def test_known_transform_values():
    long, text = T.LongType(), T.StringType()
    assert Transform("day").literal(-1, long) == -1 and Transform("hour").literal(-1, long) == -1
    assert [Transform("truncate", 10).literal(v, long) for v in (23, -23, 0)] == [20, -30, 0]
    assert [Transform("truncate", n).literal(v, text) for n, v in ((3, "Alice"), (5, "Bob"))] == ["Ali", "Bob"]
    assert 0 <= Transform("bucket", 4).literal("electronics", text) < 4
    assert all(t.literal(None, long) is None for t in (Transform("bucket", 4), Transform("day"), Transform("truncate", 3)))
    assert java_hash("hello", text) == 99162322 and java_hash(-1, long) == 0 and java_hash(-1, T.IntegerType()) == 0xFFFFFFFF
    for text_form in ("identity", "day", "hour", "bucket[4]", "truncate[10]"):
        assert str(Transform.parse(text_form)) == text_form


@pytest.mark.parametrize("bad", ["bucket[0]", "truncate[0]", "bucket", "day[3]", "week", "bucket[-1]", ""])
def test_bad_transforms(bad):
    with pytest.raises(ValidationError):
        Transform.parse(bad)


def test_transforms_of_unsuitable_types():
    for t, kind in ((Transform("hour"), T.IntegerType()), (Transform("bucket", 3), T.DoubleType()), (Transform("truncate", 3), T.DoubleType()), (Transform("day"), T.StringType())):
        with pytest.raises(ValidationError):
            t.check(kind)


def test_column_and_literal_agree(spark):
    rng = random.Random(1)
    longs = [None, 0, -1, 1, -(1 << 63), (1 << 63) - 1, DAY, -DAY, DAY - 1] + [rng.randrange(-(1 << 62), 1 << 62) for _ in range(100)]
    ints = [None, 0, -1, -(1 << 31), (1 << 31) - 1] + [rng.randrange(-(1 << 31), 1 << 31) for _ in range(104)]
    texts = [None, "", "a", "hello", "é", "日本語テキスト", "\U0001f600x", "a" * 40] + ["".join(rng.choice("abé日\U0001f600 ") for _ in range(rng.randint(0, 12))) for _ in range(101)]
    times = [None] + [dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=rng.randrange(-(1 << 50), 1 << 51)) for _ in range(108)]
    rows = list(zip(longs, ints, texts, times, times, [t.date() if t else None for t in times], strict=True))
    df = spark.createDataFrame(rows, "l long, i int, s string, n timestamp_ntz, z timestamp_ntz, d date").withColumn("z", F.col("z").cast("timestamp"))
    cases = [("l", t) for t in ("identity", "bucket[16]", "truncate[10]", "day", "hour")] + [("i", t) for t in ("identity", "bucket[16]", "truncate[7]", "day")]
    cases += [("s", t) for t in ("identity", "bucket[16]", "truncate[3]")] + [(c, t) for c in "nz" for t in ("identity", "day", "hour")] + [("d", "day"), ("d", "identity")]
    for c, name in cases:
        t, kind = Transform.parse(name), df.schema[c].dataType
        got = df.select(stored(F.col(c), kind).alias("v"), t.column(F.col(c), kind).alias("t")).collect()
        assert [r.t for r in got] == [t.literal(r.v, kind) for r in got], (c, name)


def test_projection_examples():
    ten = D * DAY + 10 * HOUR
    day = spec().day("event_time").build()
    assert projected(col("age") > 50, spec().identity("age").build()) == Compare(1000, ">", 50)
    assert projected(col("event_time") > ten, day) == Compare(1000, ">=", D)
    assert projected(col("event_time") < (D + 1) * DAY, day) == Compare(1000, "<=", D)
    bucket = spec().bucket("age", 4).build()
    assert projected(col("age") == 50, bucket) == Compare(1000, "=", Transform("bucket", 4).literal(50, T.LongType()))
    assert projected(col("age") > 50, bucket) == TRUE
    assert projected(col("age") > 20, spec().truncate("age", 10).build()) == Compare(1000, ">=", 20)
    assert projected(~(col("event_time") > D * DAY), day) == Compare(1000, "<=", D)
    both = spec().day("event_time").hour("event_time").build()
    at = D * DAY + 3 * HOUR
    assert projected(col("event_time") == at, both) == And(Compare(1000, "=", D), Compare(1001, "=", D * 24 + 3))
    assert projected(col("event_time") != at, day) == TRUE
    assert projected(col("event_time") < -(1 << 63), day) == TRUE and projected(col("event_time") > (1 << 63) - 1, day) == TRUE
    name = spec().truncate("name", 2).build()
    assert projected(col("name") < "bob", name) == Compare(1000, "<=", "bo") and projected(col("name") >= "bob", name) == Compare(1000, ">=", "bo")
    assert projected(col("category") == "x", day) == TRUE


def test_folding_and_not():
    a, b = col("age") > 1, col("id") < 2
    assert a & TRUE == a and a | FALSE == a and a & FALSE == FALSE and a | TRUE == TRUE and ~~a == a and ~TRUE == FALSE
    assert P.rewrite_not(~(a & b)) == Or(col("age") <= 1, col("id") >= 2)
    assert P.rewrite_not(~(a | ~b)) == And(col("age") <= 1, b)
    assert str(~(a & b)) == "NOT ((age > 1 AND id < 2))"


def test_unknown_columns_and_literals():
    for p in (col("nope") > 1, col("age") == "x", col("name") > 3, col("age") > None):
        with pytest.raises(ValidationError):
            P.bind(p, SCHEMA)


def test_spec_builder():
    s = spec().identity("category").day("event_time").bucket("id", 4).truncate("name", 3).hour("event_time").build()
    assert [(f.field_id, f.name) for f in s.fields] == [(1000, "category"), (1001, "event_time_day"), (1002, "id_bucket"), (1003, "name_trunc"), (1004, "event_time_hour")]
    assert s.describe({1000: "a"}).startswith("{category=a, event_time_day=None")
    assert PartitionSpec.from_json(s.to_json()) == s
    with pytest.raises(ValidationError):
        spec().day("event_time").day("event_time")
    with pytest.raises(ValidationError):
        spec().day("nope")


NUMBER = st.integers(-30, 30)
LEAF = st.builds(Compare, st.sampled_from(["age", "event_time"]), st.sampled_from(list(P.OPS)), NUMBER)
TREE = st.recursive(LEAF, lambda x: st.one_of(st.builds(And, x, x), st.builds(Or, x, x), st.builds(Not, x)), max_leaves=6)
TRANSFORM = st.sampled_from([Transform("identity"), Transform("bucket", 3), Transform("truncate", 7), Transform("day"), Transform("hour")])


def holds(p, row):
    """SQL's three values: True, False, None."""
    match p:
        case Compare(r, op, v):
            return None if row[r] is None else P.OPS[op](row[r], v)
        case Not(x):
            v = holds(x, row)
            return None if v is None else not v
        case And(x, y):
            v = (holds(x, row), holds(y, row))
            return False if False in v else None if None in v else True
        case Or(x, y):
            v = (holds(x, row), holds(y, row))
            return True if True in v else None if None in v else False


@settings(max_examples=300, deadline=None)
@given(TREE, st.lists(st.tuples(TRANSFORM, st.sampled_from([AGE, TIME])), max_size=3), st.one_of(st.none(), NUMBER), st.one_of(st.none(), NUMBER))
def test_projection_never_loses_a_row(p, fields, age, time):
    row = {AGE: age, TIME: time}
    bound = P.bind(p, SCHEMA)
    numbered = [(1000 + i, source, t) for i, (t, source) in enumerate(fields)]
    values = {f: t.literal(row[source], T.LongType()) for f, source, t in numbered}
    if holds(bound, row):
        assert P.matches_partition(P.project(bound, numbered, lambda i: T.LongType()), values)


def test_metrics_never_lose_a_row_and_strict_never_takes_one(spark):
    """Random files and predicates: inclusive keeps every file with a match, strict takes only files that match wholly."""
    rng = random.Random(5)
    files, predicates = [], []
    for _ in range(60):
        rows = [{AGE: rng.choice([None, *range(-5, 6)]) if rng.random() < 0.5 else rng.randint(-3, 3), TIME: rng.randint(-4, 4)} for _ in range(rng.randint(1, 4))]
        files.append(rows)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return Compare(rng.choice([AGE, TIME]), rng.choice(list(P.OPS)), rng.randint(-5, 5))
        return rng.choice([lambda: And(tree(depth - 1), tree(depth - 1)), lambda: Or(tree(depth - 1), tree(depth - 1)), lambda: Not(tree(depth - 1))])()

    predicates = [tree(3) for _ in range(40)]
    entries = []
    for i, rows in enumerate(files):
        known = {c: [r[c] for r in rows if r[c] is not None] for c in (AGE, TIME)}
        bound = lambda f: {str(c): f(v) if v and i % 7 else None for c, v in known.items()}  # noqa: B023, E731
        entries.append((i, len(rows), bound(min), bound(max), {str(c): sum(r[c] is None for r in rows) for c in (AGE, TIME)}))
    kind = "i int, record_count long, lower struct<`3`:long,`5`:long>, upper struct<`3`:long,`5`:long>, null_counts struct<`3`:long,`5`:long>"
    df = spark.createDataFrame([(i, n, *[(d[str(TIME)], d[str(AGE)]) for d in (lo, hi, nulls)]) for i, n, lo, hi, nulls in entries], kind)
    got = df.select("i", *(P.inclusive(p).alias(f"a{k}") for k, p in enumerate(predicates)), *(P.strict(p).alias(f"s{k}") for k, p in enumerate(predicates))).collect()
    for r in got:
        for k, p in enumerate(predicates):
            matches = [holds(p, row) for row in files[r.i]]
            assert r[f"a{k}"] or True not in matches
            assert not r[f"s{k}"] or all(m is True for m in matches)

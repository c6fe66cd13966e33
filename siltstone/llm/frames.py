"""Small pieces that the operators share: column naming, pass-through, shared folders, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    out, n = name, 0
    while out.lower() in have:
        n += 1
        out = f"{name}_{n}"
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under spark.checkpoint.dir, which the driver and all executors see.

    Where that setting is absent, a temporary folder is set for checkpoints on one machine (master ``local``); on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/siltstone-{uuid.uuid4().hex}"


#: Bytes of the plan's inputs for each partition that is written.
FILE_BYTES = 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files (or other sources) that df is made from, as the planner knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def few_files(df: DataFrame, per_core: int = 2) -> DataFrame:
    """df in fewer partitions where there are many for little data: narrow rows in many partitions would make many small files.

    One is left for each ``FILE_BYTES`` of the inputs, and so many per core at least. Partitions are read one after the
    other by fewer tasks, without an exchange.
    """
    by_bytes = min(-(-input_bytes(df) // FILE_BYTES), 2**31 - 1)  # sources of unknown size count as endless
    return df.coalesce(max(per_core * df.sparkSession.sparkContext.defaultParallelism, by_bytes))


def saved(df: DataFrame, name: str = "part", folder: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut and executors may be lost."""
    path = f"{folder or shared_dir(df.sparkSession)}/{name}"
    few_files(df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: str) -> DataFrame:
    """An inner join of many rows with a row per key (a grouped result), where one key may have most of the rows.

    A key's rows on the left are spread over ``SALTS`` tasks by the column ``spread``; the right's narrow rows are copied
    for each. Without this, rows would go where the grouping left its key: all of a hot key's to one task.
    """
    salt = "_salt"
    many = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    one = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = many.join(one.hint("merge"), [*on, salt])  # never broadcast: nothing bounds the number of keys
    return out.select(*(c for c in out.columns if c != salt))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, unless the session has a setting of its own.

    Spark's own 10,000 rows of long texts are tens of MB, several times over: in the JVM, on the way, in Python.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def give_back() -> None:
    """Return memory that a Python worker has freed but holds; workers live on and serve later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def map_batches(
    df: DataFrame,
    fn: Callable[..., dict[str, pa.Array]],
    inputs: list[str],
    outputs: dict[str, T.DataType],
    keep: Iterable[str],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Add output columns computed from whole Arrow batches; rows keep their order and number.

    ``fn`` gets the arrays of the columns ``inputs`` (and what ``setup``, which runs once in each task,
    returned, if there is one) and returns the arrays of the outputs. ``keep`` names the columns passed
    through; one named like an output gives way to the output. Only these columns are read.
    """
    small_batches(df.sparkSession)
    names = {o.lower() for o in outputs}
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in names]
    more = [c for c in inputs if c not in kept]
    place = {c: i for i, c in enumerate([*kept, *more])}
    aliased = [named(c).alias(f"_input_{i}") for i, c in enumerate([*kept, *more])]  # any name goes in and comes out
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(k, t) for k, t in outputs.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = () if setup is None else (setup(),)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn(*(batch.column(place[c]) for c in inputs), *state)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(made[o] for o in outputs)], names=[*kept, *outputs])

    return df.select(*aliased).mapInArrow(tidy(run), schema)

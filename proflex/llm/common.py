"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir, table_path, tune_session

#: Rows of an Arrow batch handed to Python: long texts must fit in a worker many at a time.
BATCH_ROWS = 512
BATCH_CHARS = 1 << 23


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on; the caller's checkpoint folder is kept."""
    tune_session(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # a persisted table keeps its hash partitioning, so joins on its key do not shuffle it again
    spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "false")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` into a new folder below spark.checkpoint.dir, which all machines share, and
    read it back: lineage ends there, lost executors do not matter, and the plan runs once
    (checkpoint() runs it twice).  The folder goes when the application ends."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: it does so when the driver's
    garbage collection finds that nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def map_batches(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]],
                fields: str) -> DataFrame:
    """Run a small row function in Arrow batches.

    `make()` is called once in each task and returns a function that takes the values of one
    row and gives the output rows for it.  `fields` is the DDL of these rows."""
    schema = T.StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_fn = make()
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for values in zip(*columns):
                out.extend(row_fn(*(v.as_py() for v in values)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, make: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]],
               fields: str) -> DataFrame:
    """Run a generator over the rows of each partition, in their order.

    `make()` is called once in each task; what it returns takes an iterator of row tuples and yields
    output tuples of the DDL `fields`.  Rows pass by, so a generator that holds little works for
    partitions of any length; batches end early when their texts get long."""
    schema = T.StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns))

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

        out, size = [], 0
        for row in make()(rows()):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; every other column stays behind, whatever its name."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

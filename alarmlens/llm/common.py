"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A key that at least so many rows have, and at least this share of all, is joined by broadcast: no more than HOT_SHARE keys can be so frequent.
HOT_ROWS, HOT_SHARE = 1_000, 100_000
#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="alarmlens-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and written as a table in the shared folder, so that lost executors cost no recomputation of its lineage."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame, shuffles: bool = False) -> None:
    """Deletes saved tables that nothing needs any more; with shuffles, Spark also looks for the shuffles that went into them."""
    for table in tables:
        remove_folder(table.sparkSession, table.saved_at)
    if shuffles:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def joined(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join with a table of one row a key, whose column size says how many rows have the key. Both are saved tables.

    The most frequent keys, a bounded number, are sent to all tasks, so that none of them has to meet in one.
    """
    bound = max(HOT_ROWS, rows.count() // HOT_SHARE)
    marked = rows.join(F.broadcast(table.where(F.col(size) >= bound)), on, "left")
    rest = marked.where(F.col(size).isNull()).select(*rows.columns)
    return marked.where(F.col(size).isNotNull()).unionByName(rest.join(table.where(F.col(size) < bound).hint("merge"), on))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column's values."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


def map_columns(df: DataFrame, columns: list, make: Callable[[], Callable], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Runs make()(*arrays) on slices of the columns; it returns the output columns as lists or Arrow arrays, in the order of schema."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn(*(part.column(i) for i in range(part.num_columns)))
                arrays = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(got, out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = SLICE_ROWS) -> DataFrame:
    """Filters or rewrites whole rows: make()(batch) returns a batch with the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, df.schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], dict | None], schema: str, order: tuple = ()) -> DataFrame:
    """Runs fn on the rows of each key, as a table, and yields the columns that it returns. Groups stream through a task one after the other; only one is held."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        made: list[pa.RecordBatch] = []

        def finish():
            if held:
                got = fn(pa.Table.from_batches(held))
                if got is not None:
                    made.append(pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(column(batch, key))
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:]):
                part = batch.slice(a, b - a)
                if held and np.asarray(column(held[-1], key))[-1] != keys[a]:
                    finish()
                held.append(part)
                if len(made) >= 256:
                    yield pa.Table.from_batches(made).combine_chunks().to_batches()[0] if sum(x.num_rows for x in made) else made[0]
                    made.clear()
        finish()
        yield from made

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

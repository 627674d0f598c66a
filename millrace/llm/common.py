"""What the operators of this subpackage share: lineage cuts, batch sizes and sorted groups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

BATCH_ROWS = 256  #: rows of an Arrow batch, so that a batch of long texts stays small


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one is set only where none is configured (local tests)."""
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``cut``, in no more partitions than ``rows`` each make: else a small table leaves files of every partition in every shuffle of a loop.

    A table of one partition carries its number of rows as a limit, which leaves none out: with it Spark knows the size, and joins and sums
    of such tables take a task each. A shuffle would take as many as there are shuffle partitions, whose records the driver keeps.
    """
    out = cut(df)
    n = out._jdf.queryExecution().toRdd().count()
    return out.coalesce(1).limit(n) if n <= rows else out.coalesce(-(-n // rows))


def tidy(spark: SparkSession) -> None:
    """Lets go of the shuffle files and checkpoints of rounds that are over: Spark removes them once their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def return_arrays() -> None:
    """Makes the driver return the memory of large arrays once they are freed; glibc would keep it for later ones."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass  # another allocator


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that no plan reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches handed to Python; called by every operator that uses Python on executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(df: DataFrame, id_col: str, text_col: str, keep: Iterable[str] = ()) -> DataFrame:
    """Only the columns an operator needs, under its own names: ``_id``, ``_text`` (null: empty) and ``keep``."""
    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *keep)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``fn`` over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by ``keys`` (non-null integers)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def bucket(bits: int, *cols: Column) -> Column:
    """A number below ``2 ** bits``: sets of them can be broadcast, as their size has a fixed bound."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << bits) - 1))


def without(df: DataFrame, key: Column, gone: DataFrame, gone_key: str, bits: int = 18) -> DataFrame:
    """The rows of ``df`` whose ``key`` (a long, never null) isn't in ``gone``.

    Only rows whose key falls into a bucket of some key in ``gone`` are shuffled; the set of buckets has a fixed bound.
    """
    gone = gone.select(F.col(gone_key).alias("gone"))
    buckets = gone.select(bucket(bits, F.col("gone")).alias("bucket")).distinct().withColumn("near", F.lit(True))
    nested = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"))
    marked = nested.withColumn("bucket", bucket(bits, F.col("key"))).join(F.broadcast(buckets), "bucket", "left")
    quiet = marked.filter("near IS NULL").select("row.*")
    near = marked.filter("near").join(gone.distinct(), F.col("key") == F.col("gone"), "left_anti").select("row.*")
    return quiet.unionByName(near)

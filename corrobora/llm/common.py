"""What the operators share: scratch tables, size checks and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small table is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text that Python code works on at a time.
SLICE_BYTES = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH = "67108864b"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests on one machine) a temporary folder is taken.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {master}")
        root = getattr(shared_root, "_own", None)
        if root is None:
            root = shared_root._own = tempfile.mkdtemp(prefix="corrobora-")
    return root.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone at exit; the folder's owner clears it then
            pass

    atexit.register(drop)
    return path


def small_batches(spark: SparkSession) -> None:
    """Arrow batches as small as Python works on, which bounds the memory of both sides; a session's own setting stays."""
    if spark.conf.get(BATCH, DEFAULT_BATCH) in (DEFAULT_BATCH, DEFAULT_BATCH.rstrip("b"), "64m", "64mb"):
        spark.conf.set(BATCH, str(2 * SLICE_BYTES))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    small_batches(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(df: DataFrame | None) -> None:
    """Delete a table that ``cut`` wrote and nothing reads any more; others are left alone."""
    path = getattr(df, "scratch_path", None)
    if path:
        remove(df.sparkSession, path)


def lean(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function of a task, which gives its memory back at the end: workers wait for their next task with what they hold."""

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # a C library without it
            pass

    return tidy


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose counted rows are within the limit; else leave it to a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def id_text_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def id_hash32(col: str = "doc_id", seed: str = "") -> Column:
    """Unsigned 32-bit hash of an id: the first 8 hex digits of md5(seed + id)."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about so many bytes of text, a row at least."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    lead = "__"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

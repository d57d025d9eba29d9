"""What the operators share: table reading, shipping the package to executors, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PACKAGE = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder, by any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that Spark hands to Python at once while a table is stored, where the session has its default: texts are long,
#: and both sides hold them.
BATCH_ROWS, _DEFAULT_BATCH_ROWS, _BATCH_CONF = "2000", "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"

_HELD: dict = {}


def _emptied() -> None:
    """Give back what this worker holds for other operators, and what its allocators keep."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call outside glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker_cache(key, make: Callable):
    """What a worker keeps from task to task: the table of one operator at a time, whichever ran last."""
    if key not in _HELD:
        _emptied()
        _HELD[key] = make()
    return _HELD[key]


def mapped(df: DataFrame, run: Callable, schema, cached: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) by workers that hold no other operator's table meanwhile and give memory back at the end.

    `cached`: the operator has a table in the worker's cache, which stays for its next task.
    """

    def task(batches):
        if _HELD and not cached:
            _emptied()
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that Python stages import it there."""
    context = spark.sparkContext
    if getattr(context, "_ledgerspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="ledgerspark-")) / "ledgerspark_pkg.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, str(source.relative_to(_PACKAGE.parent)))
    context.addPyFile(str(archive))
    context._ledgerspark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, our own on one machine only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return Path(tempfile.gettempdir(), "ledgerspark-checkpoints").as_uri()


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Python gets few rows at once meanwhile; the session's own setting comes back."""
    before = spark.conf.get(_BATCH_CONF)
    if before != _DEFAULT_BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH_CONF, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


#: What `stored` has written in the innermost `temporaries`.
_WRITTEN: list[set[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, lost executors cost nothing.

    The files go by `dropped`, at the end of `temporaries`, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/ledgerspark-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    if _WRITTEN:
        _WRITTEN[-1].add(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        system, where = _file_system(df.sparkSession, df.stored_path)
        system.delete(where, True)


@contextlib.contextmanager
def temporaries(spark: SparkSession):
    """Tables stored meanwhile are deleted at the end, but for those added to the set that this gives."""
    keep: set[str] = set()
    _WRITTEN.append(set())
    try:
        yield keep
    finally:
        for path in _WRITTEN.pop() - keep:
            system, where = _file_system(spark, path)
            system.delete(where, True)


def hashed_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most `rows` rows, the same ones however the table is split: those whose keys hash lowest.

    Rows are thinned out by their hashes first, so that no more than about twice as many meet anywhere.
    """
    own = F.xxhash64(*keys)
    every = max(1, df.count() // rows)
    return df.where(F.pmod(own, F.lit(every)) == 0).orderBy(own, *keys).limit(rows)


#: Bytes up to which a table is broadcast; beyond, it is shuffled.
BROADCAST_BYTES = 48_000_000


def _row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory, its strings, binaries and arrays as long as they are."""
    total = F.lit(16)
    for f in df.schema.fields:
        own = F.lit(8)
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            own = F.octet_length(f.name) + 16
        elif isinstance(f.dataType, T.ArrayType):
            each = len(f.dataType.elementType.fields) + 2 if isinstance(f.dataType.elementType, T.StructType) else 1
            own = F.size(f.name) * 8 * each + 16
        total = total + F.greatest(F.coalesce(own, F.lit(0)), F.lit(8)).cast("long")
    return total


def beside(large: DataFrame, small: DataFrame, keys: list[str], how: str, null_safe: bool = False) -> DataFrame:
    """Join a table to one that is mostly far smaller: by broadcast if its measured bytes allow, else by a shuffle.

    `small` should be a stored table: it is read here. Null keys are equal if `null_safe`, and the keys then are the large table's.
    """
    size = small.agg(F.sum(_row_bytes(small)).alias("size")).first().size or 0
    on = keys
    if null_safe:
        own = {k: f"_{uuid.uuid4().hex}" for k in keys}
        small, on = small.withColumnsRenamed(own), [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()]
    joined = large.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)
    return joined.drop(*own.values()) if null_safe else joined


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: whatever else the table carries, its names can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

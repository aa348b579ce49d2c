"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..session import ship_code as ship_package

#: Arrow batches that go to Python workers stay under these, whatever the text lengths.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound their Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)


def materialise(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread, not a recomputation,
    and no block lives on one machine only. The driver's garbage goes with it.
    """
    spark = session(df)
    path = f"{shared_dir(spark)}/topicloom/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    _written.append((spark, path))
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: The driver's heap is collected when it has grown beyond this share of its limit.
HEAP_SHARE = 0.4


def release(spark: SparkSession) -> bool:
    """Whether the driver's JVM held more than ``HEAP_SHARE`` of the heap that it may have, and so gave back what nothing uses.

    Plans, task metrics and broadcasts of earlier jobs stay in it until a full
    collection, which it puts off while its limit allows; the pages then stay
    taken. Spark also deletes the shuffle files of a table only when its plan
    is collected.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() <= HEAP_SHARE * heap.maxMemory():
        return False
    gc.collect()  # Python's references to plans
    jvm.java.lang.System.gc()
    return True


_written: list[tuple[SparkSession, str]] = []


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read any more."""
    for df in written:
        _delete(session(df), df.written_at)
        _written.remove((session(df), df.written_at))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the cluster's own cleaning applies
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    _written.clear()


atexit.register(_drop_written)


def quoted(column: str) -> str:
    """A column's name as a reference, whatever characters it holds."""
    return "`" + column.replace("`", "``") + "`"


def fresh(stem: str, taken: list[str]) -> str:
    """A name that no column of ``taken`` has."""
    name, held = "_" + stem, {c.lower() for c in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for columns of any names."""
    names = df.columns

    def named(batches):
        import pyarrow as pa

        return run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def identity(id_col: str, text_col: str) -> Column:
    """The id, or a negative hash of the text where it is null."""
    return F.coalesce(F.col(id_col).cast("long"), -F.abs(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))) - 1)


def fraction(*columns):
    """A deterministic uniform in [0, 1) from the 64-bit hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def cpu_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)

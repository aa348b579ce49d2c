"""Sessions, and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import hashlib
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[tuple[str, str]] = set()
#: Spark's setting that removes an execution's shuffle files at its end.
CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of more rows are shuffled to a join, not broadcast.
MOST_ROWS = 500_000


def parts(spark: SparkSession, n: int, rows: int) -> int:
    """Partitions of some ``rows`` of ``n`` rows each, as many as Spark's own at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows, to be broadcast unless they are too many."""
    return F.broadcast(df) if rows <= MOST_ROWS else df


def build(app: str = "topicloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is the cluster's own setting."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="topicloom-shared-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: iterations neither recompute nor pile up plans. Deleted by ``forget``, or when the driver exits.

    What was shuffled for it goes from the executors' disks as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/topicloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANING, None)
    spark.conf.set(CLEANING, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)  # planned anew, with the setting
    finally:
        spark.conf.unset(CLEANING) if before is None else spark.conf.set(CLEANING, before)
    drop_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*written: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read any more."""
    for df in written:
        delete(df.sparkSession, df.written_at)
        _written.remove((df.sparkSession, df.written_at))


_written: list[tuple[SparkSession, str]] = []


def drop_later(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver exits."""
    _written.append((spark, path))


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session is gone: the cluster's own cleaning applies
            break
    _written.clear()


atexit.register(_drop_written)


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a session.

    The archive goes through Spark's own file service, so executors need
    neither a shared folder nor a PYTHONPATH.
    """
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # we run from an archive ourselves
        return
    files = sorted(root.rglob("*.py"))
    key = spark.sparkContext.applicationId, hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    if key in _shipped:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in files:
            z.write(p, str(p.relative_to(root.parent)))
    folder = Path(tempfile.mkdtemp(prefix="topicloom-code-"))
    atexit.register(shutil.rmtree, folder, True)
    (archive := folder / f"topicloom_{key[1]}.zip").write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(key)

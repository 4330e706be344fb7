"""Session helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from ..session import share_package

#: Rows and bytes in one Arrow batch sent to Python: bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 4096, 6 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and let them find this package."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset in local mode (tests) a temporary folder is made; on a
    cluster that is an error, as executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(spark.sparkContext, "_tidemark_shared", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext._tidemark_shared = root
            atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    return root.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; removed when the driver ends, on a store only if the session still runs then."""
    path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
    if is_local(path):
        os.makedirs(local(path), exist_ok=True)
    atexit.register(drop, path)
    return path


def is_local(path: str) -> bool:
    """Whether the shared folder is mounted (a plain or file: path)."""
    return urlparse(path).scheme in ("", "file")


def local(path: str) -> str:
    return urlparse(path).path


def table(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(path: str) -> None:
    """Remove what was written under a path and is no longer read by anything."""
    if is_local(path) and os.path.isfile(local(path)):
        os.remove(local(path))
    elif is_local(path):
        shutil.rmtree(local(path), ignore_errors=True)
    elif spark := SparkSession.getActiveSession():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark notice which shuffles are no longer referenced, so that their files go."""
    import gc

    for _ in range(2):  # the driver's Python tells of its last references with the next call
        gc.collect()
        spark._jvm.System.gc()


def partitions(df: DataFrame, least: int = 1) -> int:
    """Number of partitions for a shuffle of what df reads: it grows with the input."""
    return max(least, df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def put_file(path: str, data: bytes) -> None:
    """Write one file whole; a retried task replaces it with the same bytes."""
    if is_local(path):
        at = local(path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(tmp := f"{at}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(tmp, at)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as f:
        f.write(data)


def map_file(path: str):
    """The file's bytes, memory-mapped.

    Where the shared folder is no mounted one, a nameless copy of the task's own is
    mapped: it is gone with the mapping, and a task run again makes another.
    """
    import numpy as np

    if is_local(path):
        at = local(path)
        return np.memmap(at, dtype=np.uint8, mode="r").view(np.ndarray) if os.path.getsize(at) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f, tempfile.TemporaryFile() as copy:
        shutil.copyfileobj(f, copy, 4 << 20)
        size = copy.tell()
        copy.flush()
        return np.memmap(copy, dtype=np.uint8, mode="r").view(np.ndarray) if size else np.zeros(0, np.uint8)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores more that df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def schema(text: str):
    """A schema from "name type, ..."; unlike DDL it needs no session."""
    from pyspark.sql import types as T

    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    kind = lambda k: T.ArrayType(kinds[k[6:-1]]) if k.startswith("array<") else kinds[k]
    return T.StructType([T.StructField(n, kind(k)) for n, k in (x.split() for x in text.split(","))])


def mapped(df: DataFrame, run, out) -> DataFrame:
    """df.mapInArrow(run, out) whose workers give freed memory back when a task ends.

    Workers live on between tasks; without this one that is idle keeps the most it ever used.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, out)


def release() -> None:
    """Return freed memory of this process to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to return

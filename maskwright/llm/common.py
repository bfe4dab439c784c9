"""What several operators of this subpackage share: the shared folder and stable row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS, TEXTS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: The letters that "lower-case A-Z" changes; all other characters stay as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if driver and
    executors are one process (tests), and an error on a cluster, whose executors couldn't see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="maskwright-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: this cuts lineage, survives
    lost executors, and fixes rows that a second evaluation might order otherwise."""
    spark = df.sparkSession
    path = workspace(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile delete their shuffle files at their end (else these stay until the driver collects garbage)."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def texts_in_batches(df: DataFrame) -> DataFrame:
    """df, with at most TEXTS_A_BATCH rows in an Arrow batch from now on in its session: batches of texts stand in the JVM's memory
    outside its heap and in the Python worker at once. A smaller setting of the session's own stays."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(BATCH_ROWS, "10000")) <= TEXTS_A_BATCH:
        spark.conf.set(BATCH_ROWS, str(TEXTS_A_BATCH))
    return df


def removed(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What operators keep in a Python worker between tasks, and how to let go of it.
_KEPT: dict[str, Callable[[], object]] = {}


def keeps(owner: str, clear: Callable[[], object]) -> None:
    _KEPT[owner] = clear


def claim(owner: str) -> None:
    """Called where an operator starts in a worker: what the others keep there goes, so that memory doesn't add up over the stages of a job."""
    for name, clear in _KEPT.items():
        if name != owner:
            clear()


def let_go() -> None:
    """Called where an operator ends in a worker: gives freed memory back to the system. Workers live on between tasks, and an executor's memory
    is what its JVM and its workers hold together."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns of df: these, with as many underscores before them as it takes for df to have none of them."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size (for a table scan, the size of its files); where it has none, the bytes of `text`."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size


def parts_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """A number of partitions that grows with the input, so that each keeps its size."""
    return max(least, -(-input_bytes(df) // bytes_each))

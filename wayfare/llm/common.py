"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` splits the same way.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB: texts and index rows are long, and Python workers share an executor's memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864", "67108864b", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4MB")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of this machine only in local mode without one (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark, "_wayfare_shared_dir", None) or f"file://{tempfile.mkdtemp(prefix='wayfare-')}"
        spark._wayfare_shared_dir = at
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._wayfare_written = getattr(spark, "_wayfare_written", 0) + 1
    if spark._wayfare_written % 8 == 0:  # iterative operators write many tables; the driver keeps little of each
        give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns named by place: map functions don't take every name that a column may have."""
    return df.toDF(*[f"__{i}" for i in range(len(df.columns))])


def n_words(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, rf"{SPACE_CLASS}+"))).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at its end the worker, which Spark keeps for later tasks, gives free memory back."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return inner


def give_back(spark: SparkSession | None = None) -> None:
    """Return free memory of this process to the system, and on the driver that of its JVM: what earlier queries
    left there (plans, broadcasts, results) would otherwise stay until the heap is full."""
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
        trim_jvm(spark)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU library


def trim_jvm(spark: SparkSession) -> str | None:
    """Return what the driver JVM's malloc holds free (of compilers, class loaders, buffers) to the system; its answer, None without the command."""
    jvm = spark.sparkContext._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # through the public interface: the server's own class is not open to reflection
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(call.invoke(server, args))
    except Py4JError:
        return None

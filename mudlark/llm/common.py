"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One or more of the characters that part words: space, tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
#: What holds while a table is written: shuffle files go at the end, and whole texts go to Python in small batches.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}

#: What a Python worker keeps from one task of a run to the next, by the run's name.
KEPT: dict = {}


def release() -> None:
    """For the first body of a run: frees what this Python worker has kept of other runs, and gives unused memory back."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trim(spark: SparkSession) -> str:
    """Collects the driver's heap, and gives back what its JVM has freed outside of it; what the JVM says to that, nothing if it can't."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.java.lang.System.gc()
    of = jvm.java.lang.Class.forName
    types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for k, name in enumerate(types):
        kinds[k] = of(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # By the interface: the server's own class is closed to callers.
        return str(of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given))
    except Py4JJavaError:
        return ""


def settle(spark: SparkSession) -> None:
    """Collects the heaps of executors and driver, between steps that have little in common: G1 gives memory back after full collections only."""
    trim(spark)
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A folder of this machine is made only where the setting is unset and all runs on this machine, as in local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='mudlark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Makes this package importable by Python workers wherever they run; done once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_mudlark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = Path(tempfile.mkdtemp(prefix="mudlark-")) / "mudlark.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent).as_posix())
    context.addPyFile(str(packed))
    context._mudlark_shipped = True


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again, so lost executors can't undo it.

    Its shuffle files are of no more use then and go at once. ``rows`` go to Python at a time, where they are small.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writing = WRITING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {k: spark.conf.get(k) for k in writing}
    try:
        for k, v in writing.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what :func:`cut` wrote, once nothing reads it any more."""
    for df in frames:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, as a long; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    blank = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - blank(1) - blank(-1), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str, columns: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns.split()) if columns else df


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)

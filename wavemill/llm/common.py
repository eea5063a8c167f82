"""Helpers that the training-data operators share: tables, scratch tables, hashing, Arrow bounds."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that an Arrow batch holds at most; documents can be long, so batches stay small.
BATCH_ROWS = 512
#: Seconds between two reliefs of the driver, at least, and the share of the time that they may take.
RELIEF_S, RELIEF_SHARE = 10, 0.05
_made: list[tuple[SparkSession, str]] = []
_relief_due = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and all runs in this process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def relieve(spark: SparkSession) -> bool:
    """Has the driver's JVM collect its garbage and give the memory that it freed back to the system; False if that isn't due yet.

    A plan leaves garbage in the heap and, by its compilers, codecs and threads, freed memory that the C library keeps.
    Over hundreds of small queries that adds up, whatever the size of the data. A JVM that can't trim the latter does the rest.
    """
    began = time.monotonic()
    if began < _relief_due[0]:
        return False
    context = spark.sparkContext
    jvm = context._jvm
    jvm.System.gc()
    try:  # by reflection: the server's class is hidden, its interface isn't
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = context._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # another JVM or C library
        pass
    ended = time.monotonic()
    _relief_due[0] = ended + max(RELIEF_S, (ended - began) / RELIEF_SHARE)
    return True


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared scratch folder and returns the written table: lineage ends there, and a lost executor costs no recomputation. The driver is relieved now and then."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release() -> None:
    """Deletes every scratch table of this process; run it once no DataFrame over them is needed."""
    while _made:
        spark, path = _made.pop()
        try:
            drop_scratch(spark, path)
        except Exception:  # the session may be over; the folder belongs to the cluster then
            return


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches small, as one row can be a text of megabytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def crc_of(col: str) -> Column:
    return F.crc32(F.col(col).cast("string"))


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], rows: int, most: int = 100_000, how: str = "inner") -> DataFrame:
    """Broadcasts right if its counted rows allow it; else an ordinary join, which adaptive execution splits where it is skewed."""
    return left.join(F.broadcast(right) if rows <= most else right, on, how)


def fields(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)

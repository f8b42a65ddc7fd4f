"""Helpers that the operators share: tables, the shared folder, cut points."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java class of the white space that separates words, as contracts give it.
SPACE = r"[\x20\x09-\x0D]"
#: A null id sorts and groups as this value inside operators.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder is made and set if all runs in one process on one machine,
    as in tests; on a cluster nothing but that setting will do.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(folder)
    return folder


#: Of a driver's heap, the share beyond which its garbage is collected between
#: two steps.
FULL = 0.4
#: Plans hold tables as literals; as text, each of their many copies is cut here.
PLAN, PLAN_CHARS = "spark.sql.maxPlanStringLength", "20000"


#: Percent of a heap that may stay free when such a collection ends; a JVM's
#: default lets it keep 70.
FREE = "MaxHeapFreeRatio", "45"


def _managed(spark: SparkSession, bean: str, operation: str, *texts: str) -> object:
    """What an operation of one of the driver's JVM's own beans gives; a JVM
    without it does without, and gives none."""
    with suppress(Exception):
        jvm, gateway = spark._jvm, spark.sparkContext._gateway

        def array(kind: object, *values: object) -> object:
            out = gateway.new_array(kind, len(values))
            for i, v in enumerate(values):
                out[i] = v
            return out

        # The server's class is not open to callers; its interface is.
        named, text = jvm.java.lang.Class.forName, "java.lang.String"
        types = array(jvm.java.lang.Class, *[named(t) for t in ("javax.management.ObjectName", text, "[Ljava.lang.Object;", "[Ljava.lang.String;")])
        invoke = named("javax.management.MBeanServer").getMethod("invoke", types)
        name = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
        given = array(jvm.java.lang.Object, *texts), array(jvm.java.lang.String, *[text] * len(texts))
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, name, operation, *given))


def _shrunk(spark: SparkSession, collect: Callable[[], None]) -> None:
    """Collects garbage with FREE in force, and sets back what was."""
    was = _managed(spark, "HotSpotDiagnostic", "getVMOption", FREE[0])
    if was is not None:
        _managed(spark, "HotSpotDiagnostic", "setVMOption", *FREE)
    try:
        collect()
    finally:
        if was is not None:
            _managed(spark, "HotSpotDiagnostic", "setVMOption", FREE[0], was.get("value"))


def give_back(spark: SparkSession) -> bool:
    """Collects a driver's garbage if much of its heap is taken: a step leaves
    plans and broadcasts by the hundred MB, little of it alive, and the heap
    would grow to its bound on top of what else the process holds.  Of that,
    what compilers and threads have freed is held by the C library, by the
    hundred MB too, until it is asked for.  Where tasks run in the same process,
    the heap is theirs and is left alone."""
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return False
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    full = runtime.totalMemory() > FULL * runtime.maxMemory()
    if full:
        _shrunk(spark, runtime.gc)
    _managed(spark, "DiagnosticCommand", "systemTrimNativeHeap")
    return full


#: Shuffle files of a query go when it ends, not when the driver happens to
#: collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    held = {CLEAN: "true", PLAN: PLAN_CHARS}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, folder: str | None = None, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage: what later stages read survives the loss of any
    executor, and is not computed again for each of several readers.  The
    shuffles that made it are of no more use and go at once.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with clean_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run of an operator, which go together once it has written
    what its result reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove(self.folder)

    def written(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        return written(df, name, self.folder, codec)

    def drop(self, *tables: DataFrame) -> None:
        """Tables of this run whose last reader has run."""
        for t in tables:
            for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
                self.remove(folder)

    def remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key(name: str) -> Column:
    """An id column as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def unkey(column: Column) -> Column:
    """The id back from ``key``: null where it was null."""
    return F.when(column != F.lit(NULL_ID), column)


def words(text: Column) -> Column:
    """The words of a text: maximal runs without white space; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " ", -1), "")

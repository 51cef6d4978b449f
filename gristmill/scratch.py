"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from typing import ClassVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where it may be unset, one under the temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/gristmill"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _diagnose(sc: SparkContext, command: str) -> str:
    """What a diagnostic command of the driver's JVM answers.  Called by reflection, as the class of its server is not open to Python."""
    jvm = sc._jvm
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    given = sc._gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), command
    return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


class Scratch:
    """Intermediate tables of one call.  A written table cuts the lineage: a lost executor costs the tasks it ran, never the steps before.

    Operators drop tables that their result does not read; what it reads stays until
    ``sweep``, at the latest that at the end of the application.
    """

    _open: ClassVar[dict[str, SparkSession]] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if not Scratch._open:
            atexit.register(Scratch.sweep)
        Scratch._open[self.root] = spark

    @staticmethod
    def roots() -> set[str]:
        return set(Scratch._open)

    @staticmethod
    def sweep(but: set[str] = frozenset()) -> None:
        """Deletes the tables of all calls, but for some; their results can't be read any more."""
        for root in Scratch.roots() - but:
            with contextlib.suppress(Exception):  # the session may have ended
                _delete(Scratch._open.pop(root), root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Lets go of the shuffle files of finished jobs, which else stay until the driver happens to collect its garbage.

        What the driver's JVM has freed outside its heap, above all after compiling, goes back to the system too.
        """
        sc = self.spark.sparkContext
        sc._jvm.System.gc()
        with contextlib.suppress(Exception):  # not every JVM has this command
            _diagnose(sc, "systemTrimNativeHeap")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))

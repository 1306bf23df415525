"""Sessions, input tables, and the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
import weakref
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))

_shipped: set[str] = set()
_own_shared: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: Bytes of a batch that goes to a Python worker, and of a row group of an intermediate table.
BATCH_BYTES, ROW_GROUP = 8 * 2**20, 32 * 2**20


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stowage")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def small_batches(spark: SparkSession) -> None:
    """Bound what is on its way between a task and its Python worker by bytes, unless the session has a lower bound.

    The bound by rows alone lets long texts through, some hundred megabytes at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application.

    Python workers import the functions of the package by name, so they need its
    files even where it is not installed on the machines of the cluster.
    """
    sc = spark.sparkContext
    small_batches(spark)
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="stowage-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "stowage.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, names in os.walk(PACKAGE):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("stowage", os.path.relpath(full, PACKAGE)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder of its
    own; on a cluster a machine-local folder would lose files, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_shared:
        folder = tempfile.mkdtemp(prefix="stowage-shared-")
        atexit.register(shutil.rmtree, folder, True)
        _own_shared[sc.applicationId] = folder
    return _own_shared[sc.applicationId]


def _forget(spark: SparkSession, app: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written.pop(app, []):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM may be gone already; then its folder is the cluster's to clear
        pass


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the driver's Python ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/stowage-{name}-{uuid.uuid4().hex}"
    if app not in _written:
        _written[app] = []
        atexit.register(_forget, spark, app)
    _written[app].append(path)
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _tables[made] = path
    return made


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that ``materialize`` gave back and that no later plan reads."""
    path = _tables.pop(df)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written[spark.sparkContext.applicationId].remove(path)


def trim(spark: SparkSession) -> str | None:
    """Give the free native memory of the driver's JVM back to the system; what the JVM says of it, or None if it can't.

    Compilers, codecs and the network leave some hundred megabytes in the allocator's arenas, which keep them otherwise.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    try:
        # By the interface, as the class of the server is not open to the gateway.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # other JVMs and systems don't have the command
        return None


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, and the driver's JVM the native memory that is free.

    Its cleaner waits for the driver's collector, and what a job held last only goes
    with the second collection after it.
    """
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
    trim(spark)


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

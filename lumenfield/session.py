"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on; cluster sizing is left alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # HotSpot never compiles methods above 8000 bytes of bytecode; long formulas are better split
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    ship(spark)
    sc = spark.sparkContext
    if sc.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))
    return spark


#: bytes of the input files for each partition of a shuffle
PARTITION_BYTES = 4 << 20
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """Let the number of shuffle partitions follow the size of the tables, so that what one task holds does not grow.

    Spark merges small partitions again after each shuffle, up to 8 MB unless the session names a size: packed rows take
    some sixty times as much in a sort or a hash table.
    """
    if spark.conf.get(ADVISORY, None) in (None, "64MB", "64m", "67108864b"):
        spark.conf.set(ADVISORY, "8m")
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    spark.conf.set(INITIAL, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))))


def shuffle_width(spark: SparkSession) -> int:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, int(spark.conf.get(INITIAL, None) or n))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lumenfield-"), "lumenfield.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def local_session(app: str = "lumenfield", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder the cluster names; survives executor loss.

    A machine-local folder is chosen only where ``spark.checkpoint.dir`` is unset and the
    master is local, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="lumenfield-"))
        folder = _LOCAL[0]
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh subfolder of the shared folder for written tables and stream checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

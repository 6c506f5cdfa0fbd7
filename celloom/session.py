"""Session helpers: shipping the package, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that a Python worker gets at once, so that its memory does not follow the length of the texts.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Rows up to which a narrow table (a few numbers a row) is broadcast, and bytes where the width of a row is told; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: Rows of a file of a stored table, where it is known how many rows there can be.
FILE_ROWS = 50_000


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("celloom")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, and bounds the batches that Python workers get.

    Functions that run in Python workers are pickled by reference, so the workers must be able to import the package.
    """
    for name, value in ARROW.items():
        spark.conf.set(name, value)
    sc = spark.sparkContext
    if getattr(sc, "_celloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="celloom-"), "celloom-package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(target)
    sc._celloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or on one machine (tests) a folder of our own where it
    is unset. On a cluster without the setting this raises, as executors could not read each other's files."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_celloom_shared", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = sc._celloom_shared = f"file://{tempfile.mkdtemp(prefix='celloom-shared-')}"
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone when the interpreter ends; the folder is then left to its owner
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/celloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """df, which has about so many rows at most, in no more partitions than FILE_ROWS asks for; all rows stay."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


#: Rows that a task should make of few, and most such tasks for each core.
SPREAD_ROWS, SPREAD_TASKS = 500_000, 64


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, of which so many rows will be made, dealt (by columns) to so many tasks as that asks for: a small file is read by one task, and
    Spark joins small shuffle partitions, whatever their rows become."""
    most = SPREAD_TASKS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(-(-rows // SPREAD_ROWS), most)), *by)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: this cuts the lineage, survives lost executors and gives real sizes.

    rows is about the most that df can have, where that is known; a small table then gets few files, however many the shuffle
    partitions are. In a local or mounted folder Hadoop starts three processes for a file (chmod of its folder, itself and its
    checksums), and one just started counts its executor's memory once more until it has loaded its program.
    """
    spark = df.sparkSession
    df = df if rows is None else in_few(df, rows)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, width: int | None = None) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most so many rows, else df as it is. Give it stored or tiny tables.

    width is the bytes of a row in memory, if they are more than a few numbers take.
    """
    rows = rows if width is None else min(rows, BROADCAST_BYTES // width)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Session helpers: a local builder, the shared scratch folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "gleaner") -> SparkSession:
    """A session for tests and benches; on a cluster the job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of a folder, on whatever filesystem holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def spread(scan: DataFrame) -> DataFrame:
    """Give a table of very few files one partition per core.

    Parquet cannot split a row group, so a small table in one file would feed its costly
    text work to one core. A table of many files or many splits passes through without a
    shuffle. Use on scans only: counting partitions plans the frame.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < 4 * cores and 2 * len(scan.inputFiles()) <= cores:
        return scan.repartition(cores)
    return scan


def small_side(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Broadcast ``df`` if it is seen to have at most ``max_rows`` rows, else leave it as it is.

    The rows come and go as Arrow: a frame of Python rows is read through Python on the executors, by workers of their own kind
    that stay there beside those of the search.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later jobs reuse the files after the loss of any executor, and Spark plans their joins
    with the true size of the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that was started elsewhere."""
    if spark.conf.get("gleaner.shipped", None) is None:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="gleaner-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as bundle:
            for module in sorted(root.rglob("*.py")):
                bundle.write(module, module.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        spark.conf.set("gleaner.shipped", "true")


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python a thousand, and 4 MB, at a time, unless the session asks for other numbers than Spark's own.

    Rows here are whole texts and wide vectors: batches of ten thousand take tens of MB each in the executor, outside its heap, and again in its workers.
    """
    for name, own, small in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "4194304b")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) == own:
            spark.conf.set(name, small)

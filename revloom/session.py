"""Session set-up and tables kept between the stages of one query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from revloom.errors import InvalidInput


def build_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings all operators expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("revloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a local session, whose tasks run in this
    process, may leave it unset; it gets a temporary folder. Elsewhere a folder of one machine would
    lose data, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif is_local(spark.sparkContext.master):
            found = "file://" + tempfile.mkdtemp(prefix="revloom-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise InvalidInput("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/")


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/revloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove all tables ``materialize`` wrote in this application; results that read them must be done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor later costs only the tasks it held, and a stage that
    several branches read is computed once. Parquet keeps column pruning and is smaller than the
    row format of ``checkpoint()``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

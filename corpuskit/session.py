"""Session settings shared by tests, bench and the driver entry."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  AQE splits skewed join partitions, turns a
# shuffled join into a broadcast one when the measured side is small, and
# coalesces small shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A worker holds whole batches: long texts and packed blocks make 10,000 rows of them too large.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = 8, app: str = "corpuskit", memory: str = "8g",
                  shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is
    used instead; on a cluster without the setting this refuses to guess.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="corpuskit-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder, read again: computed once, whatever is lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by their bytes, in sessions that were made without ``SETTINGS``, too."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, SETTINGS[name])


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Not needed where it is installed on the workers or sent with ``--py-files``.
    """
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_corpuskit_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="corpuskit-zip-"))
    archive = shutil.make_archive(
        str(folder / "corpuskit"), "zip", root_dir=package.parent, base_dir=package.name)
    context.addPyFile(archive)
    context._corpuskit_shipped = True

"""A session with the settings that results depend on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What results depend on (the time zone, the JDK's code pages), and what lets filters reach our data sources.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Rows and bytes of an Arrow batch at most: texts and chunks can be long, and a batch is held by the JVM and by Python at once, in several forms.
BATCH_ROWS, BATCH_BYTES = 1500, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session gives Python such batches; a narrower bound of its own stays."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def build(master: str | None = None, conf: dict[str, str] | None = None, name: str = "sedira") -> SparkSession:
    """`master` is for local use; on a cluster spark-submit says it."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | (conf or {})).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as Spark names it; without one, a folder of this machine if everything runs on it."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="sedira-")
    atexit.register(shutil.rmtree, where, True)
    return where


def shared_folder(spark: SparkSession) -> str:
    """The same as a mounted folder, for files that readers of images open."""
    where = scratch_folder(spark)
    if "://" in where and not where.startswith("file:///"):
        raise RuntimeError(f"{where} is not a mounted folder, which readers of images need")
    return where.removeprefix("file://").removeprefix("file:")


def written(df: DataFrame) -> DataFrame:
    """The rows, written once: what is computed over and over from then on starts from files."""
    path = f"{scratch_folder(df.sparkSession)}/sedira-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

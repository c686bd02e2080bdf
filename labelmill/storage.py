"""Where intermediate tables go, so that a lost executor never costs the whole lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # from Spark 4.1 on; older sessions ignore it

_own: dict[str, str] = {}  # folders made for local sessions, by application


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local-mode session without that setting, as in tests, gets one of its own, which goes when Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = tempfile.mkdtemp(prefix="labelmill-")
        atexit.register(shutil.rmtree, _own[application], ignore_errors=True)
    return _own[application]


def work_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds all tables of this application."""
    return f"{shared_dir(spark)}/labelmill-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, keeps size statistics.

    ``group_rows``: rows in a row group at most, for rows so large that a reader should not unpack many of them at once.
    The shuffle files of the job go as soon as it has ended, not when the driver happens to collect its garbage: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it when its results have been written."""
    _delete(spark, work_dir(spark))


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` has returned; no plan that has still to run may read it."""
    spark = table.sparkSession
    for folder in {path.rpartition("/")[0] for path in table.inputFiles()}:
        if f"/labelmill-{spark.sparkContext.applicationId}/" in folder:
            _delete(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def deal_out(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """Hash the rows of a small table over ``partitions`` before costly per-row work; 0 leaves the table as it is read."""
    return df.repartition(partitions, key) if partitions > 0 else df

"""Session helpers: one place for Spark settings and for the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "postlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is made only for local masters where the setting is absent (tests);
    on a cluster an unset value is an error, because a machine-local folder would be lost
    with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    in_use = spark.sparkContext.getCheckpointDir()
    if in_use:
        return in_use
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postlake-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


_written: dict[tuple[str, str], str] = {}


def written_once(spark: SparkSession, name: str, build: Callable[[], DataFrame], by: list[str]) -> DataFrame:
    """Write a table into the shared folder the first time it is asked for and read it afterwards.

    The table is partitioned by ``by``. The rows are rebalanced by it before the write, so a value
    that holds a third of the table is split over several files instead of landing in one task,
    and a rare value does not leave one small file per task. Without ``by`` each task writes its rows as they are.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _written:
        path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
        rows = build()
        (rows.hint("rebalance", *by) if by else rows).write.mode("overwrite").partitionBy(*by).parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result into the shared folder and read it back.

    Like a reliable checkpoint it survives the loss of executors and ends the plan's growth; as a
    table it also has a known size, so Spark broadcasts it where it is small and shuffles it where
    it is not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

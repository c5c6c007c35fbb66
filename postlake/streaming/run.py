"""Running a stream to the end of its input into a table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from postlake.session import shared_dir


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything that is available and return the emitted rows with their ``batch`` number.

    Every micro-batch overwrites its own folder, so a replayed batch changes nothing.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/streams/{name}-{uuid.uuid4().hex[:8]}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")

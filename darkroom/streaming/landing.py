"""Running a stream over all that has arrived so far."""

from __future__ import annotations

from pyspark.sql import DataFrame

from darkroom.session import scratch_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(stream: DataFrame) -> DataFrame:
    """Run ``stream`` until its sources are read to their end and return the rows it wrote.

    Offsets, state and rows lie in the shared folder, so the run survives lost executors.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    landed = scratch_dir(spark, "landed")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", landed)
        .option("checkpointLocation", scratch_dir(spark, "offsets")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(landed)

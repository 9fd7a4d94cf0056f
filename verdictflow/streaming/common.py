"""Starting streams, and marking the table versions they write."""

import uuid

from pyspark.sql import functions as F

from verdictflow.sources.files import exists


def start(stream, handle, checkpoint, trigger, mode="append"):
    """Run `handle(batch, batch_id)` per micro-batch; default trigger: all there is, then stop."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_id(spark, checkpoint) -> str:
    """A name of the stream, the same after every restart from its checkpoint.

    It is noted beside the checkpoint when the stream first starts; with the batch id it
    marks what a batch has written.
    """
    note = f"{checkpoint}/stream_id"
    if not exists(spark, f"{note}/_SUCCESS"):
        name = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("id"))
        name.write.mode("overwrite").parquet(note)
    return spark.read.parquet(note).first()["id"]

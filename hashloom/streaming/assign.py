"""An extension: vectors that arrive as a stream join a built index without a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import buckets, encode


def assigned(stream: DataFrame, layers: list, thr: list[float]) -> DataFrame:
    """The stream with logits and bucket code. Stateless: thresholds are those of the index, so nothing is held between batches."""
    from pyspark.sql import functions as F

    from ..functions.vectors import literal, packed_bits

    encoded = encode.encode(stream, layers)
    return encoded.withColumn("code", packed_bits(F.col("logits"), literal(thr)))


def append_to_index(stream: DataFrame, layers: list, thr: list[float], path: str, checkpoint: str):
    """Write each batch's coded rows to the index's table in `path`, the folder that Index.write returned, from where Index.load reads them; a batch that is replayed overwrites its own folder, so it counts once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/coded_increment/batch={batch_id}")

    return assigned(stream, layers, thr).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def balance_of(path: str, spark, bits: int) -> DataFrame:
    """Balance of the buckets of the rows that came by stream: when it has drifted, the index is due for a rebuild."""
    return buckets.balance(buckets.histogram(spark.read.parquet(f"{path}/coded_increment")), bits)

"""Process input in pieces with Structured Streaming.

A file source with ``maxBytesPerTrigger`` hands the input over in pieces of
whole files of about so many bytes, so the number of pieces follows from the
input's size and a piece from what the cluster takes at once; ``foreachBatch``
runs ordinary batch code on each piece and appends
its result; ``trigger(availableNow=True)`` drains what exists and stops.
Progress lives in the checkpoint location, so a restarted run resumes after
the last committed piece instead of starting over."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kiln.operators.events import first_contact
from kiln.session import scratch_path


#: Bytes of files in a piece, unless the caller says otherwise.
CHUNK_BYTES = 8 << 30


def file_stream(spark: SparkSession, source: str, schema: T.StructType, fmt: str, chunk_bytes: int) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema).option("maxBytesPerTrigger", chunk_bytes)
            .load(source))


def process_in_chunks(spark: SparkSession, source: str, schema: T.StructType, fn: Callable[[DataFrame, int], DataFrame],
                      sink: str, fmt: str = "parquet", chunk_bytes: int = CHUNK_BYTES,
                      checkpoint: str | None = None) -> DataFrame:
    """Run ``fn(chunk, chunk_id)`` on each piece of ``source`` and append the
    results to ``sink``; returns the sink as a DataFrame."""
    checkpoint = checkpoint or scratch_path(spark, "chunk-ckpt")

    def each(batch: DataFrame, batch_id: int):
        out = fn(batch, batch_id)
        if out is not None:
            out.write.mode("append").parquet(sink)

    q = (file_stream(spark, source, schema, fmt, chunk_bytes).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


def score_stream(spark: SparkSession, source: str, schema: T.StructType, prepare: Callable[[DataFrame], DataFrame],
                 model, sink: str, fmt: str = "parquet", checkpoint: str | None = None,
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score arriving records: file stream -> preparation with constants
    fitted beforehand (no aggregation on the stream) -> model -> sink."""
    checkpoint = checkpoint or scratch_path(spark, "score-ckpt")
    scored = model.transform(prepare(file_stream(spark, source, schema, fmt, chunk_bytes)))
    q = (scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


def first_contact_stream(spark: SparkSession, source: str, schema: T.StructType, pair: Sequence[str], ts: str, tiebreak: str,
                         sink: str, fmt: str = "parquet", checkpoint: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """First connection of each pair on a stream of files, whatever their order.

    The state store keeps one row for each pair, the earliest so far, merged
    within a piece before it is shuffled. A piece writes the pairs that it met
    (update mode) under its number, over what an interrupted attempt at the
    same piece may have left, and the earliest of a pair's written rows is its
    first contact: after any number of pieces and restarts from the same
    checkpoint the result is that of the batch operator over all files."""
    checkpoint = checkpoint or scratch_path(spark, "contact-ckpt")
    stream = file_stream(spark, source, schema, fmt, chunk_bytes)

    def each(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{sink}/piece={batch_id}")

    q = (first_contact(stream, pair, ts, tiebreak).writeStream.outputMode("update").foreachBatch(each)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return first_contact(spark.read.parquet(sink).drop("piece"), pair, ts, tiebreak)

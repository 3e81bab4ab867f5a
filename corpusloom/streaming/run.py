"""Run a stream over what is there now and read its result as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import shared_dir


def scratch(spark: SparkSession) -> str:
    """A new folder in the session's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, path: str, per_trigger: int | None = 1) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream with the table's schema: so many files at a time, or all that are there in one micro-batch (None)."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file, a plain path must be a folder
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(pattern)


def append_result(stream: DataFrame) -> DataFrame:
    """Append-mode result of all available data, in a Parquet table with exactly-once files."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def update_result(stream: DataFrame, *keys: str, mode: str = "update") -> DataFrame:
    """Update-mode result: every batch is a partition of its own, so a retried batch replaces itself; the last row of a key wins."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{at}/out").parquet(f"{at}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, *[f"x.{c}" for c in rest])


def split_result(stream: DataFrame, parts: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Each batch is cut into several tables, like good rows and a quarantine."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)
    schemas = {k: f(spark.createDataFrame([], stream.schema)).schema for k, f in parts.items()}

    def put(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        for name, f in parts.items():
            f(kept).write.mode("overwrite").parquet(f"{at}/{name}/batch={n}")
        kept.unpersist()

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return {k: spark.read.schema(s).option("basePath", f"{at}/{k}").parquet(f"{at}/{k}") for k, s in schemas.items()}


def buffered(messages: DataFrame, answer: Callable[[list[str]], list[str]], text: str, queues: list[str], order: list[str], most: int = 32) -> DataFrame:
    """messages of a micro-batch with a reply; the model is called with up to `most` messages of a queue at once.

    The trigger is the time limit: what a queue holds at the end of a micro-batch is sent, however little.  A call that fails gives null replies.
    """
    names = messages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def sent() -> pa.RecordBatch:
            try:
                replies = answer([r[text] for r in held])
            except Exception:
                replies = [None] * len(held)
            columns = [pa.array([r[c] for r in held], kinds[c]) for c in names]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array(replies, pa.string())], names=[*names, "reply"])

        kinds: dict[str, pa.DataType] = {}
        for batch in batches:
            kinds = {c: batch[c].type for c in names}
            for row in batch.to_pylist():
                if held and (len(held) == most or any(row[q] != held[0][q] for q in queues)):
                    yield sent()
                held.append(row)
        if held:
            yield sent()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
    return messages.repartition(*queues).sortWithinPartitions(*queues, *order).mapInArrow(run, f"{schema}, reply string")


def due_again(dead: DataFrame, delay: str, at: str = "ts") -> DataFrame:
    """Failed messages with the time at which they are due: their event time and `delay` seconds."""
    return dead.withColumn("due", F.timestamp_seconds(F.unix_micros(at) / 1e6 + F.col(delay)))

"""Running a stream to files, and sinks that survive replays.

Every sink writes under a folder; a batch goes to its own `batch_id=` directory and overwrites it, so a
replayed batch leaves one copy of its rows.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.session import checkpoint_folder


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, folder: str, mode: str = "append", each=None):
    """Process everything available and stop; returns the ended query. `each(batch, folder, batch_id)` handles the
    batches itself; without it the rows are appended to parquet by the file sink."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    if each is None:
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.foreachBatch(lambda batch, batch_id: each(batch, folder, batch_id)).start()
    query.awaitTermination()
    return query


def read_rows(spark: SparkSession, folder: str, schema, part: str = "rows") -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{part}").select(*schema.names)


def idempotent(batch: DataFrame, folder: str, batch_id: int, part: str = "rows") -> None:
    """One directory per batch, overwritten on replay."""
    batch.write.mode("overwrite").parquet(f"{folder}/{part}/batch_id={batch_id}")


def upsert_latest(keys, order: str):
    """A batch handler that stores the newest row per key of its batch; `read_latest` merges the batches."""
    def each(batch: DataFrame, folder: str, batch_id: int) -> None:
        from bourse.operators.outcomes import latest_per_key
        idempotent(latest_per_key(batch, list(keys), [order]), folder, batch_id)
    return each


def read_latest(spark: SparkSession, folder: str, schema, keys, order: str) -> DataFrame:
    """The newest row per key over all batches; of equal `order` that of the later batch."""
    rows = spark.read.schema(f"{schema.simpleString()[7:-1].replace(':', ' ')}, batch_id bigint").parquet(f"{folder}/rows")
    best = F.max_by(F.struct(*schema.names), F.struct(order, "batch_id")).alias("_r")
    return rows.groupBy(*keys).agg(best).select("_r.*")


def compact_latest(spark: SparkSession, folder: str, schema, keys, order: str, version: int) -> str:
    """The merged rows written to a folder of their own version; readers of older versions are not disturbed."""
    path = f"{folder}/version={version}"
    read_latest(spark, folder, schema, keys, order).write.mode("overwrite").parquet(path)
    return path


def slices_of(rows: DataFrame, number, slices: int, folder: str, files: int = 1) -> str:
    """The table as a source of `slices` batches: slice after slice by `number` (0 on), `files` files each, in order of time."""
    for k in range(slices):
        rows.where(number == k).repartition(files).write.parquet(f"{folder}/slice={k}")
    return f"{folder}/*"


def with_previous(part: str, keys, value: str, order: str, spark: SparkSession):
    """For batch handlers: the newest `value` per key that earlier batches left in `part`, as previous_<value>.

    Only directories of earlier batches count, so a replayed batch sees what it saw the first time.
    """
    def joined(batch: DataFrame, folder: str, batch_id: int) -> DataFrame:
        kind = batch.schema[value].dataType.simpleString()
        shape = ", ".join(f"{k} {batch.schema[k].dataType.simpleString()}" for k in [*keys, order])
        if batch_id == 0:
            return batch.withColumn(f"previous_{value}", F.lit(None).cast(kind))
        kept = spark.read.schema(f"{shape}, {value} {kind}, batch_id long").parquet(f"{folder}/{part}").where(F.col("batch_id") < batch_id)
        newest = kept.groupBy(*keys).agg(F.max_by(value, order).alias(f"previous_{value}"))
        return batch.join(newest, list(keys), "left")

    return joined


def split_late(event_time: str, delay_seconds: int):
    """Rows older than the newest event of earlier batches minus the delay go to a side table, none are lost."""
    def each(batch: DataFrame, folder: str, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("newest timestamp, batch_id long").parquet(f"{folder}/marks") if batch_id else None
        newest = marks.where(F.col("batch_id") < batch_id).agg(F.max("newest")).scalar() if marks is not None else F.lit(None).cast("timestamp")
        late = F.coalesce(F.col(event_time) < newest - F.make_dt_interval(secs=F.lit(delay_seconds)), F.lit(False))
        tagged = batch.withColumn("is_late", late).persist()
        idempotent(tagged.where("NOT is_late").drop("is_late"), folder, batch_id)
        idempotent(tagged.where("is_late").drop("is_late"), folder, batch_id, "late")
        idempotent(tagged.agg(F.max(event_time).alias("newest")), folder, batch_id, "marks")
        tagged.unpersist()

    return each

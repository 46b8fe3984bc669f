"""Append-only attempt logs: resume, exactly-once keys, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import after_accepted, not_contiguous, require


def resumable(log: DataFrame, accepted: Column, key: str = "case_id", index: str = "attempt") -> DataFrame:
    """Rows of a log up to each key's accepted attempt, that one included; what follows it is foreign."""
    first = log.where(accepted).groupBy(key).agg(F.min(index).alias("__done"))
    return log.join(first, key, "left").where(F.col("__done").isNull() | (F.col(index) <= F.col("__done"))).drop("__done")


def validate(log: DataFrame, accepted: Column, key: str = "case_id", index: str = "attempt") -> None:
    """Raise unless attempts number 1 to k and nothing follows an accepted one."""
    require(not_contiguous(log, key, index), "attempts are not contiguous")
    require(after_accepted(log, key, index, accepted), "rows after an accepted attempt")


def pending(cases: DataFrame, log: DataFrame, accepted: Column, most: int, key: str = "case_id", index: str = "attempt") -> DataFrame:
    """``key, next_attempt`` of cases that are neither accepted nor out of attempts."""
    state = log.groupBy(key).agg(F.max(index).alias("last"), F.bool_or(accepted).alias("done"))
    left = cases.select(key).distinct().join(state, key, "left").where(~F.coalesce("done", F.lit(False)) & (F.coalesce("last", F.lit(0)) < most))
    return left.select(key, (F.coalesce("last", F.lit(0)) + 1).alias("next_attempt"))


def deduplicated_log(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: tuple[str, ...] = ("case_id", "attempt")) -> DataFrame:
    """Stream new files of a log into a table with one row a key, then read the table.

    The checkpoint remembers files and keys: a run that is started again goes on where it stopped.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source).dropDuplicates(list(keys))
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(sink)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], measures: list[Column], late: str | None = None) -> DataFrame:
    """Counts by event-time window, for batches and streams alike; ``late``: how long a stream waits for late rows."""
    d = events.withWatermark(time, late) if late else events
    return d.groupBy(F.window(time, width), *by).agg(*measures)


def _batches(spark: SparkSession, sink: str, before: int | None = None) -> list[str]:
    """The folders of finished batches of a log, of those before a number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    numbers = sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))
    done = lambda n: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/batch-{n}/_SUCCESS"))
    return [f"{sink}/batch-{n}" for n in numbers if (before is None or n < before) and done(n)]


def resumed_log(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, accepted: Column, own: Column, key: str = "case_id", index: str = "attempt", files: int = 2, watch: Callable[[int], None] | None = None) -> DataFrame:
    """Stream new files of a log into a folder, a batch at a time, and read what it holds: one row for each key and index, up to the accepted one.

    The stream keeps no state. A batch writes its own folder, named by its number, whole or not at all for who reads it; a batch that was killed is
    made again over what it left. Its rows are compared with the keys of earlier batches in the folder: repeats go, and of equal keys within a batch the
    least row stays. Rows that are not ``own`` (another configuration), or behind the accepted attempt of their key, are written to ``sink-rejected`` with a ``reason``.
    What is accepted only later hides rows behind it when the log is read. ``watch`` is called with the number of each batch that was written.
    """

    def take(batch: DataFrame, n: int) -> None:
        session, known = batch.sparkSession, _batches(spark, sink, n)
        mine = batch.where(F.coalesce(own, F.lit(False)))
        once = mine.groupBy(key, index).agg(F.min(F.struct(*batch.columns)).alias("row")).select("row.*")
        earlier = session.read.schema(schema).parquet(*known) if known else batch.limit(0)
        fresh = once.join(earlier.select(key, index), [key, index], "left_anti")
        done = earlier.where(accepted).select(key, index).union(fresh.where(accepted).select(key, index)).groupBy(key).agg(F.min(index).alias("__done"))
        judged = fresh.join(done, key, "left").withColumn("__late", F.coalesce(F.col(index) > F.col("__done"), F.lit(False))).drop("__done")
        late = judged.where("__late").drop("__late").withColumn("reason", F.lit("after_accepted"))
        foreign = batch.where(~F.coalesce(own, F.lit(False))).withColumn("reason", F.lit("foreign"))
        late.unionByName(foreign).write.mode("overwrite").parquet(f"{sink}-rejected/batch-{n}")
        judged.where("not __late").drop("__late").write.mode("overwrite").parquet(f"{sink}/batch-{n}")
        if watch is not None:
            watch(n)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    run = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    held = _batches(spark, sink)
    return resumable(spark.read.schema(schema).parquet(*held), accepted, key, index) if held else spark.createDataFrame([], schema)

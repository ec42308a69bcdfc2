"""Structured Streaming forms of the counters. Event time is a choice of this engine: late rows count until the watermark passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.traffic import leaderboard


def daily_counts(events: DataFrame, ts: str = "ts", key: Column | None = None, hours: int = 9, late: str = "2 days") -> DataFrame:
    """Running counts of each local day (and key); a day's state goes when the watermark has passed it."""
    local = events.withColumn("local_ts", (F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")).cast("timestamp")).withWatermark("local_ts", late)
    day = F.window("local_ts", "1 day")
    keys = [day.alias("w")] + ([key.alias("key")] if key is not None else [])
    out = local.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("day"), *(["key"] if key is not None else []), "n")


def best_scores(scores: DataFrame, ts: str, member: str, score: Column) -> DataFrame:
    """Running best score of each member for all time, months and ISO weeks, by the rules of the batch form."""
    return leaderboard(scores, ts, member, score)


#: Days after which a day's counters and a period's board go.
DAY_TTL, BOARD_TTL = 120, 400


def retained(rows: DataFrame, day: str, as_of: str, days: int = DAY_TTL) -> DataFrame:
    """Rows whose counters have not expired."""
    return rows.where(F.col(day) > F.date_sub(F.lit(as_of).cast("date"), days))


def publish_due(slots: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("slot",), part: str | None = None, now: str | None = None) -> StreamingQuery:
    """Appends slots to a table once each: rows whose keys it has are left out, so a repeated batch adds nothing.

    With ``now`` (``HH:MM``) only slots that are due. With ``part`` the table is partitioned by that key, and only
    the partitions of a batch are read.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        due = batch if now is None else batch.where(F.col(keys[-1]) <= now)
        new = due.dropDuplicates(list(keys))
        known = spark.read.schema(batch.schema).parquet(target)
        if part is not None:
            known = known.join(F.broadcast(new.select(part).distinct()), part, "left_semi")
        writer = new.join(known.select(*keys), list(keys), "left_anti").select(*batch.columns).write.mode("append")
        (writer.partitionBy(part) if part else writer).parquet(target)

    slots.sparkSession.createDataFrame([], slots.schema).write.mode("append").parquet(target)  # the folder is there for the first batch

    return slots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregate over all that a stream holds and returns its last state, a table in ``path`` with one folder a batch."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    query = df.writeStream.foreachBatch(step).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={last:08d}")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is into a table in memory; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)

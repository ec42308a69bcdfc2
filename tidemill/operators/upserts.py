"""Last-writer-wins tables, retention, histories and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import kept


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; an aggregate, so nothing is sorted and hot keys combine early."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with their keys, or are added."""
    return base.join(changes.select(*keys), list(keys), "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def delete(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys), list(keys), "left_anti").select(*base.columns)


def keep_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int, payload: str | None = None, payload_rows: int = 0) -> DataFrame:
    """The newest ``rows`` rows of each key; ``payload`` is emptied beyond the newest ``payload_rows``."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= rows)
    return ranked if payload is None else ranked.withColumn(payload, F.when(F.col("rn") <= payload_rows, F.col(payload)))


def transitions(df: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """Each change of status with the status before it; the first row of a key is no change."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("from_status", F.lag(status).over(w)).where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col(status)))


def streaks(days: DataFrame, key: str, day: str, as_of: str) -> DataFrame:
    """Length of the run of consecutive days of each key that ends on ``as_of`` or the day before; 0 without one."""
    distinct = days.select(key, F.col(day).alias("day")).where(F.col("day") <= F.lit(as_of).cast("date")).distinct()
    islands = distinct.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day"))))
    runs = islands.groupBy(key, "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.datediff(F.lit(as_of).cast("date"), "last") <= 1, F.col("n"))), F.lit(0)).alias("streak"))


def depletion(items: DataFrame, count: str, per_day: Column, since: str, as_of: str) -> DataFrame:
    """Days that a stock lasts, the day it ends and the days left; null without a positive dose."""
    days = F.when(per_day > 0, F.floor(F.try_divide(F.col(count).cast("double"), per_day))).cast("int")
    out = items.withColumn("lasts_days", days).withColumn("ends_on", F.date_add(F.col(since), F.col("lasts_days")))
    return out.withColumn("days_left", F.datediff("ends_on", F.lit(as_of).cast("date")))


def due(items: DataFrame, day: str, as_of: str, open_: Column) -> DataFrame:
    """Open rows with a day that has come."""
    return items.where(open_ & (F.col(day) <= F.lit(as_of).cast("date")))


def review_due(items: DataFrame, kind: Column, since: str, as_of: str, after: dict[str, int]) -> DataFrame:
    """Rows whose kind has a review interval that has passed; other kinds never are."""
    days = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])
    waited = F.datediff(F.lit(as_of).cast("date"), F.col(since))
    return items.withColumn("days_since", waited).where(F.col("days_since") >= F.try_element_at(days, kind))


def delete_reporting(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What stays, and the rows that were there and are removed."""
    return delete(base, gone, keys), base.join(gone.select(*keys), list(keys), "left_semi")


def ranked(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows with their place in one order of all.

    The place within each range of a range partitioning is added to the number of rows in the ranges before, so no task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(parts, *columns).withColumn("__part", F.spark_partition_id())
    placed = kept(placed.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*columns))), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn("rank", (F.col("__start") + F.col("__in")).cast("int")).drop("__part", "__in", "__start")

"""Queries that read ``events`` as a stream and return what the stream has settled on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.book import Book
from tidemill.plans.traffic import BOARD_SQL
from tidemill.sources.tables import fresh_path, parquet
from tidemill.streaming import counters, stateful

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(parquet(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def _settled(spark: SparkSession, df: DataFrame) -> DataFrame:
    return counters.settled(df, fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint"))


@query("SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, counters.daily_counts(_events(spark, sf_dir), key=F.col("event_type")))


@query(BOARD_SQL)
def stream_best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, counters.best_scores(_events(spark, sf_dir), "ts", "user_id", F.col("value")))


@query("SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts + INTERVAL 9 HOUR AS DATE) > DATE '2024-05-15' - 120 GROUP BY 1")
def stream_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.retained(_settled(spark, counters.daily_counts(_events(spark, sf_dir))), "day", "2024-05-15")


NOW = "2024-01-20 12:00:00"
_DUE = f"TIMESTAMP '{NOW}'"
_TIME = "(ts - CAST(CAST(ts AS DATE) AS TIMESTAMP))"


def _in_two_runs(spark: SparkSession, build, first: DataFrame, then: DataFrame) -> DataFrame:
    """Lets a stream drain one part of its input, stop, and go on with the other from its checkpoint."""
    source, out, checkpoint = (fresh_path(spark, label) for label in ("stream-in", "stream-out", "stream-checkpoint"))
    for part in (first, then):
        part.write.mode("append").parquet(source)
        sent = stateful.drained(build(spark.readStream.schema(first.schema).parquet(source)), out, checkpoint)
    return sent


def _at(time: str, **values: Column) -> list[Column]:
    return [*[c.alias(k) for k, c in values.items()], F.lit(time).cast("timestamp").alias("seen_at")]


@query(f"SELECT event_id AS id, ts AS fired_at, CASE WHEN CAST(CAST({_DUE} AS DATE) AS TIMESTAMP) + {_TIME} > {_DUE} THEN CAST(CAST({_DUE} AS DATE) AS TIMESTAMP) + {_TIME} ELSE CAST(CAST({_DUE} AS DATE) + 1 AS TIMESTAMP) + {_TIME} END AS next_fire_at FROM events WHERE ts <= {_DUE} AND event_id % 3 <> 0")
def stream_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alarm for each event, on timers; half of them come after a restart, with the time up to which alarms fire."""
    own = {"id": F.col("event_id"), "active": F.col("event_id") % 3 != 0, "next_fire_at": F.col("ts").cast("timestamp")}
    rows = parquet(spark, sf_dir, "events")
    clock = spark.range(1).select(*_at(f"{NOW}.001", id=F.lit(-1).cast("bigint"), active=F.lit(False), next_fire_at=F.lit(None).cast("timestamp")))
    first, then = rows.where("event_id % 2 = 0").select(*_at("2023-12-01 00:00:00", **own)), rows.where("event_id % 2 = 1").select(*_at("2023-12-01 00:00:01", **own))
    return _in_two_runs(spark, stateful.alarms, first, then.unionByName(clock)).select("id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("fired_at", "next_fire_at")])


@query(
    "WITH s AS (SELECT DISTINCT user_id, ts FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, (epoch_us(ts) + 3599999999) // 3600000000 AS c FROM s)"
    " SELECT user_id AS lane, ts AS slot, make_timestamp(CAST((max(c - i // 3) OVER (PARTITION BY user_id, i % 3 ORDER BY i) + i // 3) * 3600000000 AS BIGINT)) AS published_at FROM n"
)
def stream_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events are slots of a lane, polled by the hour for three slots at most; the stream stops in the middle of the month and goes on."""
    clock = lambda time: spark.range(1).select(*_at(time, lane=F.lit(-1).cast("bigint"), slot=F.lit(None).cast("timestamp")))
    slots = parquet(spark, sf_dir, "events").select(*_at("2023-12-01 00:00:00", lane=F.col("user_id"), slot=F.col("ts").cast("timestamp")))
    sent = _in_two_runs(spark, stateful.publisher, slots.unionByName(clock("2024-01-15 00:30:00")), clock("2100-01-01 00:00:00"))
    return sent.select("lane", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("slot", "published_at")])


def _last(sent: DataFrame) -> DataFrame:
    """The last value that each key had."""
    return sent.groupBy("key").agg(F.max_by("value", "batch").alias("value"))


@query("SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")
def stream_expiring_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stateful.day_counts(_events(spark, sf_dir), "ts")
    return _last(stateful.drained(counts, fresh_path(spark, "stream-out"), fresh_path(spark, "stream-checkpoint"), "update"))


@query("SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m') || '|' || user_id AS key, max(value) AS value FROM events GROUP BY 1 HAVING max(value) IS NOT NULL")
def stream_expiring_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = stateful.boards(_events(spark, sf_dir), F.col("user_id").cast("string"), F.date_format(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM"), F.col("value"))
    return _last(stateful.drained(best, fresh_path(spark, "stream-out"), fresh_path(spark, "stream-checkpoint"), "update"))

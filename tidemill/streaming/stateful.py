"""Streams with state of their own: alarms and a publisher on timers, counters and boards that expire.

Times inside the state are microseconds. Alarms and the publisher go by event time: what the watermark has passed is now, so
a replay fires what the first run fired. Expiry goes by the clock of the machines, like that of the keys it stands for.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemill.streaming.counters import BOARD_TTL, DAY_TTL

HOUR, DAY, MONTH = 3600 * 10**6, 24 * 3600 * 10**6, 30 * 24 * 3600 * 10**6
#: Slots that one poll publishes at most.
PER_POLL = 3
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Timers and expiry need the store that keeps state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def up(us: int, step: int) -> int:
    """The first multiple of ``step`` that is not before a time."""
    return -(-us // step) * step


#: Ids that share a key of the state: a call to the state costs more than the alarms of a whole block.
BLOCK_BITS = 10


class Alarms(StatefulProcessor):
    """An alarm fires when its time has come, once however late that is noticed, and moves on past now by whole days.

    A key holds the alarms of a block of ids, and one timer for the earliest of them.
    """

    def __init__(self, every_days: int) -> None:
        self.every = every_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "timer bigint, ids array<bigint>, due array<bigint>, active array<boolean>")

    def held(self) -> tuple[int | None, dict[int, tuple[int, bool]]]:
        if not self.block.exists():
            return None, {}
        timer, ids, due, active = self.block.get()
        return timer, dict(zip(ids, zip(due, active, strict=True), strict=True))

    def keep(self, old: int | None, alarms: dict[int, tuple[int, bool]]) -> None:
        """Writes a block and moves its timer from ``old`` to the earliest active alarm."""
        timer = min((up(due, 1000) // 1000 for due, active in alarms.values() if active), default=None)
        if old is not None and timer != old:
            self.handle.deleteTimer(old)
        if timer is not None and timer != old:
            self.handle.registerTimer(timer)
        if alarms:
            self.block.update((timer, list(alarms), *map(list, zip(*alarms.values(), strict=True))))
        else:
            self.block.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last: dict[int, tuple] = {}
        for row in rows:
            one, active, due, seen = row.id, row.active, row.next_fire, row.seen
            if one not in last or seen > last[one][0]:
                last[one] = seen, due, bool(active)
        timer, alarms = self.held()
        for one, (_, due, active) in last.items():
            if due is None:
                alarms.pop(one, None)
            else:
                alarms[one] = due, active
        if alarms or timer is not None:
            self.keep(timer, alarms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        _, alarms = self.held()
        ms = timerValues.getCurrentWatermarkInMs()
        for one, (due, active) in alarms.items():
            if active and up(due, 1000) // 1000 < ms:
                following = due + ((ms * 1000 - due) // self.every + 1) * self.every
                alarms[one] = following, active
                yield Row(id=one, fired=due, next_fire=following)
        self.keep(None, alarms)  # the timer that went off is gone

    def close(self) -> None:
        pass


def alarms(rows: DataFrame, every_days: int = 1) -> DataFrame:
    """Fired alarms of a stream: id, fired_at, next_fire_at.

    ``rows``: id (bigint), active, next_fire_at and seen_at, the time of the row. A later row of an id replaces the alarm; one without a
    time takes it away. The greatest ``seen_at`` of a batch is the time up to which alarms fire.
    """
    with_store(rows.sparkSession)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = rows.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", "0 seconds")
    fired = timed.select(F.shiftright("id", BLOCK_BITS).alias("block"), "id", "active", us("next_fire_at").alias("next_fire"), us("seen_at").alias("seen"), "seen_at").groupBy("block").transformWithState(Alarms(every_days), "id bigint, fired bigint, next_fire bigint", "Append", "EventTime")
    return fired.select("id", F.timestamp_micros("fired").alias("fired_at"), F.timestamp_micros("next_fire").alias("next_fire_at"))


class Publisher(StatefulProcessor):
    """Polls a lane as long as slots wait; each poll publishes the earliest slots that are due, a few at most, and each slot once.

    A lane has one timer, for its next poll, and what it has published is kept by months, so a slot costs no call to the state of its own.
    """

    def __init__(self, every: int, most: int) -> None:
        self.every, self.most = every, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lane = handle.getValueState("lane", "polled bigint, timer bigint, waiting array<bigint>")
        self.published = handle.getMapState("published", "month bigint", "slots array<bigint>")

    def held(self) -> tuple[int | None, int | None, list[int]]:
        return tuple(self.lane.get()) if self.lane.exists() else (None, None, [])

    def next_poll(self, waiting: Sequence[int], polled: int | None) -> int | None:
        """The hour of the earliest slot, but after the last poll; null if none waits."""
        if not waiting:
            return None
        return up(waiting[0], self.every) if polled is None else max(up(waiting[0], self.every), polled + self.every)

    def keep(self, polled: int | None, old: int | None, waiting: list[int]) -> None:
        """Writes a lane and moves its timer from ``old`` to the next poll."""
        poll = self.next_poll(waiting, polled)
        timer = None if poll is None else poll // 1000
        if old is not None and timer != old:
            self.handle.deleteTimer(old)
        if timer is not None and timer != old:
            self.handle.registerTimer(timer)
        self.lane.update((polled, timer, waiting))

    def of_month(self, month: int) -> list[int]:
        return list(self.published.getValue((month,))[0]) if self.published.containsKey((month,)) else []

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = {r.slot for r in rows if r.slot is not None}
        if new:
            polled, timer, waiting = self.held()
            if polled is not None:
                for month in {slot // MONTH for slot in new}:
                    new.difference_update(self.of_month(month))
            self.keep(polled, timer, sorted(new.union(waiting)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        polled, _, waiting = self.held()
        done, months = 0, defaultdict(list)
        while (at := self.next_poll(waiting[done : done + 1], polled)) is not None and at <= now:
            for slot in waiting[done : done + self.most]:
                if slot > at:
                    break
                months[slot // MONTH].append(slot)
                done += 1
                yield Row(lane=key[0], slot=slot, published=at)
            polled = at
        for month, slots in months.items():
            self.published.updateValue((month,), (self.of_month(month) + slots,))
        self.keep(polled, None, waiting[done:])  # the timer that went off is gone

    def close(self) -> None:
        pass


def publisher(rows: DataFrame, every_hours: int = 1, most: int = PER_POLL) -> DataFrame:
    """Published slots of a stream: lane, slot, published_at, a poll at a full hour.

    ``rows``: lane (bigint), slot, and seen_at, the time of the row, which may not be later than the slot's poll for it to be in time. Slots that
    come again are published no second time, and what one poll leaves over the next one takes.
    """
    with_store(rows.sparkSession)
    timed = rows.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", "0 seconds").select("lane", F.unix_micros(F.col("slot").cast("timestamp")).alias("slot"), "seen_at")
    out = timed.groupBy("lane").transformWithState(Publisher(every_hours * HOUR, most), "lane bigint, slot bigint, published bigint", "Append", "EventTime")
    return out.select("lane", F.timestamp_micros("slot").alias("slot"), F.timestamp_micros("published").alias("published_at"))


class Expiring(StatefulProcessor):
    """A number for each key, counted or the best so far; the store forgets it some time after the last change."""

    def __init__(self, best: bool, ttl_ms: int) -> None:
        self.best, self.ttl = best, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value double", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.value.get()[0] if self.value.exists() else None
        values = [r.value for r in rows if r.value is not None]
        if values:
            new = max(values if old is None else [*values, old]) if self.best else sum(values) + (old or 0.0)
            self.value.update((new,))
            yield Row(key=key[0], value=new)

    def close(self) -> None:
        pass


def expiring(rows: DataFrame, key: Column, value: Column, best: bool, days: float) -> DataFrame:
    """The changing value of each key: ``key``, ``value``. Keys untouched for ``days`` leave the state, and start anew if they come again."""
    with_store(rows.sparkSession)
    return rows.select(key.cast("string").alias("key"), value.cast("double").alias("value")).groupBy("key").transformWithState(Expiring(best, int(days * 86_400_000)), "key string, value double", "Update", "ProcessingTime")


def day_counts(events: DataFrame, ts: str, hours: int = 9, days: float = DAY_TTL) -> DataFrame:
    """Counts of each local day and all of them, each kept for ``days``."""
    return expiring(events, F.to_date(F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")), F.lit(1), False, days)


def boards(scores: DataFrame, member: Column, period: Column, score: Column, days: float = BOARD_TTL) -> DataFrame:
    """The best score of each member and period, kept for ``days``; ``key`` is period|member."""
    return expiring(scores, F.concat_ws("|", period, member), score, True, days)


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns all that it has sent so far, with the number of its batch.

    A batch that runs again writes its own folder anew. Streams whose state goes by the clock never run dry, so they take one batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    whole = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    df.sparkSession.createDataFrame([], df.schema).write.mode("append").parquet(path)  # the folder is there, whatever comes
    writer = df.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    (writer.trigger(once=True) if mode == "update" else writer.trigger(availableNow=True)).start().awaitTermination()
    return df.sparkSession.read.schema(whole).parquet(path)

"""Queries over routines: customers take their orders in slots, check them, follow schedules and alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import dates, text
from tidemill.operators import routine as ops
from tidemill.plans.book import Book
from tidemill.sources.tables import parquet

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles

_SLOTS = "CASE o_orderkey % 3 WHEN 0 THEN ['morning'] WHEN 1 THEN ['evening'] ELSE ['morning', 'evening'] END"
_EACH = f"""SELECT o_custkey AS "user", o_orderkey AS id, slot, (o_orderkey + length(slot)) % 5 <> 0 AND o_orderkey % 7 <> 0 AND slot = 'morning' OR o_orderkey % 2 = 0 AS checked FROM (SELECT *, unnest({_SLOTS}) AS slot FROM orders)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    slots = F.when(k % 3 == 0, F.array(F.lit("morning"))).when(k % 3 == 1, F.array(F.lit("evening"))).otherwise(F.array(F.lit("morning"), F.lit("evening")))
    return parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), k.alias("id"), F.col("o_orderstatus").alias("name"), slots.alias("slots"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    checks = items.select("user", "id", F.explode("slots").alias("slot")).where("(id + length(slot)) % 5 <> 0 and id % 7 <> 0 and slot = 'morning' or id % 2 = 0")
    return ops.slots_of(items, checks)


@query(f"""SELECT "user", count(*) FILTER (checked) AS done, count(*) AS total, bool_and(checked) AS complete FROM ({_EACH}) GROUP BY 1""")
def routine_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.progress(_slots(spark, sf_dir))


@query(f"""SELECT "user", slot, array_to_string(list(id ORDER BY id), ',') AS items FROM ({_EACH}) GROUP BY 1, 2""")
def routine_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.by_slot(_slots(spark, sf_dir)).select("user", "slot", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


_OLD = f"""SELECT o_custkey AS "user", o_orderkey AS id, o_orderstatus AS name, {_SLOTS} AS slots FROM orders WHERE o_orderkey % 2 = 0"""
_NEW = """SELECT o_custkey AS "user", o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'new' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN ['morning'] ELSE ['evening'] END AS slots FROM orders WHERE o_orderkey % 3 = 0"""


@query(f"""SELECT coalesce(o."user", n."user") AS "user", coalesce(o.id, n.id) AS id, coalesce(nullif(n.name, ''), o.name) AS name, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.slots, []), coalesce(n.slots, [])))), ',') AS slots FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o."user" = n."user" AND o.id = n.id""")
def routine_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    new = items.where("id % 3 = 0").select("user", "id", F.when(F.col("id") % 4 == 0, "").otherwise("new").alias("name"), F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("evening"))).alias("slots"))
    return ops.add_items(items.where("id % 2 = 0"), new).withColumn("slots", F.array_join(F.array_sort("slots"), ","))


@query(
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE 'a,b,c' END AS keys, CASE WHEN c_custkey % 2 = 0 THEN 'x=1' ELSE 'x=1,y=' || c_custkey % 5 END AS scores, CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'p' WHEN 2 THEN 'p,q,r' ELSE 'q' END AS picked FROM customer"
)
def routine_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    checks = F.create_map(F.lit("a"), F.lit(True), F.lit("b"), F.lit(True))
    keys = ops.toggled(checks, F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("c"))
    had = F.when(k % 2 == 0, F.create_map(F.lit("x"), F.lit(1), F.lit("y"), (k % 5).cast("int"))).otherwise(F.create_map(F.lit("x"), F.lit(1)))
    scores = ops.toggled_value(had, F.lit("y"), (k % 5).cast("int"))
    picked = ops.chosen(F.when(k % 4 == 3, F.array(F.lit("q"), F.lit("r"))).when(k % 4 == 1, F.array(F.lit("none"))).otherwise(F.array(F.lit("p"), F.lit("q"))), F.when(k % 4 == 0, "none").when(k % 4 == 1, "p").otherwise("r"))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(scores)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return parquet(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(keys)), ",").alias("keys"), joined.alias("scores"), F.array_join(picked, ",").alias("picked"))


_RANGES = "SELECT s_suppkey AS id, s_suppkey % 3 AS ord, CAST(DATE '2024-01-01' + CAST(s_suppkey % 20 AS INTEGER) AS DATE) AS f, CAST(DATE '2024-01-01' + CAST(s_suppkey % 20 + s_suppkey % 4 - 1 AS INTEGER) AS DATE) AS t FROM supplier"


@query(f"SELECT d.day, arg_min(r.id, (r.ord, r.id)) AS id FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d LEFT JOIN ({_RANGES}) r ON d.day BETWEEN r.f AND r.t GROUP BY 1")
def schedule_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, first = F.col("s_suppkey"), F.lit("2024-01-01").cast("date")
    ranges = parquet(spark, sf_dir, "supplier").select(k.alias("id"), (k % 3).alias("ord"), F.date_add(first, (k % 20).cast("int")).alias("from"), F.date_add(first, (k % 20 + k % 4 - 1).cast("int")).alias("to"))
    return ops.schedule_on(ranges, parquet(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct())


_IMUL = lambda a, b: f"((({a} & 65535) * {b} + (((({a} >> 16) * {b}) & 65535) << 16)) & 4294967295)"
_RANDOM = f"""WITH c AS (SELECT c_custkey, 1 + c_custkey % 5 AS n, 540 + c_custkey % 60 AS lo, 1080 - c_custkey % 60 AS hi FROM customer WHERE c_custkey % 4 = 2),
h AS (SELECT *, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('2024-01-30|' || lo || '|' || hi || '|' || n, ''), lambda x: ord(x)::BIGINT)), lambda a, x: xor(a, x) * 16777619 % 4294967296) AS seed FROM c),
a AS (SELECT *, (seed + i * 1831565813) & 4294967295 AS a FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM h)), t AS (SELECT *, {_IMUL("xor(a, a >> 15)", "(a | 1)")} AS t FROM a), u AS (SELECT *, xor((t + {_IMUL("xor(t, t >> 7)", "(t | 61)")}) & 4294967295, t) AS u FROM t),
m AS (SELECT *, lo + CAST(floor(xor(u, u >> 14) / 4294967296.0 * (hi - lo + 1)) AS BIGINT) AS m FROM u),
s AS (SELECT c_custkey, lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS hm FROM m
UNION ALL SELECT c_custkey, '00:00' FROM customer, range(1, 6) g(i) WHERE c_custkey % 4 = 0 AND i <= 1 + c_custkey % 5
UNION ALL SELECT c_custkey, coalesce(['08:15', '21:05'][i], '21:05') FROM customer, range(1, 6) g(i) WHERE c_custkey % 4 = 1 AND i <= 1 + c_custkey % 5
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 8 = 3 THEN '10:30' ELSE '09:00' END FROM customer, range(1, 6) g(i) WHERE c_custkey % 4 = 3 AND i <= 1 + c_custkey % 5)"""


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mode = F.when(k % 4 == 0, "instant").when(k % 4 == 1, "individual").when(k % 4 == 2, "random").otherwise("same")
    first, last = dates.hhmm(F.lit(540) + k % 60), dates.hhmm(F.lit(1080) - k % 60)
    slots = dates.publish_times(mode, (k % 5 + 1).cast("int"), F.when(k % 8 == 3, "10:30").otherwise(""), F.array(F.lit("08:15"), F.lit("21:05")), last, first, F.lit("2024-01-30"))
    return parquet(spark, sf_dir, "customer").select("c_custkey", slots.alias("slots"))


@query(f"{_RANDOM} SELECT c_custkey, array_to_string(list(hm ORDER BY hm), ',') AS slots, count(*) FILTER (hm <= '11:00') AS due, greatest(0, least(3, count(*) FILTER (hm <= '11:00') - c_custkey % 2)) AS to_publish FROM s GROUP BY 1")
def publish_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = dates.due_slots(F.col("slots"), F.lit(660)).cast("bigint")
    return _times(spark, sf_dir).select("c_custkey", F.array_join("slots", ",").alias("slots"), due.alias("due"), ops.to_publish(due, F.size("slots").cast("bigint"), F.col("c_custkey") % 2).alias("to_publish"))


@query(f"{_RANDOM} SELECT c_custkey, strftime(CAST('2024-01-30 ' || min(hm) || ':00' AS TIMESTAMP) - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS publish_at FROM s GROUP BY 1")
def publish_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).select("c_custkey", dates.local_time_utc(F.lit("2024-01-30").cast("date"), F.get("slots", F.lit(0))).alias("publish_at"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-30' - 25 AND DATE '2024-01-30' - 3 GROUP BY 1")
def lagged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.traffic import within_days

    events = within_days(parquet(spark, sf_dir, "events"), "2024-01-05", "2024-01-27", hours=0)
    first, last = dates.lagged_range(F.lit("2024-01-30").cast("date"), 25, 3)
    return events.select(F.to_date("ts").alias("day")).where(F.col("day").between(first, last)).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN [0] WHEN 1 THEN [2, 4] ELSE [7] END) AS trigger FROM customer")
def alarm_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    days = F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(*map(F.lit, dates.WEEKDAYS))).when(k % 3 == 1, F.array(F.lit("mon"), F.lit("wed"))).otherwise(F.array(F.lit("sat")))
    return parquet(spark, sf_dir, "customer").select("c_custkey", F.explode(dates.triggers(days)).alias("trigger"))


@query(
    "SELECT event_id, next_fire_at <= TIMESTAMP '2024-01-20 12:00:00' AND active AS due, CASE WHEN next_fire_at <= TIMESTAMP '2024-01-20 12:00:00' AND active THEN CASE WHEN CAST(CAST('2024-01-20' AS DATE) AS TIMESTAMP) + (next_fire_at - CAST(CAST(next_fire_at AS DATE) AS TIMESTAMP)) > TIMESTAMP '2024-01-20 12:00:00'"
    " THEN CAST(CAST('2024-01-20' AS DATE) AS TIMESTAMP) + (next_fire_at - CAST(CAST(next_fire_at AS DATE) AS TIMESTAMP)) ELSE CAST(CAST('2024-01-21' AS DATE) AS TIMESTAMP) + (next_fire_at - CAST(CAST(next_fire_at AS DATE) AS TIMESTAMP)) END ELSE next_fire_at END AS next_fire_at FROM (SELECT event_id, ts AS next_fire_at, event_id % 3 <> 0 AS active FROM events)"
)
def alarm_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    alarms = parquet(spark, sf_dir, "events").select("event_id", F.col("ts").alias("next_fire_at"), (F.col("event_id") % 3 != 0).alias("active"))
    now = F.lit("2024-01-20 12:00:00").cast(dict(alarms.dtypes)["next_fire_at"])
    due, moved = ops.due_alarms(alarms, now)
    return moved.join(due.select("event_id", F.lit(True).alias("due")), "event_id", "left").select("event_id", F.coalesce("due", F.lit(False)).alias("due"), "next_fire_at")


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30')) ORDER BY user_id LIMIT 15")
def measure_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = parquet(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return ops.not_yet_measured(users.select("user_id").distinct(), users.where(F.col("day") == F.lit("2024-01-30").cast("date")), ["user_id"], most=15)


@query("SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda x: ord(x)::BIGINT)), lambda h, x: xor(h, x) * 16777619 % 4294967296) AS fnv1a, CASE WHEN p >= 2147483648 THEN 4294967296 - p ELSE p END AS poly31, d AS djb2, ['a', 'b', 'c'][d % 3 + 1] || ['x', 'y'][d // 7 % 2 + 1] AS choice FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: ord(x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296) AS p, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_name, ''), lambda x: ord(x)::BIGINT)), lambda h, x: (h * 33 + x) % 4294967296) AS d FROM customer)")
def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return parquet(spark, sf_dir, "customer").select("c_custkey", text.fnv1a(name).alias("fnv1a"), text.poly31(name).alias("poly31"), text.djb2(name).alias("djb2"), F.concat(*text.mixed_radix(text.djb2(name), [["a", "b", "c"], ["x", "y"]], [1, 7])).alias("choice"))


@query(f"""SELECT o_orderkey, list_contains({_SLOTS}, 'morning') AS morning, list_contains({_SLOTS}, 'evening') AS evening FROM orders""")
def slot_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select(F.col("id").alias("o_orderkey"), *[F.array_contains("slots", s).alias(s) for s in ops.SLOTS])

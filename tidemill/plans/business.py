"""Queries over orders, parts and customers: contacts, due dates, offers, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import dates, scoring, text
from tidemill.operators import upserts
from tidemill.plans.book import Book
from tidemill.sources.tables import parquet

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles

STATUSES = ["F", "O", "P"]


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS total FROM orders GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("o_orderstatus") == s).alias(s) for s in STATUSES]
    return parquet(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*counts, F.count("*").alias("total"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due_on, CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS INTEGER) AS rank FROM orders WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) <= DATE '1996-06-30'")
def due_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("due_on"), "o_orderstatus")
    due = upserts.due(rows, "due_on", "1996-06-30", F.col("o_orderstatus") != "F")
    return upserts.ranked(due, ["due_on", "o_orderkey"]).select("o_orderkey", "due_on", "rank")


@query("SELECT o_orderkey, CAST(DATE '1998-08-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS days_since FROM orders WHERE DATE '1998-08-01' - CAST(o_orderdate AS DATE) >= CASE o_orderstatus WHEN 'F' THEN 90 WHEN 'P' THEN 56 END")
def review_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("since"))
    return upserts.review_due(rows, F.col("o_orderstatus"), "since", "1998-08-01", {"F": 90, "P": 56}).select("o_orderkey", "days_since")


_DEPLETION = "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 2.0) AS INTEGER) AS lasts_days, CAST(l_shipdate AS DATE) + CAST(floor(l_quantity / 2.0) AS INTEGER) AS ends_on, CAST(CAST(l_shipdate AS DATE) + CAST(floor(l_quantity / 2.0) AS INTEGER) - DATE '1998-08-01' AS INTEGER) AS days_left FROM lineitem"


def _depletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("since"))
    return upserts.depletion(rows, "l_quantity", F.lit(2.0), "since", "1998-08-01").select("l_orderkey", "l_linenumber", "lasts_days", "ends_on", "days_left")


@query(_DEPLETION)
def depletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depletion(spark, sf_dir)


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY days_left, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM ({_DEPLETION}) WHERE days_left <= 7")
def restock_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one number in an order may have the same days left, an order that the SQL leaves open; here the stock that lasts shorter comes first."""
    return upserts.ranked(_depletion(spark, sf_dir).where("days_left <= 7"), ["days_left", "l_orderkey", "l_linenumber", "lasts_days"])


@query(
    "SELECT l_partkey, l_orderkey, l_linenumber, unit_price, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY unit_price, l_orderkey, l_linenumber) AS rn FROM"
    " (SELECT l_partkey, l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS unit_price FROM lineitem WHERE l_quantity >= 20 AND l_extendedprice >= 3000)) WHERE rn <= 4"
)
def offer_unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = parquet(spark, sf_dir, "lineitem").where("l_quantity >= 20 and l_extendedprice >= 3000")
    priced = offers.select("l_partkey", "l_orderkey", "l_linenumber", scoring.round_half_up(scoring.unit_price(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("unit_price"))
    w = Window.partitionBy("l_partkey").orderBy(F.asc_nulls_last("unit_price"), "l_orderkey", "l_linenumber")
    return priced.withColumn("rank", F.row_number().over(w)).where("rank <= 4")


@query("SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1 ORDER BY volume DESC, l_partkey LIMIT 20")
def volume_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("volume")).orderBy(F.desc("volume"), "l_partkey").limit(20)


_PLACE = "SELECT c_custkey, CAST((c_custkey * 37) % 140 - 70 AS DOUBLE) AS lat, CAST((c_custkey * 91) % 340 - 170 AS DOUBLE) AS lng FROM customer"


@query(
    f"SELECT c_custkey, CASE WHEN lat <> 0 AND lng <> 0 THEN floor(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(lat - 37.5) / 2), 2) + cos(radians(37.5)) * cos(radians(lat)) * pow(sin(radians(lng - 127.0) / 2), 2)))) + 0.5) END AS metres FROM ({_PLACE})"
)
def nearest_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = parquet(spark, sf_dir, "customer").select(k, ((k * 37) % 140 - 70).cast("double").alias("lat"), ((k * 91) % 340 - 170).cast("double").alias("lng"))
    return rows.select("c_custkey", scoring.haversine_m(F.lit(37.5), F.lit(127.0), F.col("lat"), F.col("lng")).alias("metres"))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) >= 2))) AS toks FROM part")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "part").select("p_partkey", F.array_sort(text.tokens(F.col("p_name"))).alias("toks"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.links import dangling

    return dangling(parquet(spark, sf_dir, "lineitem"), "l_partkey", parquet(spark, sf_dir, "part"), "p_partkey").select("l_orderkey", "l_linenumber")


_HOURS = "SELECT c_custkey, lpad(CAST(6 + c_custkey % 9 AS VARCHAR), 2, '0') || ':30' AS o, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lpad(CAST(9 + c_custkey % 14 AS VARCHAR), 2, '0') || ':00' END AS c, c_custkey % 11 = 0 AS always FROM customer"


@query(f"SELECT c_custkey, CASE WHEN always THEN true ELSE 765 >= CAST(left(o, 2) AS INTEGER) * 60 + CAST(right(o, 2) AS INTEGER) AND 765 < CAST(left(c, 2) AS INTEGER) * 60 + CAST(right(c, 2) AS INTEGER) END AS is_open FROM ({_HOURS})")
def open_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    opens = F.concat(F.lpad((k % 9 + 6).cast("string"), 2, "0"), F.lit(":30"))
    closes = F.when(k % 5 != 0, F.concat(F.lpad((k % 14 + 9).cast("string"), 2, "0"), F.lit(":00")))
    return parquet(spark, sf_dir, "customer").select(k, dates.open_now(opens, closes, k % 11 == 0, F.lit(765)).alias("is_open"))


@query("SELECT c_custkey, count(*) FILTER ((480 + c_custkey % 600 + i * 90) % 1440 <= 660) AS due FROM customer, range(0, 5) g(i) WHERE i < 1 + c_custkey % 4 GROUP BY 1")
def slot_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    slots = dates.publish_slots(dates.hhmm(k % 600 + 480), (k % 4 + 1).cast("int"), F.lit(90))
    return parquet(spark, sf_dir, "customer").select(k, dates.due_slots(slots, F.lit(660)).cast("bigint").alias("due"))


_PIECES = ["{n}정 x 2캡슐", "{n}캡슐", "오메가3 {n}포", "비타민 {n}mg", "{n} 정"]


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 2 WHEN 3 THEN NULL ELSE p_size END AS pieces FROM part")
def pack_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    titles = F.array(*[F.replace(F.lit(t), F.lit("{n}"), n) for t in _PIECES])
    return parquet(spark, sf_dir, "part").select("p_partkey", scoring.pack_count(F.element_at(titles, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("pieces"))

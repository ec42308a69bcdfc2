"""Queries over events: traffic, usage, leaderboards, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.dates import local_day
from tidemill.functions.text import WHITE
from tidemill.operators import traffic as ops
from tidemill.operators import upserts
from tidemill.plans.book import Book
from tidemill.sources.tables import parquet

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles

FIRST, AS_OF, DAYS = "2024-01-01", "2024-01-30", 30
_SPINE = f"SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '{AS_OF}' - INTERVAL {DAYS - 1} DAY, TIMESTAMP '{AS_OF}', INTERVAL 1 DAY) g(d)"
_DAILY = "SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS pv, count(*) FILTER (event_type = 'signup') AS uv FROM events GROUP BY 1"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.daily_views(ops.within_days(parquet(spark, sf_dir, "events"), FIRST, AS_OF), is_new=F.col("event_type") == "signup")


@query(f"SELECT s.day, coalesce(pv, 0) AS pv, coalesce(uv, 0) AS uv FROM ({_SPINE}) s LEFT JOIN ({_DAILY}) e USING (day)")
def traffic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gap_filled(ops.day_spine(spark, AS_OF, DAYS), _daily(spark, sf_dir), ["pv", "uv"])


@query(
    "SELECT CAST(coalesce(sum(pv) FILTER (day > DATE '2024-01-30' - 1), 0) AS BIGINT) AS pv_1d, CAST(coalesce(sum(pv) FILTER (day > DATE '2024-01-30' - 7), 0) AS BIGINT) AS pv_7d, CAST(coalesce(sum(pv) FILTER (day > DATE '2024-01-30' - 30), 0) AS BIGINT) AS pv_30d,"
    " CAST(coalesce(sum(uv) FILTER (day > DATE '2024-01-30' - 1), 0) AS BIGINT) AS uv_1d, CAST(coalesce(sum(uv) FILTER (day > DATE '2024-01-30' - 7), 0) AS BIGINT) AS uv_7d, CAST(coalesce(sum(uv) FILTER (day > DATE '2024-01-30' - 30), 0) AS BIGINT) AS uv_30d"
    f" FROM ({_DAILY}) WHERE day <= DATE '2024-01-30'"
)
def traffic_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trailing_sums(_daily(spark, sf_dir), AS_OF)


_HOST = r"regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '')"


@query(
    f"SELECT CASE WHEN h = '' OR h IS NULL THEN 'direct' WHEN regexp_matches(h, 'naver\\.') THEN 'naver' WHEN regexp_matches(h, 'google\\.') THEN 'google' WHEN regexp_matches(h, 'daum\\.|kakao') THEN 'daum'"
    f" WHEN contains(h, 'instagram') THEN 'instagram' WHEN regexp_matches(h, 'facebook|fb\\.com') THEN 'facebook' WHEN regexp_matches(h, 'youtube|youtu\\.be') THEN 'youtube' WHEN regexp_matches(h, 'bing\\.') THEN 'bing' ELSE 'other' END AS channel,"
    f" count(*) AS n FROM (SELECT lower({_HOST}) AS h FROM pages) GROUP BY 1"
)
def traffic_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counted(parquet(spark, sf_dir, "pages"), ops.channel(F.col("url")), "channel")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def traffic_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counted(parquet(spark, sf_dir, "events"), F.col("event_type"), "event_type")


_SCORES = "SELECT user_id AS member, CAST(floor(greatest(0, least(100, value))) AS BIGINT) AS score, CAST(ts + INTERVAL 9 HOUR AS DATE) AS d FROM events"
_BOARD = f"""SELECT period, member, max(score) AS score FROM (
  SELECT member, score, 'all' AS period FROM ({_SCORES}) UNION ALL SELECT member, score, strftime(d, '%Y-%m') FROM ({_SCORES})
  UNION ALL SELECT member, score, isoyear(d) || '-W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') FROM ({_SCORES})) WHERE score > 0 GROUP BY 1, 2"""

BOARD_SQL = _BOARD

#: URLs as they are sent: some with white space, some without a domain.
_SENT = "CASE page_id % 5 WHEN 0 THEN chr(9) || upper(url) || chr(10) WHEN 1 THEN 'localhost' WHEN 2 THEN '' ELSE url END"
_HOST = rf"regexp_replace(regexp_replace(regexp_replace(trim(lower({_SENT}), '{WHITE}'), '^https?://', ''), '^www\.', ''), '[/?:].*$', '')"
_DOMAINS = rf"SELECT {_HOST} AS member, page_id * 7 % 113 - 3 AS score, CAST(DATE '2023-11-20' + CAST(page_id % 80 AS INTEGER) AS DATE) AS d FROM pages WHERE regexp_matches({_HOST}, '^[a-z0-9.-]+\.[a-z]{{2,}}$') AND length({_HOST}) <= 80"
_DOMAIN_BOARD = _BOARD.replace(_SCORES, f"SELECT member, least(100, score) AS score, d FROM ({_DOMAINS})")


def _board(spark: SparkSession, sf_dir: str, *days: str) -> DataFrame:
    events = parquet(spark, sf_dir, "events")
    return ops.leaderboard(ops.within_days(events, *days) if days else events, "ts", "user_id", F.col("value"))


@query(_DOMAIN_BOARD)
def leaderboard_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as submissions of scores: only those of real domains count, whatever the case and white space."""
    i, url = F.col("page_id"), F.col("url")
    sent = F.when(i % 5 == 0, F.concat(F.lit("\t"), F.upper(url), F.lit("\n"))).when(i % 5 == 1, "localhost").when(i % 5 == 2, "").otherwise(url)
    at = F.date_add(F.lit("2023-11-20").cast("date"), (i % 80).cast("int")).cast("timestamp_ntz")
    rows = parquet(spark, sf_dir, "pages").select(sent.alias("url"), at.alias("ts"), (i * 7 % 113 - 3).alias("score"))
    return ops.domain_leaderboard(rows, "ts", "url", F.col("score"))


@query(_BOARD)
def leaderboard_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir)


@query(f"SELECT * FROM ({_BOARD}) WHERE period = 'all' ORDER BY score DESC, member DESC LIMIT 5")
def leaderboard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_members(_board(spark, sf_dir), "all")


@query(f"SELECT * FROM ({_BOARD}) WHERE period = '2024-01' ORDER BY score DESC, member DESC LIMIT 5")
def leaderboard_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_members(_board(spark, sf_dir, "2024-01-01", "2024-01-31"), "2024-01")


@query(f"SELECT * FROM ({_BOARD}) WHERE period = '2024-W03' ORDER BY score DESC, member DESC LIMIT 5")
def leaderboard_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_members(_board(spark, sf_dir, "2024-01-15", "2024-01-21"), "2024-W03")


_USAGE = "SELECT CAST(ts AS DATE) AS day, count(*) AS posts, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(CAST(floor(value) AS BIGINT) * 2) AS BIGINT) AS completion_tokens, count(*) FILTER (event_id % 3 = 0) AS images FROM events WHERE event_type = 'purchase' GROUP BY 1"
_COST = f"SELECT *, floor((prompt_tokens / CAST(1e6 AS DOUBLE) * CAST(2.5 AS DOUBLE) + completion_tokens / CAST(1e6 AS DOUBLE) * CAST(10 AS DOUBLE) + images * CAST(0.04 AS DOUBLE)) * 1000000 + 0.5) / 1000000 AS cost FROM ({_USAGE})"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("value").cast("bigint")
    log = parquet(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "purchase", "generate").otherwise("other").alias("action"), n.alias("prompt_tokens"), (n * 2).alias("completion_tokens"), (F.col("event_id") % 3 == 0).alias("has_image"))
    return ops.usage_daily(log)


@query(_COST)
def usage_cost_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


@query(f"SELECT CAST(sum(posts) AS BIGINT) AS posts, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(sum(images) AS BIGINT) AS images, round(sum(cost), 4) AS cost FROM ({_COST})")
def usage_cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir).agg(F.sum("posts").alias("posts"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("images").alias("images"), F.round(F.sum("cost"), 4).alias("cost"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS part, count(*) FILTER (event_type = 'view') AS whole, round(CASE WHEN count(*) FILTER (event_type = 'view') = 0 THEN 0.0 ELSE count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*) FILTER (event_type = 'view') END, 6) AS ctr FROM events GROUP BY 1")
def ctr_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda t: F.when(F.col("event_type") == t, 1).otherwise(0).cast("bigint")
    return ops.ratio_of_sums(parquet(spark, sf_dir, "events"), "user_id", is_("purchase"), is_("view"), "ctr")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def crm_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.latest(parquet(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT * FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status FROM events) WHERE from_status IS NOT NULL AND from_status <> event_type")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.transitions(parquet(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type", "from_status")


@query("SELECT event_id, user_id, CASE WHEN rn <= 10 THEN props END AS props, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 40")
def retention_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet(spark, sf_dir, "events").select("event_id", "user_id", "ts", "props")
    return upserts.keep_newest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 40, "props", 10).select("event_id", "user_id", "props", "rn")


@query(
    "WITH d AS (SELECT DISTINCT user_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events WHERE CAST(ts + INTERVAL 9 HOUR AS DATE) <= DATE '2024-01-30'), i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),"
    " r AS (SELECT user_id, count(*) AS n, max(day) AS last FROM i GROUP BY user_id, island) SELECT user_id, coalesce(max(CASE WHEN DATE '2024-01-30' - last <= 1 THEN n END), 0) AS streak FROM r GROUP BY 1"
)
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = parquet(spark, sf_dir, "events").select("user_id", local_day(F.col("ts")).alias("day"))
    return upserts.streaks(days, "user_id", "day", AS_OF)


@query(
    "WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d)),"
    " e AS (SELECT user_id, CAST(ts AS DATE) AS day, round(max(value), 6) AS best FROM events GROUP BY 1, 2) SELECT user_id, day, best FROM u CROSS JOIN s LEFT JOIN e USING (user_id, day)"
)
def recent_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet(spark, sf_dir, "events")
    spine = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.date_sub(F.lit(AS_OF).cast("date"), 13), F.lit(AS_OF).cast("date"))).alias("day"))
    best = ops.within_days(events, "2024-01-17", AS_OF, hours=0).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.max("value"), 6).alias("best"))
    return spine.join(best, ["user_id", "day"], "left")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k"))


@query("SELECT CAST(ts AS DATE) AS date, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1 ORDER BY date DESC LIMIT 400")
def snapshot_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_id", "value")
    return upserts.latest(rows.withColumn("seq", F.col("event_id")), ["date"], ["seq"]).select("date", "event_id", "value").orderBy(F.desc("date")).limit(400)

"""Traffic, usage and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.dates import iso_week_key, local_day, month_key
from tidemill.functions.scoring import round_half_up
from tidemill.operators.content import domain

#: Channels by a pattern of the host, first match wins.
CHANNELS: list[tuple[str, str]] = [
    ("naver", r"naver\."),
    ("google", r"google\."),
    ("daum", r"daum\.|kakao"),
    ("instagram", "instagram"),
    ("facebook", r"facebook|fb\.com"),
    ("youtube", r"youtube|youtu\.be"),
    ("bing", r"bing\."),
]


def channel(referrer: Column, own_host: str = "", channels: Sequence[tuple[str, str]] = CHANNELS) -> Column:
    """The channel of a referrer: ``direct`` without a host or from the own host, ``other`` if nothing fits."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(referrer, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    out = F.when((host == "") | (host == own_host), F.lit("direct"))
    for name, pattern in channels:
        out = out.when(host.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("other"))


def day_spine(spark: SparkSession, last: str, days: int) -> DataFrame:
    """One row ``day`` for each of the days up to ``last``."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), days - 1), F.lit(last).cast("date"))).alias("day"))


def daily_views(events: DataFrame, ts: str = "ts", is_new: Column | None = None, hours: int = 9) -> DataFrame:
    """Views and flagged new visitors a day; flags are summed, not counted distinct."""
    flag = F.coalesce(is_new if is_new is not None else F.lit(False), F.lit(False))
    return events.groupBy(local_day(F.col(ts), hours).alias("day")).agg(F.count("*").alias("pv"), F.count_if(flag).alias("uv"))


def gap_filled(spine: DataFrame, daily: DataFrame, values: Sequence[str], key: str = "day") -> DataFrame:
    """The spine with 0 where a day has no row."""
    joined = spine.join(daily, key, "left")
    return joined.select(key, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def trailing_sums(daily: DataFrame, as_of: str, spans: Sequence[int] = (1, 7, 30), values: Sequence[str] = ("pv", "uv")) -> DataFrame:
    """One row with the sums of the last n days up to ``as_of``."""
    day = F.lit(as_of).cast("date")
    inside = lambda n: (F.col("day") > F.date_sub(day, n)) & (F.col("day") <= day)
    return daily.agg(*[F.coalesce(F.sum(F.when(inside(n), F.col(v))), F.lit(0)).alias(f"{v}_{n}d") for v in values for n in spans])


def counted(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows of each key that occurs, most first."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def leaderboard(scores: DataFrame, ts: str, member: str, score: Column, hours: int = 9) -> DataFrame:
    """The best score of each member for all time, each month and each ISO week, with ``score_rows``."""
    return score_rows(scores, ts, member, score, hours).groupBy("period", "member").agg(F.max("score").alias("score"))


def domain_leaderboard(scores: DataFrame, ts: str, url: str, score: Column, hours: int = 9) -> DataFrame:
    """The board of the domains in ``url``; what is no domain has no score."""
    named = scores.withColumn("__domain", domain(F.col(url))).where("__domain <> ''")
    return leaderboard(named, ts, "__domain", score, hours)


def score_rows(scores: DataFrame, ts: str, member: str, score: Column, hours: int = 9) -> DataFrame:
    """(member, score, period): a row for each period of a score. Scores are cut to whole ones within 0 and 100; 0 is no score."""
    day = local_day(F.col(ts), hours)
    value = F.floor(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("bigint")
    periods = F.array(F.lit("all"), month_key(day), iso_week_key(day))
    return scores.select(F.col(member).alias("member"), value.alias("score"), F.explode(periods).alias("period")).where("score > 0")


def within_days(events: DataFrame, first: str, last: str, ts: str = "ts", hours: int = 9) -> DataFrame:
    """Events of the local days from ``first`` to ``last``, as bounds on ``ts`` that the scan can use."""
    start = f"TIMESTAMP_NTZ '{first} 00:00:00' - INTERVAL {hours} HOURS"
    end = f"TIMESTAMP_NTZ '{last} 00:00:00' + INTERVAL 1 DAY - INTERVAL {hours} HOURS"
    kind = dict(events.dtypes)[ts]
    return events.where((F.col(ts) >= F.expr(start).cast(kind)) & (F.col(ts) < F.expr(end).cast(kind)))


def top_members(board: DataFrame, period: str, k: int = 5) -> DataFrame:
    """The best k of a period; ties go to the larger member."""
    return board.where(F.col("period") == period).orderBy(F.desc("score"), F.desc("member")).limit(k)


def usage_daily(log: DataFrame, ts: str = "ts", prices: tuple[float, float] = (2.5, 10.0), image_price: float = 0.04) -> DataFrame:
    """Posts, tokens, images and cost a UTC day over rows of the action ``generate``; missing numbers count as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        log.where("action = 'generate'")
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("posts"), F.sum(n("prompt_tokens")).alias("prompt_tokens"), F.sum(n("completion_tokens")).alias("completion_tokens"), F.count_if(F.coalesce("has_image", F.lit(False))).alias("images"))
        .withColumn("cost", round_half_up(F.col("prompt_tokens") / 1e6 * prices[0] + F.col("completion_tokens") / 1e6 * prices[1] + F.col("images") * image_price, 6))
    )


def ratio_of_sums(df: DataFrame, key: str, part: Column, whole: Column, name: str) -> DataFrame:
    """Sum over sum for each key, 0 where the whole is 0; not the mean of ratios."""
    return df.groupBy(key).agg(F.sum(part).alias("part"), F.sum(whole).alias("whole")).withColumn(name, F.round(F.coalesce(F.try_divide(F.col("part").cast("double"), F.col("whole").cast("double")), F.lit(0.0)), 6))

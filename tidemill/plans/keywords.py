"""Queries of keyword research over part names: sources, questions, volumes, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import keywords as ops
from tidemill.operators.upserts import ranked
from tidemill.plans.book import Book
from tidemill.sources.tables import parquet

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles

ASK = {5: " 얼마", 7: " 추천해 주세요"}
_NAVER = "SELECT p_brand AS brand, p_name || ' ' || p_size || CASE WHEN p_partkey % 5 = 0 THEN ' 얼마' WHEN p_partkey % 7 = 0 THEN ' 추천해 주세요' ELSE '' END AS word, p_partkey AS pos FROM part"
_GOOGLE = "SELECT p_brand AS brand, p_type || '  ' || p_size AS word, p_partkey AS pos FROM part"
_SEARCHAD = "SELECT p_brand AS brand, ' ' || upper(p_name) || ' ' || p_size AS word, p_partkey AS pos FROM part"
_NORM = "trim(regexp_replace(word, '\\s+', ' ', 'g'))"
_UNION = f"""SELECT brand, key, arg_min(word, ord) AS word, min(ord) AS ord FROM (SELECT brand, {_NORM} AS word, lower({_NORM}) AS key, row(source, pos) AS ord FROM
(SELECT *, 0 AS source FROM ({_NAVER}) UNION ALL SELECT *, 1 FROM ({_GOOGLE}) UNION ALL SELECT *, 2 FROM ({_SEARCHAD}))) WHERE key <> '' GROUP BY brand, key"""
_ASKS = f"regexp_matches(word, '{text.REQUESTS}|{text.QUESTIONS}')"
_RESEARCH = f"""SELECT brand, kind, CAST(rank AS INTEGER) AS rank, word FROM (SELECT *, row_number() OVER (PARTITION BY brand, kind ORDER BY ord) AS rank FROM (SELECT *, CASE WHEN asks AND nth <= 8 THEN 'question' ELSE 'related' END AS kind FROM
(SELECT *, row_number() OVER (PARTITION BY brand, asks ORDER BY ord) AS nth FROM (SELECT *, {_ASKS} AS asks FROM ({_UNION}) WHERE length(word) BETWEEN 2 AND 40 AND key NOT IN ('widget 7', 'large widget 7'))))) WHERE kind = 'question' OR rank <= 14"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parquet(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_name", "p_type", F.col("p_size").cast("string").alias("size"), F.col("p_partkey").alias("pos"))
    asked = F.when(F.col("pos") % 5 == 0, ASK[5]).when(F.col("pos") % 7 == 0, ASK[7]).otherwise("")
    naver = part.withColumn("word", F.concat("p_name", F.lit(" "), "size", asked))
    google = part.withColumn("word", F.concat("p_type", F.lit("  "), "size"))
    return ops.ordered_union([("naver", naver), ("google", google), ("searchad", part.withColumn("word", F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "), "size")))], "brand", "word", "pos")


def _research(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.research(_words(spark, sf_dir), "brand", F.lit("widget 7"), region=F.lit("Large"))


@query(f"SELECT brand, key, word FROM ({_UNION})")
def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("brand", "key", "word")


@query(_RESEARCH)
def keyword_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _research(spark, sf_dir)


#: Volumes as a service writes them.
_VOLUMES = "SELECT p_brand AS brand, p_name || ' ' || p_partkey AS keyword, CASE WHEN p_size % 9 = 0 THEN 5 ELSE CAST(p_size * 1000 + p_partkey AS BIGINT) END AS volume FROM part"
_TOP = f"SELECT brand, keyword, volume, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY volume DESC, keyword) AS rank FROM ({_VOLUMES}) WHERE volume > 0) WHERE rank <= 10"


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("p_size") % 9 == 0, F.lit("< 10")).otherwise(F.format_number((F.col("p_size") * 1000 + F.col("p_partkey")).cast("bigint"), 0))
    rows = parquet(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("keyword"), text.volume(written).alias("volume"))
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("volume"), "keyword"))
    return rows.where("volume > 0").withColumn("rank", rank).where("rank <= 10")


@query(_TOP)
def keyword_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir)


_LISTS = f"""r AS (SELECT brand, CAST(regexp_extract(brand, '(\\d+)', 1) AS INTEGER) AS seed, coalesce(list(word ORDER BY rank) FILTER (kind = 'related'), []) AS related, coalesce(list(word ORDER BY rank) FILTER (kind = 'question'), []) AS questions FROM ({_RESEARCH}) GROUP BY brand),
t AS (SELECT brand, array_to_string(list(keyword || ' (' || format('{{:,}}', volume) || ')' ORDER BY rank) FILTER (rank <= 6), ', ') AS top FROM ({_TOP}) GROUP BY brand)"""
_TURN = lambda c: f"CASE WHEN len({c}) < 2 THEN {c} ELSE list_concat({c}[seed % len({c}) + 1:], {c}[:seed % len({c})]) END"


@query(
    f"WITH {_LISTS} SELECT brand, array_to_string(list_filter([CASE WHEN len(related) > 0 THEN 'related: ' || array_to_string({_TURN('related')}, ', ') END, CASE WHEN len(questions) > 0 THEN 'questions: ' || array_to_string({_TURN('questions')}, ' / ') END, 'volumes: ' || top], lambda x: x IS NOT NULL), chr(10)) AS block FROM r LEFT JOIN t USING (brand)"
)
def keyword_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "word")))), lambda x: x["word"]).alias(kind)
    lists = _research(spark, sf_dir).groupBy("brand").agg(in_order("related"), in_order("question"))
    volumes = _volumes(spark, sf_dir).groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword", "volume"))), lambda x: F.struct(x["keyword"].alias("keyword"), x["volume"].alias("volume"))).alias("volumes"))
    seed = F.regexp_extract("brand", r"(\d+)", 1).cast("int")
    return lists.join(volumes, "brand", "left").select("brand", ops.research_block(ops.rotated(F.col("related"), seed), ops.rotated(F.col("question"), seed), F.col("volumes")).alias("block"))


_SUBS = f"SELECT brand, CAST(slot AS INTEGER) AS slot, word FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY ord) AS slot FROM ({_UNION}) WHERE key <> lower(brand)) WHERE slot <= 6"
_PRIOR = f"SELECT brand, upper(word) AS word, slot * 100 + length(word) AS post, CASE WHEN slot % 2 = 0 THEN 'filled' ELSE 'skip' END AS status FROM ({_SUBS}) WHERE slot % 3 <> 0"


@query(f"SELECT * FROM ({_SUBS})")
def cluster_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.subtopics(_words(spark, sf_dir).withColumn("name", F.col("brand")), "brand")


@query(f"SELECT s.brand, s.slot, s.word, p.post, p.status FROM ({_SUBS}) s LEFT JOIN ({_PRIOR}) p ON s.brand = p.brand AND lower(trim(s.word)) = lower(trim(p.word))")
def cluster_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = ops.subtopics(_words(spark, sf_dir).withColumn("name", F.col("brand")), "brand")
    prior = new.where("slot % 3 <> 0").select("brand", F.upper("word").alias("word"), (F.col("slot") * 100 + F.length("word")).alias("post"), F.when(F.col("slot") % 2 == 0, "filled").otherwise("skip").alias("status"))
    return ops.merge_prior(new, prior, ["brand"], "word", ["post", "status"])


@query("SELECT p_partkey, left(regexp_replace(regexp_replace(lower(trim(p_name || ' _ ' || p_type)), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) AS slug, left(regexp_replace(regexp_replace(p_name || ' _ ' || p_type, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 40) AS ascii, replace(regexp_replace(left(regexp_replace(trim(regexp_replace(p_name || ' _ ' || p_type, '[^가-힣a-zA-Z0-9\\s]', ' ', 'g')), '\\s+', '-', 'g'), 24), '^-+|-+$', '', 'g') || '-' || right(CAST(p_partkey AS VARCHAR), 5), '--', '-') AS page FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" _ "), "p_type")
    return parquet(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"), text.ascii_slug(name).alias("ascii"), text.page_slug(name, F.col("p_partkey")).alias("page"))


SUFFIXES = ["", " price", " review", " near me"]
KNOWN = {"coldwidget": "cool thing", "smallwidget": "little thing"}


@query("SELECT p_partkey, p_name || unnest(['', ' price', ' review', ' near me']) AS keyword, CASE p_name WHEN 'cold widget' THEN 'cool thing' WHEN 'small widget' THEN 'little thing' ELSE p_name END AS term FROM part")
def keyword_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(F.col("p_name"), s)))
    return parquet(spark, sf_dir, "part").select("p_partkey", each.alias("keyword"), text.synonym(F.col("p_name"), KNOWN).alias("term"))


_LEADS = "coalesce(nullif(upper(regexp_extract(p_name, '[A-Za-z]', 0)), ''), '#')"


@query(f"SELECT lead, row_number() OVER (ORDER BY lead) AS rank FROM (SELECT DISTINCT {_LEADS} AS lead FROM part)")
def glossary_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = parquet(spark, sf_dir, "part").select(text.latin_lead(F.col("p_name")).alias("lead")).distinct()  # 27 at most
    return leads.withColumn("rank", F.row_number().over(Window.orderBy("lead")).cast("bigint"))


_KO = "['가방', '나무', '다리', '까치', '한국', 'apple'][CAST(p_partkey % 6 AS INTEGER) + 1]"
_CHO = "['ㄱ','ㄱ','ㄴ','ㄷ','ㄷ','ㄹ','ㅁ','ㅂ','ㅂ','ㅅ','ㅅ','ㅇ','ㅈ','ㅈ','ㅊ','ㅋ','ㅌ','ㅍ','ㅎ']"


@query(
    f"SELECT p_partkey, ko, cho, CAST(row_number() OVER (ORDER BY ko = 'apple', ko, p_partkey) AS INTEGER) AS rank FROM (SELECT p_partkey, p_type, p_name, {_KO} AS ko, CASE WHEN unicode({_KO}) BETWEEN 44032 AND 55203 THEN {_CHO}[CAST(floor((unicode({_KO}) - 44032) / 588) AS INTEGER) + 1] ELSE '' END AS cho FROM part)"
    " WHERE p_type <> 'ECONOMY' AND cho IN ('ㄱ', 'ㅎ', '') AND contains(lower(ko || ' ' || p_name), 'widget')"
)
def glossary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ko = F.element_at(F.array(*map(F.lit, ["가방", "나무", "다리", "까치", "한국", "apple"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = parquet(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", ko.alias("ko")).withColumn("cho", text.initial_consonant(F.col("ko")))
    found = rows.where((F.col("p_type") != "ECONOMY") & F.col("cho").isin("ㄱ", "ㅎ", "") & F.contains(F.lower(F.concat_ws(" ", "ko", "p_name")), F.lit("widget")))
    return ranked(found, [F.collate("ko", "ko"), "p_partkey"]).select("p_partkey", "ko", "cho", "rank")

"""Queries of the recommender over neutral fixtures of its own and users from the customers table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import recommend as ops
from tidemill.operators.upserts import ranked
from tidemill.plans.book import Book, pick
from tidemill.sources.tables import parquet, small

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles

ITEMS = [("i1", 1, 3), ("i2", 2, 2), ("i3", 3, 1), ("i4", 4, 3), ("i5", 5, 2)]
CONCERNS = [("c1", ["i1", "i2", "i3", "i5"]), ("c2", ["i2", "i4"]), ("c3", ["i5", "i1", "i4"])]
RULES = [(1, "d1", "warn", "take care", ["i1"]), (2, "d2", "exclude", "not with d2", ["i2"]), (3, "d2", "warn", "ask first", ["i4"])]
PAIRS = [("i1", "i2", "synergy", ""), ("i1", "i4", "antagonism", "split"), ("i4", "i5", "antagonism", "monitor")]


def _tables(spark: SparkSession) -> tuple[DataFrame, ...]:
    return (
        spark.createDataFrame(ITEMS, "item string, ord int, evidence int"),
        spark.createDataFrame(CONCERNS, "concern string, items array<string>"),
        spark.createDataFrame(RULES, "ord int, drug string, action string, message string, items array<string>"),
        spark.createDataFrame(PAIRS, "a string, b string, kind string, mode string"),
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks by nation and market segment; some take a drug by their key."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    concerns = F.array_compact(F.array(F.when(n % 2 == 0, "c1"), F.when(n % 3 == 0, "c2"), F.when(n % 5 == 0, "c3")))
    drugs = F.array_compact(F.array(F.when(k % 7 == 0, "d1"), F.when(k % 11 == 0, "d2")))
    return parquet(spark, sf_dir, "customer").select(k.alias("user"), concerns.alias("concerns"), drugs.alias("drugs"))


def _recommended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, concerns, rules, pairs = _tables(spark)
    return ops.recommend(_users(spark, sf_dir), items, concerns, rules, pairs), pairs


_SCORES = """WITH u AS (SELECT c_custkey AS "user", c_custkey AS k, c_nationkey AS n FROM customer),
a AS (SELECT "user", k, 'c1' AS concern FROM u WHERE n % 2 = 0 UNION ALL SELECT "user", k, 'c2' FROM u WHERE n % 3 = 0 UNION ALL SELECT "user", k, 'c3' FROM u WHERE n % 5 = 0),
m(concern, item, w) AS (VALUES ('c1','i1',1.0),('c1','i2',.85),('c1','i3',.7),('c1','i5',.55),('c2','i2',1.0),('c2','i4',.85),('c3','i5',1.0),('c3','i1',.85),('c3','i4',.7)),
e(item, ord, ew) AS (VALUES ('i1',1,1.0),('i2',2,.7),('i3',3,.4),('i4',4,1.0),('i5',5,.7)),
c AS (SELECT "user", k, item, max(w) AS fit, count(*) AS matches FROM a JOIN m USING (concern) GROUP BY ALL),
r AS (SELECT "user", item, ord, CAST(ew AS DOUBLE) * CAST(fit AS DOUBLE) * CASE WHEN (k % 7 = 0 AND item = 'i1') OR (k % 11 = 0 AND item = 'i4') THEN 0.5 ELSE 1.0 END - CAST(0.3 AS DOUBLE) * (matches - 1) AS base FROM c JOIN e USING (item) WHERE NOT (k % 11 = 0 AND item = 'i2')),
b AS (SELECT x."user", x.item, x.ord, x.base + CASE WHEN y.item IS NULL THEN 0 ELSE CAST(0.1 AS DOUBLE) END AS base FROM r x LEFT JOIN r y ON x."user" = y."user" AND ((x.item = 'i1' AND y.item = 'i2') OR (x.item = 'i2' AND y.item = 'i1'))),
s AS (SELECT "user", item, ord, floor(base * 100 + 0.5) / 100 AS score FROM b)
SELECT "user", item, score, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, ord) AS INTEGER) AS rank FROM s"""


@query(_SCORES)
def reco_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir)[0].select("user", "item", "score", "rank")


_LISTS = f"""WITH s AS ({_SCORES}), l AS (SELECT "user", list(item ORDER BY rank) AS items FROM s GROUP BY 1)"""


@query(f"""{_LISTS} SELECT "user", array_to_string(list_filter(items, lambda x: NOT later(items, x)), ',') AS morning, array_to_string(list_filter(items, lambda x: later(items, x)), ',') AS evening FROM l""".replace("later(items, x)", "(x = 'i4' AND coalesce(list_position(items, 'i1') < list_position(items, 'i4'), false) OR x = 'i1' AND coalesce(list_position(items, 'i4') < list_position(items, 'i1'), false))"))
def reco_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.schedule(*_recommended(spark, sf_dir)).select("user", F.array_join("morning", ",").alias("morning"), F.array_join("evening", ",").alias("evening"))


@query(f"""{_LISTS} SELECT "user", n AS note FROM l, (VALUES ('i1', 'i2', 'i1 goes with i2'), ('i1', 'i4', 'separate i1 and i4'), ('i4', 'i5', 'watch i4 and i5')) p(a, b, n) WHERE list_contains(items, a) AND list_contains(items, b)""")
def reco_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.notes(*_recommended(spark, sf_dir))


CAUTIONS = [("i1", ["with food", "contains shellfish"]), ("i2", []), ("i3", ["soy"]), ("i4", ["may hold soybean oil"]), ("i5", ["none"])]
ALLERGIES = [("fish", ["shellfish", "fish oil"]), ("soy", ["soy"])]


def _allergic(spark: SparkSession) -> DataFrame:
    return ops.allergic(spark.createDataFrame(CAUTIONS, "item string, cautions array<string>"), spark.createDataFrame(ALLERGIES, "allergy string, words array<string>"))


_CANDIDATES = """WITH u AS (SELECT c_custkey AS "user", c_custkey AS k, c_nationkey AS n FROM customer), a AS (SELECT "user", k, 'c1' AS concern FROM u WHERE n % 2 = 0 UNION ALL SELECT "user", k, 'c2' FROM u WHERE n % 3 = 0 UNION ALL SELECT "user", k, 'c3' FROM u WHERE n % 5 = 0),
m(concern, item) AS (VALUES ('c1','i1'),('c1','i2'),('c1','i3'),('c1','i5'),('c2','i2'),('c2','i4'),('c3','i5'),('c3','i1'),('c3','i4')), c AS (SELECT DISTINCT "user", k, item FROM a JOIN m USING (concern))"""


@query(f"""{_CANDIDATES} SELECT "user", item, CASE WHEN k % 11 = 0 AND item = 'i2' THEN 'not with d2' ELSE 'allergy' END AS reason FROM c WHERE (k % 11 = 0 AND item = 'i2') OR (k % 3 = 0 AND item = 'i1') OR (k % 4 = 0 AND item IN ('i3', 'i4'))""")
def reco_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, concerns, rules, _ = _tables(spark)
    allergies = F.array_compact(F.array(F.when(F.col("user") % 3 == 0, "fish"), F.when(F.col("user") % 4 == 0, "soy")))
    return ops.not_recommended(_users(spark, sf_dir).withColumn("allergies", allergies), concerns, rules, _allergic(spark))


_STACKS = """WITH u AS (SELECT c_custkey AS k, list_filter(['i1', 'i2', 'i3', 'i4', 'i5'], lambda x, i: (c_custkey + i) % 3 <> 0) AS items FROM customer)"""
_KINDS = [("exclude", "i2: not with d2", "k % 11 = 0 AND list_contains(items, 'i2')"), ("warn", "i1: take care", "k % 7 = 0 AND list_contains(items, 'i1')"), ("warn", "i4: ask first", "k % 11 = 0 AND list_contains(items, 'i4')"), ("synergy", "i1+i2", "list_contains(items, 'i1') AND list_contains(items, 'i2')"), ("separate", "i1+i4", "list_contains(items, 'i1') AND list_contains(items, 'i4')"), ("monitor", "i4+i5", "list_contains(items, 'i4') AND list_contains(items, 'i5')"), ("limit", "i3: 40", "list_contains(items, 'i3')"), ("twice", "x: i1,i2", "list_contains(items, 'i1') AND list_contains(items, 'i2')"), ("twice", "y: i3,i4", "list_contains(items, 'i3') AND list_contains(items, 'i4')")]


@query(_STACKS + " UNION ALL ".join(f""" SELECT k AS "user", '{kind}' AS kind, '{what}' AS what FROM u WHERE {when}""" for kind, what, when in _KINDS))
def reco_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rules, pairs = _tables(spark)
    items = spark.createDataFrame([("i1", "x", None), ("i2", "x", None), ("i3", "y", 40), ("i4", "y", None), ("i5", "z", None)], "item string, category string, upper int")
    stack = F.filter(F.array(*[F.lit(i) for i, _, _ in ITEMS]), lambda x: (F.col("user") + F.substring(x, 2, 1).cast("int")) % 3 != 0)
    return ops.combinations(_users(spark, sf_dir).withColumn("stack", stack), items, rules, pairs)


@query("SELECT p_partkey, n * 2 + p_size % 4 AS score, p_size % 4 AS evidence, CAST(row_number() OVER (ORDER BY n * 2 + p_size % 4 DESC, p_size % 4 DESC, p_partkey) AS INTEGER) AS rank FROM part JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def evidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = parquet(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("n"))
    rows = parquet(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("evidence")).join(covered, "p_partkey")
    return ranked(rows.select("p_partkey", (F.col("n") * 2 + F.col("evidence")).alias("score"), "evidence"), [F.desc("score"), F.desc("evidence"), "p_partkey"])


#: The colours of reference.
_PALETTE = [
    ("하양", 245, 245, 245), ("노랑", 245, 208, 51), ("주황", 239, 138, 58), ("분홍", 241, 155, 176), ("빨강", 224, 80, 58), ("갈색", 138, 90, 58),
    ("초록", 58, 168, 115), ("파랑", 58, 123, 213), ("보라", 138, 99, 196), ("회색", 154, 168, 160), ("검정", 51, 51, 51),
]
_NEAR = ", ".join(f"{{'d': (p_partkey * 37 % 256 - {r}) * (p_partkey * 37 % 256 - {r}) + (p_partkey * 91 % 256 - {g}) * (p_partkey * 91 % 256 - {g}) + (p_size * 5 % 256 - {b}) * (p_size * 5 % 256 - {b}), 'i': {i}, 'name': '{n}'}}" for i, (n, r, g, b) in enumerate(_PALETTE))


@query(f"SELECT p_partkey, list_sort([{_NEAR}])[1].name AS name FROM part")
def nearest_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return parquet(spark, sf_dir, "part").select(k, ops.nearest([k * 37 % 256, k * 91 % 256, size * 5 % 256], _PALETTE).alias("name"))


_SOURCES = [("A", "s1"), ("B", "s2"), ("C", None)]


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'catalogue one' WHEN 1 THEN 'catalogue two' ELSE 'C' END AS label, CASE p_size % 3 WHEN 0 THEN 'https://one.example' WHEN 1 THEN 'https://two.example' END AS url FROM part")
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame(_SOURCES, "type string, source string")
    catalogue = spark.createDataFrame([("s1", "catalogue one", "https://one.example"), ("s2", "catalogue two", "https://two.example")], "source string, name string, url string")
    rows = parquet(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_size"), ["A", "B", "C"]).alias("type"))
    return ops.with_catalogue(rows, types, catalogue).select("p_partkey", "label", "url")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'strong' ELSE 'some' END AS best, array_to_string(list_filter([CASE WHEN c_custkey % 4 <> 0 THEN 'smoking' END, CASE WHEN c_custkey % 5 > 1 THEN 'drinking' END], lambda x: x IS NOT NULL), ',') AS notes, CASE c_custkey % 3 WHEN 0 THEN 'unset' WHEN 1 THEN 'daily 400' ELSE 'daily 400 · most 900' END AS dose FROM customer")
def profile_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    benefits = F.array(F.struct(F.lit("weak").alias("name"), F.lit("limited").alias("strength")), F.struct(F.lit("some").alias("name"), F.lit("moderate").alias("strength")), F.struct(F.when(k % 3 == 0, "strong").otherwise("later").alias("name"), F.when(k % 3 == 0, "established").otherwise("moderate").alias("strength")))
    lifestyle = F.create_map(F.lit("smoking"), F.when(k % 4 == 0, "none").otherwise("daily"), F.lit("drinking"), F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, "none").otherwise("often"))
    dose = ops.dose_line(F.when(k % 3 == 0, ops.UNSET).otherwise("400"), F.when(k % 3 == 2, "900"))
    return parquet(spark, sf_dir, "customer").select(k, ops.top_benefit(benefits)["name"].alias("best"), F.array_join(ops.lifestyle_notes(lifestyle, {"smoking": "smoking", "drinking": "drinking"}), ",").alias("notes"), dose.alias("dose"))


@query("SELECT c_custkey, 'concern ' || c || '' AS label FROM customer, (VALUES ('c1', 2), ('c3', 5)) t(c, m) WHERE c_nationkey % m = 0 AND c_custkey % 7 = 0")
def concerns_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir).where("array_contains(drugs, 'd1')")  # only who takes a mapped drug
    asked = users.select(F.col("user").alias("c_custkey"), F.explode("concerns").alias("concern"))
    covering = _tables(spark)[1].where(F.array_contains("items", "i1")).select("concern", F.concat(F.lit("concern "), "concern").alias("label"))
    return asked.join(small(covering), "concern").select("c_custkey", "label")


@query("SELECT c_custkey, array_to_string(list_filter(['i1', 'i4', 'i5'], lambda x: x = 'i4' AND c_custkey % 2 = 0 OR x = 'i5' AND c_custkey % 2 = 1), ',') AS clashes FROM customer")
def static_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.array(F.lit("i1"), F.when(F.col("c_custkey") % 2 == 0, "i4").otherwise("i5"))
    return parquet(spark, sf_dir, "customer").select("c_custkey", F.array_join(ops.conflicts_with(F.lit("i1"), taken, {"i1": ["i4", "i5"], "i4": ["i1"]}), ",").alias("clashes"))


@query("""SELECT "user", item, excluded, warnings FROM (SELECT c_custkey AS "user", 'i1' AS item, NULL AS excluded, 'take care' AS warnings FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'i2', 'not with d2', 'again' FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'i2', 'not with d2', '' FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0
UNION ALL SELECT c_custkey, 'i2', NULL, 'again' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, 'i4', NULL, 'ask first' FROM customer WHERE c_custkey % 11 = 0)""")
def reco_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings behind an exclusion are not given, those before it are."""
    rules = spark.createDataFrame([*RULES, (0, "d1", "warn", "again", ["i2"]), (9, "d2", "warn", "too late", ["i2"])], "ord int, drug string, action string, message string, items array<string>")
    return ops.drug_actions(_users(spark, sf_dir), rules).select("user", "item", "excluded", F.array_join("warnings", ",").alias("warnings"))

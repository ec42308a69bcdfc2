"""Queries over pages and files that are cut from a table, landed and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.book import Book
from tidemill.sources.paged import land, paged
from tidemill.sources.tables import fresh_path, json_rows_or, parquet

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles

ROWS = 5000
_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, page int"


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Orders as pages of 5000 keys."""
    path = fresh_path(spark, "pages")
    rows = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", (F.floor((F.col("o_orderkey") - 1) / ROWS) + 1).cast("int").alias("page"))
    land(rows, path)
    return path


_PAGES = f"WITH p AS (SELECT *, CAST(floor((o_orderkey - 1) / {ROWS}) + 1 AS INTEGER) AS page FROM orders), n AS (SELECT min(n) AS none FROM (SELECT unnest(range(1, (SELECT max(page) + 2 FROM p))) AS n) WHERE n NOT IN (SELECT page FROM p))"


@query(f"{_PAGES} SELECT o_orderkey, o_custkey, page FROM p, n WHERE page < none AND page >= 1 AND page <> 2 AND o_orderstatus = 'F' AND o_totalprice > 1000")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages up to the first that is empty; the second page is not opened, and status and price are compared where a page is read."""
    path = _landed(spark, sf_dir)
    some = lambda pages: paged(spark, path, _ORDERS).where(f"{pages} and o_orderstatus = 'F' and o_totalprice > 1000").select("o_orderkey", "o_custkey", "page")
    return some("page > 2").unionByName(some("page = 1"))


@query(
    "WITH c AS (SELECT c_custkey, c_acctbal, c_custkey // 50 AS pack FROM customer) SELECT pack, false AS fell_back, c_custkey, c_acctbal FROM c WHERE pack % 5 IN (1, 2, 3)"
    " UNION ALL SELECT DISTINCT pack, true, -1, NULL FROM c WHERE pack % 5 IN (0, 4)"
)
def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of fifty customers each, as arrays or under a name; some are cut off or no JSON at all, and give a row of their own."""
    packs = parquet(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 50).cast("bigint").alias("pack")).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("rows"))
    kind, rows = F.col("pack") % 5, F.col("rows")
    text = F.when(kind == 0, F.left(rows, F.length(rows) - 10)).when(kind == 1, F.concat(F.lit('{"posts":'), rows, F.lit("}"))).when(kind == 2, F.concat(F.lit(' {"more":1,"items":'), rows, F.lit("}"))).when(kind == 3, rows).otherwise("no rows today")
    path = fresh_path(spark, "files")
    packs.select("pack", text.alias("value")).write.partitionBy("pack").text(path)
    found = spark.read.schema("value string, pack bigint").text(path, wholetext=True)
    none = F.array(F.struct(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit(None).cast("double").alias("c_acctbal")))
    return json_rows_or(found, "value", "c_custkey bigint, c_acctbal double", none).select("pack", "fell_back", "c_custkey", "c_acctbal")

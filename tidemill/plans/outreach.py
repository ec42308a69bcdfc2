"""Queries over contacts, which are customers with fields derived from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import outreach as ops
from tidemill.operators import upserts
from tidemill.plans.book import Book, pick, pick_sql
from tidemill.sources.tables import matching, parquet

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles

AT = "2024-01-30T12:34:56.789Z"
TYPES = [*ops.TYPES, "other", ""]
STATUSES = [*ops.STATUSES, "unknown", ""]
SITES = ["https://one.example/", "http://two.example", "ftp://three.example", "four", "", "https://five.example/x?y"]
DATES = ["1996-06-30", "1996-07-01T10:00:00", "soon", "", "1995-01-15"]

_CONTACTS = f"SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 17 = 0 THEN chr(9) || chr(160) || ' ' ELSE c_name || ' ' || c_mktsegment || chr(10) END AS name, {pick_sql('c_custkey', TYPES)} AS type, {pick_sql('c_custkey', STATUSES)} AS status, {pick_sql('c_custkey', SITES)} AS site, {pick_sql('c_custkey', DATES)} AS next_at FROM customer"
_ERRORS = f"""list_filter([CASE WHEN trim(name, '{text.WHITE}') = '' THEN 'name' END, CASE WHEN type <> '' AND type NOT IN {ops.TYPES} THEN 'type' END, CASE WHEN status <> '' AND status NOT IN {ops.STATUSES} THEN 'status' END,
CASE WHEN site <> '' AND NOT regexp_matches(site, '(?i)^\\s*https?:/*[^/?#\\s]') THEN 'site' END, CASE WHEN next_at <> '' AND NOT regexp_matches(next_at, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'nextAt' END], lambda x: x IS NOT NULL)"""


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    fields = {"id": F.when(k % 4 == 0, "").otherwise(k.cast("string")), "name": F.when(k % 17 == 0, "\t\u00a0 ").otherwise(F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("\n"))), "type": pick(k, TYPES), "status": pick(k, STATUSES), "site": pick(k, SITES), "next_at": pick(k, DATES)}
    return parquet(spark, sf_dir, "customer").select(k.alias("k"), *[v.alias(n) for n, v in fields.items()])


@query(f"SELECT k, array_to_string({_ERRORS}, ',') AS errors, len({_ERRORS}) = 0 AS ok FROM ({_CONTACTS})")
def contact_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = ops.contact_errors(*[F.col(c) for c in ("name", "type", "status", "site", "next_at")])
    return _contacts(spark, sf_dir).select("k", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("ok"))


_SLUG = f"left(regexp_replace(regexp_replace(lower(trim(name, '{text.WHITE}')), " + "'[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 24)"


@query(
    f"SELECT CASE WHEN id = '' THEN 'oc_' || {_SLUG} || '_20240130123456' ELSE id END AS id, trim(name, '{text.WHITE}') AS name, CASE WHEN type = '' THEN 'guestpost' ELSE type END AS type, CASE WHEN status = '' THEN 'lead' ELSE status END AS status, site, left(next_at, 10) AS next_at FROM ({_CONTACTS}) WHERE len({_ERRORS}) = 0"
)
def contacts_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.normal_contacts(_contacts(spark, sf_dir), AT)


@query(
    "SELECT count(*) AS total, count(*) - count(*) FILTER (status IN ('declined', 'archived')) AS active, count(*) FILTER (status IN ('published', 'maintained')) AS acquired, "
    + ", ".join([f"count(*) FILTER (status = '{s}') AS {s}" for s in ops.STATUSES] + [f"count(*) FILTER (type = '{t}') AS {t}" for t in ops.TYPES])
    + f" FROM ({_CONTACTS})"
)
def contact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(_contacts(spark, sf_dir))


@query(f"SELECT k, status, left(next_at, 10) AS due_on, CAST(row_number() OVER (ORDER BY left(next_at, 10), k) AS INTEGER) AS rank FROM ({_CONTACTS}) WHERE regexp_matches(next_at, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND status NOT IN ('declined', 'archived') AND left(next_at, 10) <= '1996-06-30'")
def contact_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contacts(spark, sf_dir).where(F.col("next_at").rlike(r"^\d{4}-\d{2}-\d{2}")).withColumn("due_on", F.left("next_at", F.lit(10)))
    due = upserts.due(rows.withColumn("day", F.to_date("due_on")), "day", "1996-06-30", ~F.col("status").isin(*ops.TERMINAL))
    return upserts.ranked(due, ["due_on", "k"]).select("k", "status", "due_on", "rank")


@query(f"SELECT k, status, name FROM ({_CONTACTS}) WHERE k % 3 <> 0 UNION ALL SELECT -1, CAST(count(*) AS VARCHAR), 'removed' FROM customer WHERE c_custkey % 3 = 0")
def contact_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = _contacts(spark, sf_dir)
    kept, removed = upserts.delete_reporting(contacts, contacts.where("k % 3 = 0"), ["k"])
    return kept.select("k", "status", "name").unionByName(removed.agg(F.lit(-1).cast("bigint").alias("k"), F.count("*").cast("string").alias("status"), F.lit("removed").alias("name")))


@query(f"SELECT k, 'email=&name=' || url_encode(name) || '&type=' || type AS form FROM ({_CONTACTS})")
def contact_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.functions.markup import query_string

    fields = F.create_map(F.lit("name"), F.col("name"), F.lit("type"), F.col("type"), F.lit("email"), F.lit(None).cast("string"))
    return _contacts(spark, sf_dir).select("k", query_string(fields).alias("form"))


@query(f"SELECT k FROM ({_CONTACTS}) WHERE type = 'pr' AND status = 'lead'")
def contact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_contacts(spark, sf_dir), {"type": "pr", "status": "lead", "site": "", "id": None}).select("k")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND p_size = 7")
def pill_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name in part and a size; of four filters one at least is asked for, the type is a fifth that does not count."""
    wanted = {"p_name": " RED ", "p_brand": "", "p_size": 7, "p_partkey": None, "p_type": ""}
    return matching(parquet(spark, sf_dir, "part"), wanted, within=("p_name",), counted=("p_name", "p_brand", "p_size", "p_partkey")).select("p_partkey")


_PHONES = "CASE c_custkey % 3 WHEN 0 THEN '+82 10-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-5678' WHEN 1 THEN '010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-1234' ELSE '(02) 555 ' || c_custkey END"


@query(f"SELECT c_custkey, regexp_replace(regexp_replace({_PHONES}, '[^0-9]', '', 'g'), '^82', '0') AS phone, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE contains(lower(c_name), 'customer#00000000' || c_custkey % 5) END AS mentioned FROM customer")
def contact_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    phone = F.when(k % 3 == 0, F.concat(F.lit("+82 10-"), four, F.lit("-5678"))).when(k % 3 == 1, F.concat(F.lit("010-"), four, F.lit("-1234"))).otherwise(F.concat(F.lit("(02) 555 "), k.cast("string")))
    name = F.when(k % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("CUSTOMER#00000000"), (k % 5).cast("string")))
    return parquet(spark, sf_dir, "customer").select("c_custkey", text.phone_digits(phone).alias("phone"), text.mentions(F.col("c_name"), name).alias("mentioned"))

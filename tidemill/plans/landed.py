"""Queries over landed service answers: searches, registries, offers, measurements, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import landed as ops
from tidemill.operators.upserts import ranked
from tidemill.plans.book import Book, pick, pick_sql
from tidemill.sources.tables import files, first_of, fresh_path, image_kind, kept, parquet, sitemap

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles


@query("SELECT l_returnflag, l_linestatus, clicks, impressions, round(CASE WHEN impressions = 0 THEN 0 ELSE clicks / impressions END, 6) AS ctr FROM (SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS clicks, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS impressions FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2) ORDER BY clicks DESC, l_returnflag, l_linestatus LIMIT 25")
def search_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "lineitem").where("l_shipdate >= '1996-01-01' and l_shipdate < '1998-01-01'")
    return ops.search_rows(rows, ["l_returnflag", "l_linestatus"], F.col("l_linenumber").cast("bigint"), F.col("l_quantity").cast("bigint"))


_PSI = """'{"lighthouseResult":{"categories":{"performance":{"score":' || (c_custkey % 101) / 100.0 || '}' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"seo":{"score":' || (c_custkey % 11) / 10.0 || '}' END || '},"audits":{"largest-contentful-paint":{"numericValue":' || c_custkey * 3 || '}}}}'"""


@query("SELECT c_custkey, CAST(floor((c_custkey % 101) / 100.0 * 100 + 0.5) AS BIGINT) AS performance, CASE WHEN c_custkey % 3 <> 0 THEN CAST(floor((c_custkey % 11) / 10.0 * 100 + 0.5) AS BIGINT) END AS seo, CAST(c_custkey * 3 AS DOUBLE) AS lcp, CAST(NULL AS DOUBLE) AS cls FROM customer")
def page_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    seo = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(',"seo":{"score":'), ((k % 11) / 10.0).cast("string"), F.lit("}")))
    doc = F.concat(F.lit('{"lighthouseResult":{"categories":{"performance":{"score":'), ((k % 101) / 100.0).cast("string"), F.lit("}"), seo, F.lit('},"audits":{"largest-contentful-paint":{"numericValue":'), (k * 3).cast("string"), F.lit("}}}}"))
    v = F.try_parse_json(doc)
    percent = lambda path: F.floor(F.try_variant_get(v, path, "double") * 100 + 0.5)
    number = lambda name: F.try_variant_get(v, f"$.lighthouseResult.audits['{name}'].numericValue", "double")
    root = "$.lighthouseResult.categories"
    return parquet(spark, sf_dir, "customer").select("c_custkey", percent(f"{root}.performance.score").alias("performance"), percent(f"{root}.seo.score").alias("seo"), number("largest-contentful-paint").alias("lcp"), number("cumulative-layout-shift").alias("cls"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ') || [p_type]) AS word FROM part")
def autocomplete_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.array(F.transform(F.split("p_name", " "), lambda w: F.array(w)), F.array(F.array("p_type"))))
    nested = F.from_json(doc, "array<array<array<string>>>")
    return parquet(spark, sf_dir, "part").select("p_partkey", F.explode(F.flatten(F.flatten(nested))).alias("word"))


@query("SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderdate >= TIMESTAMP '1997-06-30' AND o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY 1, 2")
def keyword_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parquet(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    kind = dict(orders.dtypes)["o_orderdate"]
    inside = orders.where((F.col("o_orderdate") >= F.add_months(F.lit("1998-06-30").cast("date"), -12).cast(kind)) & (F.col("o_orderdate") <= F.lit("1998-06-30").cast("date").cast(kind)))
    return inside.groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS total, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey)[:3], ',') AS latest FROM orders GROUP BY 1")
def search_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    rows = parquet(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("rn"), F.count("*").over(w).alias("total"))
    latest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col("o_orderkey").cast("string").alias("k")))), lambda x: x["k"]), ",")
    return rows.where("rn <= 3").groupBy("o_custkey").agg(F.first("total").alias("total"), latest.alias("latest"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 3000 ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 30")
def offers_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "lineitem").where("l_extendedprice >= 3000").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy("l_extendedprice", "l_orderkey", "l_linenumber").limit(30)


@query(
    "SELECT 'a' AS source, p_name AS name, p_brand AS brand FROM part UNION ALL SELECT 'b', CASE WHEN s_suppkey % 3 = 0 THEN 'alt ' || s_suppkey ELSE s_name END, '' FROM supplier WHERE s_suppkey % 7 <> 0 OR s_suppkey % 3 = 0 UNION ALL SELECT 'c', c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0"
)
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = parquet(spark, sf_dir, "part").select(F.col("p_name").alias("fullName"), F.lit("").alias("productName"), F.col("p_brand").alias("brandName"))
    k = F.col("s_suppkey")
    b = parquet(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, F.lit("")).when(k % 7 == 0, F.lit(None)).otherwise(F.col("s_name")).alias("PRDLST_NM"), F.when(k % 3 == 0, F.concat(F.lit("alt "), k.cast("string"))).alias("itemName"), F.lit("").alias("BSSH_NM"))
    c = parquet(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("product_name"), F.lit(None).cast("string").alias("company_name"), F.col("c_mktsegment").alias("companyName"))
    return ops.registry_products([("a", a, ["fullName", "productName"], ["brandName"]), ("b", b, ["PRDLST_NM", "itemName"], ["BSSH_NM"]), ("c", c, ["product_name"], ["company_name", "companyName"])])


@query("SELECT user_id, event_type, n, total, CAST(rank AS INTEGER) AS rank FROM (SELECT *, sum(n) OVER (PARTITION BY user_id)::BIGINT AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE rank <= 6")
def reactions_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    counts = parquet(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "event_type"))}).where("rank <= 6")


@query("SELECT CAST(rank AS INTEGER) AS rank, l_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY best DESC, l_partkey) AS rank FROM (SELECT l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) ORDER BY rank LIMIT 20) LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) ON l_partkey = p_partkey")
def literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = parquet(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("best")).orderBy(F.desc("best"), "l_partkey").limit(20)
    ids = top.select("l_partkey", F.row_number().over(Window.orderBy(F.desc("best"), "l_partkey")).alias("rank"))  # 20 rows
    names = parquet(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return ops.summaries_in_order(ids, names, "l_partkey").select("rank", "l_partkey", "p_name")


@query("SELECT event_id, page FROM (SELECT event_id, event_id // 50 + 1 AS page FROM events WHERE NOT event_id BETWEEN 600 AND 649) WHERE page <= 50 AND page < 13")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "events").where("not event_id between 600 and 649").select("event_id", F.floor(F.col("event_id") / 50 + 1).alias("page"))
    return ops.pages_until_empty(rows, "page", 50)


@query("SELECT n_nationkey, s_suppkey, false AS sampled FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 UNION ALL SELECT n_nationkey, -1, true FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parquet(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    sample = parquet(spark, sf_dir, "nation").select("n_nationkey", F.lit(-1).cast("bigint").alias("s_suppkey"))
    return ops.or_sample(found, sample, "n_nationkey")


@query("SELECT source, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM documents) WHERE rank <= 3")
def latest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return parquet(spark, sf_dir, "documents").select("source", "doc_id", rank.alias("rank")).where("rank <= 3")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 ELSE 3 END AS dailyCount, CASE WHEN c_custkey % 3 = 0 THEN 'random' ELSE 'same' END AS timeMode, CASE WHEN c_custkey % 2 = 0 THEN 'primary' WHEN c_custkey % 3 = 0 THEN 'secondary' ELSE 'default' END AS source FROM customer")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    primary = F.from_json(F.when(k % 2 == 0, F.concat(F.lit('{"dailyCount":'), (k % 9).cast("string"), F.lit("}"))), "dailyCount bigint, timeMode string")
    secondary = F.from_json(F.when(k % 3 == 0, F.lit('{"timeMode":"random"}')), "dailyCount bigint, timeMode string")
    _, source = first_of(("primary", primary["dailyCount"]), ("secondary", secondary["timeMode"]), ("default", F.lit(1)))
    merged = lambda name, other: F.coalesce(primary[name], secondary[name], F.lit(other))
    return parquet(spark, sf_dir, "customer").select("c_custkey", merged("dailyCount", 3).alias("dailyCount"), merged("timeMode", "same").alias("timeMode"), source.alias("source"))


@query("SELECT page_id, md5(html) AS text_md5, sha1(html) AS version FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE page_id % 4 = 0")
def remote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("page_id") % 4 != 0, F.base64(F.col("html").cast("binary")))
    return ops.decoded_files(parquet(spark, sf_dir, "pages").select("page_id", body.alias("body"))).select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "version")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS price, p_partkey % 3 = 0 AS live FROM part")
def offers_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parquet(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    return ops.live_or_sample(part, part.where("p_partkey % 3 = 0").withColumn("price", F.col("price") * 2), "p_partkey", "price")


_RING = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|7'), doc_id) AS n, count(*) OVER (PARTITION BY source) AS size FROM documents"


@query(f"WITH r AS ({_RING}) SELECT a.doc_id, b.doc_id AS other, CAST(i AS INTEGER) AS rank FROM r a, range(1, 4) g(i), r b WHERE b.source = a.source AND i < a.size AND b.n = (a.n - 1 + i) % a.size + 1")
def related_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.related_rows(parquet(spark, sf_dir, "documents"), "doc_id", "source", seed=7)


@query("SELECT page_id, array_to_string(list_distinct(regexp_extract_all(upper(left(url, 60)), '[A-Z0-9]{2,}'))[:0], ' ') || array_to_string(list_filter(regexp_extract_all(upper(url), '[A-Z0-9]{2,}'), lambda x, i: list_position(regexp_extract_all(upper(url), '[A-Z0-9]{2,}'), x) = i)[:6], ' ') AS imprint FROM pages")
def imprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "pages").select("page_id", text.imprint_tokens(F.col("url")).alias("imprint"))


_HOSTS = ["localhost", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.9.9", "169.254.1.1", "8.8.8.8", "box.local", "x.internal", "example.org", "127.0.0.1", "256.1.1.1"]


@query(f"SELECT c_custkey, h AS host, CASE WHEN h IN ('localhost', '0.0.0.0', '::1') OR ends_with(h, '.local') OR ends_with(h, '.internal') THEN true WHEN NOT regexp_matches(h, '^(\\d{{1,3}}\\.){{3}}\\d{{1,3}}$') THEN false ELSE a IN (10, 127, 0) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) END AS blocked FROM (SELECT *, TRY_CAST(string_split(h, '.')[1] AS INTEGER) AS a, TRY_CAST(string_split(h, '.')[2] AS INTEGER) AS b FROM (SELECT c_custkey, {pick_sql('c_custkey', _HOSTS)} AS h FROM customer))")
def blocked_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.content import is_blocked_host

    host = pick(F.col("c_custkey"), _HOSTS)
    return parquet(spark, sf_dir, "customer").select("c_custkey", host.alias("host"), is_blocked_host(host).alias("blocked"))


_MODELS = ["gpt-4o-mini,whisper", "dall-e-3", "gpt-image-1,gpt-4", "tts", ""]


@query(f"SELECT c_custkey, regexp_matches(m, 'gpt-image|dall-e-3') AS image, regexp_matches(m, 'gpt-4o-mini|gpt-4o|gpt-4') AS text FROM (SELECT c_custkey, {pick_sql('c_custkey', _MODELS)} AS m FROM customer)")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.split(pick(F.col("c_custkey"), _MODELS), ",")
    return parquet(spark, sf_dir, "customer").select("c_custkey", F.exists(ids, lambda i: i.rlike("gpt-image|dall-e-3")).alias("image"), F.exists(ids, lambda i: i.rlike("gpt-4o-mini|gpt-4o|gpt-4")).alias("text"))


@query("SELECT '<url><loc>https://x.example/' || replace(lower(p_name), ' ', '%20') || '</loc><lastmod>' || CASE WHEN p_partkey % 2 = 0 THEN '2024-01-02' ELSE '2024-01-30' END || '</lastmod><changefreq>monthly</changefreq><priority>0.7</priority></url>' AS line FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 UNION ALL SELECT '<url><loc>https://x.example/</loc><lastmod>2024-01-30</lastmod></url>'")
def sitemap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("p_partkey"), lambda s: F.lit(s).cast("timestamp")
    posts = parquet(spark, sf_dir, "part").select((k % 3 != 0).alias("published"), F.lower("p_name").alias("slug"), k.cast("string").alias("id"), F.when(k % 5 == 0, at("2024-02-01")).when(k % 5 == 1, at("2024-01-01")).alias("publish_at"), F.when(k % 2 == 0, at("2024-01-02")).alias("updated_at"))
    fixed = spark.createDataFrame([("<url><loc>https://x.example/</loc><lastmod>2024-01-30</lastmod></url>",)], "line string")
    return sitemap(posts, "https://x.example/", "2024-01-30").unionByName(fixed)


@query("SELECT CASE page_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ["89504E470D0A1A0A00000000", "FFD8FFE000104A4649460001", "474946383961010001000000", "524946460000000057454250", "25504446"]
    content = F.unhex(pick(F.col("page_id"), heads))
    return parquet(spark, sf_dir, "pages").select(image_kind(content).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment, count(DISTINCT c_nationkey || c_mktsegment) AS files, 0 AS empty FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of folders with a file for each nation and segment, of which one kind of name is left out."""
    path = fresh_path(spark, "scanned")
    rows = parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    for kind, some in (("json", rows.where("segment <> 'BUILDING'")), ("csv", rows.where("segment = 'BUILDING'"))):
        some.repartition("nation", "segment").write.mode("append").partitionBy("nation", "segment").format(kind).save(path)
    found = files(spark, path, "*.json")
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    return found.groupBy(part("nation").cast("int").alias("nation"), part("segment").alias("segment")).agg(F.count("*").alias("files"), F.count_if(F.length("content") == 0).alias("empty"))


@query("SELECT c_custkey, metres, CAST(row_number() OVER (ORDER BY metres NULLS LAST, c_custkey) AS INTEGER) AS rank FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey * 7919) % 1000 END AS metres FROM customer)")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return ranked(parquet(spark, sf_dir, "customer").select(k, F.when(k % 6 != 0, (k * 7919) % 1000).alias("metres")), [F.asc_nulls_last("metres"), "c_custkey"])


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_type = 'ECONOMY' AND contains(lower(p_name), 'widget')")
def contraindications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "part").where((F.col("p_type") == "ECONOMY") & F.contains(F.lower("p_name"), F.lit("widget"))).select("p_partkey", "p_brand", "p_type")


@query("SELECT c_custkey, CASE i WHEN 0 THEN c_name ELSE '' END AS key, CASE i WHEN 0 THEN c_custkey % 7 ELSE 0 END AS clicks, CASE i WHEN 0 THEN 0 ELSE c_custkey END AS impressions FROM customer, range(0, 2) g(i) WHERE c_custkey % 4 <> 0")
def search_rows_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    doc = F.concat(F.lit('{"rows":[{"keys":["'), "c_name", F.lit('"],"clicks":'), (k % 7).cast("string"), F.lit('},{"impressions":'), k.cast("string"), F.lit("}]}"))
    return parquet(spark, sf_dir, "customer").select(k, F.explode(ops.search_rows_of(F.when(k % 4 == 0, "{}").otherwise(doc))).alias("r")).select("c_custkey", "r.*")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'stores/posts.json' WHEN 1 THEN 'stores/outreach.json' END AS path FROM customer")
def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "customer").select("c_custkey", ops.store_path(pick(F.col("c_custkey"), ["posts", " Outreach", "../secret", ""])).alias("path"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'base,medical,law' ELSE 'base,market' END AS sources, CASE WHEN c_nationkey % 2 = 0 THEN 'm1,m2,m3' ELSE 'm2,m1,m3' END AS chain FROM customer")
def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda *values: F.array(*map(F.lit, values))
    own = F.when(F.col("c_nationkey") % 3 == 0, names("medical", "law")).otherwise(names("market"))
    chain = F.array_distinct(F.concat(F.array(F.when(F.col("c_nationkey") % 2 == 0, "m1").otherwise("m2")), names("m1", "m2", "m3")))
    return parquet(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.concat(names("base"), own), ",").alias("sources"), F.array_join(chain, ",").alias("chain"))


_LAST = "regexp_extract(coalesce(url, ''), '/([^/]*)$', 1)"


@query(f"SELECT page_id, coalesce(TRY_CAST(regexp_extract({_LAST}, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS n, coalesce(TRY_CAST(regexp_extract(substring({_LAST}, 3), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS tail FROM pages")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that the last part of each URL, and what follows its first two characters, begin with."""
    last = F.regexp_extract(F.coalesce("url", F.lit("")), "/([^/]*)$", 1)
    return parquet(spark, sf_dir, "pages").select("page_id", text.first_int(last).alias("n"), text.first_int(F.substring(last, 3, 1 << 20)).alias("tail"))


@query("SELECT user_id, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') AS today FROM events GROUP BY 1")
def scheduled_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.to_date("ts") == F.lit("2024-01-30").cast("date")).alias("today"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'metformin' WHEN '2-HIGH' THEN 'warfarin' END AS name FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def medication_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("1-URGENT", "metformin"), ("2-HIGH", "warfarin")], "o_orderpriority string, name string")
    return ops.mapped_only(parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", names).select("o_orderkey", "name")

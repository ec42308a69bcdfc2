"""Queries over pages and parts as markup: charts, blocks, attributes, structured data, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import markup as ops
from tidemill.functions import scoring, text
from tidemill.plans.book import Book
from tidemill.sources.tables import parquet

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles

_md5 = lambda c: F.md5(c.cast("binary"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "pages").select("page_id", "url", "html")


_ROW = """'<div><span style="width:140px;x">A&amp;' || page_id || ' </span><div style="height:18px;width:' || page_id % 101 || '%"></div></div>'"""
_CHART = f"""'<p>a</p><div style="margin:24px 0">' || repeat({_ROW}, CAST(page_id % 4 AS INTEGER)) || CASE WHEN page_id % 7 = 0 THEN '' ELSE '</div>' END || '<p>tail</p>'"""


def _charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    row = F.concat(F.lit('<div><span style="width:140px;x">A&amp;'), k.cast("string"), F.lit(' </span><div style="height:18px;width:'), (k % 101).cast("string"), F.lit('%"></div></div>'))
    html = F.concat(F.lit('<p>a</p><div style="margin:24px 0">'), F.repeat(row, (k % 4).cast("int")), F.when(k % 7 == 0, "").otherwise("</div>"), F.lit("<p>tail</p>"))
    return _pages(spark, sf_dir).select("page_id", html.alias("html"))


@query(r"""SELECT page_id, 'A&' || page_id AS label, CAST(page_id % 101 AS INTEGER) AS value, CAST(i AS INTEGER) AS pos FROM pages, range(0, 4) g(i) WHERE i < page_id % 4""")
def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charts(spark, sf_dir).select("page_id", F.posexplode(ops.chart_rows(F.col("html"))).alias("pos", "r")).select("page_id", "r.label", "r.value", "pos")


@query(f"SELECT page_id, CASE WHEN page_id % 4 >= 2 AND page_id % 7 <> 0 THEN '<p>a</p><b>new</b><p>tail</p>' ELSE {_CHART} END AS html FROM pages")
def chart_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charts(spark, sf_dir).select("page_id", ops.replace_chart(F.col("html"), F.lit("<b>new</b>")).alias("html"))


_BLOCK = f"""'{ops.REL_START}' || chr(10) || '<aside class="related-posts">' || chr(10) || '<ul>' || chr(10) || '<li><a href="' || replace(url, '&', '&amp;') || '">a &lt; b</a></li>' || chr(10) || '</ul>' || chr(10) || '</aside>' || chr(10) || '{ops.REL_END}'"""


@query(f"SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN regexp_replace(regexp_replace(html, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', '') || chr(10) || chr(10) ELSE regexp_replace(regexp_replace(html, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', '') || chr(10) || {_BLOCK} || chr(10) END) AS html_md5 FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def related_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.array(F.struct(F.col("url").alias("url"), F.lit("a < b").alias("anchor")))
    pages = _pages(spark, sf_dir).where("url is not null and html is not null")
    once = pages.withColumn("html", ops.with_related(F.col("html"), link))  # a page that has the block already gets it once
    none = F.filter(link, lambda _: F.lit(False))
    return once.select("page_id", _md5(ops.with_related(F.col("html"), F.when(F.col("page_id") % 3 == 0, none).otherwise(link))).alias("html_md5"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '\\s{2,}', ' ', 'g')) AS html_md5 FROM pages")
def html_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", _md5(ops.minified(F.col("html"))).alias("html_md5"))


@query("""SELECT page_id, md5(replace(regexp_replace(replace(html, '<p>', '<p style="y">'), '<a (href="[^"]*")>', '<a \\1 style="y">', 'g'), '<div class="ad">', '<div class="ad" style="y">')) AS html_md5 FROM pages""")
def attributes_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style for paragraphs and links, a class where none is, and a style for what has a class."""
    html = F.col("html")
    for tag, name, value in (("p", "style", "y"), ("a", "style", "y"), ("div", "class", "z"), ("div", "style", "y")):
        html = ops.with_attribute(html, tag, name, value)
    return _pages(spark, sf_dir).select("page_id", _md5(html).alias("html_md5"))


@query("""SELECT page_id, '{"@context":"https://schema.org","@type":"Article","headline":"page ' || page_id || '","description":"","keywords":"k","datePublished":"2024-01-30","dateModified":"2024-01-30","author":{"@type":"Organization","name":"n"},"mainEntityOfPage":{"@type":"WebPage","@id":"' || url || '"}}' AS article, 'Home › ' || CASE WHEN page_id % 2 = 0 THEN 'News › ' ELSE '' END || 'page ' || page_id AS trail FROM pages WHERE url IS NOT NULL""")
def article_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    made = ops.article_json(title, F.lit(None).cast("string"), F.lit("k"), F.lit("2024-01-30"), F.lit("n"), F.col("url"))
    trail = ops.breadcrumb(F.when(F.col("page_id") % 2 == 0, "<b>News</b>").otherwise(""), title)
    return _pages(spark, sf_dir).where("url is not null").select("page_id", made.alias("article"), trail.alias("trail"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[' || '{"@type":"Question","name":"What is ' || page_id || '?","acceptedAnswer":{"@type":"Answer","text":"It is a number & more."}},{"@type":"Question","name":"And then?","acceptedAnswer":{"@type":"Answer","text":"Ten letters at least."}}]}' END AS faq FROM pages""")
def faq_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.content import faq

    k = F.col("page_id")
    head = F.when(k % 3 == 0, "<h2>Other</h2>").when(k % 3 == 1, "<h2><b>자주 묻는  질문</b></h2>").otherwise("<h2 class='x'>Our FAQ</h2>")
    body = F.concat(F.lit("<h3>Q. 1. <i>What</i> is "), k.cast("string"), F.lit("</h3> <p>A: It is a number &amp; more.</p><h4>2) And then?</h4><p>Ten letters at least.</p><h3>No</h3><p>too short a question</p><h3>Nothing said</h3><h2>End</h2><h3>Not inside</h3><p>of the part at all</p>"))
    return _pages(spark, sf_dir).select("page_id", faq(F.concat(F.lit("<h2>Start</h2>"), head, body)).alias("faq"))


@query("SELECT page_id, CAST(i AS INTEGER) AS pos, CASE WHEN i = 0 THEN 2 ELSE 3 END AS level, CASE WHEN i = 0 THEN 'Part ' || page_id ELSE 'Sub' END AS text, CASE WHEN i = 0 THEN 'part-' || page_id ELSE 'own' END AS id FROM pages, range(0, 2) g(i)")
def toc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.content import headings

    html = F.concat(F.lit("<h1>x</h1><h2>Part <b>"), F.col("page_id").cast("string"), F.lit('</b></h2><p>t</p><h3 class="c" id="own">Sub</h3>'))
    return _pages(spark, sf_dir).select("page_id", F.posexplode(headings(html)).alias("pos", "h")).select("page_id", "pos", "h.level", "h.text", "h.id")


@query("SELECT p_partkey, 'T ' || p_name AS title, '' AS seo, CASE WHEN p_partkey % 2 = 0 THEN '<p>' || p_type || '</p>' ELSE '' END AS html FROM part")
def delimited_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = [f"<<<{m}>>>" for m in ("TITLE", "SEO", "META", "KEYWORDS", "HTML", "END")]
    raw = F.concat(F.lit("<<<TITLE>>>\n T "), "p_name", F.lit(" \n<<<META>>>m"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<<<HTML>>>\n<p>"), "p_type", F.lit("</p>\n<<<END>>>"))).otherwise(""))
    return parquet(spark, sf_dir, "part").select("p_partkey", *[text.section(raw, m, marks).alias(n) for m, n in ((marks[0], "title"), (marks[1], "seo"), (marks[4], "html"))])


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'q' || p_size END AS question FROM part WHERE p_size % 3 <> 0")
def faq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(F.lit(" "), F.concat(F.lit("q"), F.col("p_size").cast("string")))
    a = F.array(F.lit("x"), F.when(F.col("p_size") % 3 != 0, "said").otherwise(" "))
    return parquet(spark, sf_dir, "part").select("p_partkey", F.explode(ops.faq_rows(q, a)).alias("p")).select("p_partkey", "p.question")


@query("SELECT c_nationkey, array_to_string(list(c_name || ' ' || repeat('★', CAST(c_custkey % 3 + 1 AS INTEGER)) || repeat('☆', CAST(2 - c_custkey % 3 AS INTEGER)) ORDER BY c_acctbal DESC, c_custkey)[:5], chr(10)) AS list, 'morning: ' || coalesce(array_to_string(list(c_custkey ORDER BY c_acctbal DESC, c_custkey) FILTER (c_custkey % 2 = 0 AND rn <= 5), ', '), 'none') AS morning FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) GROUP BY 1")
def message_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    top = parquet(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    line = F.concat("c_name", F.lit(" "), text.stars((F.col("c_custkey") % 3 + 1).cast("int")))
    lists = top.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line"), F.col("c_custkey").alias("k")))).alias("top"))
    morning = F.array_join(F.transform(F.filter("top", lambda x: x["k"] % 2 == 0), lambda x: x["k"].cast("string")), ", ")
    return lists.select("c_nationkey", F.array_join(F.transform("top", lambda x: x["line"]), "\n").alias("list"), F.concat(F.lit("morning: "), F.coalesce(F.nullif(morning, F.lit("")), F.lit("none"))).alias("morning"))


@query("""SELECT r_regionkey, '<script>const DATA = {"name":"' || r_name || '","nations":' || n || '};</script>' AS html FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON r_regionkey = n_regionkey""")
def inlined_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = parquet(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("nations"))
    data = F.to_json(F.struct(F.col("r_name").alias("name"), "nations"))
    return parquet(spark, sf_dir, "region").join(counts, "r_regionkey").select("r_regionkey", F.replace(F.lit("<script>const DATA = __DATA__;</script>"), F.lit("__DATA__"), data).alias("html"))


@query("SELECT page_id, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped, array_to_string(string_split(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), ' ')[:20], ' ') AS intro, CAST(ceil(len(string_split(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) / 200.0) AS BIGINT) AS minutes, round(len(regexp_extract_all(html, '[가-힣]')) / greatest(1, len(regexp_extract_all(html, '[가-힣]')) + len(regexp_extract_all(regexp_replace(html, '<[^>]+>', '', 'g'), '[A-Za-z]'))), 6) AS ours FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("html", "<[^>]+>", " ")
    minutes = F.ceil(F.size(F.split(text.collapse_spaces(plain), " ")) / 200.0)
    return _pages(spark, sf_dir).select("page_id", F.length(text.escape_html(F.col("html"))).alias("escaped"), text.trim_words(plain, 20).alias("intro"), minutes.alias("minutes"), F.round(text.language_ratio(F.col("html")), 6).alias("ours"))


@query("SELECT p_partkey, round(20 + 60 * cos(2 * pi() * (p_partkey % 6) / 6 - pi() / 2) * p_size / 50.0, 6) AS x, round(150 - (150 - 30) * p_size / 50.0, 6) AS y, CAST(floor((1 - p_size / 60.0) * 100 + 0.5) AS BIGINT) AS saved FROM part")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("p_size") / 50.0
    x, _ = scoring.polar(F.col("p_partkey") % 6, F.lit(6), share, 20.0, 60.0)
    return parquet(spark, sf_dir, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(scoring.scaled(F.col("p_size"), 30.0, 150.0, F.lit(50)), 6).alias("y"), F.floor((1 - F.col("p_size") / 60.0) * 100 + 0.5).alias("saved"))


@query("SELECT CAST(o_orderdate AS DATE) AS date, floor(avg(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 101 END) + 0.5)::BIGINT AS performance, greatest(1, max(greatest(o_orderkey % 7, o_custkey % 5))) AS axis FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 3 <> 0) > 0")
def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    days = parquet(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.floor(F.avg(F.when(k % 3 != 0, k % 101)) + 0.5).alias("performance"), F.greatest(F.lit(1), F.max(F.greatest(k % 7, F.col("o_custkey") % 5))).alias("axis"))
    return days.where(F.col("performance").isNotNull()).orderBy("date")


@query("SELECT p_partkey, round((CASE WHEN p_size % 2 = 0 THEN p_size * 0.5 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN p_size * 2 * 0.3 ELSE 0 END + 40 * 0.2) / (CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.3 ELSE 0 END + 0.2), 6) AS overall FROM part")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return parquet(spark, sf_dir, "part").select("p_partkey", F.round(scoring.weighted_mean([(F.when(size % 2 == 0, size), 0.5), (F.when(size % 3 == 0, size * 2), 0.3), (F.lit(40), 0.2)]), 6).alias("overall"))


@query("SELECT l_orderkey, CAST(floor(avg(l_linenumber * 10) + 0.5) AS BIGINT) AS r, CAST(floor(avg(l_quantity) + 0.5) AS BIGINT) AS g, CAST(floor(avg(l_suppkey % 256) + 0.5) AS BIGINT) AS b FROM lineitem WHERE l_partkey % 256 >= 128 OR l_partkey < 128 GROUP BY 1")
def mean_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    opaque = parquet(spark, sf_dir, "lineitem").where("l_partkey % 256 >= 128 or l_partkey < 128")
    mean = lambda c: F.floor(F.avg(c) + 0.5)
    return opaque.groupBy("l_orderkey").agg(mean(F.col("l_linenumber") * 10).alias("r"), mean("l_quantity").alias("g"), mean(F.col("l_suppkey") % 256).alias("b"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[:4], ',') AS flat, CASE WHEN count(*) > 1 THEN list(o_orderkey ORDER BY o_orderkey)[1] || '=' || list(o_orderkey ORDER BY o_orderkey)[2] END AS first_pair, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_orderstatus = 'F') AS all_f FROM orders GROUP BY 1")
def array_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = parquet(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 4).alias("ks"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_f"))
    chunks = F.transform(F.sequence(F.lit(1), F.size("ks"), F.lit(2)), lambda i: F.slice("ks", i, F.lit(2)))
    pair = F.get(F.filter(chunks, lambda c: F.size(c) == 2), F.lit(0))
    return lists.select("o_custkey", F.array_join(F.transform("ks", lambda x: x.cast("string")), ",").alias("flat"), F.array_join(F.transform(pair, lambda x: x.cast("string")), "=").alias("first_pair"), "any_f", "all_f")

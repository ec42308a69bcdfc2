"""HTML and JSON pieces: charts, marker blocks, attributes, structured data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import escape_html, strip_tags, trimmed

#: The marks around a block of related links. A row of a bar chart, and how a chart opens.
REL_START, REL_END = "<!-- related:start -->", "<!-- related:end -->"
CHART_ROW = r"(?s)width:140px[^>]*>([^<]*)</span>.*?height:18px;width:(\d{1,3})%"
CHART_OPEN = '<div style="margin:24px 0">'


def chart_rows(html: Column) -> Column:
    """Labels and values of the bars of a chart."""
    at = lambda group: F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(CHART_ROW), F.lit(group))
    rows = F.transform(F.arrays_zip(at(1).alias("label"), at(2).alias("value")), lambda r: F.struct(trimmed(F.replace(r["label"], F.lit("&amp;"), F.lit("&"))).alias("label"), r["value"].cast("int").alias("value")))
    return F.filter(rows, lambda r: r["label"] != "")


def balanced_end(html: Column, start: Column) -> Column:
    """Where the ``div`` that opens at ``start`` (from 1) is closed: the place behind its end tag; null if it never is.

    Each tag adds or takes one; the first time that nothing is open is the end.
    """
    tail = F.substring(html, start, F.length(html))
    pieces = F.regexp_extract_all(tail, F.lit(r"(?s)(.*?)(<div|</div>)"), F.lit(0))
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.endswith("</div>"), -1).otherwise(1)
        at = acc["at"] + F.length(piece)
        return F.struct(depth.alias("depth"), at.alias("at"), F.coalesce(acc["end"], F.when(depth == 0, at)).alias("end"))

    return start + F.aggregate(pieces, begin, step)["end"]


def replace_chart(html: Column, by: Column, least: int = 2) -> Column:
    """A page with its chart replaced; as it is if it has none with ``least`` bars that is closed."""
    start = F.instr(html, CHART_OPEN)
    end = F.when(start > 0, balanced_end(html, start))
    changed = F.concat(F.substring(html, F.lit(1), start - 1), by, F.substring(html, end, F.length(html)))
    return F.when((F.size(chart_rows(html)) >= least) & end.isNotNull(), changed).otherwise(html)


def without_related(html: Column) -> Column:
    """A page without the block of related links."""
    block = re.escape(REL_START) + r"[\s\S]*?" + re.escape(REL_END)
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), block, ""), r"\n{3,}", "\n\n")


def with_related(html: Column, links: Column) -> Column:
    """A page with one block of related links (structs of url and anchor) at its end, whatever it had before; none for no links."""
    items = F.array_join(F.transform(links, lambda x: F.concat(F.lit('<li><a href="'), escape_html(x["url"]), F.lit('">'), escape_html(x["anchor"]), F.lit("</a></li>"))), "\n")
    block = F.concat(F.lit(f'{REL_START}\n<aside class="related-posts">\n<ul>\n'), items, F.lit(f"\n</ul>\n</aside>\n{REL_END}"))
    base = without_related(html)
    return F.when(F.size(links) == 0, base).otherwise(F.concat(F.regexp_replace(base, r"\s+$", ""), F.lit("\n"), block, F.lit("\n")))


def minified(html: Column) -> Column:
    """Without comments, conditional ones aside, and with single spaces."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--(?!\s*(?:\[if [^\]]+]|<!|>))(?:(?!-->).)*-->", ""), r"\s{2,}", " ")


def with_attribute(html: Column, tag: str, name: str, value: str) -> Column:
    """Adds an attribute to every tag of a kind that does not have it."""
    return F.regexp_replace(html, rf"(?i)<({tag})(?![a-z0-9])((?:(?!\b{name}\s*=)[^>])*)>", f'<$1$2 {name}="{value}">')


def article_json(headline: Column, description: Column, keywords: Column, published: Column, author: Column, url: Column) -> Column:
    """An Article of schema.org as JSON."""
    named = lambda kind, name: F.struct(F.lit(kind).alias("@type"), name.alias("name"))
    page = F.struct(F.lit("WebPage").alias("@type"), url.alias("@id"))
    fields = {"@context": F.lit("https://schema.org"), "@type": F.lit("Article"), "headline": headline, "description": F.coalesce(description, F.lit("")), "keywords": keywords, "datePublished": published, "dateModified": published, "author": named("Organization", author), "mainEntityOfPage": page}
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def faq_rows(questions: Column, answers: Column) -> Column:
    """Pairs of which both sides say something."""
    pairs = F.arrays_zip(questions.alias("question"), answers.alias("answer"))
    return F.filter(pairs, lambda p: (trimmed(F.coalesce(p["question"], F.lit(""))) != "") & (trimmed(F.coalesce(p["answer"], F.lit(""))) != ""))


def breadcrumb(*steps: Column, home: str = "Home", by: str = " › ") -> Column:
    """Home and those steps that are there."""
    return F.concat_ws(by, F.lit(home), *[F.nullif(strip_tags(s), F.lit("")) for s in steps])


def query_string(fields: Column) -> Column:
    """A map as ``key=value`` pairs, percent-encoded, sorted by key."""
    code = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(code(e["key"]), F.lit("="), code(F.coalesce(e["value"], F.lit(""))))), "&")

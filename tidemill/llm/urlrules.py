"""Operator 5: URL rules by host suffixes and path prefixes.

A rule is a host and the start of a path; it fits the host and all its subdomains. Each URL is
expanded into those (host suffix, path prefix) expressions that have as many labels and as many
characters as some rule; expressions meet rules in an equi-join on the first four bytes of
their SHA-256, and the full digest confirms them. Of the rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.tables import small

#: Parts into which the pages of one host and path are dealt at most.
SALTS = 1024
#: Rules of the registered query: (action, rule); a rule's host ends at its first slash.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, *LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as rows: action, rule, host, path, labels, chars, digest, short. Of a rule given twice with both actions, block stays."""
    schema = T.StructType([T.StructField("action", T.StringType()), T.StructField("rule", T.StringType())])
    given = spark.createDataFrame(rules, schema).groupBy("rule").agg(F.max("action").alias("action"))
    cut = F.instr("rule", "/")
    host, path = F.translate(F.substring(F.col("rule"), F.lit(1), cut - 1), *LOWER), F.substring(F.col("rule"), cut, F.length("rule"))
    parts = given.where(cut > 0).select("action", "rule", host.alias("rule_host"), path.alias("rule_path"))
    return with_digest(parts.withColumns({"labels": F.size(F.split("rule_host", r"\.")), "chars": F.length("rule_path")}), F.concat("rule_host", F.lit("\n"), "rule_path"))


#: Rules that are sent to all tasks at most.
RULES_SENT = 100_000


def with_digest(df: DataFrame, expression: Column) -> DataFrame:
    digest = F.sha2(expression, 256)
    return df.withColumns({"digest": digest, "short": F.substring(digest, 1, 8)})


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Returns ``id_col``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` for every row.

    ``rules`` is what ``rule_table`` returns. A null URL or one without ``://`` has an empty host and
    path, which no rule fits. Where no rule fits, ``default`` is the verdict. Of rules of equal length
    the one that sorts last wins. Equal hosts and paths are judged once in each of
    ``SALTS`` parts, so neither a hot page nor the pages without a URL meet in one task; repeated rows of
    ``pages`` give one row each.
    """
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).alias("salt"))
    kinds = sorted({(r.labels, r.chars) for r in rules.select("labels", "chars").distinct().collect()})  # one for each length, not for each rule
    shapes = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(m).alias("chars")) for n, m in kinds or [(0, 0)]])
    labels = F.split("host", r"\.")
    expanded = urls.select("host", "path", "salt").distinct().select("host", "path", "salt", F.explode(shapes).alias("s"), labels.alias("l")).where((F.col("s.labels") <= F.size("l")) & (F.col("s.chars") <= F.length("path")))
    suffix = F.array_join(F.slice("l", F.size("l") - F.col("s.labels") + 1, F.col("s.labels")), ".")
    prefix = F.substring(F.col("path"), F.lit(1), F.col("s.chars"))
    asked = with_digest(expanded.select("host", "path", "salt", suffix.alias("suffix"), prefix.alias("prefix")), F.concat("suffix", F.lit("\n"), "prefix")).alias("u")
    # every URL under a rule has its digest: rules that fit a task are sent to the URLs, longer lists meet them by digest, which Spark cuts where it is hot
    found = asked.join(small(rules, RULES_SENT).alias("r"), "short").where(F.col("u.digest") == F.col("r.digest"))
    best = found.groupBy("host", "path", "salt").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
    return urls.join(best, ["host", "path", "salt"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))

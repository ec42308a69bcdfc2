"""Queries over documents with long lists of phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import phrases as ops
from tidemill.plans.book import Book
from tidemill.sources.tables import parquet

_book = Book()
query = _book.query
QUERIES, ORACLES = _book.queries, _book.oracles


def _word_pairs(spark: SparkSession, sf_dir: str) -> list[str]:
    """All pairs of neighbouring words of the benchmark; refused if they are more than an executor should hold."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    pairs = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.lower(F.concat(w, F.lit(" "), F.get(words, i + 1))))
    found = parquet(spark, sf_dir, "benchmark").select(F.explode(pairs).alias("p")).distinct()
    if (found.agg(F.sum(F.length("p"))).first()[0] or 0) > ops.MOST_CHARS:
        raise ValueError("too many phrases for one list")
    return sorted(r.p for r in found.collect())


@query(
    r"WITH w AS (SELECT string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark), b AS (SELECT DISTINCT lower(w[i] || ' ' || w[i + 1]) AS phrase FROM w, unnest(range(1, len(w))) t(i))"
    " SELECT doc_id, count(*) AS phrases, min(phrase) AS first FROM documents JOIN b ON contains(lower(text), phrase) GROUP BY 1"
)
def phrase_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some thousand phrases each document holds, in one pass over it."""
    found = ops.find_phrases(parquet(spark, sf_dir, "documents"), "text", _word_pairs(spark, sf_dir), ["doc_id"])
    return found.where(F.size("found") > 0).select("doc_id", F.size("found").cast("bigint").alias("phrases"), F.array_min("found").alias("first"))


#: Phrases that hold one another or overlap, not in the order of their length.
RULES = [("the", "a"), ("of the", "of"), ("the best", "good"), ("and the", "plus"), ("in", "within"), ("in the", "inside"), ("ation", "acion"), ("tion", "cion"), ("de la", "del"), ("la", "l'"), ("der", "d."), ("oder", "or"), ("a ", "one ")]


def _replaced() -> str:
    sql = "text"
    for phrase, by in ops.longest_first(RULES):
        sql = f"regexp_replace({sql}, '{phrase}', '{by.replace(chr(39), chr(39) * 2)}', 'gi')"
    return sql


@query(f"SELECT doc_id, md5({_replaced()}) AS replaced_md5 FROM documents")
def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are applied longest phrase first."""
    return ops.replace_phrases(parquet(spark, sf_dir, "documents"), "text", RULES, ["doc_id"]).select("doc_id", F.md5(F.col("replaced").cast("binary")).alias("replaced_md5"))

"""Keyword research: ordered sources, questions and related keywords, rotation, text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import collapse_spaces, is_question, trimmed


def ordered_union(sources: list[tuple[str, DataFrame]], group: str, word: str, pos: str) -> DataFrame:
    """The words of all sources one behind the other: group, word (single spaces), key, ord; of equal words the first stays."""
    parts = [df.select(group, collapse_spaces(F.col(word)).alias("word"), F.struct(F.lit(i).alias("source"), F.col(pos).cast("bigint").alias("pos")).alias("ord")) for i, (_, df) in enumerate(sources)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    keyed = out.withColumn("key", F.lower("word")).where("key <> ''")
    return keyed.groupBy(group, "key").agg(F.min_by("word", "ord").alias("word"), F.min("ord").alias("ord"))


def research(words: DataFrame, group: str, base: Column, questions: int = 8, related: int = 14, region: Column | None = None) -> DataFrame:
    """(group, kind, rank, word): the first ``questions`` questions, then the first ``related`` of all others, in order.

    Questions beyond the limit count as related. Words of 2 to 40 characters other than ``base``, alone or behind the ``region``, take part.
    """
    own = F.lower(collapse_spaces(base))
    asked = own if region is None else F.when(trimmed(region) == "", own).otherwise(F.concat(F.lower(trimmed(region)), F.lit(" "), own))
    usable = words.where(F.length("word").between(2, 40) & (F.col("key") != own) & F.coalesce(F.col("key") != asked, F.lit(True))).withColumn("asks", is_question(F.col("word")))
    nth = F.row_number().over(Window.partitionBy(group, "asks").orderBy("ord"))
    dealt = usable.withColumn("nth", nth).withColumn("kind", F.when(F.col("asks") & (F.col("nth") <= questions), "question").otherwise("related"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(group, "kind").orderBy("ord")))
    return ranked.where((F.col("kind") == "question") | (F.col("rank") <= related)).select(group, "kind", "rank", "word")


def rotated(items: Column, seed: Column) -> Column:
    """A list that starts at another place; shorter lists than two stay."""
    k = F.pmod(seed, F.size(items)).cast("int")
    return F.when(F.size(items) < 2, items).otherwise(F.concat(F.slice(items, k + 1, F.size(items)), F.slice(items, F.lit(1), k)))


def research_block(related: Column, questions: Column, volumes: Column, most: int = 6) -> Column:
    """Lines for a prompt: related words, questions, and the first volumes as ``word (n)``; empty without words.

    ``volumes`` is an array of structs of keyword and volume.
    """
    top = F.transform(F.slice(volumes, 1, most), lambda v: F.concat(v["keyword"], F.lit(" ("), F.format_number(v["volume"], 0), F.lit(")")))
    lines = F.array_compact(F.array(F.when(F.size(related) > 0, F.concat(F.lit("related: "), F.array_join(related, ", "))), F.when(F.size(questions) > 0, F.concat(F.lit("questions: "), F.array_join(questions, " / "))), F.when(F.size(top) > 0, F.concat(F.lit("volumes: "), F.array_join(top, ", ")))))
    return F.when((F.size(related) == 0) & (F.size(questions) == 0), F.lit("")).otherwise(F.array_join(lines, "\n"))


def subtopics(words: DataFrame, group: str, size: int = 6) -> DataFrame:
    """(group, slot, word): the first words of a cluster, its own name left out. ``words``: group, name, word, key, ord."""
    others = words.where(F.col("key") != F.lower(trimmed("name")))
    return others.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy("ord"))).where(F.col("slot") <= size).select(group, "slot", "word")


def merge_prior(new: DataFrame, prior: DataFrame, keys: list[str], word: str, values: list[str]) -> DataFrame:
    """New rows with what an earlier build knew of the same word, whatever its case."""
    norm = lambda c: F.lower(trimmed(F.col(c)))
    known = prior.select(*keys, norm(word).alias("__key"), *[F.col(v).alias(f"__{v}") for v in values])
    joined = new.withColumn("__key", norm(word)).join(known, [*keys, "__key"], "left")
    return joined.select(*new.columns, *[F.col(f"__{v}").alias(v) for v in values])

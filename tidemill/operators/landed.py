"""Scans over landed service answers: field choice, joins by rank, paging, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import trimmed
from tidemill.sources.tables import first_of


def search_rows(df: DataFrame, dims: Sequence[str], clicks: Column, impressions: Column, limit: int = 25) -> DataFrame:
    """Clicks, impressions and their ratio for each combination of ``dims``; the ``limit`` with most clicks."""
    sums = df.groupBy(*dims).agg(F.coalesce(F.sum(clicks), F.lit(0)).alias("clicks"), F.coalesce(F.sum(impressions), F.lit(0)).alias("impressions"))
    ratio = F.coalesce(F.try_divide(F.col("clicks").cast("double"), F.col("impressions").cast("double")), F.lit(0.0))
    return sums.withColumn("ctr", F.round(ratio, 6)).orderBy(F.desc("clicks"), *dims).limit(limit)


def registry_products(sources: list[tuple[str, DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(source, name, brand) over registries whose fields are spelled differently: for each its names and brands, best first; rows without a name go."""
    out = None
    for label, df, names, brands in sources:
        name, _ = first_of(*[(n, F.col(n)) for n in names])
        brand, _ = first_of(*[(b, F.col(b)) for b in brands])
        part = df.select(F.lit(label).alias("source"), name.alias("name"), F.coalesce(brand, F.lit("")).alias("brand")).where("name is not null")
        out = part if out is None else out.unionByName(part)
    return out


def summaries_in_order(ids: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Found ids (``key``, rank) with their summaries, in the order in which they were found; ids without one stay."""
    return ids.join(summaries, key, "left").orderBy("rank")


def pages_until_empty(rows: DataFrame, page: str, most: int = 50) -> DataFrame:
    """Rows of the pages 1, 2, ... up to the first that has none, ``most`` at most."""
    there = rows.where(F.col(page).between(1, most)).select(page).distinct()  # as many rows as pages
    run = there.withColumn("n", F.row_number().over(Window.orderBy(page))).where(F.col(page) == F.col("n")).select(page)
    return rows.join(F.broadcast(run), page, "left_semi")


def or_sample(found: DataFrame, sample: DataFrame, group: str) -> DataFrame:
    """What was found, and the sample of those groups for which nothing was."""
    return found.withColumn("sampled", F.lit(False)).unionByName(sample.join(found.select(group).distinct(), group, "left_anti").select(*found.columns).withColumn("sampled", F.lit(True)))


def decoded_files(files: DataFrame, body: str = "body") -> DataFrame:
    """Files whose base64 body is decoded to ``text`` (null if there is none), with ``version``, the hash of the bytes."""
    raw = F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))
    return files.withColumns({"text": F.decode(raw, "UTF-8"), "version": F.sha1(raw)}).drop(body)


def live_or_sample(rows: DataFrame, live: DataFrame, key: str, price: str) -> DataFrame:
    """Rows whose sample price gives way to a live one; ``live`` says which."""
    fresh = live.select(key, F.col(price).alias("__live"))
    return rows.join(fresh, key, "left").withColumns({price: F.coalesce("__live", price), "live": F.col("__live").isNotNull()}).drop("__live")


#: Rows of one stretch of a ring, about.
STRETCH = 4096


def related_rows(rows: DataFrame, key: str, category: str, seed: int, k: int = 3) -> DataFrame:
    """For each row k others of its category, drawn by a hash with a seed: ``key``, other, rank.

    Members of a category stand on a ring in hash order and everyone takes those behind, so no pairs are made. A ring is cut
    into stretches by the hash; the first rows of each are handed to the stretches before it, so a large category is no task of its own.
    Rows without a category have no others.
    """
    placed = rows.where(F.col(category).isNotNull()).select(key, category, F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")).alias("h"))
    parts = placed.groupBy(F.col(category).alias("__of")).agg((1 + F.floor(F.count("*") / STRETCH)).alias("parts"))
    cut = placed.join(parts, (F.col(category) == F.col("__of"))).withColumn("stretch", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("parts"))).drop("__of", "parts")
    ring = Window.partitionBy(category, "stretch").orderBy("h", key)
    numbered = cut.withColumns({"n": F.row_number().over(ring), **{f"a{i}": F.lead(key, i).over(ring) for i in range(1, k + 1)}})
    first = F.transform(F.array_sort(F.collect_list(F.struct("n", key))), lambda x: x[key])
    heads = numbered.where(F.col("n") <= k).groupBy(category, "stretch").agg(first.alias("heads"))  # k rows a stretch, which has thousands
    along = Window.partitionBy(category).orderBy("stretch")
    some = lambda start: F.slice(F.flatten(F.array_compact(start)), 1, k)
    following = heads.select(F.col(category).alias("__of"), F.col("stretch").alias("__at"), some(F.array(*[F.lead("heads", i).over(along) for i in range(1, k + 1)])).alias("next"))
    starts = heads.withColumn("place", F.row_number().over(along)).where(F.col("place") <= k).groupBy(F.col(category).alias("__ring")).agg(some(F.transform(F.array_sort(F.collect_list(F.struct("place", "heads"))), lambda x: x["heads"])).alias("start"))
    met = numbered.join(following, (F.col(category) == F.col("__of")) & (F.col("stretch") == F.col("__at"))).join(starts, F.col(category) == F.col("__ring"))
    behind = F.array_compact(F.array(*[F.col(f"a{i}") for i in range(1, k + 1)]))
    others = F.slice(F.filter(F.array_distinct(F.concat(behind, "next", "start")), lambda x: x != F.col(key)), 1, k)
    return met.select(key, F.posexplode(others).alias("pos", "other")).select(key, "other", (F.col("pos") + 1).alias("rank"))


#: Kinds of documents a store takes, and where each goes.
STORES = {"posts": "stores/posts.json", "clusters": "stores/clusters.json", "outreach": "stores/outreach.json"}


def store_path(kind: Column) -> Column:
    """The path of a kind of document; null for kinds that are not taken."""
    known = F.create_map(*[F.lit(x) for pair in STORES.items() for x in pair])
    return F.try_element_at(known, F.lower(trimmed(kind)))


def search_rows_of(doc: Column) -> Column:
    """Rows of a search answer in JSON, missing numbers as 0: an array of key, clicks, impressions."""
    parsed = F.from_json(doc, "rows array<struct<keys:array<string>,clicks:bigint,impressions:bigint>>")["rows"]
    rows = F.coalesce(parsed, F.array().cast("array<struct<keys:array<string>,clicks:bigint,impressions:bigint>>"))
    number = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return F.transform(rows, lambda r: F.struct(F.coalesce(F.get(r["keys"], F.lit(0)), F.lit("")).alias("key"), number(r["clicks"]).alias("clicks"), number(r["impressions"]).alias("impressions")))


def mapped_only(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Rows whose key has a name in another service, with it. ``names``: ``key``, name."""
    return rows.join(names, key, "left").where(F.col("name").isNotNull())

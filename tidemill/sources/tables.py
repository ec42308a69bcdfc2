"""Sources and sinks over Spark's readers and writers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_file(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole JSON files of one object or an array each; a path that does not exist gives an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_rows(spark: SparkSession, path: str, row: str, wrappers: Sequence[str] = ("posts", "items")) -> DataFrame:
    """Rows of a JSON file that holds an array, or an object with the array under one of ``wrappers``."""
    fields = T.StructType.fromDDL(row)
    text = spark.read.text(path, wholetext=True)
    whole = T.ArrayType(fields)
    bare = F.from_json("value", whole)
    wrapped = [F.from_json("value", T.StructType([T.StructField(w, whole)]))[w] for w in wrappers]
    chosen = F.when(F.ltrim("value").startswith("["), bare).otherwise(F.coalesce(*wrapped))
    return text.select(F.inline(chosen))


def json_rows_or(texts: DataFrame, body: str, row: str, fallback: Column, wrappers: Sequence[str] = ("posts", "items")) -> DataFrame:
    """Rows of files of JSON, one file in each row of ``texts``, with ``fell_back``: files that are no JSON, or hold no rows where ``json_rows`` looks for them, give those of ``fallback``.

    ``fallback`` is an array of the fields of ``row``. Columns of ``texts`` other than ``body`` are kept, so a sum over ``fell_back`` counts the broken files.
    """
    whole = T.ArrayType(T.StructType.fromDDL(row))
    wrapped = [F.from_json(body, T.StructType([T.StructField(w, whole)]))[w] for w in wrappers]
    read = F.when(F.ltrim(body).startswith("["), F.from_json(body, whole)).otherwise(F.coalesce(*wrapped))
    good = F.when(F.try_parse_json(body).isNotNull(), read)
    rows = texts.withColumn("__rows", good).withColumn("fell_back", F.col("__rows").isNull())
    kept_columns = [c for c in texts.columns if c != body]
    return rows.select(*kept_columns, "fell_back", F.inline(F.coalesce("__rows", fallback.cast(whole.simpleString()))))


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files below a folder by name pattern: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def image_kind(content: Column) -> Column:
    """png, jpg, webp, gif or null by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif").when(head.startswith("52494646") & head.endswith("57454250"), "webp")


def first_of(*choices: tuple[str, Column]) -> tuple[Column, Column]:
    """The first value that is neither null nor empty, and the name of its source."""
    filled = lambda c: F.when(c.cast("string") != "", c)
    value = F.coalesce(*[filled(c) for _, c in choices])
    source = F.coalesce(*[F.when(filled(c).isNotNull(), F.lit(name)) for name, c in choices])
    return value, source


def matching(df: DataFrame, wanted: dict[str, object], at_least: int = 1, within: Sequence[str] = (), counted: Sequence[str] | None = None) -> DataFrame:
    """Rows that equal all given values, or hold them in the columns of ``within``, whatever the case.

    Empty values ask nothing, and fewer than ``at_least`` that ask are refused; only those of ``counted`` count, where it is given.
    """
    asked = {k: v for k, v in wanted.items() if v is not None and str(v).strip() != ""}
    if len([k for k in asked if counted is None or k in counted]) < at_least:
        raise ValueError(f"at least {at_least} filter is needed")
    for k, v in asked.items():
        df = df.where(F.contains(F.lower(F.col(k)), F.lit(str(v).strip().lower())) if k in within else F.col(k) == v)
    return df


def sitemap(posts: DataFrame, base: str, as_of: str) -> DataFrame:
    """One ``<url>`` element a published post with a slug or an id whose time has come: place, last change, priority.

    ``posts``: published, slug, id, publish_at, updated_at.
    """
    ready = posts.where(F.col("published") & (F.col("publish_at").isNull() | (F.col("publish_at") <= F.lit(as_of).cast("timestamp"))))
    name, _ = first_of(("slug", F.col("slug")), ("id", F.col("id")))
    place = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    line = F.concat(F.lit(f"<url><loc>{base}"), place, F.lit("</loc><lastmod>"), F.coalesce(F.date_format("updated_at", "yyyy-MM-dd"), F.lit(as_of[:10])), F.lit("</lastmod><changefreq>monthly</changefreq><priority>0.7</priority></url>"))
    return ready.where(name.isNotNull()).select(line.alias("line"))


def overwrite(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replaces a table; with ``by`` only the partitions that ``df`` has."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has used in the folder in ``spark.checkpoint.dir``.

    On one machine a temporary folder serves where none is named; a cluster must name one that all machines share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it again, which cuts its lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A broadcast of a table that has ``most`` rows at most; a larger one as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

"""A paged service answer as a Spark data source: one partition a page, up to the first page that is empty.

Pages are landed as folders ``page=1``, ``page=2``, ... of JSON lines, as Spark writes them. Sizes of files alone tell
where the pages end. Filters on ``page`` keep pages from being opened; comparisons of other columns are made where a page is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COMPARE = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}


class Page(ds.InputPartition):
    """A page: its number, its files and how many of its rows count."""

    def __init__(self, number: int, files: list[str], most: int | None) -> None:
        self.number, self.files, self.most = number, files, most


class PageReader(ds.DataSourceReader):
    """Reads pages; the filters it takes over are those it can make itself."""

    def __init__(self, schema: StructType, path: str, pages: int | None, limit: int | None, page_rows: int | None) -> None:
        self.schema, self.path, self.pages, self.limit, self.page_rows = to_arrow_schema(schema), path, pages, limit, page_rows
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (*COMPARE, ds.In, ds.IsNotNull)) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def holds(self, f: ds.Filter, values: pa.Array) -> pa.Array:
        """Which values a filter lets through."""
        if isinstance(f, ds.IsNotNull):
            return pc.is_valid(values)
        if isinstance(f, ds.In):
            return pc.is_in(values, pa.array(f.value, values.type))
        return pc.fill_null(COMPARE[type(f)](values, pa.scalar(f.value, values.type)), False)

    def partitions(self) -> Sequence[Page]:
        store, folder = fs.FileSystem.from_uri(self.path)
        files: dict[int, list[str]] = {}
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
            if info.size and (m := re.search(r"/page=(\d+)/[^/_.][^/]*$", info.path)):
                files.setdefault(int(m[1]), []).append(info.path)
        out, number, left = [], 1, self.limit
        while number in files and (self.pages is None or number <= self.pages) and (left is None or left > 0):
            asked = all(self.holds(f, pa.array([number], pa.int32()))[0].as_py() for f in self.filters if f.attribute == ("page",))
            if asked:
                out.append(Page(number, sorted(files[number]), left))
            if left is not None and self.page_rows:
                left -= self.page_rows
            number += 1
        return out

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no page is asked for
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        left = partition.most
        fields = [f for f in self.schema if f.name != "page"]
        for name in partition.files:
            with store.open_input_stream(name) as data:
                table = json.read_json(data, parse_options=json.ParseOptions(explicit_schema=pa.schema(fields), unexpected_field_behavior="ignore"))
            if left is not None:
                table = table.slice(0, left)
                left -= table.num_rows
            table = table.append_column("page", pa.array([partition.number] * table.num_rows, pa.int32())).select(self.schema.names)
            for f in self.filters:
                table = table.filter(self.holds(f, table.column(f.attribute[0])))
            yield from table.cast(self.schema).to_batches()


class PagedSource(ds.DataSource):
    """Format ``tidemill_pages``; options path, pages (how many at most), limit (rows at most, in page order) and page_rows (rows of a whole page)."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_pages"

    def reader(self, schema: StructType) -> PageReader:
        number = lambda key: int(self.options[key]) if key in self.options else None
        return PageReader(schema, self.options["path"], number("pages"), number("limit"), number("page_rows"))


def paged(spark: SparkSession, path: str, schema: str, pages: int | None = None, limit: int | None = None, page_rows: int | None = None) -> DataFrame:
    """The rows of the pages 1, 2, ... up to the first that has none; ``schema`` with ``page int``.

    Spark keeps one set of filters for what one call returns, so a plan that filters pages in two ways calls twice.
    ``limit`` needs ``page_rows``, the rows of a page other than the last; it counts before any filter. Turns on filters for Python sources in the session.
    """
    if limit is not None and not page_rows:
        raise ValueError("limit needs page_rows")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    asked = {"pages": pages, "limit": limit, "page_rows": page_rows}
    return spark.read.format("tidemill_pages").schema(schema).options(**{k: v for k, v in asked.items() if v is not None}).option("path", path if "://" in path else f"file://{path}").load()


def land(df: DataFrame, path: str, page: str = "page") -> None:
    """Writes rows as pages by their number."""
    df.repartition(page).write.partitionBy(page).json(path)

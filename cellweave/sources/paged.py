"""Features behind a paged service, kept as JSON pages: a Python data source with a partition for each page.

A page is a folder offset=N that holds one feature collection. A page of fewer than `page_size` features, or a missing
one, ends the scan: pages behind it are not read. Conditions are a part of the request, as they are of a service's: tasks
leave features out before rows are made of them. They are not taken from the query by Spark's own push-down to Python
sources, which keeps one set of filters for all uses of a loaded frame, so that a second query or a union over the same
frame would lose rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.order import numbered

PAGE_SIZE = 2000
#: (column, one of these, value) is a condition; a null meets none but "is null".
CONDITIONS = {
    "=": pc.equal,
    "<>": pc.not_equal,
    ">": pc.greater,
    ">=": pc.greater_equal,
    "<": pc.less,
    "<=": pc.less_equal,
    "in": lambda x, v: pc.is_in(x, pa.array(v, x.type)),
    "starts with": pc.starts_with,
    "is null": lambda x, _: pc.is_null(x),
    "is not null": lambda x, _: pc.is_valid(x),
}


class Pages:
    """A folder of pages, in any file system that Arrow knows by its URI."""

    def __init__(self, path: str, page_size: int):
        self.path, self.page_size = path, page_size

    def features(self, offset: int) -> list[dict]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/offset={offset}", allow_not_found=True))
        out: list[dict] = []
        for f in found:
            if f.is_file and not f.base_name.startswith(("_", ".")):
                with system.open_input_stream(f.path) as stream:
                    out += [x for line in stream.read().splitlines() if line for x in json.loads(line).get("features", [])]
        return out

    def is_full(self, page: int) -> bool:
        return len(self.features(page * self.page_size)) >= self.page_size

    def count(self) -> int:
        """Pages up to the first that is not full: some of them are looked at, by steps that double and then halve, as
        all pages before the last are full."""
        lo, step = -1, 1  # page lo is full
        while self.is_full(lo + step):
            lo, step = lo + step, step * 2
        hi = lo + step  # page hi isn't
        while hi - lo > 1:
            middle = (lo + hi) // 2
            lo, hi = (middle, hi) if self.is_full(middle) else (lo, middle)
        return hi + 1


class Page(ds.InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)


class PagedReader(ds.DataSourceReader):
    def __init__(self, pages: Pages, schema: pa.Schema, where: list[tuple]):
        self.pages, self.schema, self.where = pages, schema, where
        for column, how, _ in where:
            if column not in schema.names or how not in CONDITIONS:
                raise ValueError(f"no condition of these columns: {column} {how}")

    def partitions(self) -> list[Page]:
        return [Page(k * self.pages.page_size) for k in range(self.pages.count())]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        rows = self.pages.features(partition.value)
        table = pa.table([_column(rows, field) for field in self.schema], schema=self.schema)
        for column, how, value in self.where:
            table = table.filter(CONDITIONS[how](table.column(column), value))
        yield from table.to_batches()


def _column(features: list[dict], field: pa.Field) -> pa.Array:
    """A property of all features; the geometry as JSON text; null where a feature lacks it."""
    if field.name == "geometry":
        return pa.array([json.dumps(f["geometry"]) if f.get("geometry") else None for f in features], pa.string())
    values = [f.get("properties", {}).get(field.name) for f in features]
    try:
        return pa.array(values, field.type)
    except (pa.ArrowInvalid, pa.ArrowTypeError):  # a text for a number, or a date
        return pa.array([None if v is None else str(v) for v in values]).cast(field.type)


class PagedFeatures(ds.DataSource):
    """spark.read.format("paged_features").schema(DDL).option("page_size", 2000).load(folder); where: conditions as JSON."""

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        raise ValueError("name the columns by .schema(): features of a page need not agree in their properties")

    def reader(self, schema) -> PagedReader:
        pages = Pages(self.options["path"], int(self.options.get("page_size", PAGE_SIZE)))
        return PagedReader(pages, to_arrow_schema(schema), json.loads(self.options.get("where", "[]")))


def read_pages(spark: SparkSession, path: str, schema: str, page_size: int = PAGE_SIZE, where: tuple[tuple, ...] = ()) -> DataFrame:
    """The features that meet all conditions of `where`, with these columns of their properties."""
    spark.dataSource.register(PagedFeatures)
    return spark.read.format("paged_features").schema(schema).option("page_size", page_size).option("where", json.dumps(where)).load(path)


def write_pages(features: DataFrame, path: str, order: list[str], page_size: int = PAGE_SIZE, geometry: str | None = None) -> None:
    """Pages of page_size features in this order; the columns are their properties, `geometry` names one of GeoJSON text."""
    rows = numbered(features, [F.col(c).asc_nulls_last() for c in order], "_n")
    properties = F.to_json(F.struct(*[c for c in features.columns if c != geometry]), {"ignoreNullFields": "false"})
    shape = F.coalesce(F.col(geometry), F.lit("null")) if geometry else F.lit("null")
    one = F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": '), shape, F.lit("}"))
    offset = (F.floor(F.col("_n") / page_size) * page_size).alias("offset")
    pages = rows.groupBy(offset).agg(F.array_sort(F.collect_list(F.struct("_n", one.alias("f")))).alias("all"))  # page_size rows at most
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.transform("all", lambda x: x["f"]), ", "), F.lit("]}"))
    pages.select("offset", text.alias("value")).write.partitionBy("offset").text(path)

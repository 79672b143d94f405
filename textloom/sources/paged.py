"""A service that answers in pages ordered by time, as a Spark source for batches and streams.

The service gives at most `page` rows from a second on, by time and then id. A reader asks again from the last second that
it got, as that may go on in the next page, and gives out a second only when a later one or a short page shows that it
is whole; so rows that share the last second of a full page aren't lost, as they are where the next cursor is that second
plus one. A short page ends the reading. A second that alone fills a page is asked for with twice the size.

A Parquet table can stand in for such a service (`table_pages`), but then each page reads and sorts all that is left of its span. For
tables of size, `laid_out` sorts the table by time once, in Spark; `laid_out_pages` then finds a page by the first and last second of
each row group and reads no more than the groups that the page is in.

Time is cut into spans, each read by a task of its own. A stream's offset is the second up to which all has been read, so a
restarted one goes on from its checkpoint.
"""

from __future__ import annotations

import importlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Fetch = Callable[[int, int, int], pa.Table]


def table_pages(options: Mapping[str, str], after: int, before: int, limit: int) -> pa.Table:
    """A Parquet table as such a service: the first rows by (time, id) with after <= second < before."""
    import pyarrow.dataset as ds

    data = ds.dataset(options["path"])
    kind = data.schema.field(options["time"]).type
    at = lambda second: pa.scalar(second, pa.int64()).cast(pa.timestamp("s", getattr(kind, "tz", None))).cast(kind)
    when = ds.field(options["time"])
    return data.to_table(filter=(when >= at(after)) & (when < at(before))).sort_by([(options["time"], "ascending"), (options["id"], "ascending")]).slice(0, limit)


#: Bytes of rows in a row group of a laid-out table, and the column that holds a row's second.
_GROUP_BYTES, _SECOND = 1 << 18, "_second"


def _micros(rows: DataFrame, time: str) -> Column:
    """Since 1970; of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{time}`)") if dict(rows.dtypes)[time] == "timestamp_ntz" else F.unix_micros(time)


def laid_out(rows: DataFrame, time: str, id_col: str, path: str) -> str:
    """Writes rows sorted by time and id, in files and row groups of ascending seconds, and returns the path. Rows without a time have no page and are left out."""
    timed = rows.where(F.col(time).isNotNull()).withColumn(_SECOND, F.floor(_micros(rows, time) / 1_000_000))
    dealt = timed.repartitionByRange(_SECOND, id_col).sortWithinPartitions(_SECOND, time, id_col)
    dealt.write.option("parquet.block.size", _GROUP_BYTES).parquet(path)
    return path


@lru_cache(maxsize=4)
def _groups(path: str) -> tuple[list[int], list[int], list[tuple[object, str, int]], pa.Schema]:
    """Of a laid-out table: first and last second of each row group, where it is, and the schema. Small numbers, read once in a worker."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    files, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:/*", "/", path))
    names = sorted(f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet"))
    firsts, lasts, places, schema = [], [], [], None
    for name in names:
        with pq.ParquetFile(name, filesystem=files) as f:
            schema, at = f.schema_arrow, f.metadata.schema.names.index(_SECOND)
            for i in range(f.metadata.num_row_groups):
                seconds = f.metadata.row_group(i).column(at).statistics
                firsts.append(seconds.min), lasts.append(seconds.max), places.append((files, name, i))
    return firsts, lasts, places, schema


@lru_cache(maxsize=4)
def _opened(path: str, n: int):
    import pyarrow.parquet as pq

    files, name, _ = _groups(path)[2][n]
    return pq.ParquetFile(name, filesystem=files)


@lru_cache(maxsize=8)
def _group(path: str, n: int) -> pa.Table:
    """A row group; the next pages are mostly in the same one."""
    places = _groups(path)[2]
    first = n - places[n][2]  # groups of a file follow each other
    return _opened(path, first).read_row_group(places[n][2])


def laid_out_pages(options: Mapping[str, str], after: int, before: int, limit: int) -> pa.Table:
    """The same pages as `table_pages`, of a table that `laid_out` wrote."""
    firsts, lasts, _, schema = _groups(options["path"])
    held, rows, n = [], 0, bisect_left(lasts, after)
    while n < len(firsts) and firsts[n] < before and rows < limit:
        group = _group(options["path"], n)
        seconds = group.column(_SECOND)
        held.append(group.filter(pc.and_(pc.greater_equal(seconds, after), pc.less(seconds, before))).slice(0, limit - rows))
        rows, n = rows + held[-1].num_rows, n + 1
    return pa.concat_tables(held) if held else (schema.empty_table() if schema else pa.table({}))


def pages(fetch: Fetch, second: Callable[[pa.Table], pa.Array], after: int, before: int, limit: int) -> Iterator[pa.Table]:
    """All rows with after <= second < before, each once."""
    size = limit
    while after < before:
        page = fetch(after, before, size)
        if page.num_rows < size:
            if page.num_rows:
                yield page
            return
        seconds = second(page)
        last = seconds[-1].as_py()
        whole = page.filter(pc.less(seconds, last))
        if not whole.num_rows:
            size *= 2
            continue
        yield whole
        after, size = last, limit


class Span(InputPartition):
    def __init__(self, first: int, until: int):
        self.first, self.until = first, until


class _Paged:
    """What reading a batch and a stream share."""

    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.schema, self.options = schema, dict(options)
        self.first, self.until, self.span, self.page = (int(options[k]) for k in ("first", "until", "span", "page"))

    def spans(self, first: int, until: int) -> list[Span]:
        return [Span(a, min(a + self.span, until)) for a in range(first, until, self.span)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        module, name = self.options["fetch"].split(":")
        fetch, wanted = getattr(importlib.import_module(module), name), to_arrow_schema(self.schema)
        second = lambda t: pc.floor(pc.divide(t.column(self.options["time"]).cast(pa.timestamp("us")).cast(pa.int64()).cast(pa.float64()), 1e6)).cast(pa.int64())
        for page in pages(lambda a, b, n: fetch(self.options, a, b, n), second, partition.first, partition.until, self.page):
            columns = [page.column(f.name).cast(pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type).cast(f.type) for f in wanted]
            yield from pa.Table.from_arrays(columns, schema=wanted).combine_chunks().to_batches()


class _Batch(_Paged, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans(self.first, self.until)


class _Stream(_Paged, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"second": self.first}

    def latestOffset(self) -> dict:
        return {"second": self.until}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start["second"], end["second"])


class Paged(DataSource):
    """Options: schema (DDL), fetch (module:function of (options, after, before, limit)), time and id (columns), page (rows), first and until (seconds since 1970), span (seconds for a task), and any that fetch takes."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)


def options_for(spark: SparkSession, path: str, time: str, id_col: str, page: int, span: int, first: int, until: int, fetch: Fetch = table_pages) -> dict[str, str]:
    """The options under which a Parquet table is read in pages; fetch is `laid_out_pages` for one that `laid_out` wrote."""
    schema = ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(path).dtypes if c != _SECOND)
    given = {"schema": schema, "fetch": f"{__name__}:{fetch.__name__}", "path": path, "time": time, "id": id_col, "page": page, "span": span, "first": first, "until": until}
    return {k: str(v) for k, v in given.items()}

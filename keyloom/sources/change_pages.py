"""Paged lists of changed files as a Spark source, read by several tasks, whole or as they grow.

``page(n)`` gives the n-th page, from 1, as dicts with filename and status; a page with fewer than ``size`` rows is the last. It is pickled and
runs in tasks, so it must not hold on to a connection. with_retries and with_fallback of sources.files wrap what it calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Page = Callable[[int], list[dict]]
SCHEMA = "filename string, status string"
#: Tasks of a read, and pages of a task of a stream.
TASKS, PAGES = 8, 16


class _Every(InputPartition):
    """Pages first, first + step, first + 2 * step and so on, up to the end of the list."""

    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class _Span(InputPartition):
    """The rows from start up to stop, both counted over all pages."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def _rows(found: list[dict]) -> Iterator[tuple]:
    return ((x.get("filename"), x.get("status")) for x in found)


def last_row(page: Page, size: int, from_row: int = 0) -> int:
    """How many rows the list has, at least from_row of them known: pages are asked for in steps that double, then halve."""
    low = from_row // size + 1  # the page that the next row is on
    found = len(page(low))
    if found < size:
        return (low - 1) * size + found
    step = 1
    while len(page(low + step)) == size:
        low, step = low + step, step * 2
    high = low + step  # low is full, high isn't
    while high - low > 1:
        middle = (low + high) // 2
        if len(page(middle)) == size:
            low = middle
        else:
            high = middle
    return (high - 1) * size + len(page(high))


def source(name: str, page: Page, size: int = 100, tasks: int = TASKS) -> type[DataSource]:
    """A data source of a name that reads the pages: spark.dataSource.register(it), then spark.read or spark.readStream with that format.

    A read deals pages over tasks in turn, and each task stops at its first page that isn't full, so nobody needs to know how
    many there are. A stream keeps as its offset how many rows were taken, so it also takes what a last page gains.
    """

    class Whole(DataSourceReader):
        def partitions(self):
            return [_Every(i + 1, tasks) for i in range(tasks)]

        def read(self, partition):
            n = partition.first
            while True:
                found = page(n)
                yield from _rows(found)
                if len(found) < size:
                    return
                n += partition.step

    class Growing(DataSourceStreamReader):
        def __init__(self):
            self.known = 0

        def initialOffset(self):  # noqa: N802
            return {"row": 0}

        def latestOffset(self):  # noqa: N802
            self.known = max(self.known, last_row(page, size, self.known))
            return {"row": self.known}

        def partitions(self, start, end):
            a, b, each = int(start["row"]), int(end["row"]), PAGES * size
            self.known = max(self.known, a)
            # cut at borders of pages, so no page is asked for twice but at the ends
            edges = [a, *range((a // each + 1) * each, b, each), b]
            return [_Span(x, y) for x, y in zip(edges[:-1], edges[1:], strict=True) if y > x]

        def read(self, partition):
            for n in range(partition.start // size, -(-partition.stop // size)):
                at = n * size
                yield from _rows(page(n + 1)[max(0, partition.start - at) : partition.stop - at])

        def commit(self, end):
            pass

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Whole()

        def streamReader(self, schema):  # noqa: N802
            return Growing()

    return Pages


def read_pages(spark: SparkSession, page: Page, size: int = 100, tasks: int = TASKS, name: str = "change_pages") -> DataFrame:
    """filename, status of all pages, by ``tasks`` tasks."""
    spark.dataSource.register(source(name, page, size, tasks))
    return spark.read.format(name).load()


def stream_pages(spark: SparkSession, page: Page, size: int = 100, name: str = "change_pages") -> DataFrame:
    """The same as a stream that takes the rows that come to be."""
    spark.dataSource.register(source(name, page, size))
    return spark.readStream.format(name).load()

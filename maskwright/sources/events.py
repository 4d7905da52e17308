"""Log events and paged corpora as Python data sources over an injected client.

A client is any picklable object with groups() -> names and events(group, since_ms, limit) -> iterable of
(stream, timestamp_ms, message); for pages, page(offset, size) -> list of dicts. Spark plans one partition per
group or page range, so groups are read in parallel; a group that fails yields no rows and a note on stderr.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EVENT = "log_group string, log_stream string, timestamp timestamp, message string"
PAGE_SIZE = 100


class Group(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _EventReader(DataSourceReader):
    def __init__(self, client, contains: str, groups: int | None, since: int, limit: int | None, width: int | None):
        self.client, self.contains, self.groups, self.since, self.limit, self.width = client, contains, groups, since, limit, width

    def partitions(self) -> list[InputPartition]:
        # Filter before the limit, so that a match beyond the first names isn't missed.
        names = [g for g in self.client.groups() if self.contains in g]
        return [Group(g) for g in names[: self.groups]] or [Group("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.name:
            return
        try:
            rows = list(self.client.events(partition.name, self.since, self.limit))
        except Exception as why:  # a failed group is reported, not fatal
            print(f"{partition.name}: {why}", file=sys.stderr)
            return
        for stream, ms, message in rows[: self.limit]:
            if ms is not None and ms < self.since or not isinstance(message, str) or message == "":
                continue
            at = None if ms is None else datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)
            yield partition.name, stream, at, message[: self.width]


class LogEvents(DataSource):
    """Options: client (pickled, hexadecimal), contains, max_groups, since_ms, max_events, max_chars."""

    @classmethod
    def name(cls) -> str:
        return "log_events"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        number = lambda k: int(o[k]) if k in o else None
        return _EventReader(cloudpickle.loads(bytes.fromhex(o["client"])), o.get("contains", ""), number("max_groups"), number("since_ms") or 0, number("max_events"), number("max_chars"))


class _PageReader(DataSourceReader):
    def __init__(self, client, rows: int):
        self.client, self.rows = client, rows

    def partitions(self) -> list[InputPartition]:
        return [Span(a, min(self.rows, a + PAGE_SIZE)) for a in range(0, self.rows, PAGE_SIZE)] or [Span(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.last > partition.first:
            for k, row in enumerate(self.client.page(partition.first, partition.last - partition.first)):
                yield partition.first + k, row.get("language"), row.get("source_text")


class PagedRows(DataSource):
    """Options: client, rows. Rows (offset, language, text) of pages of 100."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "offset long, language string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(cloudpickle.loads(bytes.fromhex(self.options["client"])), int(self.options["rows"]))


def read_events(spark: SparkSession, client, **options) -> DataFrame:
    """Events of all groups that match; see LogEvents for the options."""
    spark.dataSource.register(LogEvents)
    reader = spark.read.format("log_events").option("client", cloudpickle.dumps(client).hex())
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load()


def read_pages(spark: SparkSession, client, rows: int) -> DataFrame:
    """English rows that aren't blank of a paged service."""
    spark.dataSource.register(PagedRows)
    found = spark.read.format("paged_rows").option("client", cloudpickle.dumps(client).hex()).option("rows", str(rows)).load()
    return found.where("language = 'English' and trim(text) <> ''")

"""Paged REST events as a Spark data source: one partition per date range, read by offset until a short page."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 100


def pages(fetch: Callable[[str], object], url: str, query: dict[str, str], page: int = PAGE, strict: bool = False) -> Iterator[dict]:
    """Events of url?query&count=page&from=offset; ends at an empty or short page or an error, with what came before.
    A strict read raises the error instead, so that its task is tried again and no table is short without a sign."""
    offset = 0
    while True:
        try:
            data = fetch(f"{url}?{urlencode({**query, 'count': page, 'from': offset})}")
        except (OSError, ValueError):
            if strict:
                raise
            return
        found = data.get("events", []) if isinstance(data, dict) else data
        yield from found
        if len(found) < page:
            return
        offset += page


def fetch_json(address: str) -> object:
    """The JSON behind an address; file:// addresses lose their query."""
    with urlopen(address.split("?")[0] if address.startswith("file:") else address, timeout=10) as answer:
        return json.load(answer)


class Range(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.page = options["url"], int(options.get("page", PAGE))
        self.ranges = [r.split("..") for r in options["ranges"].split(",")]
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.query = dict(kv.split("=", 1) for kv in options.get("query", "").split("&") if kv)

    def partitions(self) -> list[Range]:
        return [Range(a, b) for a, b in self.ranges]

    def read(self, part: Range) -> Iterator[tuple]:
        for event in pages(fetch_json, self.url, self.query | {"from_date": part.start, "to_date": part.end}, self.page, self.strict):
            yield part.start, json.dumps(event)


class PagedEvents(DataSource):
    """spark.read.format("paged_events"), options url, ranges (start..end, by comma), page, query, strict: range_start and the
    event as JSON text, for from_json with schemas.EVENT. Ranges are read in parallel and come as one table."""

    @classmethod
    def name(cls) -> str:
        return "paged_events"

    def schema(self) -> str:
        return "range_start string, event string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

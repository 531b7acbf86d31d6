"""A Spark data source over paged HTTP APIs, one partition per range of pages."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 500, 502, 503, 504)


def fetch_json(url: str, tries: int = 5, wait: float = 0.5, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep):
    """A page's JSON; busy and failing answers are tried again, longer each time or as Retry-After says."""
    for attempt in range(tries):
        try:
            with opener(url) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED or attempt == tries - 1:
                raise
            sleep(float(error.headers.get("Retry-After") or wait * 2**attempt) if error.headers else wait * 2**attempt)
    raise RuntimeError("no answer")


def pages(url: str, style: str, start: int, stop: int, size: int, get: Callable = fetch_json, items: str = "items", cursor: str = "next") -> Iterator[dict]:
    """Items of the pages ``start`` to ``stop``: by offset, page number, cursor or next link.

    Offset and page styles end at a short page; cursor and link styles go on from the first page
    alone, so they can't be split.
    """
    if style in ("offset", "page"):
        for p in range(start, stop):
            key = f"offset={p * size}&limit={size}" if style == "offset" else f"page={p + 1}&per_page={size}"
            found = get(f"{url}{'&' if '?' in url else '?'}{key}")[items]
            yield from found
            if len(found) < size:
                return
        return
    at: str | None = url
    seen = set()
    while at and at not in seen:
        seen.add(at)
        page = get(at)
        yield from page[items]
        more = page.get(cursor)
        at = None if not more else more if style == "link" else f"{url}{'&' if '?' in url else '?'}cursor={more}"


class PageRange(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class PagedApi(DataSource):
    """Options: url, style (offset, page, cursor, link), pages, page_size, partitions. Rows are JSON texts."""

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[PageRange]:
        total, parts = int(self.options.get("pages", 1)), int(self.options.get("partitions", 1))
        if self.options.get("style", "page") in ("cursor", "link"):
            return [PageRange(0, total)]
        step = max(1, -(-total // parts))
        return [PageRange(i, min(total, i + step)) for i in range(0, total, step)]

    def read(self, partition: PageRange) -> Iterator[tuple[str]]:
        for item in pages(self.options["url"], self.options.get("style", "page"), partition.start, partition.stop, int(self.options.get("page_size", 100))):
            yield (json.dumps(item),)

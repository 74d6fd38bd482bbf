"""A paged listing of a service as a data source, for batches and for streams: a partition has one page or, of many pages, up to TASK_PAGES.

``spark.dataSource.register(PagedListing)``, then ``spark.read.format("paged").option("url", ...)``. The URL has ``{page}`` for the
page's number, from 1; http, https and file URLs are read (a folder that holds one file counts as that file). A page is
a JSON object with its rows in ``data`` and the number of pages in ``metadata.total_pages`` (1 if missing). A
page that fails is asked for again ``retries`` times, each time after twice the ``wait`` (seconds) before; then the read fails. A
stream goes on where its last batch ended as pages are added.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

RETRIES, WAIT = 4, 0.2
#: Partitions before pages share one, and pages that one may have: a task costs more than a page.
LEAST_PARTITIONS, TASK_PAGES = 64, 32


class Pages(InputPartition):
    def __init__(self, numbers: range):
        super().__init__(numbers.start)
        self.numbers = numbers


def dealt(first: int, last: int) -> list[Pages]:
    """The pages from ``first`` to ``last`` in partitions."""
    each = min(max((last - first + 1) // LEAST_PARTITIONS, 1), TASK_PAGES)
    return [Pages(range(n, min(n + each, last + 1))) for n in range(first, last + 1, each)]


class Listing:
    """What readers share: the URL, retries, rows by the schema's names."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.url, self.retries, self.wait, self.schema = options["url"], int(options.get("retries", RETRIES)), float(options.get("wait", WAIT)), schema

    def fetch(self, number: int) -> dict:
        url = self.url.replace("{page}", str(number))
        parts = urllib.parse.urlsplit(url)
        if parts.scheme == "file" and (folder := Path(urllib.parse.unquote(parts.path))).is_dir():
            url = next(p for p in sorted(folder.iterdir()) if p.name[0] not in "._").as_uri()
        with urllib.request.urlopen(url, timeout=30) as got:  # noqa: S310  the caller's own service
            found = json.load(got)
        if not isinstance(found, dict):
            raise ValueError(f"page {number} is no object")
        return found

    def page(self, number: int) -> dict:
        for attempt in range(self.retries + 1):
            try:
                return self.fetch(number)
            except (OSError, ValueError, StopIteration) as e:
                if attempt == self.retries or isinstance(e, urllib.error.HTTPError) and e.code in (400, 401, 403, 404):
                    raise RuntimeError(f"page {number} of {self.url}: {e}") from e
                time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def total(self) -> int:
        return int((self.page(1).get("metadata") or {}).get("total_pages") or 1)

    def rows(self, numbers: range) -> Iterator[tuple]:
        kinds = {"string": str, "integer": int, "long": int, "double": float}
        fields = [(f.name, kinds.get(f.dataType.typeName(), lambda x: x)) for f in self.schema.fields]
        for number in numbers:
            for item in self.page(number).get("data") or []:
                yield tuple(None if item.get(n) is None else kind(item[n]) for n, kind in fields)


class PagedReader(DataSourceReader):
    def __init__(self, listing: Listing):
        self.listing = listing

    def partitions(self) -> list[Pages]:
        return dealt(1, self.listing.total())

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.listing.rows(partition.numbers)


class PagedStream(DataSourceStreamReader):
    """Offsets are numbers of pages read."""

    def __init__(self, listing: Listing):
        self.listing = listing

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": self.listing.total()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return dealt(start["pages"] + 1, end["pages"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.listing.rows(partition.numbers)


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "setid string, title string, spl_version int, published_date string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(Listing(self.options, schema))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(Listing(self.options, schema))

"""Stored response pages as a table: a Python data source with a partition per house and page file.

Layout: ``<path>/<house>/<from>_<to>.json``, times as yyyyMMdd. A filter on the house is pushed down to the
listing, so that pages of other houses are never opened. Files are read through Arrow's file systems (local, HDFS, S3
by URI); the folder must be one that all executors reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "house_id string, from_day string, to_day string, body string"
PAGE = re.compile(r"([^/]+)/(\d{8})_(\d{8})\.json$")


@dataclass
class Page(InputPartition):
    house: str
    first: str
    last: str
    path: str


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class StoredResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"])


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.houses = path, None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Takes equality and IN on the house; gives back the rest."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("house_id",):
                yield f
            else:
                self.houses = wanted if self.houses is None else self.houses & wanted

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        store, root = _store(self.path)
        roots = [root] if self.houses is None else [f"{root.rstrip('/')}/{h}" for h in sorted(self.houses)]
        found = [f.path for r in roots for f in store.get_file_info(fs.FileSelector(r, recursive=True, allow_not_found=True)) if f.is_file]
        pages = [(*m.groups(), p) for p in sorted(found) if (m := PAGE.search(p))]
        return [Page(*p) for p in pages] or [Page("", "", "", "")]

    def read(self, page: Page) -> Iterator[tuple]:
        if page.path:
            store, _ = _store(self.path)
            with store.open_input_stream(page.path) as f:
                yield page.house, page.first, page.last, f.read().decode("utf-8", "replace")


def read_responses(spark, path: str):
    """(house_id, from_day, to_day, body) of every stored page; see ingest.parse_responses() for the readings in them."""
    spark.dataSource.register(StoredResponses)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("stored_responses").load(path)

"""A data source over paged search results.

Offline the pages are JSON files ``<query>/<page>.json`` with ``items`` and an optional ``next`` token; a
client for a live service gives the same pages by another ``fetch``.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


class SearchPages(DataSource):
    """``spark.read.format("search_pages").option("path", ...)``: query, page, item_id, url, title."""

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return "query string, page int, item_id string, url string, title string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"], int(self.options["max_pages"]) if "max_pages" in self.options else None)


class PageReader(DataSourceReader):
    """One partition a query, read to its last page; more than ``max_pages``, where that is given, are an error. An equality on the query is pushed down, so other queries are not fetched."""

    def __init__(self, path: str, max_pages: int | None):
        self.path, self.max_pages, self.only = path, max_pages, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.listdir(self.path))
        return [InputPartition(n) for n in names if self.only in (None, n)] or [InputPartition(None)]

    def fetch(self, query: str, page: int, token: str | None) -> dict | None:
        file = os.path.join(self.path, query, f"{page}.json")
        if not os.path.exists(file):
            return None
        with open(file, encoding="utf-8") as f:
            return json.load(f)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        query, token, seen = partition.value, None, set()
        for page in itertools.count() if query is not None else ():
            if page == self.max_pages:
                raise ValueError(f"{query}: more than {page} pages")
            found = self.fetch(query, page, token)
            if found is None:
                return
            for item in found.get("items", []):
                if item["id"] not in seen and not item.get("url", "").lower().endswith(".svg"):
                    seen.add(item["id"])
                    yield query, page, str(item["id"]), item.get("url"), item.get("title")
            token = found.get("next")
            if token is None:
                return


def register(spark) -> None:
    """Make the format known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchPages)

"""Pages over HTTP as a Spark data source: ``spark.read.format("web_pages").option("urls", "...")``."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Slice(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], slices: int, timeout: float):
        self.urls, self.slices, self.timeout = urls, slices, timeout

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.slices, len(self.urls)))
        return [_Slice(self.urls[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as r:
                    yield (url, r.status, r.headers.get("ETag"), r.headers.get("Last-Modified"), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"))
            except urllib.error.HTTPError as e:
                yield (url, e.code, None, None, None)
            except (OSError, ValueError):
                yield (url, None, None, None, None)


class WebPages(DataSource):
    """One row per URL (option ``urls``, by white space): ``url, status, etag, last_modified, html``.

    Unreachable pages have a null status. At most ``concurrency`` tasks (default 6) fetch at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, status int, etag string, last_modified string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("urls", "").split(), int(self.options.get("concurrency", "6")), float(self.options.get("timeout", "10")))

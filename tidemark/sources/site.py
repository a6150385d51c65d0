"""Paged listings and message queues as Spark data sources.

A listing is read query by query, each in a task of its own that turns pages until a stop rule holds. A queue is a stream over numbered segments: its
offset is the number of the next one, which the query's checkpoint keeps, so a message is acknowledged when its batch is complete and a restart reads
nothing twice. Both read folders that the whole cluster shares (`query=.../page=...` and `segment=...`, as a partitioned write leaves them).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MOST_PAGES = 10
#: What a partitioned write escapes in a folder's name, besides control characters.
ESCAPED = set("\"#%'*/:=?\\{[]^\x7f")
LINK = re.compile(r"""<a\s[^>]*?href\s*=\s*["']([^"'#]+)""", re.I)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def folder_name(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in value)


def _text(root: str, folder: str) -> str | None:
    """All files of a folder below the root as one text; None where there is no such folder."""
    store, path = _store(root)
    path = f"{path}/{folder}"
    found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    if not files:
        return None
    parts = []
    for f in files:
        with store.open_input_stream(f) as s:
            parts.append(s.read().decode("utf-8", "replace"))
    return "".join(parts)


class Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.queries = json.loads(options["queries"])
        self.most = int(options.get("maxPages", MOST_PAGES))
        self.marker = options.get("noResults", "")
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[InputPartition]:
        return [Query(q) for q in dict.fromkeys(self.queries)] or [Query("")]

    def fetch(self, query: str, page: int) -> str | None:
        for k in range(self.attempts):
            try:
                return _text(self.root, f"query={folder_name(query)}/page={page}")
            except OSError:
                if k + 1 == self.attempts:
                    return None
        return None

    def read(self, partition: Query) -> Iterator[tuple]:
        for page in range(1, self.most + 1) if partition.query else ():
            html = self.fetch(partition.query, page)
            if html is None or (self.marker and self.marker in html):
                return
            links = list(dict.fromkeys(LINK.findall(html)))
            if not links:
                return
            for rank, url in enumerate(links, 1):
                yield partition.query, page, rank, url


class Listing(DataSource):
    """format("paged_listing"): (query, page, rank, url) of the links on a query's pages, each link once a page.

    Options: path; queries, a JSON list; maxPages; noResults, a text that says so; attempts. A query ends at the page limit, at a page without links or with
    the text, or where a page cannot be had.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "query string, page int, rank int, url string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


class Segment(InputPartition):
    def __init__(self, number: int):
        self.number = number


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def _numbers(self) -> list[int]:
        store, path = _store(self.root)
        found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"segment=(\d+)", f.base_name)))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max(self._numbers(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Segment(k) for k in self._numbers() if start["next"] <= k < end["next"]]

    def read(self, partition: Segment) -> Iterator[tuple]:
        for k, line in enumerate((_text(self.root, f"segment={partition.number}") or "").splitlines()):
            yield partition.number, k, line


class Queue(DataSource):
    """format("message_queue"), a stream of (segment, position, body): a message for each line. Option: path. A segment is complete when its folder
    appears; empty ones hold nothing."""

    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return "segment int, position int, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QueueReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (Listing, Queue):
        spark.dataSource.register(source)

"""External pages behind a cursor, as a data source for batches and streams.

A service lists the pages of a database some at a time, each time with the cursor of the rest.
``spark.read.format("paged")`` reads the databases in parallel, each along its cursors;
``spark.readStream`` goes on after the cursors that its checkpoint holds, so a restarted stream
reads nothing twice and misses nothing. Rows are (database, page_id, title, edited, markdown).

The client is a class with ``databases``, ``fetch`` and ``last``, named by the option ``client``
as ``module:Class`` and made from the options in each task. ``FolderClient`` serves folders of
JSON files in a folder that all executors share, a file a listing, in order of their names.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "database string, page_id string, title string, edited string, markdown string"
# What stands before the text of a block.
MARKS = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> ", "to_do": "- [ ] ", "done": "- [x] "}


def markdown_of_blocks(blocks: list[dict]) -> str:
    """Markdown of blocks (type, text, language, checked); unknown types are paragraphs, list items stand together."""
    parts: list[str] = []
    before = ""
    for b in blocks or []:
        kind, text = str(b.get("type") or ""), str(b.get("text") or "")
        if kind == "divider":
            text = "---"
        elif kind == "code":
            text = f"```{b.get('language') or ''}\n{text}\n```"
        elif kind == "to_do" and b.get("checked"):
            text = MARKS["done"] + text
        else:
            text = MARKS.get(kind, "") + text
        item = kind.endswith("list_item") or kind == "to_do"
        if text.strip():
            parts.append(("\n" if item and before == kind else "\n\n" if parts else "") + text)
            before = kind
    return "".join(parts)


class FolderClient:
    """Listings in files: ``path/database/name.json`` holds {"pages": [...]}; a cursor is the number of listings read."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def _files(self, database: str) -> list[str]:
        return sorted(f for f in os.listdir(os.path.join(self.path, database)) if f.endswith(".json"))

    def databases(self) -> list[str]:
        return sorted(d for d in os.listdir(self.path) if os.path.isdir(os.path.join(self.path, d)))

    def last(self, database: str) -> int:
        """The cursor after the newest listing."""
        return len(self._files(database))

    def fetch(self, database: str, cursor: int) -> tuple[list[dict], int | None]:
        """The pages of one listing and the cursor of the next, or None at the end."""
        files = self._files(database)
        if cursor >= len(files):
            return [], None
        with open(os.path.join(self.path, database, files[cursor]), encoding="utf-8") as f:
            return json.load(f).get("pages") or [], cursor + 1 if cursor + 1 < len(files) else None


def client_of(options: dict):
    module, _, name = options.get("client", f"{__name__}:FolderClient").partition(":")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class Listings(InputPartition):
    """The listings of a database from one cursor up to another, or to the end."""

    database: str
    start: int
    end: int | None = None


def pages(options: dict, part: Listings) -> Iterator[tuple]:
    client, cursor = client_of(options), part.start
    while cursor is not None and (part.end is None or cursor < part.end):
        found, cursor = client.fetch(part.database, cursor)
        for p in found:
            yield part.database, str(p.get("id")), p.get("title"), p.get("edited"), markdown_of_blocks(p.get("blocks"))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Listings]:
        return [Listings(d, 0) for d in client_of(self.options).databases()]

    def read(self, partition: Listings) -> Iterator[tuple]:
        return pages(self.options, partition) if partition.database else iter(())


class PagedStreamReader(DataSourceStreamReader):
    """Offsets are the cursors of all databases; databases that come later start at 0."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        client = client_of(self.options)
        return {d: client.last(d) for d in client.databases()}

    def partitions(self, start: dict, end: dict) -> list[Listings]:
        return [Listings(d, start.get(d, 0), to) for d, to in sorted(end.items()) if to > start.get(d, 0)]

    def read(self, partition: Listings) -> Iterator[tuple]:
        return pages(self.options, partition)


class PagedSource(DataSource):
    """Register with ``spark.dataSource.register(PagedSource)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(dict(self.options))

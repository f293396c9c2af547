"""A live feed of several partitions as a stream: one offset for each, messages framed by CR LF.

An offset is a position in bytes and always lies after a complete message, so a batch never ends
inside one and a stream that is restarted goes on at the next. Empty messages, which keep a
connection alive, are passed over. A connection that breaks is opened again where it was.

``client`` names a class ``module:Name`` with ``partitions()``, ``size(partition)`` and
``read(partition, start, end)`` (bytes in pieces of any size); ``FileFeed`` reads growing files.
"""

from __future__ import annotations

import importlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "postmill_feed"
BREAK = b"\r\n"
SCHEMA = "feed string, position bigint, value string"


class FileFeed:
    """Every file of a folder is a partition that may grow; names with ``_`` or ``.`` in front are left out."""

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.piece = int(options.get("piece", 1 << 20))

    def _listed(self):
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self.root))
        return [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]

    def partitions(self) -> list[str]:
        return sorted(f.base_name for f in self._listed())

    def size(self, partition: str) -> int:
        return self.files.get_file_info(f"{self.root}/{partition}").size

    def read(self, partition: str, start: int, end: int) -> Iterator[bytes]:
        with self.files.open_input_file(f"{self.root}/{partition}") as file:
            while start < end:
                data = file.read_at(min(self.piece, end - start), start)
                if not data:
                    return
                yield data
                start += len(data)


class Steady:
    """A client whose reads go on over as many connections as they take; ``tries`` may fail in a row."""

    def __init__(self, client, tries: int = 5, pause: float = 0.5):
        self.partitions, self.size = client.partitions, client.size
        self.client, self.tries, self.pause = client, tries, pause

    def read(self, partition: str, start: int, end: int) -> Iterator[bytes]:
        failed = 0
        while start < end:
            try:
                for data in self.client.read(partition, start, end):
                    yield data
                    start, failed = start + len(data), 0
                if start < end:
                    raise OSError(f"{partition} ended at {start}, before {end}")
            except OSError:
                failed += 1
                if failed >= self.tries:
                    raise
                time.sleep(self.pause * 2 ** (failed - 1))


def messages(pieces: Iterator[bytes], start: int) -> Iterator[tuple[int, bytes]]:
    """(position, message) of the complete messages that are not empty, whatever pieces they come in."""
    rest = b""
    for data in pieces:
        *whole, rest = (rest + data).split(BREAK)
        for message in whole:
            if message:
                yield start, message
            start += len(message) + len(BREAK)


def complete_end(client, partition: str, start: int, wanted: int, size: int, step: int = 1 << 16) -> int:
    """Where the last complete message up to ``wanted`` ends; if there is none, where the first one ends, or ``start``."""
    high = wanted
    while high > start:
        low = max(start, high - step)
        # One byte more, as a break may lie across the edge.
        data = b"".join(client.read(partition, low, min(high + 1, wanted)))
        at = data.rfind(BREAK)
        if at >= 0:
            return low + at + len(BREAK)
        high = low
    at, seen = start, b""
    for data in client.read(partition, start, size):
        seen = seen[-1:] + data
        at += len(data)
        found = seen.find(BREAK)
        if found >= 0:
            return at - len(seen) + found + len(BREAK)
    return start


@dataclass
class Stretch(InputPartition):
    feed: str
    start: int
    end: int


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        module, name = self.options.get("client", f"{__name__}:FileFeed").split(":")
        client = getattr(importlib.import_module(module), name)(self.options)
        self.client = Steady(client, int(self.options.get("tries", 5)), float(self.options.get("pause", 0.5)))
        self.most = int(self.options.get("maxbytes", 64 << 20))
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """At most ``maxBytes`` on from what was read last, for each partition.

        A reader that has just started does not know what its checkpoint says, and takes
        all that is there, so offsets never go back.
        """
        for partition in self.client.partitions():
            start, size = self.reached.get(partition), self.client.size(partition)
            wanted = size if start is None else min(size, start + self.most)
            self.reached[partition] = complete_end(self.client, partition, start or 0, wanted, size)
        return dict(self.reached)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        # After a restart the stream's checkpoint knows more than this reader.
        for feed, position in end.items():
            self.reached[feed] = max(self.reached.get(feed, 0), position)
        return [s for feed, high in sorted(end.items()) for s in self._stretches(feed, start.get(feed, 0), high)]

    def _stretches(self, feed: str, low: int, high: int) -> Iterator[Stretch]:
        """At most ``maxBytes`` for each task, cut after a message; a message that is longer is whole."""
        while low < high:
            end = complete_end(self.client, feed, low, min(high, low + self.most), high)
            yield Stretch(feed, low, end if end > low else high)
            low = end if end > low else high

    def read(self, partition: Stretch) -> Iterator[tuple]:
        pieces = self.client.read(partition.feed, partition.start, partition.end)
        for position, message in messages(pieces, partition.start):
            yield partition.feed, position, message.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        for feed, position in end.items():
            self.reached[feed] = max(self.reached.get(feed, 0), position)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def read_feed(spark: SparkSession, path: str, **options) -> DataFrame:
    """The feed below ``path`` as a stream of (feed, position, value)."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
    spark.dataSource.register(FeedSource)
    return spark.readStream.format(NAME).options(path=path, **options).load()

"""Lookups that a SQL user calls on any table: Python table functions over partitioned table arguments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .entities import ADDRESS, EDGES, HOST, UPLINK

_LINE = re.compile(r"\r\n|\r|\n")


@udtf(returnType="layer string, source_device string, source_port string, dest_device string, dest_port string, place int, spot int")
class LinksOf:
    """links_of(TABLE(chunks) PARTITION BY chunk_order): every link that a row's content names; place and spot say where it was found."""

    def eval(self, row: Any) -> Iterator[tuple]:
        text = row["content"] or ""
        for place, (layer, pattern, groups) in enumerate(EDGES):
            for spot, match in enumerate(re.finditer(pattern, text)):
                yield (layer, *(match.group(g).strip() for g in groups), place, spot)


@udtf(returnType="hostname string, iblf string")
class UplinksOf:
    """uplinks_of(TABLE(chunks) PARTITION BY chunk_order): each pair of a host and an uplink switch after it on a line, once a partition."""

    def __init__(self) -> None:
        self.pattern = re.compile(rf"(?i)({HOST}).*?({UPLINK})")
        self.seen: set[tuple[str, str]] = set()

    def eval(self, row: Any) -> Iterator[tuple]:
        for line in _LINE.split(row["content"] or ""):
            for pair in self.pattern.findall(line):
                if pair not in self.seen:
                    self.seen.add(pair)
                    yield pair


@udtf(returnType="sn string, hostname string, outband string, inband string")
class AddressOf:
    """address_of(TABLE(lines) PARTITION BY sn ORDER BY (chunk_order, line)): the host and addresses of a serial, from its lines (sn, chunk_order, line, rest, last_out, last_in).

    The first chunk whose line names a host decides; in it a line with both addresses comes first.
    """

    def __init__(self) -> None:
        self.full = re.compile(rf"(?i)({HOST})[^,]*,([^,]*),({ADDRESS}),({ADDRESS})")
        self.host = re.compile(f"(?i)({HOST})")
        self.best: tuple | None = None
        self.rank: tuple = ()

    def eval(self, row: Any) -> None:
        host = self.host.search(row["rest"])
        if host is None:
            return
        full = self.full.search(row["rest"])
        rank = (row["chunk_order"], full is None, row["line"])
        if self.best is None or rank < self.rank:
            addresses = (full.group(3), full.group(4)) if full else (row["last_out"], row["last_in"])
            self.best, self.rank = (row["sn"], host.group(1), *addresses), rank

    def terminate(self) -> Iterator[tuple]:
        if self.best is not None:
            yield self.best


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("links_of", LinksOf)
    spark.udtf.register("uplinks_of", UplinksOf)
    spark.udtf.register("address_of", AddressOf)

"""Connected components of a graph given by its edges, in rounds of joins with stored results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Edges that a task contracts at a time.
_PIECE = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (high, low) that connect the same nodes as those given: in each piece of a task, every node with the smallest it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := owner.setdefault(x, x)) != x:
                owner[x] = x = owner[up]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in list(owner) if (r := root(x)) != x]
            owner.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["high", "low"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    owner[max(a, b)] = min(a, b)
            if len(owner) > _PIECE:
                yield stars()
        yield stars()

    return edges.mapInArrow(run, "high long, low long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``edges`` (a, b: long).

    Tasks contract the edges they hold; then alternating large-star and small-star steps hand each node's larger, then its smaller
    neighbours to the smallest node it knows, so a graph of any shape becomes stars in about log n rounds. It is done when no
    node has two centres or is itself a centre of others. Nothing is collected. Loops and repeated edges do no harm; no edges give no rows.
    """
    pairs = stored(contracted(edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()))
    while True:
        ends = pairs.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 0 AND up + down > 1").isEmpty():
            return pairs.select(F.col("high").alias("node"), F.col("low").alias("component")).union(pairs.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
        both = pairs.union(pairs.select("low", "high")).toDF("node", "near")
        least = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("least"))
        large = both.filter("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low")).distinct()
        # now every edge leads down; hand a node's smaller neighbours to the smallest of them
        low = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(low, "high").select(F.explode(F.array("high", "low")).alias("high"), F.col("least").alias("low")).filter("high <> low").distinct()
        before, pairs = pairs, stored(contracted(small))
        discard(before)


def in_blocks(members: DataFrame, *key: str, block: int = 1024) -> DataFrame:
    """The rows of ``members`` (key, id, component, ...) whose group has several components, dealt so that groups of any size can be compared.

    Only rows outside their group's largest component need to meet the group. Both sides are cut into blocks of about ``block`` rows, and
    rows of the same key, ``one`` and ``other`` meet in one task: those with ``outside`` are compared with those without.
    """
    sizes = members.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy(*key).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    rows = members.join(whole, list(key))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    role = lambda one, other, outside: F.struct(one.alias("one"), other.alias("other"), F.lit(outside).alias("outside"))
    first = F.transform(F.sequence(F.lit(0), blocks("n") - 1), lambda i: role(spot("outside"), i, True))
    second = F.transform(F.sequence(F.lit(0), blocks("outside") - 1), lambda i: role(i, spot("n"), False))
    roles = F.when(F.col("component") == F.col("main"), second).otherwise(F.concat(first, second))
    return rows.select(*members.columns, F.explode(roles).alias("role")).select(*members.columns, "role.*")


class Roots:
    """Which components have been joined in a task."""

    def __init__(self) -> None:
        self.owner: dict[int, int] = {}

    def join(self, a: int, b: int) -> bool:
        """Join two components; false if they were one already."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.owner[a] = b
        return a != b

    def root(self, x: int) -> int:
        while (up := self.owner.get(x, x)) != x:
            x = up
        return x

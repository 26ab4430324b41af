"""Exact-order search among approximate candidates: multi-index hashing over learned binary codes.

Codes come from rotations learned on a bounded sample (iterative quantisation), are cut into 16-bit substrings, and each
substring is indexed. By the pigeonhole principle a code within Hamming radius r agrees with the query's in some substring up to r /
substrings bits; the buckets within that distance are probed, with growing radius, until enough codes are found. The
original vectors of these are then ranked by inner product in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SUBSTRING_BITS = 16


def learned_rotations(sample: np.ndarray, rotations: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The sample's mean and ``rotations`` rotation matrices side by side: each alternates between signs and the rotation that
    brings the vectors closest to them, from a different seeded start."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    out = []
    for seed in range(rotations):
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((sample.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(centred @ turn > 0, 1.0, -1.0).T @ centred)
            turn = (u @ vt).T
        out.append(turn)
    return mean, np.hstack(out)


def codes_of(vectors: np.ndarray, mean: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Binary codes as 16-bit substrings, filled up with zeros to 64 bits."""
    bits = np.packbits((vectors - mean) @ turns > 0, axis=1)
    return np.hstack([bits, np.zeros((len(bits), -bits.shape[1] % 8), np.uint8)]).view(np.uint16)


class SubstringIndex:
    """One table for each substring: its values, sorted, with the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.whole = self.codes.view(np.uint64)
        self.tables = []
        self.ring = 0
        for column in self.codes.T:
            order = np.argsort(column, kind="stable")
            values, first = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(first, len(order)), order))

    def probed(self, query: np.ndarray, ring: int) -> np.ndarray:
        """Which codes have a substring within ``ring`` bits of the query's: the buckets of each table's ball."""
        seen = np.zeros(len(self.codes), bool)
        for (values, first, order), part in zip(self.tables, query):
            hit = np.flatnonzero(np.bitwise_count(values ^ part) <= ring)
            if 2 * len(hit) > len(values):  # the ball holds most buckets: all codes are compared
                seen[:] = True
                return seen
            sizes = first[hit + 1] - first[hit]
            at = np.repeat(first[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            seen[order[at]] = True
        return seen

    def within(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Rows of all codes within the smallest radius that holds ``wanted`` of them.

        Balls of ``ring`` bits hold every code within (ring + 1) * substrings - 1. The ring starts a step below the last query's.
        """
        n, parts = self.codes.shape
        if n <= wanted:
            return np.arange(n)
        for ring in range(max(0, self.ring - 1), SUBSTRING_BITS + 1):
            rows = np.flatnonzero(self.probed(query, ring))
            if len(rows) < wanted:
                continue
            far = np.bitwise_count(self.whole[rows] ^ query.view(np.uint64)).sum(axis=1, dtype=np.int64)
            radius = (ring + 1) * parts - 1 if len(rows) < n else SUBSTRING_BITS * parts
            nearest = np.partition(far, wanted - 1)[wanted - 1]
            if nearest <= radius:
                self.ring = ring
                return rows[far <= nearest]
        return np.arange(n)


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, mean: np.ndarray, turns: np.ndarray, k: int, share: float, least: int) -> Iterator[tuple]:
    """(query_id, vec_id, score) of each query's nearest ``k`` rows among the candidates of one block."""
    index = SubstringIndex(codes_of(vectors, mean, turns))
    wanted = max(least, int(np.ceil(share * len(vectors))))
    for query, query_id, code in zip(queries, query_ids.tolist(), codes_of(queries, mean, turns)):
        rows = index.within(code, wanted + 1)
        rows = rows[ids[rows] != query_id]
        if not len(rows):
            continue
        scores = (vectors[rows] * query).sum(axis=1)
        if len(rows) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= edge], scores[scores >= edge]
        best = np.lexsort((ids[rows], -scores))[:k]
        yield from zip([query_id] * len(best), ids[rows[best]].tolist(), scores[best].tolist())


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = 20, sample_rows: int = 20_000, rotations: int = 4, share: float = 0.04, least: int = 500, block_rows: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id and score: for rows whose vec_id is divisible by ``every``, the ``k`` rows of largest inner product.

    ``vectors`` has vec_id (long) and embedding (array of numbers). Rotations are learned from at most ``sample_rows`` rows, taken in the
    order of a hash; every row is indexed. Rows and queries are dealt into blocks of about ``block_rows`` and each pair of blocks is
    searched by itself, so a task holds two blocks whatever the size of the table; ``share`` of a block's rows, ``least`` at
    least, are ranked by their original vectors. Vectors that are null, zero, of another length than most, or that hold null or
    non-finite parts take no part; neither do rows without vec_id. Rows that repeat a vec_id count as one (the first by value).
    Ties go to the smaller vec_id. Other columns are ignored; an empty table gives an empty result.
    """
    good = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda v: v.cast("double")).alias("v")).filter(
        F.col("vec_id").isNotNull() & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("v", lambda v: v != 0)
    )
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = stored(good.filter(F.size("v") == common["n"]).groupBy("vec_id").agg(F.min("v").alias("v")))
    total = good.count()
    sample = np.array([r["v"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()])
    mean, turns = learned_rotations(sample, rotations)
    blocks = max(1, -(-total // block_rows))
    query_blocks = max(spark.sparkContext.defaultParallelism if blocks == 1 else 1, -(-total // (every * block_rows // 4)))
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    rows = good.withColumn("block", spot(blocks)).select("vec_id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), F.lit(False).alias("query"))
    asked = good.filter(F.col("vec_id") % every == 0).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), spot(query_blocks).alias("query_block"), F.lit(True).alias("query"))

    def search_block(group: pa.Table) -> pa.Table:
        v = group.column("v").combine_chunks()
        v = v.values.to_numpy().reshape(len(v), -1) if len(v) else np.empty((0, 1))
        ids, query = group.column("vec_id").to_numpy(), group.column("query").to_numpy()
        found = list(search(v[~query], ids[~query], v[query], ids[query], mean, turns, k, share, least)) if query.any() and not query.all() else []
        columns = list(zip(*found)) if found else [[]] * 3
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    # a number of its own, so that small tables are not put into few tasks
    dealt = rows.unionByName(asked).repartition(max(spark.sparkContext.defaultParallelism, 2 * blocks * query_blocks), "block", "query_block")
    found = dealt.groupBy("block", "query_block").applyInArrow(search_block, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

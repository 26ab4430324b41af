"""An index of the character grams of chunk contents: substring search that reads only contents which can hold a term.

Whoever holds a term holds all of its grams, so the chunks in the intersection of the grams' postings are a superset of the hits; the contents
of these, and of no others, are then searched exactly. Contents lie in a table clustered by chunk, postings in one sorted by gram, so both are found by
row groups. Postings are cut into blocks of chunks, so no row, and no task, holds all of a frequent gram; inside a block chunks are numbered, and a gram's
postings are the numbers or, where that is shorter, a bit for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import clustered
from ..sources.shared import release, stored
from . import search

#: Longest grams held; a term of this length or more is looked up by its grams of this length.
LONGEST = 3
#: Chunks in a block of postings, about, and characters. A number takes 16 bits.
BLOCK, CHARACTERS = 4096, 1 << 24
#: Blocks whose postings a task writes, and candidates that are sent to every task that reads contents.
_WRITTEN, _SENT = 4, 1_000_000
#: Bits of a character in a gram's code; 0 stands for none, so that a gram of fewer characters is a code, too.
_BITS = 21
_LAST, _LAST_TWO = (np.uint64((1 << _BITS * n) - 1) for n in (1, 2))


def grams_of(text: str) -> np.ndarray:
    """The codes of all different runs of one to LONGEST characters."""
    signs = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    signs = np.append(signs, np.zeros(LONGEST - 1, np.uint64))
    codes = np.sort(signs[:-2] << np.uint64(2 * _BITS) | signs[1:-1] << np.uint64(_BITS) | signs[2:])
    out = [codes := codes[np.append(codes[1:] != codes[:-1], True)]] if len(codes) else [codes]
    for shorter in (_LAST, _LAST_TWO):
        codes = codes & ~shorter
        out.append(codes := codes[np.append(codes[1:] != codes[:-1], True)] if len(codes) else codes)
    ends = [own[(own & below) != 0] for own, below in zip(out, (_LAST, _LAST_TWO))]  # what has no last character is among the shorter ones
    return np.concatenate([*ends, out[-1]])


def spelled(codes: np.ndarray) -> list[str]:
    """The grams of codes."""
    signs = np.stack([codes >> np.uint64(2 * _BITS), codes >> np.uint64(_BITS) & _LAST, codes & _LAST], axis=1)
    out = np.maximum(signs.astype(np.int64) - 1, 0).astype("<u4").view(f"<U{LONGEST}").ravel().tolist()
    for i in np.flatnonzero((signs == 1).any(axis=1)).tolist():  # the character 0, which numpy strips at the end
        out[i] = "".join(chr(s - 1) for s in signs[i].tolist() if s)
    return out


def packed(numbers: np.ndarray, of: int) -> bytes:
    """Ascending different numbers below ``of``."""
    if 2 * len(numbers) <= -(-of // 8):
        return b"\0" + numbers.astype("<u2").tobytes()
    bits = np.zeros(of, np.uint8)
    bits[numbers] = 1
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2", offset=1).astype(np.int64) if data[0] == 0 else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block")


def block_postings(contents: DataFrame, blocks: int) -> DataFrame:
    """gram, block, n and chunks: for each gram of a block's lower-cased contents, how many chunks have it, and their packed numbers (ranks by chunk_id)."""

    def postings(block: int, grams: list[np.ndarray], numbers: list[int]) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.array(numbers, np.uint16), [len(g) for g in grams])
        codes = np.concatenate(grams)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        fresh = np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1]))[: len(codes)]  # rows of one chunk_id count once
        codes, owner = codes[fresh], owner[fresh]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        size = np.diff(np.append(first, len(codes)))
        for at in range(0, len(first), 10_000):
            part, n = first[at : at + 10_000], size[at : at + 10_000]
            chunks = [packed(owner[a : a + k], numbers[-1] + 1) for a, k in zip(part.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(spelled(codes[part]), pa.string()), pa.array([block] * len(part), pa.int32()), pa.array(n, pa.int32()), pa.array(chunks, pa.binary())], ["gram", "block", "n", "chunks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, grams, numbers = None, None, [], []
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for block, chunk_id, content in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    if block != now:
                        if grams:
                            yield from postings(now, grams, numbers)
                        now, grams, numbers = block, [], []
                    numbers.append(numbers[-1] + (chunk_id != last) if numbers else 0)
                    last = chunk_id
                    grams.append(grams_of((content or "").lower()))
        if grams:
            yield from postings(now, grams, numbers)

    placed = contents.select(block_of(blocks), "chunk_id", "content")
    return placed.repartition("block").sortWithinPartitions("block", "chunk_id").mapInArrow(run, "gram string, block int, n int, chunks binary")


def build(chunks: DataFrame, path: str, buckets: int = 64, rows_per_file: int = 1_000_000) -> None:
    """Write the index of ``chunks`` (chunk_id, content, filename): contents by chunk, postings and their sizes by gram, the chunks' numbers, and filenames."""
    spark = chunks.sparkSession
    cores = spark.sparkContext.defaultParallelism
    kept = chunks.select("chunk_id", "content", "filename").filter("chunk_id IS NOT NULL")
    rows = kept.count()
    parts = lambda blocks: max(-(-rows // rows_per_file), -(-blocks // _WRITTEN), min(blocks, cores))
    clustered.create(kept, f"{path}/contents", "chunk_id", buckets=buckets, rows_per_file=rows_per_file, parts=parts(max(1, -(-rows // BLOCK))))
    release(spark)
    contents = clustered.read(spark, f"{path}/contents")
    characters = contents.agg(F.sum(F.length("content"))).first()[0] or 0
    blocks = max(1, -(-rows // BLOCK), -(-characters // CHARACTERS))
    clustered.create(block_postings(contents, blocks), f"{path}/postings", "gram", order=("block",), buckets=buckets, rows_per_file=rows_per_file, parts=parts(blocks))
    release(spark)
    sizes = clustered.read(spark, f"{path}/postings").groupBy("gram").agg(F.sum("n").alias("n"))
    clustered.create(sizes, f"{path}/sizes", "gram", buckets=buckets, rows_per_file=rows_per_file)
    contents.groupBy(block_of(blocks)).agg(F.array_sort(F.collect_set("chunk_id")).alias("ids")).write.parquet(f"{path}/numbers")
    contents.select("chunk_id", F.lower("filename").alias("name")).filter("name IS NOT NULL").write.parquet(f"{path}/names")


def candidates(spark: SparkSession, path: str, terms: DataFrame, most_grams: int = 4) -> DataFrame:
    """term and chunk_id: for each of ``terms`` (term), chunks that hold its ``most_grams`` rarest grams, a superset of those that hold it."""

    def shared(lists: pd.Series) -> pd.Series:
        return pd.Series([reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), map(unpacked, own)) for own in lists])

    kind = F.least(F.length("term"), F.lit(LONGEST))
    wanted = terms.select("term").filter("term <> ''").distinct()
    pieces = wanted.select("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - kind + 1), lambda i: F.substring(F.col("term"), i, kind)))).alias("gram"))
    sizes = clustered.lookup_all(spark, f"{path}/sizes", pieces.select("gram"))
    # a gram that no chunk has empties its term: it counts as the rarest and finds nothing
    ranked = pieces.join(sizes, "gram", "left").groupBy("term").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, most_grams).alias("best"))
    chosen, _ = stored(ranked.select("term", F.size("best").alias("needed"), F.explode("best.gram").alias("gram")))
    postings = clustered.lookup_all(spark, f"{path}/postings", chosen.select("gram"))
    met = chosen.join(postings, "gram").groupBy("term", "needed", "block").agg(F.collect_list("chunks").alias("lists")).filter(F.size("lists") == F.col("needed"))
    held = met.select("term", "block", F.pandas_udf(shared, "array<int>")("lists").alias("numbers")).filter(F.size("numbers") > 0)
    named = held.join(spark.read.parquet(f"{path}/numbers"), "block")
    return named.select("term", F.explode(F.transform("numbers", lambda i: F.get("ids", i))).alias("chunk_id"))


def keyword_search(spark: SparkSession, path: str, queries: DataFrame, limit: int = 30, expansions: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank as ``search.keyword_search_batch`` gives them for the indexed chunks.

    Only contents of candidates are read, and of chunks whose filename holds a term.
    """
    patterns, _ = stored(patterns_of(queries, expansions))
    names = spark.read.parquet(f"{path}/names")
    named = names.select("name").distinct().join(F.broadcast(patterns), F.contains("name", "term")).select("name").distinct()
    found, _ = stored(candidates(spark, path, patterns).select("chunk_id").union(names.join(named, "name").select("chunk_id")).distinct())
    release(spark)
    return search.keyword_search_batch(clustered.lookup_all(spark, f"{path}/contents", found, _SENT), queries, limit, expansions)


def patterns_of(queries: DataFrame, expansions: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """term: each query's terms and its whole text, lower-cased, once each; worked out where the queries lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = {q or "" for q in batch.column(0).to_pylist()}
            terms = {t for q in texts for t in [q.lower(), *search.expanded_terms(q, expansions)] if t}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(terms), pa.string())], ["term"])

    return queries.select("query").mapInArrow(run, "term string").distinct()

"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets decide.

An odd sketch folds a document's MinHash samples into a parity bitmap. The bits in which two sketches differ count the
samples in which the sets differ, so high similarities are estimated precisely from 128 bytes a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, discard, mixed, shingle_set, slices, spread, stored, text_bytes
from .components import Roots, connected_components, in_blocks

SAMPLES = 256
SKETCH_BITS = 1024
BANDS, ROWS = 32, 4
SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def multipliers() -> np.ndarray:
    """One odd multiplier for each MinHash sample."""
    return mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)


def min_hashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each multiplier's permutation; in pieces, as sets may be very large."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            np.minimum(low, (shingles[at : at + 2048, None] * factors).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in low[: BANDS * ROWS].reshape(BANDS, ROWS).T:
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """The parity bitmap of the samples (number, value) as 64-bit words."""
    with np.errstate(over="ignore"):
        spot = mixed(low ^ (np.arange(len(low), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(spot.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def differing_bits(similarity: float) -> float:
    """Expected number of differing sketch bits of two sets of a given similarity."""
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - similarity)))


def most_differing_bits(similarity: float, deviations: float = 5.0) -> int:
    """A bound that a pair of at least this similarity exceeds with a chance below one in a million: ``deviations`` standard
    errors of the MinHash estimate, and as many of the bitmap."""
    low = max(0.0, similarity - deviations * math.sqrt(similarity * (1 - similarity) / SAMPLES))
    return math.ceil(differing_bits(low) + math.sqrt(SKETCH_BITS) / 2)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Set size, set digest, band keys and odd sketch of every document (doc_id, text); no words: null bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = WordHash(), multipliers()
        for batch in slices(batches):
            sizes, digests, bands, sketches = [], [], [], []
            for text in text_bytes(batch.column(1)):
                own = shingle_set(hashes.of(text.lower().split()), k)
                sizes.append(len(own))
                if len(own):
                    low = min_hashes(own, factors)
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    bands.append(band_keys(low))
                    sketches.append(odd_sketch(low))
                else:
                    digests.append(None)
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the sorted 64-bit shingle hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(batches):
            sets = [shingle_set(hashes.of(t.lower().split()), k).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(run, "a long, b long")


def alike(a: str, b: str, bits: int) -> Column:
    """Whether two sketches differ in at most ``bits`` bits."""
    words = SKETCH_BITS // 64
    return sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(1, words)), F.bit_count(F.col(f"{a}.sketch")[0].bitwiseXOR(F.col(f"{b}.sketch")[0]))) <= bits


def bucket_links(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect the families (component) of each bucket (key, id, component) by near sketches (id, n_shingles, sketch).

    Blocks of a bucket are compared in tasks; only pairs that join families leave them, fewer than there are members.
    """
    bits = most_differing_bits(percent / 100)

    def linked(group: pa.Table) -> pa.Table:
        outside = group["outside"].to_numpy()
        ids, component, size = (group[c].to_numpy() for c in ("id", "component", "n_shingles"))
        sketch = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        roots, out = Roots(), ([], [])
        inside = np.flatnonzero(~outside)
        for i in np.flatnonzero(outside).tolist():
            at = inside[component[inside] != component[i]]
            at = at[100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i])]
            for j in at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= bits].tolist():
                if roots.join(int(component[i]), int(component[j])):
                    out[0].append(int(min(ids[i], ids[j])))
                    out[1].append(int(max(ids[i], ids[j])))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return in_blocks(members, "key").join(sketches, "id").groupBy("key", "one", "other").applyInArrow(linked, "a long, b long")


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components inside families of candidates.

    ``members`` has id, family, component and sketch. Each family's members outside its largest component meet all of its members,
    in blocks on both sides. A pair of blocks is compared in one task: odd sketches first, full sets next;
    only links that join components leave it, fewer than there are members.
    """
    bits = most_differing_bits(percent / 100)

    def linked(group: pa.Table) -> pa.Table:
        outside = group.column("outside").to_numpy()
        ids, component = group.column("id").to_numpy(), group.column("component").to_numpy()
        sketch = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        parts = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
        size = np.array(list(map(len, parts)))
        _, codes = np.unique(np.concatenate(parts), return_inverse=True)
        first = np.cumsum(size) - size
        roots = Roots()
        out: tuple[list[int], list[int]] = ([], [])
        inside = np.flatnonzero(~outside)
        mark = np.zeros(codes.max() + 1, bool)
        for i in np.flatnonzero(outside):
            at = inside[(component[inside] != component[i]) & (np.bitwise_count(sketch[inside] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= bits)]
            if not len(at):
                continue
            own = codes[first[i] : first[i] + size[i]]
            mark[own] = True
            places = np.repeat(first[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())
            common = np.add.reduceat(mark[codes[places]], np.cumsum(size[at]) - size[at], dtype=np.int64)
            mark[own] = False
            for j in at[100 * common >= percent * (size[i] + size[at] - common)].tolist():
                if roots.join(int(component[i]), int(component[j])):
                    out[0].append(int(ids[i]))
                    out[1].append(int(ids[j]))
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return in_blocks(members, "family", block=512).join(sets.withColumnRenamed("doc_id", "id"), "id").groupBy("family", "one", "other").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (doc_id, text).

    Documents are linked when the sets of their ``k``-word shingles have 100 * intersection >= percent * union, whatever the
    size of a group. Documents with equal sets are one class, of which the smallest doc_id goes on. Classes that share a band are
    candidates. Candidates that the odd sketches do not strike out form families: those near the smallest or the largest
    member of a bucket come together, and other families of a bucket are joined where members are near. Full
    sets decide on the joining pairs, and then, inside each family, on all pairs that are not connected yet. With 32 bands
    of 4 rows a pair at exactly 0.75 shares a band with a chance of 1 - 5e-6.

    A null text, or one without words, has an empty set and is linked with nothing. Rows that repeat a doc_id are one
    document; if their texts differ, it has the links of them all. A null doc_id has no component. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long"), "text"))
    signed = stored(signatures(docs, k))
    filled = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = filled.select("digest", "doc_id").join(classes, "digest").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    # one row for each class; a repeated row of the first document stays one
    heads = classes.select(F.col("first").alias("doc_id"), F.col("digest").alias("own")).join(filled, "doc_id").filter("own = digest")
    heads = stored(heads.dropDuplicates(["doc_id", "own"]).select("doc_id", "n_shingles", "bands", "sketch"))

    members = heads.select("doc_id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).filter("lead <> last")
    placed = stored(members.join(buckets, "key").select("key", "doc_id", "lead", "last"))
    star = lambda centre: placed.filter(F.col("doc_id") != F.col(centre)).select(F.least(centre, "doc_id").alias("a"), F.greatest(centre, "doc_id").alias("b"))
    few_bits = most_differing_bits(percent / 100)
    sketches = heads.select("doc_id", "n_shingles", "sketch")

    def near(x: str, y: str) -> Column:
        sizes = F.least(f"{x}.n_shingles", f"{y}.n_shingles") * 100 >= F.greatest(f"{x}.n_shingles", f"{y}.n_shingles") * percent
        return sizes & alike(x, y, few_bits)

    def close(pairs: DataFrame) -> DataFrame:
        x, y = sketches.alias("x"), sketches.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.doc_id")).select("a", "b", F.struct("x.*").alias("x")).join(y, (F.col("b") == F.col("y.doc_id")) & near("x", "y")).select("a", "b")

    proposed = stored(close(star("lead").union(star("last")).distinct()))
    families = stored(connected_components(proposed).select(F.col("node").alias("doc_id"), F.col("component").alias("family")))
    # every bucket's first and last document have met all its others by now; buckets with the same documents are compared once
    alike_buckets = placed.groupBy("key").agg(F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("sum"), F.count(F.lit(1)).alias("n")).filter("n > 2").groupBy("sum", "n").agg(F.min("key").alias("key")).select("key")
    grouped = placed.filter("doc_id <> lead AND doc_id <> last").select("key", "doc_id").join(alike_buckets, "key", "left_semi").join(families, "doc_id", "left")
    grouped = stored(grouped.select("key", F.col("doc_id").alias("id"), F.coalesce("family", "doc_id").alias("component")))
    across = stored(bucket_links(grouped, sketches.withColumnRenamed("doc_id", "id"), percent))
    discard(placed, grouped)
    families = connected_components(proposed.union(across)).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))

    sets = stored(shingle_sets(docs.join(families.select("doc_id").distinct(), "doc_id", "left_semi"), k))
    links = stored(confirmed(proposed.union(across), sets, percent))
    owners = connected_components(links).select(F.col("node").alias("doc_id"), "component")
    placed_in = families.join(owners, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = stored(family_links(placed_in.join(heads.select("doc_id", "sketch"), "doc_id").withColumnRenamed("doc_id", "id"), sets, percent))
    discard(sets)
    components = connected_components(links.union(more).union(copies)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(components, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))

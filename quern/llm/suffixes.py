"""Removal of repeated byte strings with suffix arrays.

Shards are made by content, so that equal strings meet in one shard: every window of ``LENGTH`` bytes belongs to the run of
windows that share its anchor, the smallest hash of a ``GRAM``-byte gram inside it, which depends on the window's bytes alone. Runs
with equal bytes are repeated whole and need no further look. Runs with the same anchor but other bytes go to a shard, where
a suffix array (Larsson-Sadakane refinement) and its common prefixes (Kasai) tell which windows occur twice. An anchor with too many
runs for one shard is split, and the sorted windows of its shards are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mixed, slices, spread, stored, text_bytes

LENGTH = 200
GRAM = 64
#: Most windows of one run; longer ones (periodic text) go on as a further run.
RUN = 256
#: Bytes of a shard's text, and runs of one anchor that go to one shard.
SHARD_BYTES = 1 << 20
SHARD_RUNS = 8192
#: Parts into which the runs of an anchor with more rows than that are dealt before they are counted.
SALTS = 256
_POWERS = mixed(np.arange(101, 108, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every run of ``GRAM`` bytes, by doubling."""
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) + np.uint64(1)
        size, level = 1, 0
        while size < GRAM:
            h = mixed(h[:-size] * _POWERS[level] + h[size:]) if level == 3 else h[:-size] * _POWERS[level] + h[size:]
            size, level = size * 2, level + 1
        return mixed(h)


def sliding(choose: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or largest of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = choose(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return choose(values[: len(values) - rest], values[rest:])


def text_runs(text: bytes) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, start, number of windows and whether the anchor has several places, for each run of a text."""
    width = LENGTH - GRAM + 1
    grams = gram_hashes(np.frombuffer(text, np.uint8))
    anchors = sliding(np.minimum, grams, width)
    # a gram is an anchor's place if it is the smallest of some window, that is, no larger than the largest anchor around it
    around = sliding(np.maximum, np.concatenate([np.zeros(width - 1, np.uint64), anchors, np.zeros(width - 1, np.uint64)]), width)
    places = np.sort(grams[grams <= around])
    several = places[1:][places[1:] == places[:-1]]
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    count = np.diff(np.append(first, len(anchors)))
    cut = np.isin(anchors[first], several) if len(several) else np.zeros(len(first), bool)
    pieces = -(-count // RUN)
    if pieces.max() > 1:
        rank = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(first, pieces) + rank * RUN
        windows = np.minimum(np.repeat(count, pieces) - rank * RUN, RUN)
        cut = np.repeat(cut, pieces)
    else:
        start, windows = first, count
    view = memoryview(text)
    content = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + n]) for a, n in zip(start.tolist(), (windows + LENGTH - 1).tolist())), np.uint64, len(start))
    return anchors[start].view(np.int64), content.view(np.int64), start, windows, cut


RUN_COLUMNS = "anchor long, content long, windows int, cut boolean, alone boolean, docs array<long>, starts array<int>"


def run_table(docs: DataFrame, buffered: int = 1_000_000) -> DataFrame:
    """All runs, those of equal anchor and content gathered in the task: many copies become one row for each task. ``alone``: no other content beside it there."""

    def gathered(parts: list[tuple]) -> pa.RecordBatch:
        anchor, content, start, windows, cut, doc = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((content, anchor))
        anchor, content = anchor[order], content[order]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
        offsets = pa.array(np.append(first, len(anchor)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order], t)) for v, t in ((doc, pa.int64()), (start, pa.int32()))]
        at, anchor = order[first], anchor[first]
        changes = anchor[1:] != anchor[:-1]
        alone = np.append(True, changes) & np.append(changes, True)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content[first]), pa.array(windows[at], pa.int32()), pa.array(cut[at]), pa.array(alone), *lists], ["anchor", "content", "windows", "cut", "alone", "docs", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if doc_id is not None and len(text) >= LENGTH:
                    own = text_runs(text)
                    parts.append((*own, np.full(len(own[0]), doc_id, np.int64)))
                    size += len(own[0])
            if size > buffered:
                yield gathered(parts)
                parts, size = [], 0
        if parts:
            yield gathered(parts)

    return docs.mapInArrow(run, RUN_COLUMNS)


def suffix_array(data: np.ndarray, depth: int = LENGTH + RUN + 8) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes at least (by when a shard's borders have parted all of them), and ranks.

    Larsson-Sadakane: sort by 8 bytes, then refine only the groups that are still tied, by the rank of the suffix as many bytes
    further on as are sorted already.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    size = 8
    rank = np.empty(n, np.int64)
    while True:
        # the rank of a group is the place of its last member, as later refinements only lower the others'
        group = np.cumsum(fresh) - 1
        last = np.append(np.flatnonzero(fresh)[1:], n) - 1
        rank[order] = last[group]
        if size >= depth or fresh.all():
            return order, rank
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        at = order[tied]
        ahead = np.where(at + size < n, rank[np.minimum(at + size, n - 1)] + 1, 0)
        pair = rank[at] * np.int64(n + 1) + ahead
        by = np.argsort(pair, kind="stable")
        order[tied] = at[by]
        pair = pair[by]
        fresh[tied] = np.concatenate([[True], pair[1:] != pair[:-1]])
        size *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place, the common prefix (up to ``most``) of its suffix with the one before it in ``order``.

    Kasai's walk, side by side for all strings: the prefix found at a place, less one, holds at the next place.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n + most + 8, 8), (1, 1))).view("<u8").ravel()
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    have = np.zeros(len(starts), np.int64)
    for step, lanes in enumerate(live.tolist()):
        at = starts[:lanes] + step
        other = before[at]
        h = np.maximum(have[:lanes] - 1, 0)
        h[other < 0] = 0
        going = np.flatnonzero((other >= 0) & (h < most))
        while len(going):
            differ = eight[at[going] + h[going]] ^ eight[other[going] + h[going]]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) / 8).astype(np.int64))
            h[going] += same
            going = going[(same == 8) & (h[going] < most)]
        h = np.minimum(h, most)
        out[at] = h
        have[:lanes] = h
    return out


def repeated_windows(contents: list[bytes]) -> list[np.ndarray]:
    """For each string, which of its windows occur at another place of these strings. One shard."""
    parts, starts, at = [], [], 0
    for number, content in enumerate(contents):
        # UTF-8 has no byte 255: a string that crosses this numbered border equals no other
        border = bytes([255, *(number >> s & 127 for s in (21, 14, 7, 0)), 255])
        starts.append(at)
        parts += [content, border]
        at += len(content) + len(border)
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.array(starts, np.int64)
    windows = np.array([len(c) - LENGTH + 1 for c in contents], np.int64)
    order, _ = suffix_array(data)
    sizes = np.diff(np.append(starts, at))
    prefix = common_prefixes(data, order, starts, sizes)
    twice = prefix >= LENGTH
    twice[order[:-1][twice[order[1:]]]] = True
    return [twice[s : s + w] for s, w in zip(starts.tolist(), windows.tolist())]


SPAN = "doc_id long, start long, stop long, anchor long, digest binary"


def spans_of(doc_id: int, start: int, mask: np.ndarray) -> Iterator[tuple]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        yield doc_id, start + a, start + b - 1 + LENGTH, None, None


def shard_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows from runs sorted by anchor and part; of split anchors, all distinct windows' digests as well."""

    def solved(rows: list[dict]) -> pa.RecordBatch:
        out = []
        for row, mask in zip(rows, repeated_windows([r["bytes"] for r in rows])):
            if not row["whole"]:
                out += spans_of(row["doc_id"], row["start"], mask)
            if row["parts"] > 1:
                text = row["bytes"]
                out += [(row["doc_id"], row["start"] + i, int(row["whole"]), row["anchor"], xxhash.xxh3_128_digest(text[i : i + LENGTH])) for i in range(row["windows"])]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "stop", "anchor", "digest"])

    rows, size, last = [], 0, None
    for batch in slices(batches):
        for row in batch.to_pylist():
            key = row["anchor"], row["part"]
            if size >= SHARD_BYTES and key != last:
                yield solved(rows)
                rows, size = [], 0
            last = key
            rows.append(row)
            size += len(row["bytes"])
    if rows:
        yield solved(rows)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document (doc_id, text).

    Every byte is removed that some ``LENGTH``-byte string covers which also starts elsewhere, in the same document or another, as the
    input stands. A null text counts as empty; texts shorter than ``LENGTH`` lose nothing. doc_id is expected to be unique: rows that
    repeat it count as separate places and share their removed ranges. Rows with a null doc_id lose nothing. Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long"), "text"))
    gathered = stored(run_table(docs))
    # rows that were alone in their piece of a task are at most one a piece, so an anchor with many rows is found without them
    crowded = stored(gathered.filter("NOT alone").groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > SHARD_RUNS))
    part, content = Window.partitionBy("anchor", "salt"), Window.partitionBy("anchor", "salt", "content")
    runs = (
        gathered.join(crowded, "anchor", "left")
        .withColumn("salt", F.when(F.col("rows").isNotNull(), F.pmod("content", F.lit(SALTS))).otherwise(0))
        .repartition("anchor", "salt")
        .withColumn("n", F.sum(F.size("docs")).over(content))
        .withColumn("head", F.row_number().over(content.orderBy("docs", "starts")) == 1)
        .withColumn("kinds", F.coalesce("rows", F.sum(F.col("head").cast("long")).over(part)))
        .filter("n > 1 OR kinds > 1 OR cut")
        .drop("rows", "salt", "alone")
    )
    runs = stored(runs)
    discard(gathered, crowded)
    pairs = runs.filter("n > 1").select(F.explode(F.arrays_zip("docs", "starts")).alias("at"), "windows")
    whole = pairs.select(F.col("at.docs").alias("doc_id"), F.col("at.starts").cast("long").alias("start"), (F.col("at.starts") + F.col("windows") + LENGTH - 1).cast("long").alias("stop"))

    parts = F.ceil(F.col("kinds") / SHARD_RUNS).cast("long")
    wanted = runs.filter("head AND (kinds > 1 OR cut)").select(
        F.col("docs")[0].alias("doc_id"), F.struct(F.col("starts")[0].alias("start"), "windows", "anchor", (F.col("n") > 1).alias("whole"), parts.alias("parts"), F.pmod("content", parts).alias("part")).alias("run")
    )
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = [
                {"doc_id": doc_id, "bytes": text[r["start"] : r["start"] + r["windows"] + LENGTH - 1], **r}
                for doc_id, text, own in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist())
                for r in own
                if r["start"] + r["windows"] + LENGTH - 1 <= len(text)  # another row of a repeated doc_id may be shorter
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("anchor", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("whole", pa.bool_()), ("bytes", pa.binary())]))

    strings = docs.join(by_doc, "doc_id").select("doc_id", "text", "runs").mapInArrow(cut_out, "anchor long, part long, parts long, doc_id long, start long, windows long, whole boolean, bytes binary")
    found = stored(strings.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(shard_spans, SPAN))
    split = found.filter("digest IS NOT NULL")
    across = split.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("places")).filter("places > 1")
    merged = split.filter("stop = 0").join(across, ["anchor", "digest"]).select("doc_id", "start", (F.col("start") + LENGTH).alias("stop"))
    spans = found.filter("digest IS NULL").select("doc_id", "start", "stop").union(merged).union(whole)
    by_doc = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, starts, stops in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n_spans = 0
                rest = text
                if starts:
                    steps = np.zeros(len(text) + 1, np.int64)
                    np.add.at(steps, np.minimum(starts, len(text)), 1)
                    np.add.at(steps, np.minimum(stops, len(text)), -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    n_spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
                    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((doc_id, len(text), len(text) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(by_doc, "doc_id", "left").select("doc_id", "text", "starts", "stops").mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Benchmark decontamination: exact windows of benchmark items inside documents, by a prefix-filtered join.

A window is a run of item words. Its words are ordered by how many documents hold them; exact containment needs every word, so
the rarest one is a sufficient prefix. Each place of a document that holds a window's rarest word proposes one start (the place
minus the word's offset in the window); starts outside the document fall to the length and position bounds, and what is left is
compared word by word.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import slices, spread, stored, text_bytes

#: ASCII letters in lower case, digits and every byte of other characters stay; all else becomes a space.
KEPT_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

HIT_COLUMNS = StructType(
    [StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()), StructField("contaminated", BooleanType()), StructField("hit_spans", StringType())]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(KEPT_BYTES).split()


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id and window (words joined by a space), one row for each distinct pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = words_of(text)
                for at in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    windows.append(b" ".join(words[at : at + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.string())], ["item_id", "window"])

    return spread(benchmark.select(F.col("item_id").cast("string"), "text")).mapInArrow(run, "item_id string, window string").distinct()


def document_frequency(docs: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """In how many documents each word of ``vocabulary`` occurs, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(shared.value)}
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in text_bytes(batch.column(0)):
                seen.update(known.keys() & set(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([known[w] for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for row in rows:
        out[row["word"]] = row["n"]
    return out


class WindowIndex:
    """Distinct windows under the place of their rarest word. Word numbers start at 1; 0 is any word of no window."""

    def __init__(self, windows: list[str], vocabulary: list[bytes], frequency: np.ndarray):
        self.known = {w: i + 1 for i, w in enumerate(vocabulary)}
        rows = [[self.known[w] for w in window.encode().split(b" ")] for window in windows]
        self.length = np.array([len(r) for r in rows], np.int64)
        width = int(self.length.max()) if rows else 1
        self.words = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            self.words[i, : len(r)] = r
        rarity = np.concatenate([[np.iinfo(np.int64).max], frequency])[self.words]
        self.offset = rarity.argmin(axis=1) if rows else np.empty(0, np.int64)
        prefix = self.words[np.arange(len(rows)), self.offset]
        self.order = np.argsort(prefix, kind="stable")
        self.first = np.searchsorted(prefix[self.order], np.arange(len(vocabulary) + 2))

    def found(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and window numbers of all occurrences in ``words``."""
        ids = np.fromiter(map(self.known.get, words, [0] * len(words)), np.int64, len(words))
        count = self.first[ids + 1] - self.first[ids]
        count[ids == 0] = 0
        at = np.flatnonzero(count)
        if not len(at):
            return at, at
        count = count[at]
        place = np.repeat(at, count)
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        window = self.order[np.repeat(self.first[ids[at]], count) + rank]
        start = place - self.offset[window]
        fits = (start >= 0) & (start + self.length[window] <= len(ids))
        start, window = start[fits], window[fits]
        for i in range(self.words.shape[1]):  # word by word; most candidates fall at the first few
            inside = i < self.length[window]
            same = ~inside | (ids[np.minimum(start + i, len(ids) - 1)] == self.words[window, i])
            start, window = start[same], window[same]
        return start, window


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def result(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def summary(doc_id: int | None, n: int, starts: np.ndarray, ends: np.ndarray, items: set[str | None]) -> tuple:
    mask = covered(starts, ends, n)
    hits = int(mask.sum())
    digest = hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()
    return doc_id, n, hits, len(items), digest, hits > 0, ",".join(f"{a}:{b}" for a, b in runs(mask))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_windows: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (word ranges) of every document.

    An item of fewer than ``size`` words, but not none, is one window. Up to ``broadcast_windows`` distinct (item, window) rows
    the index is sent to every executor; beyond it :func:`decontaminate_by_join` gives the same rows through a shuffle.
    Null or empty texts have no words and no hits; equal texts of several items share windows and count for each item; items
    with a null id count as one item, which has no place in the digest; documents with null ids keep a row each; other columns are ignored; either table may be empty.
    """
    windows = stored(item_windows(benchmark, size))
    if windows.limit(broadcast_windows + 1).count() > broadcast_windows:
        return decontaminate_by_join(docs, windows)
    docs = spread(docs.select(F.col("doc_id").cast("long"), "text"))
    items: dict[str, list[str]] = {}
    for row in windows.collect():
        items.setdefault(row["window"], []).append(row["item_id"])
    distinct = sorted(items)
    vocabulary = sorted({w for window in distinct for w in window.encode().split(b" ")})
    frequency = document_frequency(docs, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((distinct, [items[w] for w in distinct], vocabulary, frequency))
    schema = to_arrow_schema(HIT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, owners, vocabulary, frequency = shared.value
        index = WindowIndex(distinct, vocabulary, frequency)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = words_of(text)
                start, window = index.found(words)
                hit = {i for w in np.unique(window).tolist() for i in owners[w]}
                rows.append(summary(doc_id, len(words), start, start + index.length[window], hit))
            yield result(schema, rows)

    return docs.mapInArrow(run, HIT_COLUMNS)


def decontaminate_by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for a benchmark of any size. Nothing is broadcast by hand: words meet windows in a shuffled join.

    Document words are paired with the windows whose rarest word they are; the words around the place travel along and are
    compared in the join's condition, so only true occurrences leave it.
    """
    longest = windows.select(F.max(F.size(F.split("window", " "))).alias("n")).first()["n"] or 0
    docs = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, words, places, around, sizes, firsts = [], [], [], [], [], []
            for row_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = [w.decode() for w in words_of(text)]
                for at, word in enumerate(own):
                    first = max(0, at - longest + 1)
                    ids.append(row_id)
                    words.append(word)
                    places.append(at)
                    firsts.append(first)
                    sizes.append(len(own))
                    around.append(own[first : at + longest])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.array(places, pa.int64()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(around, pa.list_(pa.string()))], ["row_id", "word", "place", "first", "n", "around"])

    held = stored(docs)
    # a word of no window is dropped where it is read, by a Bloom filter that Spark may push below the shuffle, or else by the join
    words = held.select("row_id", "text").mapInArrow(tokens, "row_id long, word string, place long, first long, n long, around array<string>")
    split = windows.select("item_id", F.split("window", " ").alias("parts"))
    vocabulary = split.select(F.explode("parts").alias("word")).distinct()
    frequency = words.select("row_id", "word").distinct().join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    rare = (
        windows.select("window").distinct()
        .select("window", F.posexplode(F.split("window", " ")).alias("offset", "word"))
        .join(frequency, "word", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n"), "offset", "word")).alias("rarest"))
        .select("window", F.col("rarest.offset").cast("long").alias("offset"), F.col("rarest.word").alias("word"), F.split("window", " ").alias("parts"))
    )
    start = F.col("place") - F.col("offset")
    matches = words.join(
        rare,
        (words["word"] == rare["word"]) & (start >= 0) & (start + F.size("parts") <= F.col("n")) & (F.slice("around", (start - F.col("first") + 1).cast("int"), F.size("parts")) == F.col("parts")),
    ).select("row_id", "window", start.alias("start"), (start + F.size("parts")).alias("end"))
    matches = matches.join(windows, "window").groupBy("row_id").agg(F.collect_set(F.struct("start", "end")).alias("hits"), F.collect_set(F.struct("item_id")).alias("items"))
    schema = to_arrow_schema(HIT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, hits, items in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                starts = np.array([h["start"] for h in hits or []], np.int64)
                ends = np.array([h["end"] for h in hits or []], np.int64)
                rows.append(summary(doc_id, len(words_of(text)), starts, ends, {i["item_id"] for i in items or []}))
            yield result(schema, rows)

    return held.join(matches, "row_id", "left").select("doc_id", "text", "hits", "items").mapInArrow(run, HIT_COLUMNS)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns as they are.

    Rows that share a doc_id, or have none, go together if one of them holds a window.
    """
    hits = decontaminate(docs, benchmark, **options).filter("contaminated").select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["hit_id"]), "left_anti")

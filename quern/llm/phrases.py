"""Phrases that occur often, and how much more often than their parts would let expect: mining by sample and negative border.

A sample of the documents proposes phrases. A pass over all documents then counts these and their negative border: every phrase that was not
proposed, but whose first and last words (all but one) were. If a phrase of the border turns out to be frequent, the proposal was too
small: it is enlarged, and a further pass counts what the larger one borders on. Then no frequent phrase can
be missing, whatever the sample was.

The further pass does not stop at the next border: a phrase that no pass has counted may be frequent, so phrases built on it are counted with it. One
such pass therefore closes the search.

Passes hand on 64-bit keys of phrases. Equal keys of different phrases can only add to a count, so they can propose a phrase, never hide one; the
last pass counts all phrases left by their words. Which keys are proposed reaches the tasks as bits of a fixed number (a
Bloom filter): what is broadcast does not grow with the input, and a key that passes by accident is counted in vain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, WordHash, discard, mixed, sized_slices, spread, stored

#: Capital letters to small ones, the marks that end a piece to one of them, tabs to blanks.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Stands between pieces; no word is a full stop, since it ends a piece.
_STOP = b"."
#: Bytes of text that a task splits at a time, and different keys or phrases it holds before it hands them on.
_SEGMENT = 2 << 20
_HELD = 1_000_000


def segments(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Words of several texts with a stop between pieces, a bounded part at a time; parts are cut between pieces only."""
    data = b"\n".join((t or "").encode() for t in texts).translate(_FOLD)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > _SEGMENT:
            end = data.rfind(b"\n", at, at + _SEGMENT)
            if end <= at:
                end = data.find(b"\n", at + _SEGMENT)
            end = len(data) if end < 0 else end + 1
        yield data[at:end].replace(b"\n", b" . ").split()
        at = end


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Language and words of each part of the rows (text, lang)."""
    for batch in sized_slices(batches, 0, most=_SEGMENT, rows=4096):
        here: dict[str, list] = {}
        for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            here.setdefault(name, []).append(text)
        for name, texts in here.items():
            for words in segments(texts):
                yield name, words


class PieceHash(WordHash):
    """Hashes of words; 0 for a stop, also after it was emptied."""

    def __init__(self) -> None:
        super().__init__(limit=250_000)

    def __missing__(self, word: bytes) -> int:
        if word == _STOP:
            self[word] = 0
            return 0
        return super().__missing__(word)


class Filter:
    """A set of keys as bits: two for each key. It holds every key put in, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(64 * len(bits) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        first, second = keys & self.mask, (keys >> np.uint64(29)) & self.mask
        six, low = np.uint64(6), np.uint64(63)
        return ((self.bits[first >> six] >> (first & low)) & (self.bits[second >> six] >> (second & low)) & np.uint64(1)).astype(bool)


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """The bits of a Filter for the column ``key``: at most bits / 64 numbers reach the driver, however many keys there are."""
    places = keys.select(F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 29).bitwiseAND(bits - 1))).alias("p"))
    numbers = places.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[numbers.column("at").to_numpy()] = numbers.column("word").to_numpy().view(np.uint64)
    return out


def word_keys(words: list[bytes], known: PieceHash, language: str) -> np.ndarray:
    """One key for each word, different for each language; 0 for a stop."""
    hashes = known.of(words)
    keys = mixed(hashes ^ np.uint64(known[b"\n" + language.encode()])) | np.uint64(1)
    keys[hashes == 0] = 0
    return keys


def longer(shorter: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Keys of the runs of ``length`` words from those of one word less."""
    with np.errstate(over="ignore"):
        return mixed(shorter[: len(words) - length + 1] * _BASE + words[length - 1 :])


class Tally:
    """Counts of keys, merged when many are held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> bool:
        """Count keys; true if so many are held that they should be handed on."""
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])
            if self.size > 2 * _HELD:
                self.parts = [self.merged()]
                self.size = len(self.parts[0][0])
        return self.size > _HELD and len(self.parts) == 1

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, counts = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts, first)

    def batches(self) -> Iterator[pa.RecordBatch]:
        keys, counts = self.merged()
        self.parts, self.size = [], 0
        for at in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)].view(np.int64)), pa.array(counts[at : at + (1 << 17)], pa.int64())], ["key", "n"])


def counted_keys(rows: DataFrame, lengths: range, proposed=None, before=None, every: bool = False) -> DataFrame:
    """key and n of the phrases of these lengths in ``rows`` (text, lang).

    Without ``proposed`` all phrases count. With it (a broadcast Filter's bits), those of one word in it and those whose first and last words, all but one, are
    in it; with ``every``, those whose words all are in it. With ``before``, the proposal of an earlier pass, phrases which that pass has
    counted are left out, and ``proposed`` says which of them are frequent: counted are all others whose first and last words are either frequent or
    counted in this pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally = PieceHash(), Tally()
        now, old = (Filter(b.value) if b is not None else None for b in (proposed, before))
        for name, words in by_language(batches):
            single = word_keys(words, known, name)
            keys, inside = single, single != 0
            if now is not None:
                inside = inside & now.holds(keys)
            earlier = inside & old.holds(keys) if old is not None else None
            if 1 in lengths and tally.add(keys[inside]):
                yield from tally.batches()
            for length in range(2, min(lengths.stop - 1, len(words)) + 1):
                both = inside[:-1] & inside[1:]
                at = np.flatnonzero(both)
                if not len(at):
                    break
                keys = longer(keys, single, length)
                fresh = keys[at]
                if old is not None:
                    done = earlier[at] & earlier[at + 1]
                    if tally.add(fresh[~done]):
                        yield from tally.batches()
                elif tally.add(fresh):
                    yield from tally.batches()
                if every or now is None:
                    inside = both
                elif old is None:
                    inside = np.zeros(len(both), bool)
                    inside[at] = now.holds(fresh)
                else:  # what was not counted before may be frequent, so all that is built on it is counted, too
                    inside, earlier = np.zeros(len(both), bool), np.zeros(len(both), bool)
                    inside[at] = ~done | now.holds(fresh)
                    earlier[at] = done & old.holds(fresh)
        yield from tally.batches()

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def exact_counts(rows: DataFrame, longest: int, frequent) -> DataFrame:
    """lang, phrase and n of the phrases whose keys pass the filter, by their words; and n of all words of each lang under a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, passes = PieceHash(), Filter(frequent.value)
        counts: dict[str, dict[bytes, int]] = {}
        totals: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            while counts:
                name, held = counts.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "phrase", "n"])

        for name, words in by_language(batches):
            single = word_keys(words, known, name)
            totals[name] = totals.get(name, 0) + int((single != 0).sum())
            numbers: dict[bytes, int] = {}
            word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            held = counts.setdefault(name, {})
            keys, group = single, word  # group: equal numbers for equal runs of words, exactly
            inside = (single != 0) & passes.holds(single)
            for length in range(1, min(longest, len(words)) + 1):
                if length > 1:
                    keys = longer(keys, single, length)
                    inside = inside[:-1] & inside[1:]
                    at = np.flatnonzero(inside)
                    inside[at] = passes.holds(keys[at])
                at = np.flatnonzero(inside)
                if not len(at):
                    break
                runs = group[at] if length == 1 else group[at] * len(numbers) + word[at + length - 1]
                _, first, number, n = np.unique(runs, return_index=True, return_inverse=True, return_counts=True)
                group = np.full(len(words), -1)
                group[at] = number
                for i, count in zip(at[first].tolist(), n.tolist()):
                    phrase = b" ".join(words[i : i + length]) if length > 1 else words[i]
                    held[phrase] = held.get(phrase, 0) + count
            if sum(map(len, counts.values())) > 3 * _HELD // 10:
                yield from out()
        yield from out()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([None] * len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "phrase", "n"])

    return rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: float = 0.1, filter_bits: int = 1 << 26, seed: int = 7) -> DataFrame:
    """lang, phrase, n: every phrase of one to ``longest`` words that occurs ``least`` times or more in its language, exactly counted, and all words of a language under
    a null phrase.

    ``share`` of the documents propose phrases that occur there at least so often that one which is frequent in all documents is seldom missed; a
    proposal only decides how many passes are needed. ``filter_bits`` (a power of two) bounds what is broadcast: past some ten
    million frequent phrases the filter lets more and more others through, which costs time and changes nothing.
    """
    spark = docs.sparkSession
    rows = spread(docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).filter("text IS NOT NULL"))
    send = spark.sparkContext.broadcast
    words = stored(counted_keys(rows, range(1, 2)).filter(F.col("n") >= least).select("key"))
    bits = key_filter(words, filter_bits)
    expected = least * share
    enough = max(2, math.ceil(expected - 1.65 * math.sqrt(expected)))
    sample = stored(counted_keys(rows.filter(F.rand(seed) < share), range(2, longest + 1), send(bits), every=True).filter(F.col("n") >= enough).select("key"))
    bits = bits | key_filter(sample, filter_bits)
    proposal = send(bits)
    counted = stored(counted_keys(rows, range(2, longest + 1), proposal).filter(F.col("n") >= least).select("key"))
    frequent = words.unionByName(counted)
    tables = [words, sample, counted]
    if not counted.join(sample, "key", "left_anti").isEmpty():
        # a phrase of the border is frequent. This pass counts all that may border on such phrases up to the full length, so it closes the search
        further = stored(counted_keys(rows, range(2, longest + 1), send(key_filter(frequent, filter_bits)), proposal).filter(F.col("n") >= least).select("key"))
        frequent = frequent.unionByName(further)
        tables.append(further)
    exact = stored(exact_counts(rows, longest, send(key_filter(frequent, filter_bits))).filter((F.col("n") >= least) | F.col("phrase").isNull()))
    discard(*tables)
    return exact


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: float = 0.1, filter_bits: int = 1 << 26) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's ``top`` phrases of two to ``longest`` words by how much they exceed what their parts let expect.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends and those into words at blanks and tabs; phrases lie inside pieces, overlapping
    occurrences all count. ``a`` is a phrase's count (``least`` at least), ``n`` counts all words of the language; a cut into two parts that
    occur ``l`` and ``r`` times gives floor(1000 a n / (l r)), and the lowest-scoring cut counts (ties: the earliest). A phrase inside a longer one that
    occurs as often is left out. Equal scores go by ``a``, then by the phrase's bytes.

    A null lang is the language ``und``; a null or empty text has no words; repeated rows count each; other columns are ignored; an empty
    table, or one without frequent phrases, gives an empty result.
    """
    exact = frequent_phrases(docs, least, longest, share, filter_bits)
    totals = exact.filter("phrase IS NULL").select("lang", F.col("n").alias("total"))
    counts = exact.filter("phrase IS NOT NULL")
    phrases = counts.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    # a longer phrase that occurs as often as one inside it is matched by one that is longer by a single word
    inner = phrases.filter(F.size("words") > 2).select("lang", F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"), F.col("n").alias("outer"))
    widest = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = phrases.join(widest, ["lang", "phrase"], "left").filter("outer IS NULL OR outer < n").drop("outer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    size = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(size("first", "l"), ["lang", "first"]).join(size("rest", "r"), ["lang", "rest"]).join(F.broadcast(totals), "lang")
    best = scored.select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "k", surplus().alias("score")).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.select("lang", "phrase", "best.*").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def surplus() -> Column:
    """floor(1000 a total / (l r)) in whole numbers of 38 digits: the product may pass 64 bits, the quotient is 10 times ``total`` at most."""
    wide = lambda name: F.col(name).cast("decimal(18,0)")
    return F.call_function("div", (wide("a") * wide("total")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))

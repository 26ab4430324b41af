"""Language identification by rank order: a text's most frequent letter n-grams against each language's profile.

N-grams have one to three code points and lie inside one word with a blank on either side. Three code points fit into one
63-bit number, so n-grams are compared exactly, never by a hash. A profile is a language's most frequent n-grams in order; the distance of
a text from it sums how far each of the text's own most frequent n-grams is out of place there.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_slices, spread, stored

#: A task hands on its counts when it holds about so many different n-grams.
_HELD = 1_000_000
#: Code points of a piece of a very long text that is counted at a time.
_PIECE = 1 << 20
_BLANK = 0x20


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point what it counts as: its lower case if it is a letter or a mark, else a blank."""
    table = np.full(0x110000, _BLANK, np.int64)
    for c in range(0x80, 0x110000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(s := chr(c))[0] in "LM":
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    for c in range(0x80):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower())
    return table


@functools.cache
def mark_table() -> np.ndarray:
    """Which code points are marks: they belong to a word but make none."""
    return np.fromiter((not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """The n-grams of a text with repetitions: one to three code points within a word and the blanks around it.

    A mark without a letter before it is no part of a word. Without letters there are none.
    """
    seen = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    c = letter_table()[seen]
    if not text.isascii():
        mark = mark_table()[seen] & (c != _BLANK)
        if mark.any():  # a run of marks counts if what stands before it is a letter
            base = np.maximum.accumulate(np.where(mark, 0, np.arange(len(c))))
            c[mark & (c[base] == _BLANK)] = _BLANK
    letter = c != _BLANK
    one = c[letter]
    two = (c[:-1] << 21 | c[1:])[letter[:-1] | letter[1:]]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[letter[1:-1]]
    return np.concatenate([one, two, three])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a whole text, ascending, and how often each occurs; long texts are counted piece by piece.

    Pieces are cut at blanks; a word that is longer than a piece is cut inside.
    """
    if len(text) <= _PIECE:
        return np.unique(grams(text), return_counts=True)
    parts, at = [], 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text) and (blank := text.rfind(" ", at, end)) > at:
            end = blank
        parts.append(np.unique(grams(text[at:end]), return_counts=True))
        at = end
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several parts added up."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent n-grams (ties: first by code points) and their places from 0; of these, equally frequent ones share the middle of their places."""
    order = np.lexsort((keys, -counts))[:size]
    _, first, group, n = np.unique(-counts[order], return_index=True, return_inverse=True, return_counts=True)
    return keys[order], (first + (n - 1) / 2)[group]


@dataclass
class Profiles:
    """Places of all profiles' n-grams: one row a language, one column an n-gram (ascending); n-grams a profile lacks are ``size`` out of place."""

    languages: list[str]
    keys: np.ndarray
    places: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, float]], size: int) -> Profiles:
        languages = sorted({r[0] for r in rows})
        keys = np.unique(np.array([r[1] for r in rows], np.int64))
        places = np.full((len(languages), len(keys)), np.inf)
        at = {name: i for i, name in enumerate(languages)}
        for name, gram, place in rows:
            places[at[name], np.searchsorted(keys, gram)] = place
        return cls(languages, keys, places, size)

    def distances(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each language the mean distance of a text's n-grams from their places, as a share of the largest, 0 to 1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        apart = np.minimum(np.abs(self.places[:, at[known]] - places[known]), self.size)
        return (apart.sum(axis=1) + self.size * float((~known).sum())) / (self.size * len(keys))


def held_out(doc_id, folds: int = 4, fold: int = 2):
    """Whether a row is kept from learning: crc32 of its id as text, modulo ``folds``, is ``fold``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def learn_profiles(docs: DataFrame, size: int = 1500) -> DataFrame:
    """lang, gram and place: each language's ``size`` most frequent n-grams, from all rows of ``docs`` (text, lang).

    Counts cover every whole text of every row. Rows with a null lang or text teach nothing. N-grams that are equally frequent share the middle
    of their places; which of them enter a full profile goes by code points.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(name, *merged(parts)) for name, parts in held.items()]
            held.clear()
            names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(rows), dtype=np.int32), [len(k) for _, k, _ in rows]), pa.array([r[0] for r in rows], pa.string())).cast(pa.string())
            column = lambda i: pa.array(np.concatenate([r[i] for r in rows]) if rows else [], pa.int64())
            return pa.RecordBatch.from_arrays([names, column(1), column(2)], ["lang", "gram", "n"])

        total = 0
        for batch in sized_slices(batches, 0):
            here: dict[str, list] = {}
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here.setdefault(name, []).append(text)
            for name, texts in here.items():
                part = counted(" ".join(texts))
                held.setdefault(name, []).append(part)
                total += len(part[0])
            if total > _HELD:
                held = {name: [merged(parts)] for name, parts in held.items()}
                total = sum(len(parts[0][0]) for parts in held.values())
                if total > _HELD // 2:
                    yield out()
                    total = 0
        yield out()

    rows = spread(docs.select("text", F.col("lang").cast("string")).filter("lang IS NOT NULL AND text IS NOT NULL"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= size)
    return top.select("lang", "gram", (F.avg("at").over(Window.partitionBy("lang", "n")) - 1).alias("place"))


def identify_languages(docs: DataFrame, profiles: DataFrame, size: int = 1500, compared: int = 400, block: int = 256) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text), from the whole text.

    ``lang_pred`` is the language whose profile is least out of place for the text's ``compared`` most frequent n-grams (ties: first by code
    point). The score is 1 less that distance as a share of the largest possible: 1 for a text that is ordered like the profile, 0 for one without a common n-gram. A null text
    and one without letters gives ``und`` and 0; so does every text when no profile was learned. Only the text decides: rows with equal or null
    doc_id each keep their row; other columns, whatever their names, are ignored; an empty table gives an empty result.

    Profiles hold ``size`` rows a language. Up to ``block`` languages are compared in a pass; with more of them each pass takes the next block of
    languages over all rows and hands on the nearest so far, so the memory of a task is bounded and no language is left out. The driver holds the
    languages' names and one block's profiles.
    """
    profiles = stored(profiles)
    names = sorted(r["lang"] for r in profiles.select("lang").distinct().collect())
    out = spread(docs.select("doc_id", "text")).select("doc_id", "text", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = out.schema
    for start in range(0, len(names), block):
        part = names[start : start + block]
        rows = profiles.filter(F.col("lang").isin(part)).collect()  # at most block * size rows
        model = Profiles.of([tuple(r) for r in rows], size)

        def run(batches: Iterator[pa.RecordBatch], model: Profiles = model) -> Iterator[pa.RecordBatch]:
            for batch in sized_slices(batches, 1):
                found, scores = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if text is None:
                        continue
                    keys, counts = counted(text)
                    if not len(keys):
                        continue
                    distances = model.distances(*ranked(keys, counts, compared))
                    best = int(np.argmin(distances))
                    score = float(1 - distances[best])
                    if found[i] == "und" and scores[i] == 0 or score > scores[i]:
                        found[i], scores[i] = model.languages[best], score
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out.select("doc_id", "lang_pred", "score")

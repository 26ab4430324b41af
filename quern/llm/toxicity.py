"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, zero-width characters, digits and signs that stand for letters), and a lexicon learned from
labelled rows is matched in one pass with an Aho-Corasick automaton. Exception phrases, learned too, cancel the entry they
contain. The sum of weights is divided by the square root of the number of words and mapped to (0, 1).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import slices, spread

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аесорхуіјѕԁһԛԝвмнткοανιρτυχκ", "aecopxyijsdhqwbmhtkoavipt" + "uxk"))
#: Digits and signs that stand for letters inside a word.
SUBSTITUTES = dict(zip("0134578@$!|", "oieastbasil"))
_FOLD = str.maketrans(HOMOGLYPHS)
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
#: Runs of letters, digits and signs with a substitute; only looked for at the start of a run, so long runs cost their length.
_DISGUISED = re.compile(r"(?<![\w@$!|])[^\W0134578]*+[0134578@$!|][\w@$!|]*+")
_LETTER = re.compile(r"[^\W\d_]")
_BEFORE_LETTER = re.compile(r"[0134578@$!|](?=[^\W\d_])")
_LEADING = re.compile(r"[0134578@$|]++[^\W\d_]")
_TRAILING = "@$!|_"
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_WORD = re.compile(r"[^\W\d_]+")


_LOOKALIKE = re.compile(f"[{''.join(HOMOGLYPHS)}]")


def undisguised(run: str) -> str:
    """A run with the letters that its substitutes stand for, if one stands before a letter and after another or at the start."""
    if _LEADING.match(run):
        start = 0
    else:
        letter = _LETTER.search(run)
        if letter is None or _BEFORE_LETTER.search(run, letter.end()) is None:
            return run
        start = letter.start()
    end = len(run.rstrip(_TRAILING))
    return run[:start] + run[start:end].translate(_SUBSTITUTE) + run[end:]


def folded(text: str) -> str:
    """A text in lower case and compatibility form, without hidden characters, homoglyphs and disguised letters."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _HIDDEN.search(text):
            text = _HIDDEN.sub("", text)
        if _LOOKALIKE.search(text):
            text = text.translate(_FOLD)
    if any(sign in text for sign in SUBSTITUTES):
        text = _DISGUISED.sub(lambda m: undisguised(m.group()), text)
    return text


def folded_words(text: str) -> list[str]:
    """The words of a text after folding."""
    return _WORD.findall(folded(text))


#: So many occurrences of an entry count for the score; more of the same word say no more.
MOST = 8


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the line from a normalised sum to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    intercept: float = -3.0

    def anywhere(self) -> ahocorasick.Automaton:
        """Finds entries inside words, too: a text without any needs no further look."""
        found = ahocorasick.Automaton()
        for entry in self.weights:
            found.add_word(entry, 1)
        if len(found):
            found.make_automaton()
        return found

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for number, entry in enumerate(self.weights):
            found.add_word(f" {entry} ", (number, len(entry) + 1))
        for phrase in self.exceptions:
            if phrase not in self.weights:
                found.add_word(f" {phrase} ", (-1, len(phrase) + 1))
        if len(found):
            found.make_automaton()
        return found


def entry_counts(found: ahocorasick.Automaton, words: list[str]) -> Counter:
    """Occurrences of each entry that lie in no exception phrase; each occurrence counts or is cancelled once, by its place."""
    if not words or not len(found):
        return Counter()
    matches = [(end - length, end, number) for end, (number, length) in found.iter(f" {' '.join(words)} ")]
    spans = sorted(m[:2] for m in matches if m[2] < 0)
    if not spans:
        return Counter(number for *_, number in matches)
    starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    free = lambda start, end: not (at := bisect_right(starts, start)) or ends[at - 1] < end
    return Counter(number for start, end, number in matches if number >= 0 and free(start, end))


def held_out(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id and toxic of at most ``rows`` labelled documents outside the held-out fold, one for each distinct text.

    The bound is what allows the broadcast. Rows are taken in the order of a hash of doc_id, the same at every size.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return texts.select("doc_id", "toxic")


def document_counts(rows: DataFrame, terms, limit: int = 100_000) -> DataFrame:
    """term, positive and n: in how many rows (text, toxic) each of ``terms(words)`` occurs, summed in the task first, which holds ``limit`` terms and those of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            every = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] + seen[1][t] for t in every], pa.int64())], ["term", "positive", "n"])
            seen[0].clear()
            seen[1].clear()
            return batch

        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[int(toxic == 1)].update(set(terms(folded_words(text or ""))))
                if len(seen[0]) + len(seen[1]) > limit:
                    yield out()
        yield out()

    return rows.select("text", "toxic").mapInArrow(run, "term string, positive long, n long").groupBy("term").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n"))


def fitted(hits: list[tuple[dict[int, int], int, int]], entries: int, steps: int = 300, shrink: float = 2e-4, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic weights of the entries and the intercept, from (counts, words, label) rows; weights stay at or above 0."""
    row = np.array([i for i, (c, _, _) in enumerate(hits) for _ in c], np.int64)
    entry = np.array([e for c, _, _ in hits for e in c], np.int64)
    value = np.array([min(v, MOST) / np.sqrt(max(n, 16)) * 4 for c, n, _ in hits for v in c.values()], float)
    y = np.array([label for *_, label in hits], float)
    w, b, square, square_b = np.ones(entries), -3.0, np.full(entries, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, w[entry] * value, len(y)) + b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(entry, off[row] * value, entries) / len(y) + shrink * w
        square += g * g
        square_b += off.mean() ** 2
        w = np.maximum(w - rate * g / np.sqrt(square), 0)
        b -= rate * off.mean() / np.sqrt(square_b)
    slope, b = calibrated(np.bincount(row, w[entry] * value, len(y)), y)
    return w * slope, b


def calibrated(total: np.ndarray, y: np.ndarray, steps: int = 60, shrink: float = 1e-5) -> tuple[float, float]:
    """Slope and intercept that turn sums into chances: Newton steps of a two-parameter logistic fit."""
    x = np.column_stack([total, np.ones(len(total))])
    line = np.array([1.0, -3.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + shrink * line
        curve = (x.T * (p * (1 - p))) @ x / len(y) + shrink * np.eye(2)
        line -= np.clip(np.linalg.solve(curve, gradient), -1, 1)
    return float(max(line[0], 0)), float(line[1])


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = 100_000, max_entries: int = 5_000, min_positive: int = 4) -> Lexicon:
    """Learn entries, weights and exceptions from a bounded sample of labelled rows outside the held-out fold.

    An entry is a word that occurs in at least ``min_positive`` distinct toxic texts and whose log-odds, less two standard
    errors, are above log 4; of these the ``max_entries`` most telling ones stay. An exception is a pair of words around an
    entry that occurs in at least ``min_positive`` clean texts and no toxic one. Without labelled rows, or with one
    label only, the lexicon is empty and every text gets the same score.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, sample_rows)
    # at most sample_rows rows by construction
    sample = docs.sparkSession.createDataFrame(sample.collect(), "doc_id long, toxic int")
    rows = spread(docs.select("doc_id", "text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("positive")).first()
    positives, negatives = totals["positive"] or 0, totals["n"] - (totals["positive"] or 0)
    if not positives or not negatives:
        return Lexicon()
    p, q = F.col("positive") + 0.5, F.col("n") - F.col("positive") + 0.5
    odds = F.log(p / q) + float(np.log((negatives + 1) / (positives + 1)))
    telling = odds - 2 * F.sqrt(1 / p + 1 / q)
    chosen = document_counts(rows, lambda words: words).filter((F.col("positive") >= min_positive) & (telling > float(np.log(4)))).orderBy(telling.desc(), "term").limit(max_entries)
    entries = sorted(r["term"] for r in chosen.collect())
    if not entries:
        return Lexicon()
    known = frozenset(entries)

    def around(words: list[str]) -> list[str]:
        return [f"{a} {b}" for a, b in zip(words, words[1:]) if a in known or b in known]

    phrases = document_counts(rows, around).filter((F.col("positive") == 0) & (F.col("n") >= min_positive)).orderBy(F.desc("n"), "term").limit(max_entries)
    lexicon = Lexicon(dict.fromkeys(entries, 1.0), tuple(sorted(r["term"] for r in phrases.collect())))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for batch in slices(batches):
            hits, sizes = [], []
            for text in batch.column(0).to_pylist():
                words = folded_words(text or "")
                hits.append(list(entry_counts(found, words).items()))
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.map_(pa.int32(), pa.int32())), pa.array(sizes, pa.int32()), batch.column(1).cast(pa.int32())], ["hits", "words", "toxic"])

    fit_rows = rows.mapInArrow(features, "hits map<int,int>, words int, toxic int").collect()  # at most sample_rows rows
    weights, intercept = fitted([(r["hits"] or {}, r["words"], r["toxic"]) for r in fit_rows], len(entries))
    lexicon.weights = {e: float(w) for e, w in zip(entries, weights) if w > 1e-3}
    lexicon.intercept = intercept
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of ``docs`` (text, ...) with score in (0, 1) and n_matches, from every whole text.

    An entry counts for at most ``MOST`` occurrences. A null or empty text has no match and the score of the intercept. Folding and matching
    take time in proportion to a text's length, however long its words are. Only the text decides: equal texts score alike, null ids and
    repeated rows keep a row each; columns of ``docs`` named score or n_matches are replaced; an empty table gives an empty result.
    """
    docs = spread(docs.drop("score", "n_matches"))
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("n_matches", IntegerType())])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, anywhere, weights = lexicon.automaton(), lexicon.anywhere(), list(lexicon.weights.values())
        for batch in slices(batches):
            scores, matches = [], []
            for text in batch.column(place).to_pylist():
                text = folded(text or "")
                words = _WORD.findall(text) if text and len(anywhere) and next(anywhere.iter(text), None) else []
                counts = entry_counts(found, words)
                total = sum(weights[e] * min(c, MOST) for e, c in counts.items()) * 4 / np.sqrt(max(len(words), 16))
                scores.append(float(1 / (1 + np.exp(-min(max(total + lexicon.intercept, -30), 30)))))
                matches.append(sum(counts.values()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(matches, pa.int32())], [*batch.schema.names, "score", "n_matches"])

    return docs.mapInArrow(run, schema)

"""Fuzzy line deduplication: normalised lines, pigeonhole blocks of rare word pairs, edit similarity, connected groups.

A line's words are normalised, and for the comparison each becomes one symbol, so that the edit distance of two lines counts words.
Keys are pairs of neighbouring words, common pairs together with the next word. An edit takes away at most three keys, so of any 3 d + 1 keys that a line
shows, one outlives d edits: lines that are alike share one of the keys that come first in any fixed order of all keys. Rare ones come first, so few
other lines share them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, release, sized_slices, spread, stored
from .components import connected_components, in_blocks

#: ASCII marks and control characters end words, and every digit counts as 0. Capitals are lower-cased before.
_FOLDED = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or b == 0x0A else 0x30 if 0x30 <= b <= 0x39 else 0x20 for b in range(256))
#: Thai, Lao, Burmese, Khmer, kana and Han characters are words of their own: these scripts put no spaces between words.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
#: First bytes of characters from U+0800 on, below which there is no unspaced script.
_THREE_BYTES = 0xE0
_ALPHABET = 0xF0000
_NUMBER = np.uint64(2)
#: More lines than any document has.
_LINES = 1 << 31
#: Bytes hashed at a time; a longer word is hashed by itself.
_PIECE = 1 << 16
#: Documents from which the order of word pairs is estimated, and cells of the estimate. They decide on speed alone.
_SAMPLE, _CELL_BITS = 20_000, 23
#: Words that a sample has no more often are equally rare. A pair whose levels sum up to more than _COMMON is common: it is a key
#: together with the next word, if there is one, which takes off _WORD levels. Only the pair decides, never the line's length.
_RARE, _COMMON, _WORD = 64, 16, 68
#: Keys up to this cost are alike in the second order: those of lines that a sample has 8 times or less.
_ALIKE = 64
#: Keys that a line shows at most if not every pair is asked for: all that are needed up to 29 words.
MOST_KEYS = 16
#: Parts of all keys for each partition of the documents, and bits of a key beside its part. There are 128 parts at least, so a key has 39 bits or more.
_PARTS, _REST = 2, 32
#: Keys of a part that a task holds before it hands them on, and of all parts at most.
_HELD, _MOST_HELD = 2048, 1 << 20
#: Of buckets of up to so many lines all pairs with near sketches are compared. In larger ones those lines that are near any other are compared with the
#: first of them, then by blocks in tasks; of buckets of more than _WHOLE lines, which no task holds, all lines.
_SMALL, _WHOLE = 32, 1024
#: Bucket rows that a task holds, beside those of the last bucket.
_ROWS = 1 << 15
#: Pairs of lines whose sketches are compared at once.
_AT_ONCE = 1 << 16
#: The sketch of a line's pairs of neighbours has 2 to the power of this many bits.
_PAIR_BITS = 10
#: Lines of which a task remembers that their keys are out already.
_SEEN = 100_000
#: Lines of fewer words are alike only if they are equal.
FUZZY_WORDS = 4
#: An odd factor and the random value of each byte: a word's code is a polynomial in the factor.
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the factor and of its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE, f)]), dtype=np.uint64) for f in (_FACTOR, inverse))


def folded(text: str | None) -> bytes:
    """A text in compatibility form and lower case: letters, 0 for digits, spaces for marks, and line ends."""
    text = text or ""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if np.frombuffer(text.encode(), np.uint8).max() >= _THREE_BYTES:
            text = _UNSPACED.sub(r" \1 ", text)
    return text.lower().encode().translate(_FOLDED)


def word_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of each word of folded bytes, and where each word starts. Words of digits only have a fixed code."""
    codes, places, at = [], [], 0
    power, inverse = powers()
    while at < len(data):
        end = len(data)
        if end - at > _PIECE:
            end = max(data.rfind(b" ", at, at + _PIECE), data.rfind(b"\n", at, at + _PIECE)) + 1
            if end == 0:  # a word of more than a piece
                end = min((e for e in (data.find(b" ", at), data.find(b"\n", at)) if e >= 0), default=len(data))
                word = data[at:end]
                codes.append(np.array([xxhash.xxh3_64_intdigest(word) if word.strip(b"0") else _NUMBER], np.uint64))
                places.append(np.array([at]))
                at = end
                continue
        piece = np.frombuffer(data, np.uint8, end - at, at)
        inside = piece > 0x20
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate([[0] if inside[0] else [], edges, [len(piece)] if inside[-1] else []]).astype(np.int64)
        start, stop = edges[::2], edges[1::2]
        if len(start):
            with np.errstate(over="ignore"):
                total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[piece] * power[: len(piece)], dtype=np.uint64)])
                own = mixed((total[stop] - total[start]) * inverse[start])
            maybe = np.flatnonzero((piece[start] == 0x30) & (piece[stop - 1] == 0x30))
            if len(maybe):
                letters = np.concatenate([[0], np.cumsum(piece != 0x30, dtype=np.int64)])
                own[maybe[letters[stop[maybe]] == letters[start[maybe]]]] = _NUMBER
            codes.append(own)
            places.append(start + at)
        at = end
    return (np.concatenate(codes), np.concatenate(places)) if codes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def line_words(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """All word codes of some texts, and for each line: text number, line number, first word and number of words."""
    parts = [folded(t) for t in texts]
    lines = np.array([p.count(b"\n") + 1 for p in parts], np.int64)
    data = b"\n".join([*parts, b""]) if parts else b""
    words, place = word_codes(data)
    first = np.searchsorted(place, np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A))
    text = np.repeat(np.arange(len(texts)), lines)
    number = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
    count = np.diff(np.concatenate([[0], first]))
    return words, text, number, first - count, count


def in_line(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words of chosen lines, and each one's rank in its line."""
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + rank, rank


def line_digests(words: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over (word, rank) for each line."""
    with np.errstate(over="ignore"):
        return tuple(np.add.reduceat(mixed(words + (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(seed)), start).view(np.int64) for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def most_edits(count: np.ndarray, similarity: float) -> np.ndarray:
    """The most edits that two lines may differ in if the longer has ``count`` words."""
    return np.floor(count * (1 - similarity) + 1e-9).astype(np.int64)


def prefix_lengths(count: np.ndarray, similarity: float) -> np.ndarray:
    """How many of its first keys a line of ``count`` words must show to meet all lines that are alike.

    A substituted or deleted word takes away three of a line's keys at most, an inserted one two. Beside a line of n >= count words, n - count edits
    or more are insertions.
    """
    sizes, code = np.unique(count, return_inverse=True)
    longer = [np.arange(m, int(m / similarity) + 2) for m in sizes.tolist()]
    return np.array([(3 * most_edits(n, similarity) - n + n[0]).max() + 1 for n in longer], np.int64)[code]


def rare_pairs(words: np.ndarray, count: np.ndarray, level: tuple[np.ndarray, np.ndarray], similarity: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines of ``count`` words: how many each line shows, and the keys.

    The rarest come first. A line that would need more than ``most`` shows half as many of these, and as many more of its keys in an order by
    hash in which all that are not very common count alike: what a large group of copies shares is more common than what sets them apart.
    """
    keys = [np.empty(0, np.int64)]
    needed = np.minimum(prefix_lengths(count, similarity), count - 1)
    more = np.where(needed > most, most // 2, 0)
    limit = np.minimum(needed, most - more)
    for at in range(0, len(count), 1 << 17):  # line numbers take 17 bits of the sorted value
        own, n = words[count[:at].sum() : count[: at + (1 << 17)].sum()], count[at : at + (1 << 17)]
        last = np.cumsum(n) - 1
        value = pair_values(own)
        single, double = level[0][cells(own)].astype(np.int64), level[1][cells(value)].astype(np.int64)
        cost = np.maximum(single[:-1] + single[1:], double)
        # a common pair takes in the word after it; if that pair is common, too, the three may often stand together
        line = np.repeat(np.arange(len(n)), n)
        wide = np.flatnonzero((cost[:-1] > _COMMON) & (line[2:] == line[:-2]))
        with np.errstate(over="ignore"):
            value[wide] = mixed(value[wide] + own[wide + 2])
        cost[wide] = np.maximum(single[wide] + single[wide + 1] + single[wide + 2] - _WORD, np.minimum(double[wide], double[wide + 1]))
        value >>= np.uint64(25)
        pairs = n - 1
        begin = np.cumsum(pairs) - pairs
        found, owner = [], []
        for less, take in ((0, limit[at : at + (1 << 17)]), (_ALIKE, more[at : at + (1 << 17)])):
            if not take.any():
                continue
            order = value | (np.clip(cost - less, 0, 255).astype(np.uint64) << np.uint64(39)) | (line[:-1].astype(np.uint64) << np.uint64(47))
            order = np.sort(np.delete(order, last[:-1]))
            place, _ = in_line(begin, take)
            # a key that a line has several times counts as several
            fresh = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
            again = place - np.repeat(fresh, np.diff(np.concatenate([fresh, [len(order)]])))[place]
            with np.errstate(over="ignore"):
                found.append(mixed((order[place] & np.uint64((1 << 39) - 1)) + again.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64))
            owner.append(np.repeat(np.arange(len(n)), take))
        if found:
            keys.append(np.concatenate(found)[np.argsort(np.concatenate(owner), kind="stable")])
    return limit + more, np.concatenate(keys)


def cells(words: np.ndarray) -> np.ndarray:
    """The cells of words, or of pairs of neighbours."""
    return (words >> np.uint64(64 - _CELL_BITS)).astype(np.int64)


def pair_values(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def rarity(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How common the words and the pairs of words of each cell are in a sample, on a scale of logarithms from 0 to 255.

    0 is the square of the share of _RARE words. Words that often stand together show in the pairs only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in sized_slices(batches, 0):
            words = line_words(batch.column(0).to_pylist())[0]
            single.append(cells(words))
            double.append(cells(pair_values(words)))
        for pairs, found in enumerate((single, double)):
            n = np.bincount(np.concatenate(found))
            cell = np.flatnonzero(n > pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), bool(pairs))), pa.array(cell), pa.array(n[cell])], ["pair", "cell", "n"])

    rows = docs.count()
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(rows, 1))) < _SAMPLE).select("text").repartition(8)
    counts = sample.mapInArrow(run, "pair boolean, cell long, n long").groupBy("pair", "cell").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") > F.when(F.col("pair"), 7).otherwise(_RARE)).toArrow()  # bounded by the sample
    pair, cell, n = (found[c].to_numpy() for c in ("pair", "cell", "n"))
    total = max(counts.filter("NOT pair").agg(F.sum("n")).first()[0] or 0, _RARE**2)
    levels = np.zeros((2, 1 << _CELL_BITS), np.uint8)
    # words are equally rare up to a point: an edit's own words are the rarest, and their pairs must not come before all shared ones
    levels[0, cell[~pair]] = np.clip(4 * np.log2(n[~pair] / _RARE), 0, 255)
    levels[1, cell[pair]] = np.clip(4 * np.log2(n[pair] * (total / _RARE**2)), 0, 255)
    return levels[0], levels[1]


OCCURRENCES = "low long, high long, doc_id long, line int, words int, sketch_0 long, sketch_1 long"


def line_occurrences(docs: DataFrame) -> DataFrame:
    """The digest (low, high), place, number of words and sketch of every line but blanks.

    Each word of a line turns over one of the 128 bits of its sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 1):
            texts = batch.column(1).to_pylist()
            words, text, number, first, count = line_words(texts)
            ids = batch.column(0).to_numpy()
            chosen = np.flatnonzero(count >= 1)
            low = high = np.empty(0, np.int64)
            sketch = [low, low]
            size = count[chosen]
            if len(chosen):
                place, rank = in_line(first[chosen], size)
                start = np.cumsum(size) - size
                low, high = line_digests(words[place], rank, start)
                bit = words[place] >> np.uint64(57)
                sketch = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == half, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), start).view(np.int64) for half in (0, 1)]
            # lines of marks only have no words, so their own characters count
            bare = np.flatnonzero(count == 0)
            parts = {t: (texts[t] or "").split("\n") for t in set(text[bare].tolist())}
            marks = [(i, parts[t][n].strip()) for i, t, n in zip(bare.tolist(), text[bare].tolist(), number[bare].tolist())]
            marks = [(i, xxhash.xxh3_128_digest(m)) for i, m in marks if m]
            digests = np.frombuffer(b"".join(d for _, d in marks), np.int64).reshape(-1, 2)
            every = np.concatenate([chosen, np.array([i for i, _ in marks], np.int64)])
            if len(every):
                sketches = [pa.array(np.concatenate([half, np.zeros(len(marks), np.int64)])) for half in sketch]
                columns = [pa.array(np.concatenate([a, b])) for a, b in zip((low, high), digests.T)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[text[every]]), pa.array(number[every], pa.int32()), pa.array(count[every], pa.int32()), *sketches], ["low", "high", "doc_id", "line", "words", "sketch_0", "sketch_1"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, OCCURRENCES)


def line_keys(docs: DataFrame, similarity: float, min_words: int, most_keys: int) -> DataFrame:
    """Keys and ids (digests' low halves) of the lines of ``min_words`` words or more, packed by part: the first bits of a key say its part, ``rest`` holds the next 32.

    A line that a task has just seen elsewhere is left out: equal lines have equal keys.
    """
    level = rarity(docs)
    bits = max(39 - _REST, (_PARTS * docs.rdd.getNumPartitions() - 1).bit_length())
    most_held = min(_HELD << bits, _MOST_HELD)

    def packed(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        rest = (keys >> np.uint64(64 - bits - _REST)).astype("<u4")
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        last = np.append(first[1:], len(part))
        for at in range(0, len(first), 256):
            ends = list(zip(first[at : at + 256].tolist(), last[at : at + 256].tolist()))
            columns = [pa.array(part[first[at : at + 256]], pa.int32()), *(pa.array([v[a:b].tobytes() for a, b in ends], pa.binary()) for v in (rest, ids))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "rest", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size_held = ([], []), 0
        for batch in sized_slices(batches, 0):
            words, _, _, first, count = line_words(batch.column(0).to_pylist())
            first, size = first[count >= min_words], count[count >= min_words]
            if not len(size):
                continue
            place, rank = in_line(first, size)
            low = line_digests(words[place], rank, np.cumsum(size) - size)[0]
            if len(seen) > _SEEN:
                seen.clear()
            fresh = np.fromiter((d not in seen and not seen.add(d) for d in low.tolist()), bool, len(low))
            place, _ = in_line(first[fresh], size[fresh])
            shown, keys = rare_pairs(words[place], size[fresh], level, similarity, most_keys)
            held[0].append(keys)
            held[1].append(np.repeat(low[fresh], shown))
            size_held += len(keys)
            if size_held > most_held:
                yield from packed(*map(np.concatenate, held))
                held, size_held = ([], []), 0
        if size_held:
            yield from packed(*map(np.concatenate, held))

    return docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(run, "part int, rest binary, ids binary")


def buckets(keys: DataFrame) -> DataFrame:
    """key, id and n (lines of the bucket) of all buckets of two lines or more, from packed ``keys``: each part is sorted as a whole where it meets."""

    def shared(part: int, rest: list[bytes], ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not rest:
            return
        key, own = np.frombuffer(b"".join(rest), "<u4"), np.frombuffer(b"".join(ids), np.int64)
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        several = np.append(same, False) | np.append(False, same)
        key, own = key[several], own[order[several]]
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        if len(key):  # a line that several tasks have met counts once
            fresh = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
            key, own = key[fresh], own[fresh]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            n = np.repeat(size, size)
            key, own, n = key[n > 1], own[n > 1], n[n > 1]
        for at in range(0, len(key), 1 << 16):
            piece = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[piece].astype(np.int64) | part << _REST), pa.array(own[piece]), pa.array(n[piece], pa.int64())], ["key", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, ids = -1, [], []
        for batch in batches:
            for part, r, i in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    yield from shared(now, rest, ids)
                    now, rest, ids = part, [], []
                rest.append(r)
                ids.append(i)
        yield from shared(now, rest, ids)

    return keys.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, id long, n long")


def line_symbols(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and symbols of the lines of ``wanted`` (id, doc_id, line): one character of the supplementary planes for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, 0):
            texts, asked, ids = [], [], []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = (text or "").split("\n")
                own = [x for x in own if x["line"] < len(parts)]  # another row of a repeated doc_id may be shorter
                asked += [parts[x["line"]] for x in own]
                ids += [x["id"] for x in own]
            words, *_, first, count = line_words(asked)
            symbols = (words % np.uint64(_ALPHABET) + np.uint64(0x10000)).astype("<u4")
            texts = [symbols[f : f + n].tobytes().decode("utf-32-le") for f, n in zip(first.tolist(), count.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "symbols"])

    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))
    return docs.join(by_doc.hint("shuffle_hash"), "doc_id").select("text", "wanted").mapInArrow(run, "id long, symbols string")


def edit_alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether 1 - distance / length of the longer line reaches ``similarity``, both in words."""
    most = F.floor(F.greatest(F.length(a), F.length(b)) * F.lit(1 - similarity) + 1e-9).cast("int")
    near = F.call_function("levenshtein", a, b, most) >= 0
    return (F.abs(F.length(a) - F.length(b)) <= most) & near


def turned(sketch: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of lines differ; an edit turns over two at most. Of a negative number numpy would count those of its absolute value."""
    return sum(np.bitwise_count((half[one] ^ half[other]).view(np.uint64)).astype(np.int64) for half in sketch)


def near_lines(members: DataFrame, similarity: float) -> DataFrame:
    """What sketches leave of ``members`` (key, id, n, words, sketch_0, sketch_1): pairs (a, b) with a null key, and members (key, a) of large buckets.

    Pairs are all near ones of a small bucket. In a larger one the lines that are near any other stay members, and make pairs with the first of them if near. Of a bucket
    of over _WHOLE lines all stay, and it goes through a task without being held.
    """

    def near(words: np.ndarray, sketch: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
        most = most_edits(np.maximum(words[one], words[other]), similarity)
        return (turned(sketch, one, other) <= 2 * most) & (np.abs(words[one] - words[other]) <= most)

    def left(rows: list[np.ndarray], begun: bool) -> Iterator[pa.RecordBatch]:
        """``begun``: the first row was seen before and is only there to be compared with."""
        key, ids, n, words, *sketch = rows
        place = np.arange(len(key))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        lead, size, whole = np.repeat(first, size), np.repeat(size, size), n <= _WHOLE
        others = np.where(whole, lead + size - 1 - place, 0)
        total = np.cumsum(others)
        active, pairs, at = ~whole, [], 0
        while at < len(key):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _AT_ONCE, "right")))
            one = np.repeat(place[at:end], others[at:end])
            other, _ = in_line(place[at:end] + 1, others[at:end])
            kept = near(words, sketch, one, other)
            one, other = one[kept], other[kept]
            small = size[one] <= _SMALL
            pairs.append((one[small], other[small]))
            active[one[~small]] = active[other[~small]] = True
            at = end
        some = np.flatnonzero(active)
        start = some[np.searchsorted(lead[some], lead[some])]
        kept = (start != some) & near(words, sketch, start, some)
        pairs.append((start[kept], some[kept]))
        a, b = (ids[np.concatenate(x)] for x in zip(*pairs))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["key", "a", "b"])
        some = some[int(begun and active[0]) :]
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(ids[some]), pa.nulls(len(some), pa.int64())], ["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = [], False
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append([c.to_numpy() for c in batch.columns])
                if sum(len(h[0]) for h in held) < _ROWS:
                    continue
            if not held:
                break
            rows = [np.concatenate(c) for c in zip(*held)]
            key, n = rows[0], rows[2]
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            goes_on = batch is not None and n[-1] > _WHOLE
            end = len(key) if batch is None or goes_on else last
            if end:
                yield from left([c[:end] for c in rows], begun)
                begun = goes_on
            held = [[c[last : last + 1] if goes_on else c[end:] for c in rows]]

    rows = members.select("key", "id", "n", "words", "sketch_0", "sketch_1")
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, a long, b long")


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two texts is ``most`` at most: bit-parallel, after what they share at both ends."""
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b or abs(len(a) - len(b)) > most:
        return max(len(a), len(b)) <= most
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for y in b:
        equal = at.get(y, 0)
        flat = (((equal & up) + up) ^ up) | equal
        right, left = down | (full & ~(flat | up)), up & flat
        score += bool(right & top) - bool(left & top)
        steep = equal | down
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = left | (full & ~(steep | right)), right & steep
    return score <= most


def sketched(outside: np.ndarray, inside: np.ndarray, component: np.ndarray, words: np.ndarray, sketch: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each line of ``outside`` with those of ``inside`` that are in other components and may be alike by lengths and sketches, and the most edits of each pair."""
    allowed = most_edits(words, similarity)
    step = max(1, _AT_ONCE // max(1, len(inside)))
    for at in range(0, len(outside), step):
        some = outside[at : at + step, None]
        most = np.maximum(allowed[some], allowed[inside])
        bits = turned(sketch, some, inside)
        row, column = np.nonzero((bits <= 2 * most) & (np.abs(words[some] - words[inside]) <= most) & (component[some] != component[inside]))
        ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1 if len(row) else []
        start = 0
        for end in ends:
            r, c = row[start], column[start:end]
            yield int(some[r, 0]), inside[c], most[r, c]
            start = end


def numbered(values: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A number from 1 for each different value (from 0) and how often its line had it before: what two lines have in common, they have as often."""
    order = np.lexsort((values, line))
    fresh = np.flatnonzero(np.append(True, (values[order[1:]] != values[order[:-1]]) | (line[order[1:]] != line[order[:-1]])))
    before = np.empty(len(values), np.int64)
    before[order] = np.arange(len(values)) - np.repeat(fresh, np.diff(np.append(fresh, len(values))))
    return np.unique(values * (before.max(initial=0) + 1) + before, return_inverse=True)[1] + 1


class Strict:
    """What tells lines apart before their edits are counted, however long they are: words and pairs of neighbours that one of them has and the other has not.

    An edit turns over four bits at most of a sketch of the pairs, and takes one word or two pairs at most from what the lines have in common.
    """

    def __init__(self, symbols: list[str], words: np.ndarray):
        self.words, self.first = words, np.cumsum(words) - words
        line = np.repeat(np.arange(len(words)), words)
        _, codes = np.unique(np.frombuffer("".join(symbols).encode("utf-32-le"), "<u4"), return_inverse=True)
        starts = np.flatnonzero(line[1:] == line[:-1])
        self.codes, self.pairs = numbered(codes, line), np.zeros(len(codes), np.int64)  # 0 where a line ends
        self.pairs[starts] = numbered(codes[starts] * (len(codes) + 1) + codes[starts + 1], line[starts])
        self.own_word, self.own_pair = (np.zeros(len(codes) + 1, bool) for _ in range(2))
        bit = line[starts] << _PAIR_BITS | (mixed(self.pairs[starts].astype(np.uint64)) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        odd = np.bincount(bit, minlength=len(words) << _PAIR_BITS) & 1
        self.sketch = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(words), -1)

    def left(self, i: int, near: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``near`` that ``most`` edits may make line i, and their ``most``."""
        kept = np.bitwise_count(self.sketch[near] ^ self.sketch[i]).sum(1, dtype=np.int64) <= 4 * most
        near, most = near[kept], most[kept]
        if not len(near):
            return near, most
        n = self.words[near]
        place, start = in_line(self.first[near], n)[0], np.cumsum(n) - n
        longer = np.maximum(n, self.words[i])
        kept = np.ones(len(near), bool)
        for values, own, size, each in ((self.codes, self.own_word, self.words[i], 1), (self.pairs, self.own_pair, self.words[i] - 1, 2)):
            here = values[self.first[i] : self.first[i] + size]
            own[here] = True
            kept &= longer - (each - 1) - np.add.reduceat(own[values[place]], start, dtype=np.int64) <= each * most
            own[here] = False
        return near[kept], most[kept]


def large_links(members: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between lines (id, words, sketch_0, sketch_1, symbols) of different components in buckets (key, id, component).

    Pairs of blocks are compared in a task, sketches first and of many lines at once; only links that join components leave it, fewer than there are lines.
    """

    def linked(group: pa.Table) -> pa.Table:
        outside = group["outside"].to_numpy()
        ids, component, words = (group[c].to_numpy().astype(np.int64, copy=True) for c in ("id", "component", "words"))
        sketch = [group[c].to_numpy() for c in ("sketch_0", "sketch_1")]
        out = ([], [])
        symbols = None
        for i, near, most in sketched(np.flatnonzero(outside), np.flatnonzero(~outside), component, words, sketch, similarity):
            if symbols is None:
                symbols = group["symbols"].to_pylist()
                strict = Strict(symbols, words)
            # what has become one component since is not compared again
            left = component[near] != component[i]
            near, most = strict.left(i, near[left], most[left])
            while len(near):
                j, limit, near, most = int(near[0]), int(most[0]), near[1:], most[1:]
                if edits_within(symbols[i], symbols[j], limit):
                    out[0].append(int(ids[i]))
                    out[1].append(int(ids[j]))
                    component[component == component[j]] = component[i]
                    left = component[near] != component[i]
                    near, most = near[left], most[left]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return in_blocks(members, "key").join(lines, "id").groupBy("key", "one", "other").applyInArrow(linked, "a long, b long")


def line_groups(docs: DataFrame, distinct: DataFrame, similarity: float, min_words: int, most_keys: int) -> DataFrame:
    """id and group of every line of ``distinct`` that is linked with another.

    Lines are linked when they share a key and are alike in edits. Sketches are compared where buckets meet; pairs of small buckets that they leave, and pairs
    with the first line of every large one, are compared in edits; then, in large buckets that still hold several groups, the lines outside the largest group with all others.
    Only lines in pairs and large buckets that sketches leave are fetched from the texts.
    """
    placed = stored(buckets(line_keys(docs, similarity, min_words, most_keys)))
    release(docs.sparkSession)
    lines = distinct.select(F.col("low").alias("id"), "words", "sketch_0", "sketch_1", "doc_id", "line")
    small = lines.select("id", "words", "sketch_0", "sketch_1")
    found = stored(near_lines(placed.join(small, "id"), similarity))
    discard(placed)
    release(docs.sparkSession)
    pairs = stored(found.filter("key IS NULL AND a <> b").select("a", "b").distinct())
    large = found.filter("key IS NOT NULL").select("key", F.col("a").alias("id"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct()
    texts = stored(line_symbols(docs, lines.select("id", "doc_id", "line").join(asked, "id", "left_semi")).dropDuplicates(["id"]))
    x, y = texts.alias("x"), texts.alias("y")
    links = stored(pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & edit_alike(F.col("x.symbols"), F.col("y.symbols"), similarity)).select("a", "b"))
    groups = connected_components(links).select(F.col("node").alias("id"), "component")
    # buckets with the same lines are compared once
    alike = large.groupBy("key").agg(F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum"), F.count(F.lit(1)).alias("n")).groupBy("sum", "n").agg(F.min("key").alias("key")).select("key")
    members = stored(large.join(alike, "key", "left_semi").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")).select("key", "id", "component"))
    more = stored(large_links(members, small.join(texts, "id").dropDuplicates(["id"]), similarity))
    groups = connected_components(links.union(more)).select(F.col("node").alias("id"), F.col("component").alias("group"))
    discard(found, pairs, texts, links, members, more)
    return groups


def repeated_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = FUZZY_WORDS, every_pair: bool = True) -> DataFrame:
    """doc_id and lines (from 0) that repeat an earlier one, for every document that has such.

    Of each connected group of lines the occurrence with the smallest (doc_id, line) stays; all its other occurrences are named.
    """
    if similarity < 0.8:
        raise ValueError("below 0.8, lines that are alike need not share a key")
    found = stored(line_occurrences(docs))
    # a place as one number, doc_id then line, so that the aggregation can hash
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(_LINES).cast("decimal(10,0)") + F.col("line")
    packed = found.select("low", "high", place.alias("place"), "words", "sketch_0", "sketch_1")
    distinct = packed.groupBy("low", "high").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("words", "sketch_0", "sketch_1")))
    line = F.pmod(F.col("place"), F.lit(_LINES)).cast("int")
    distinct = stored(distinct.select("low", "high", F.floor((F.col("place") - line) / F.lit(_LINES)).cast("long").alias("doc_id"), line.alias("line"), "words", "sketch_0", "sketch_1", "n"))
    linked = line_groups(docs, distinct, similarity, min_words, 1 << 30 if every_pair else MOST_KEYS)
    # only lines that stand twice or are linked can go
    groups = distinct.drop("words", "sketch_0", "sketch_1").join(linked.withColumnRenamed("id", "low"), "low", "left").filter("n > 1 OR group IS NOT NULL")
    alone = groups.filter("group IS NULL").select("low", "high", F.col("doc_id").alias("keep_doc"), F.col("line").alias("keep_line"))
    together = groups.filter("group IS NOT NULL")
    keepers = together.groupBy("group").agg(F.min(F.struct("doc_id", "line")).alias("keeper"))
    kept = together.join(keepers, "group").select("low", "high", F.col("keeper.doc_id").alias("keep_doc"), F.col("keeper.line").alias("keep_line"))
    gone = found.select("low", "high", "doc_id", "line").join(alone.union(kept), ["low", "high"]).filter("doc_id <> keep_doc OR line <> keep_line")
    lists = stored(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")))
    discard(found, distinct)
    return lists


def dedupe_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = FUZZY_WORDS, every_pair: bool = True) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with repeated lines taken out of text, and n_lines and n_removed.

    Lines are split at line feeds; lines are equal if they are so after folding, whatever their length, but blank ones are left alone. Lines
    of ``min_words`` words or more repeat one another if their edit similarity in words is ``similarity`` at least, directly or by others
    between. Every such pair is found, whatever the lines' length: each line shows as many keys as the edits that are allowed may spoil, and one more.
    Without ``every_pair`` lines of over 29 words show 16 keys, half of them the rarest, half chosen by hash, which is cheaper and may leave pairs undetected.

    Documents keep their row, with an empty text if nothing is left; a null text stays null with 0 lines, an empty one has 1. Rows that repeat
    a doc_id share what is removed; rows with a null doc_id lose nothing. Very long lines are compared whole, in words. Columns of
    ``docs`` named n_lines or n_removed are replaced; others stay. An empty table gives an empty result.
    """
    docs = spread(docs)
    gone = repeated_lines(docs.select(F.col("doc_id").cast("long"), "text"), similarity, min_words, every_pair)
    # a flag for each line up to the last one that goes
    before = lambda i: F.when(i > 0, F.get("lines", i - 1)).otherwise(-1)
    flags = F.flatten(F.transform("lines", lambda x, i: F.concat(F.array_repeat(F.lit(False), x - before(i) - 1), F.array(F.lit(True)))))
    gone = gone.select(F.col("doc_id").alias("gone_id"), flags.alias("gone_lines"), F.size("lines").alias("gone_count"))
    columns = [F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*columns).join(gone, F.col("doc_id").cast("long") == F.col("gone_id"), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.coalesce(F.get("gone_lines", i), F.lit(False)))
    left = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counted = joined.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.coalesce("gone_count", F.lit(0)).cast("long")})
    return counted.withColumn("text", left).drop("gone_lines", "gone_id", "gone_count")

"""Token counts by byte-pair merging, without producing identifiers.

The vocabulary file is a public one in the ``tokenizers`` format: NFC, white space folded, lower case, a splitting pattern,
byte symbols and an end-of-word suffix. A text's count is the sum over its pieces of the initial symbols minus the merges.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import slices, spread


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


# Lower case of letters that are newer than the runtime's tables but known to the library.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# Code points that the pattern's tables take for letters or numbers and the library's do not, in hexadecimal.
UNKNOWN = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
).split()
_RANGES = [[int(end, 16) for end in part.split("-")] for part in UNKNOWN]
_UNKNOWN = "".join(f"{chr(part[0])}-{chr(part[-1])}" for part in _RANGES)
_HAS_UNKNOWN = regex.compile(f"[{_UNKNOWN}]")
_HAS_NEWER = regex.compile(f"[{''.join(map(chr, NEWER_LOWER))}]")


class PieceCounts(dict):
    """Tokens of each piece, remembered for short pieces; emptied when it has grown to ``limit`` pieces."""

    def __init__(self, merged: Callable[[str], int], limit: int, length: int):
        super().__init__()
        self.merged, self.limit, self.length = merged, limit, length

    def __missing__(self, piece: str) -> int:
        count = self.merged(piece)
        if len(piece) <= self.length:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = count
        return count


class MergeCounter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, path: str, cache_limit: int = 500_000, cached_length: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        known = {r"[\p{L}]+": rf"(?:(?![{_UNKNOWN}])\p{{L}})+", r"[\p{N}]": rf"(?![{_UNKNOWN}])\p{{N}}", r"[^\s\p{L}\p{N}]+": rf"(?:[^\s\p{{L}}\p{{N}}]|[{_UNKNOWN}])+"}
        self.careful_pieces = regex.compile("|".join(known.get(part, part) for part in pattern.split("|")))
        self.symbols = byte_symbols()
        self.known = PieceCounts(self.merged, cache_limit, cached_length)

    def normal(self, text: str) -> str:
        """NFC and lower case, one character at a time (no final-sigma rule). White space needs no folding: no piece has any."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if _HAS_NEWER.search(text):
            text = text.translate(NEWER_LOWER)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def merged(self, piece: str) -> int:
        """Tokens of one piece: a heap of adjacent pairs by rank over a doubly linked list of symbols."""
        parts = [self.symbols[b] for b in piece.encode()]
        parts[-1] += self.suffix
        n, rank = len(parts), self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, *p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if right < 0 or parts[left] != a or parts[right] != b:
                continue  # one side has been merged since
            parts[left], parts[right] = a + b, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            merges += 1
            for i in (before[left], left):
                if i >= 0 and (j := after[i]) >= 0 and (p := (parts[i], parts[j])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
        return n - merges

    def count(self, text: str) -> int:
        parts = [text]
        total = 0
        pieces = self.careful_pieces if not text.isascii() and _HAS_UNKNOWN.search(text) else self.pieces
        if self.split_special is not None and "<|" in text:
            parts = self.split_special.split(text)
            total = len(parts) - 1
        return total + sum(sum(map(self.known.__getitem__, pieces.findall(self.normal(p)))) for p in parts if p)


TOKEN_COLUMNS = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every whole text.

    A null or empty text has 0 bytes and 0 tokens. Rows with equal or null doc_id each keep their row; other columns, whatever
    their names, are ignored; an empty table gives an empty result. A very long piece takes n log n steps. ``folder`` names
    the place of the vocabulary files on the executors; by default the installed public files are used.
    """
    schema = to_arrow_schema(TOKEN_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder is None:
            import public_tokenizers

            path = str(public_tokenizers.path(vocabulary))
        else:
            path = f"{folder}/{vocabulary}"
        counter = MergeCounter(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [counter.count(t) for t in texts]
            columns = [batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, TOKEN_COLUMNS)

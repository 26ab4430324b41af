"""Personal data by weak supervision.

Labelers of three kinds vote on candidate spans: patterns (the fixed base patterns and looser ones), gazetteers (mail-host
endings, secret prefixes, card issuers) and context (cue words before the span). Expectation-maximisation over the vote
patterns of all documents estimates each labeler's reliability and each pattern's chance of being personal data; a logistic
span classifier is trained on those chances and decides on the candidates that no base pattern has settled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import slices, spread

#: Fixed patterns of the base kinds, in the order of the digest.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # a run of digits that gives no match from its first digit gives none from a later one
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Fixed patterns of further candidates.
MORE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,63}){1,4}"),
    "phone": re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|(?:password|passwd|secret|token|api_key)[ \"']*[=:][ \"']*[A-Za-z0-9/+_.-]{8,128}|(?<=\")[0-9a-f]{32,64}(?=\"))(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
#: Cue words in the 40 characters before a span.
CUES = {
    "email": ("mail", "contact", "write to", "@"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("key", "secret", "token", "password", "credential"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank"),
}
#: Endings of reserved or well-known mail hosts, issuer digits of cards, prefixes of keys.
GAZETTEER = {
    "email": re.compile(r"(?:\.com|\.org|\.net|\.edu|\.gov|\.de|\.fr|\.es)$"),
    "ip": re.compile(r"^(?!0\.|127\.|255\.)"),
    "card": re.compile(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
    "phone": re.compile(r"(?:^|\D)[2-9][0-9]{2}\D{0,2}[0-9]{3}\D?[0-9]{4}$"),
    "secret": re.compile(r"^(?:AKIA|gh[pousr]_|sk_live_|pass|secret|token|api)"),
    "ssn": re.compile(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
    "iban": re.compile(r"^(?:DE|FR|ES|IT|GB|NL|BE|AT|CH|PT|IE)"),
}
CONTEXT = 40
LABELERS = ("pattern", "checked", "gazetteer", "context", "varied")
#: Fixed patterns of further kinds that leave little doubt.
STRICT = {
    "email": re.compile(r".*\[at\].*\[dot\].*"),
    "phone": re.compile(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"),
    "secret": re.compile(r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?:password|passwd|secret|token|api_key)[ \"']*[=:].*"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
}

SPAN_COLUMNS = StructType(
    [StructField("doc_id", LongType()), StructField("n_email", LongType()), StructField("n_ip", LongType()), StructField("n_card", LongType()), StructField("n_phone", LongType()), StructField("base_sha256", StringType()), StructField("spans", StringType())]
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def octets(text: str) -> bool:
    """Whether all parts of a dotted number are at most 255, whatever their leading zeros."""
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base e-mail pattern, found around each @ instead of tried at every character."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = BASE["email"].match(text, start) if start < at else None
        if match:
            yield match.span()
            done = match.end()
        at = text.find("@", max(at + 1, done))


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str, failed: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds; a match that fails its check is dropped and not tried again.

    ``failed`` gathers the dropped matches: they never become spans, but tell the labelers' model what false spans look like.
    """
    out, failed = [], [] if failed is None else failed
    if "@" in text:
        out += [(0, *span) for span in emails(text)]
    if DIGIT.search(text) is None:
        return out
    for m in BASE["ip"].finditer(text):
        (out if octets(m.group()) else failed).append((1, *m.span()))
    for m in BASE["card"].finditer(text):
        if (n := len(d := only_digits(m.group()))) >= 7:
            (out if 13 <= n <= 19 and luhn(d) else failed).append((2, *m.span()))
    if "+" in text:
        for m in BASE["phone"].finditer(text):
            (out if 9 <= len(only_digits(m.group())) <= 15 else failed).append((3, *m.span()))
    return out


DIGIT = re.compile("[0-9]")


def checked(kind: str, text: str) -> bool:
    """Whether the kind's own arithmetic or shape test holds."""
    d = only_digits(text)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        return octets(text)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "iban":
        return iban_valid(text)
    if kind == "secret":
        return bool(DIGIT.search(text)) and bool(re.search("[A-Za-z]", text))
    if kind == "ssn":
        return d[:3] not in ("000", "666") and d[0] != "9"
    return "." in text or "dot" in text


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the looser patterns that touch no base span."""
    out: list[tuple[int, int, int]] = []
    taken = bytearray()
    for kind, pattern in MORE.items():
        if kind == "email" and "at]" not in text and "at)" not in text:
            continue
        if kind in ("phone", "ssn", "iban") and DIGIT.search(text) is None:
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if not taken:
                taken = bytearray(len(text))
                for _, x, y in base:
                    taken[x:y] = b"\1" * (y - x)
            if 1 not in taken[s:e]:
                out.append((KINDS.index(kind), s, e))
                taken[s:e] = b"\1" * (e - s)
    return out


def votes(text: str, kind: int, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """1 or 0 of each labeler."""
    name, span = KINDS[kind], text[start:end]
    before = text[max(0, start - CONTEXT) : start].lower()
    return (
        int(is_base or name in STRICT and STRICT[name].fullmatch(span) is not None),
        int(checked(name, span)),
        int(GAZETTEER[name].search(span) is not None),
        int(any(cue in before for cue in CUES[name])),
        int(len(set(span)) >= 5),
    )


def vote_patterns(docs: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    """How often each (kind, votes) occurs over all documents: at most kinds x 2 ** labelers rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text, failed := [])
                    seen.update((k, "".join(map(str, votes(text, k, s, e, True)))) for k, s, e in base)
                    seen.update((k, "".join(map(str, votes(text, k, s, e, False)))) for k, s, e in failed)
                    seen.update((k, "".join(map(str, votes(text, k, s, e, False)))) for k, s, e in candidates(text, base))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([v for _, v in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "n"])

    rows = docs.select("text").mapInArrow(run, "kind int, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return sorted((r["kind"], tuple(map(int, r["votes"])), r["n"]) for r in rows)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for two classes and independent labelers: the chance of each vote pattern to be a true span,
    and each labeler's (vote rate on true spans, vote rate on others). Starts from the share of labelers that voted."""
    chance = np.clip(patterns.mean(axis=1), 0.05, 0.95)
    rates = np.full((patterns.shape[1], 2), 0.5)
    for _ in range(rounds):
        prior = np.clip((counts * chance).sum() / counts.sum(), 0.02, 0.98)
        for c, weight in enumerate((counts * chance, counts * (1 - chance))):
            rates[:, c] = (weight @ patterns + 1) / (weight.sum() + 2)
        log = np.log(prior) - np.log1p(-prior) + patterns @ np.log(rates[:, 0] / rates[:, 1]) + (1 - patterns) @ np.log((1 - rates[:, 0]) / (1 - rates[:, 1]))
        chance = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return chance, rates


def train_classifier(patterns: np.ndarray, counts: np.ndarray, chance: np.ndarray, steps: int = 400, shrink: float = 1e-3) -> np.ndarray:
    """Weights (last one the intercept) of a logistic span classifier fitted to the estimated chances."""
    x = np.hstack([patterns, np.ones((len(patterns), 1))])
    share = counts / counts.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (share * (p - chance)) + shrink * w)
    return w


def span_model(docs: DataFrame) -> np.ndarray:
    """The classifier's weights, over labelers, kinds and an intercept, from the vote patterns of all documents."""
    seen = vote_patterns(docs)
    if not seen:
        return np.zeros(len(LABELERS) + len(KINDS) + 1)
    patterns = np.array([v for _, v, _ in seen], float)
    kinds = np.eye(len(KINDS))[[k for k, _, _ in seen]]
    counts = np.array([n for *_, n in seen], float)
    chance, _ = reliabilities(patterns, counts)
    return train_classifier(np.hstack([patterns, kinds]), counts, chance)


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans (kind:start:end by kind, then start; code points).

    Base spans are always kept; further candidates are added where the classifier's chance reaches ``threshold``. A null or
    empty text has no span and the digest of the empty string. Texts are read whole, in linear time for any length; equal rows
    and null ids keep a row each; other columns are ignored; an empty table gives an empty result.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long"), "text"))
    weights = span_model(docs)
    schema = to_arrow_schema(SPAN_COLUMNS)

    def accepted(text: str, kind: int, start: int, end: int) -> bool:
        x = np.zeros(len(weights))
        x[: len(LABELERS)] = votes(text, kind, start, end, False)
        x[len(LABELERS) + kind] = x[-1] = 1
        return 1 / (1 + np.exp(-x @ weights)) >= threshold

    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                base = base_spans(text)
                more = [c for c in candidates(text, base) if accepted(text, *c)]
                n = Counter(k for k, *_ in base)
                rows.append((doc_id, n[0], n[1], n[2], n[3], hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return docs.mapInArrow(run, SPAN_COLUMNS)

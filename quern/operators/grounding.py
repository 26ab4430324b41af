"""Audit of generated answers against their references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import trimmed


def answer_grounding(answers: DataFrame) -> DataFrame:
    """Adds suspicious_commands, missing_sentences, n_sentences, confidence and grounded to ``answers`` (answer, references array).

    A line that starts with $ or # is a command; it is suspicious if its first three words stand in no reference. A sentence of
    over 10 characters is missing if none of its words of over 2 characters does and it is no generic opening. Confidence is
    1 less the share of both among the sentences, not below 0.
    """
    answer = F.coalesce("answer", F.lit(""))
    known = F.lower(F.array_join(F.coalesce("references", F.array().cast("array<string>")), "\n"))
    commands = F.filter(F.transform(F.split(answer, "\n"), lambda line: trimmed(F.regexp_extract(line, r"^[$#]\s+(.+)$", 1))), lambda c: c != "")
    suspicious = F.filter(commands, lambda c: ~F.contains(F.col("known"), F.array_join(F.slice(F.split(F.lower(c), r"\s+"), 1, 3), " ")))
    sentences = F.filter(F.split(answer, r"[。！？\n]"), lambda s: F.length(s) > 10)
    found = lambda s: F.exists(F.filter(F.split(F.lower(s), r"\s+"), lambda w: F.length(w) > 2), lambda w: F.contains(F.col("known"), w))
    missing = F.transform(F.filter("sentences", lambda s: ~found(s) & ~s.rlike(v.GENERIC_OPENINGS)), lambda s: F.substring(s, 1, 50))
    out = answers.withColumns({"known": known, "sentences": sentences})
    out = out.withColumns({"suspicious_commands": suspicious, "missing_sentences": missing, "n_sentences": F.size("sentences")})
    bad = F.size("suspicious_commands") + F.size("missing_sentences")
    return out.withColumns({"confidence": F.greatest(F.lit(0.0), 1 - bad / F.greatest(F.col("n_sentences"), F.lit(1))), "grounded": bad == 0}).drop("known", "sentences")

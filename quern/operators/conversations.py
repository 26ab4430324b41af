"""Conversations and tenants: search, previews, context, retention, export, purge and restore.

Conversations have id, user_id, title, created_at and updated_at; messages id, conversation_id, role, content and created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

STAR = "⭐"


def fuzzy_match(text: Column, query: str) -> Column:
    """Whether a text fits a search word: as a substring; or, for words of over 2 characters all of which occur, where some window of
    the word's length is within 0.3 edits a character; or as a whole within 0.4, for short words and texts."""
    q = query.lower()
    if not q.strip():
        return F.lit(True)
    t, n = F.lower(text), len(q)
    exact = F.contains(t, F.lit(q))
    if n <= 2:
        return exact
    letters = F.forall(F.array(*(F.lit(c) for c in dict.fromkeys(q) if c.strip())), lambda c: F.contains(t, c))
    near = lambda s, most: F.levenshtein(F.lit(q), s, most) >= 0
    starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    window = F.exists(starts, lambda i: near(F.substring(t, i, F.lit(n)), max(1, n * 3 // 10)))
    whole = (F.length(t) <= 2 * n) & near(t, max(1, n * 4 // 10)) if n <= 10 else F.lit(False)
    return exact | (letters & (window | whole))


def plain_text(content: Column) -> Column:
    """A message without code, links, marks and tags."""
    for pattern, into in ((r"(?s)```.*?```", "[代码]"), (r"`[^`]+`", "[代码]"), (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"[#*_~]", ""), (r"<[^>]+>", "")):
        content = F.regexp_replace(content, pattern, into)
    return trimmed(content)


def shortened(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def previews(messages: DataFrame, last: int = 3, size: int = 80) -> DataFrame:
    """conversation_id and preview: the last messages by time, cleaned, shortened and joined."""
    order = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = messages.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= last)
    label = F.when(F.col("role") == "user", "你").otherwise("AI")
    line = F.concat(label, F.lit(": "), shortened(plain_text(F.col("content")), size))
    return recent.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), line.alias("line")))), lambda x: x["line"]), " | ").alias("preview"))


def conversation_list(conversations: DataFrame, messages: DataFrame, term: str = "", favourites: bool = False) -> DataFrame:
    """Conversations that have messages, fit the search word and, if asked, are starred; newest first, with preview."""
    shown = conversations.filter(fuzzy_match(F.col("title"), term))
    if favourites:
        shown = shown.filter(F.contains("title", F.lit(STAR)))
    joined = shown.join(previews(messages).withColumnRenamed("conversation_id", "id"), "id")
    return joined.orderBy(F.desc("updated_at"), "id")


def rolling_context(messages: DataFrame, turns: int = 10, order: str = "created_at") -> DataFrame:
    """Messages with context: the contents of up to ``turns`` messages before each one in its conversation."""
    before = Window.partitionBy("conversation_id").orderBy(order).rowsBetween(-turns, -1)
    return messages.withColumn("context", F.collect_list("content").over(before))


def with_history(messages: DataFrame, turns: int = 3, order: str = "created_at") -> DataFrame:
    """Messages with query: the content, followed by that of up to ``turns`` messages before it."""
    return rolling_context(messages, turns, order).withColumn("query", trimmed(F.concat_ws(" ", "content", F.array_join("context", " ")))).drop("context")


def retain(conversations: DataFrame, messages: DataFrame, keep: int = 20, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The newest ``keep`` conversations of each user (of the given users only; others keep all), and their messages."""
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("id"))
    ranked = conversations.withColumn("turn", F.row_number().over(order))
    if users is not None:
        ranked = ranked.join(users.select("user_id", F.lit(True).alias("swept")), "user_id", "left")
        kept = ranked.filter((F.col("turn") <= keep) | F.col("swept").isNull()).drop("swept")
    else:
        kept = ranked.filter(F.col("turn") <= keep)
    kept = kept.drop("turn").select(*conversations.columns)
    return kept, messages.join(kept.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select(*messages.columns)


def newest_messages(messages: DataFrame, keep: int = 500) -> DataFrame:
    """The newest ``keep`` messages of the whole table, by time, then id."""
    return messages.orderBy(F.desc("created_at"), F.desc("id")).limit(keep)


def tenant_rows(tenant: str, conversations: DataFrame, messages: DataFrame, documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """All rows of one tenant by entity."""
    own = conversations.filter(F.col("user_id") == tenant)
    docs = documents.filter(F.col("user_id") == tenant)
    return {
        "conversations": own,
        "messages": messages.join(own.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select(*messages.columns),
        "documents": docs,
        "chunks": chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(*chunks.columns),
    }


def purge(tenant: str, conversations: DataFrame, messages: DataFrame, documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """All tables without a tenant. Messages and chunks stay only if their owner survives, so orphans go as well."""
    left = conversations.filter(~F.col("user_id").eqNullSafe(tenant))
    docs = documents.filter(~F.col("user_id").eqNullSafe(tenant))
    return {
        "conversations": left,
        "messages": messages.join(left.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select(*messages.columns),
        "documents": docs,
        "chunks": chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(*chunks.columns),
    }


def restore(tenant: str, tables: dict[str, DataFrame], saved: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables purged of a tenant, with its saved rows put back."""
    return {name: left.unionByName(saved[name], allowMissingColumns=True) for name, left in purge(tenant, **tables).items()}


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """entity and n of every table of a bundle."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in sorted(tables.items())]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out

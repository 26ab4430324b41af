"""Documents, chunks, categories, query logs: mutations and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..sources.shared import stored


def blank_to(column: str, *others) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), *others)


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with a key; the filter reaches the scan."""
    return df.filter(F.col(column) == value)


def browse(docs: DataFrame, term: str, categories: DataFrame | None = None) -> DataFrame:
    """Documents whose filename or content_preview holds ``term`` in any case, in one of ``categories`` (id) if given."""
    t = F.lit(term.lower())
    found = docs.filter(F.contains(F.lower("filename"), t) | F.contains(F.lower("content_preview"), t))
    return found if categories is None else found.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")


def category_closure(tree: DataFrame, root: str) -> DataFrame:
    """id and depth of a category and all below it, from an adjacency table (id, parent_id) of any depth.

    Every node points to its parent; a round lets it point where its target points, so after n rounds it points 2^n levels up or to the
    root. A tree of d levels takes about log2(d) rounds, each a join of what is not settled yet. Nodes that end elsewhere fall out; those that still
    wander after as many steps as there are nodes run in a circle and are not below the root. ValueError if the root is below itself.
    """
    ids = tree.select("id", "parent_id").filter("id IS NOT NULL")
    top = F.col("id") == root
    pointers, path = stored(ids.select("id", F.when(top, F.col("id")).otherwise(F.col("parent_id")).alias("at"), F.when(top, 0).otherwise(1).cast("long").alias("depth")).filter("at IS NOT NULL").distinct())
    nodes, steps = pointers.count(), 1
    while steps < 2 * nodes and not (wandering := pointers.filter(F.col("at") != root)).isEmpty():
        hops = pointers.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = wandering.join(hops, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        pointers, path = stored(pointers.filter(F.col("at") == root).unionByName(moved.distinct()), path)
        steps *= 2
    below = pointers.filter(F.col("at") == root).select("id", F.col("depth").cast("int").alias("depth"))
    if not ids.filter(top).select(F.col("parent_id").alias("id")).join(below, "id").isEmpty():
        raise ValueError(f"category {root} is its own ancestor")
    return below


def delete_category(tree: DataFrame, docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree without a category and its subtree; documents, with those on that very category moved to "default"; and
    the ids of documents left on a category that is gone."""
    gone = category_closure(tree, root).select("id")
    left = tree.join(gone, "id", "left_anti")
    moved = docs.withColumn("category_id", F.when(F.col("category_id") == root, F.lit("default")).otherwise(F.col("category_id")))
    dangling = moved.join(gone.withColumnRenamed("id", "category_id"), "category_id", "left_semi").filter(F.col("category_id") != root)
    return left, moved, dangling


def add_category(tree: DataFrame, added: DataFrame) -> DataFrame:
    """The tree with new rows (id, parent_id, name); rows whose parent is unknown are not added."""
    parents = tree.select(F.col("id").alias("parent_id"))
    good = added.filter("parent_id IS NULL").unionByName(added.join(parents, "parent_id", "left_semi"))
    return tree.unionByName(good, allowMissingColumns=True)


def insert_documents(docs: DataFrame, added: DataFrame) -> DataFrame:
    """Documents with new rows; missing user, id and upload time get their defaults (id from a hash of the row, time from now)."""
    filled = added.withColumns({"user_id": blank_to("user_id", F.lit("shared")), "id": blank_to("id", F.sha2(F.to_json(F.struct(*[c for c in added.columns if c != "id"])), 256))})
    if "uploaded_at" in added.columns:
        filled = filled.withColumn("uploaded_at", F.coalesce("uploaded_at", F.current_timestamp()))
    return docs.unionByName(filled, allowMissingColumns=True)


def patch(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of ``updates`` laid over them by key; unknown keys change nothing, the last of several
    updates (by column ``seq`` if there is one) wins."""
    fields = [c for c in updates.columns if c not in (key, "seq")]
    if "seq" in updates.columns:
        last = updates.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in fields))
    else:
        last = updates.select(key, *(F.col(c).alias(f"new_{c}") for c in fields))
    joined = rows.join(last, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def toggle_favourite(conversations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Conversations with the star at the head of the title set or taken off for the ids of ``wanted``."""
    title = F.when(F.contains("title", F.lit("⭐")), trimmed(F.replace(F.col("title"), F.lit("⭐"), F.lit("")))).otherwise(F.concat(F.lit("⭐ "), "title"))
    flagged = conversations.join(wanted.select("id", F.lit(True).alias("toggle")), "id", "left")
    return flagged.withColumn("title", F.when(F.col("toggle"), title).otherwise(F.col("title"))).drop("toggle")


def delete_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of ``gone`` (document_id)."""
    return docs.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def write_embeddings(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Chunks with new embeddings by chunk_id; of several updates the last (by seq) wins."""
    last = updates.groupBy("chunk_id").agg(F.max_by("embedding", "seq").alias("new_embedding"))
    joined = chunks.join(last, "chunk_id", "left")
    return joined.withColumn("embedding", F.coalesce("new_embedding", "embedding")).drop("new_embedding")


def write_report(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """success and failed: distinct updated chunks that exist, and those that do not."""
    known = chunks.select("chunk_id", F.lit(True).alias("known")).distinct()
    return updates.select("chunk_id").distinct().join(known, "chunk_id", "left").agg(F.count("known").alias("success"), F.count_if(F.col("known").isNull()).alias("failed"))


def lacks_embedding(embedding: str = "embedding") -> Column:
    return F.col(embedding).isNull() | (F.size(embedding) == 0)


def newest(log: DataFrame, rows: int = 1000) -> DataFrame:
    """The newest rows of a query log, by time, then id."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(rows)


def append_query(log: DataFrame, entries: DataFrame, rows: int = 1000) -> DataFrame:
    """The query log with new entries, cut to its newest rows."""
    return newest(log.unionByName(entries, allowMissingColumns=True), rows)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """document_id, total, parents, children, normal, requiring and embedded chunks."""
    kind = F.col("chunk_type")
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == "parent").alias("parents"),
        F.count_if(kind == "child").alias("children"),
        F.count_if(~F.coalesce(kind, F.lit("")).isin("parent", "child")).alias("normal"),
        F.count_if(F.coalesce(kind, F.lit("")) != "parent").alias("requiring"),
        F.count_if(~lacks_embedding()).alias("embedded"),
    )


def embedding_gaps(chunks: DataFrame) -> DataFrame:
    """document_id and missing: documents with chunks that lack an embedding."""
    return chunks.groupBy("document_id").agg(F.count_if(lacks_embedding()).alias("missing")).filter("missing > 0")


def embedding_progress(chunks: DataFrame) -> DataFrame:
    """success, failed and percent of all chunks."""
    done, every = F.count_if(~lacks_embedding()), F.count(F.lit(1))
    return chunks.agg(done.alias("success"), (every - done).alias("failed"), F.when(every > 0, F.round(100.0 * done / every)).otherwise(0.0).alias("percent"))


def preview_only(docs: DataFrame, chunks: DataFrame, size: int = 100_000, preview: int = 1000) -> DataFrame:
    """Documents that seem to hold their preview only: large, with one chunk at most and a short preview."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    joined = docs.join(counts, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return joined.filter((F.col("file_size") > size) & (F.col("n_chunks") <= 1) & (F.length(F.coalesce("content_preview", F.lit(""))) < preview))


def documents_by_category(docs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """category (its name if ``names`` (id, name) has it, else its id) and n."""
    key = blank_to("category_id", F.nullif(F.col("category"), F.lit("")), F.lit("default")) if "category" in docs.columns else blank_to("category_id", F.lit("default"))
    counts = docs.groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if names is not None:
        return counts.join(names.select("id", "name"), "id", "left").select(F.coalesce("name", "id").alias("category"), "n")
    return counts.select(F.col("id").alias("category"), "n")


def daily_counts(log: DataFrame, anchor: str, days: int = 7) -> DataFrame:
    """day, label (M/D) and n of the last days up to ``anchor``, days without rows included."""
    last = F.to_date(F.lit(anchor))
    calendar = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = log.filter(F.to_date("ts").between(F.date_sub(last, days - 1), last)).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.concat_ws("/", F.month("day"), F.dayofmonth("day")).alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_questions(log: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent questions, equal in their first 50 trimmed characters."""
    counts = log.groupBy(F.substring(trimmed(F.col("query")), 1, 50).alias("question")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "question").limit(k)


def mean_response(log: DataFrame) -> DataFrame:
    """Mean seconds over rows with a time above 0, to one decimal; 0 if there are none."""
    mean = F.avg(F.when(F.col("response_time") > 0, F.col("response_time"))) / 1000
    return log.agg(F.coalesce(F.round(mean, 1), F.lit(0.0)).alias("avg_seconds"))


def service_metrics(log: DataFrame, percentile: bool = True) -> DataFrame:
    """Mean and 95th percentile of the response time, and the rates of the flags the log has (cache_hit, accurate, hallucinated,
    cost). The percentile is exact and holds all values; ``sketches.service_report`` takes it from days' sketches."""
    rates = [F.round(F.avg(F.col(c).cast("double")), 4).alias(n) for c, n in (("cache_hit", "cache_hit_rate"), ("accurate", "accuracy"), ("hallucinated", "hallucination_rate"), ("cost", "cost_per_query")) if c in log.columns]
    return log.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("response_time"), 3).alias("avg_ms"), *([F.round(F.percentile("response_time", 0.95), 3).alias("p95_ms")] if percentile else []), *rates)


def feedback_statistics(feedback: DataFrame) -> DataFrame:
    """total, average rating, helpful, accurate and complete counts, and how often each rating from 1 to 5 was given."""
    return feedback.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("rating"), 4).alias("average_rating"),
        *(F.count_if(c).alias(c) for c in ("helpful", "accurate", "complete")),
        *(F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in range(1, 6)),
    )


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("turn = 1").drop("turn")

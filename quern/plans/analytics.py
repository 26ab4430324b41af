"""Queries on documents, chunks, categories and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as c
from . import binding as b


def document_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.documents(spark, sf_dir)
    tree = docs.select(F.col("category_id").alias("id")).distinct().filter("id <> 'es'")
    return c.browse(docs, "Src1", tree).select("doc_id", "filename", "category_id")


def category_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.category_closure(b.category_tree(spark, sf_dir), "r1")


def category_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("r1")).otherwise(F.concat(F.lit("c"), "o_custkey")).alias("category_id"))
    left, moved, dangling = c.delete_category(b.category_tree(spark, sf_dir), docs, "r1")
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("categories", left), ("moved", moved.filter("category_id = 'default'")), ("dangling", dangling))]
    return counts[0].union(counts[1]).union(counts[2])


def documents_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    docs = b.table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") == 3, "").when(F.col("c_nationkey") == 4, "99").otherwise(F.col("c_nationkey").cast("string")).alias("category_id"))
    return c.documents_by_category(docs, names)


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents")).crossJoin(b.table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(b.query_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("queries")))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunk_statistics(b.stored_chunks(spark, sf_dir))


def embedding_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.embedding_gaps(b.stored_chunks(spark, sf_dir))


def embedding_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.embedding_progress(b.stored_chunks(spark, sf_dir))


def preview_only_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.documents(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    chunks = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"))
    return c.preview_only(docs, chunks, size=3000).select("document_id", "file_size", "n_chunks")


def query_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.daily_counts(b.query_log(spark, sf_dir), "2024-02-02").withColumn("day", F.col("day").cast("string"))


def top_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.top_questions(b.query_log(spark, sf_dir))


def avg_response_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.mean_response(b.query_log(spark, sf_dir).withColumn("response_time", F.col("response_time") * 100))


def service_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.service_metrics(b.query_log(spark, sf_dir).withColumn("cache_hit", F.col("id") % 3 == 0))


def newest_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.newest(b.query_log(spark, sf_dir)).select("id", "response_time")


def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    updates = b.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "poor").alias("lang"), F.when(F.col("toxic") == 1, "held").alias("source"))
    return c.patch(docs, updates, "doc_id")


def doc_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("user_id"))
    added = b.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "").alias("user_id"))
    return c.insert_documents(docs, added).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def embedding_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    changed = chunks.filter("chunk_id % 2 = 0").select("chunk_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(2).alias("seq"))
    earlier = chunks.filter("chunk_id % 4 = 0").select("chunk_id", "embedding", F.lit(1).alias("seq"))
    return c.write_embeddings(chunks, changed.unionByName(earlier)).select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_part"))


def embedding_write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return c.write_report(chunks, b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    chunks = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"))
    gone = b.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    left, kept = c.delete_documents(docs, chunks, gone)
    return left.select("document_id", F.lit("document").alias("entity")).union(kept.select("document_id", F.lit("chunk").alias("entity")))


def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = b.table(spark, sf_dir, "labels")
    flags = labels.select((F.col("doc_id") % 5 + 1).alias("rating"), (F.col("quality") == 1).alias("helpful"), (F.col("toxic") == 0).alias("accurate"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("complete"))
    return c.feedback_statistics(flags)


QUERIES = {
    f.__name__: f
    for f in (
        document_browse, category_closure, category_delete, documents_by_category, corpus_totals, chunk_stats, embedding_gap, embedding_progress, preview_only_audit, query_daily_counts, top_questions,
        avg_response_time, service_metrics, newest_queries, doc_upsert, doc_insert, embedding_writeback, embedding_write_report, cascade_delete, feedback_stats,
    )
}

_TREE = "SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"
_CLOSURE = f"WITH RECURSIVE tree AS ({_TREE}), below AS (SELECT id, 0 AS depth FROM tree WHERE id = 'r1' UNION ALL SELECT t.id, b.depth + 1 FROM tree t JOIN below b ON t.parent_id = b.id)"
_LOG = "(SELECT event_id AS id, props AS query, value AS response_time, ts FROM events WHERE event_type = 'view')"
_CHUNKS = "(SELECT d.doc_id, d.source AS document_id, CASE WHEN n_chars > 3000 THEN 'parent' WHEN n_chars < 1000 THEN 'child' ELSE 'semantic' END AS chunk_type, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"

SQL = {
    "document_browse": "SELECT doc_id, source AS filename, lang AS category_id FROM documents WHERE (contains(lower(source), 'src1') OR contains(lower(substr(text, 1, 500)), 'src1')) AND lang <> 'es'",
    "category_closure": f"{_CLOSURE} SELECT id, depth FROM below",
    "category_delete": f"""{_CLOSURE}, docs AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'r1' ELSE 'c' || o_custkey END AS category_id FROM orders)
        SELECT 'categories' AS what, count(*) AS n FROM tree WHERE id NOT IN (SELECT id FROM below)
        UNION ALL SELECT 'moved', count(*) FROM docs WHERE category_id = 'r1'
        UNION ALL SELECT 'dangling', count(*) FROM docs WHERE category_id <> 'r1' AND category_id IN (SELECT id FROM below)""",
    "documents_by_category": "SELECT coalesce(n.n_name, k.id) AS category, count(*) AS n FROM (SELECT CASE c_nationkey WHEN 3 THEN 'default' WHEN 4 THEN '99' ELSE c_nationkey::VARCHAR END AS id FROM customer) k LEFT JOIN nation n ON n.n_nationkey::VARCHAR = k.id GROUP BY 1",
    "corpus_totals": f"SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM {_LOG}) AS queries",
    "chunk_stats": f"SELECT document_id, count(*) AS total, count(*) FILTER (chunk_type = 'parent') AS parents, count(*) FILTER (chunk_type = 'child') AS children, count(*) FILTER (chunk_type = 'semantic') AS normal, count(*) FILTER (chunk_type <> 'parent') AS requiring, count(embedding) AS embedded FROM {_CHUNKS} GROUP BY 1",
    "embedding_gap": f"SELECT document_id, count(*) AS missing FROM {_CHUNKS} WHERE embedding IS NULL OR len(embedding) = 0 GROUP BY 1",
    "embedding_progress": f"SELECT count(embedding) AS success, count(*) - count(embedding) AS failed, round(100.0 * count(embedding) / count(*)) AS percent FROM {_CHUNKS}",
    "preview_only_audit": "SELECT d.doc_id AS document_id, n_chars AS file_size, count(e.vec_id) AS n_chunks FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE n_chars > 3000 GROUP BY 1, 2 HAVING count(e.vec_id) <= 1",
    "query_daily_counts": f"SELECT d::DATE::VARCHAR AS day, month(d) || '/' || day(d) AS label, count(l.id) AS n FROM generate_series(DATE '2024-01-27', DATE '2024-02-02', INTERVAL 1 DAY) AS s(d) LEFT JOIN {_LOG} l ON l.ts::DATE = s.d::DATE GROUP BY 1, 2",
    "top_questions": f"SELECT substr(trim(query), 1, 50) AS question, count(*) AS n FROM {_LOG} GROUP BY 1 ORDER BY n DESC, question LIMIT 5",
    "avg_response_time": f"SELECT round(avg(response_time * 100) FILTER (response_time > 0) / 1000, 1) AS avg_seconds FROM {_LOG}",
    "service_metrics": f"SELECT count(*) AS n, round(avg(response_time), 3) AS avg_ms, round(quantile_cont(response_time, 0.95), 3) AS p95_ms, round(avg((id % 3 = 0)::INT), 4) AS cache_hit_rate FROM {_LOG}",
    "newest_queries": f"SELECT id, response_time FROM {_LOG} ORDER BY ts DESC, id DESC LIMIT 1000",
    "doc_upsert": "SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'poor' ELSE d.lang END AS lang, CASE WHEN l.toxic = 1 THEN 'held' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)",
    "doc_insert": "SELECT user_id, count(*) AS n FROM (SELECT lang AS user_id FROM documents UNION ALL SELECT 'shared' FROM benchmark) GROUP BY 1",
    "embedding_writeback": "SELECT vec_id AS chunk_id, round(CASE WHEN vec_id % 2 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first_part FROM embeddings",
    "embedding_write_report": "SELECT count(*) FILTER (e.vec_id IS NOT NULL) AS success, count(*) FILTER (e.vec_id IS NULL) AS failed FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN embeddings e ON e.vec_id = d.doc_id",
    "cascade_delete": "SELECT doc_id AS document_id, 'document' AS entity FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT vec_id, 'chunk' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "feedback_stats": "SELECT count(*) AS total, round(avg(doc_id % 5 + 1), 4) AS average_rating, count(*) FILTER (quality = 1) AS helpful, count(*) FILTER (toxic = 0) AS accurate, count(*) FILTER (quality = 1 AND toxic = 0) AS complete, "
    + ", ".join(f"count(*) FILTER (doc_id % 5 = {r - 1}) AS rating_{r}" for r in range(1, 6))
    + " FROM labels",
}

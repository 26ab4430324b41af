"""Queries on stored forms: clustered tables, gram index, sketches, bundles with unknown fields, table functions in SQL, keyed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, embedding, entities, gram_index, sketches, tables_in_sql
from ..sources import clustered, variants
from ..sources.shared import scratch
from ..streaming import keyed
from . import binding as b


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents as their chunks."""
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return docs.select("document_id", F.concat_ws("-", "document_id", "chunk_index").alias("id"), "chunk_index", "content")


def clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all labelled documents, from a clustered table that was written in two appends and compacted."""
    path, chunks = f"{scratch(spark)}/chunks", line_chunks(spark, sf_dir)
    clustered.create(chunks.filter("document_id % 3 <> 0"), path, order=("chunk_index",), buckets=16)
    clustered.append(spark, path, chunks.filter("document_id % 3 = 0"))
    clustered.compact(spark, path, most_files=1)
    found = clustered.lookup_all(spark, path, b.table(spark, sf_dir, "labels").select("doc_id"))
    return found.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("size"), F.max("chunk_index").alias("last_index"))


def durable_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks on files after deleting the toxic documents' and patching the poor ones'."""
    path, labels = f"{scratch(spark)}/chunks", b.table(spark, sf_dir, "labels")
    clustered.create(line_chunks(spark, sf_dir), path, order=("chunk_index",), buckets=16)
    clustered.delete(spark, path, labels.filter("toxic = 1").select("doc_id"))
    poor = labels.filter("quality = 0").select(F.col("doc_id").alias("document_id"), F.concat(F.col("doc_id").cast("string"), F.lit("-0")).alias("id"), F.lit("held back").alias("content"))
    clustered.patch(spark, path, poor)
    return clustered.read(spark, path).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("size"))


def indexed_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    gram_index.build(b.chunk_texts(spark, sf_dir), f"{path}/index", buckets=16)
    found = gram_index.keyword_search(spark, f"{path}/index", b.golden_queries(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def category_closure_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as three chains: an order is below the one three numbers before it."""
    key = F.col("o_orderkey")
    tree = b.table(spark, sf_dir, "orders").select(key.cast("string").alias("id"), F.when(key >= 3, (key - 3).cast("string")).alias("parent_id"))
    return catalog.category_closure(tree, "1")


def top_questions_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent questions of all days from the days' sketches; the log has fewer different ones than a sketch keeps, so counts are exact."""
    return sketches.frequent_questions(sketches.question_sketches(b.query_log(spark, sf_dir))).select("question", "n")


def response_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from the days' sketches: how many values they stand for, and whether the log's own share of values up to each is within two hundredths."""
    log = b.query_log(spark, sf_dir)
    found = sketches.response_quantiles(sketches.response_sketches(log)).withColumnRenamed("response_time", "at")
    times = log.select("response_time").filter("response_time IS NOT NULL")
    up_to = F.avg((F.col("response_time") <= F.col("at")).cast("double"))
    below = F.avg((F.col("response_time") < F.col("at")).cast("double"))
    shares = times.join(F.broadcast(found), F.lit(True)).groupBy("share", "n", "at").agg(up_to.alias("own"), below.alias("less"))
    return shares.select("share", "n", ((F.col("less") <= F.col("share") + 0.02) & (F.col("own") >= F.col("share") - 0.02)).alias("close"))


def bundle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines: every tenth is broken, every tenth after it lacks its user, the others have fields that the import does not declare."""
    events = b.table(spark, sf_dir, "events")
    turn = F.col("event_id") % 10
    whole = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.when(turn == 1, "").otherwise(F.concat(F.lit(',"user_id":"u'), F.col("user_id").cast("string"), F.lit('"'))), F.lit(',"kind":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit("}"))
    return events.select(F.when(turn == 0, F.concat(F.lit("{"), "event_type")).otherwise(whole).alias("value"))


def variant_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows with a field of their undeclared part, after a round trip through an export, and the rejected ones by reason."""
    read = lambda lines: variants.split(variants.parsed(lines, "id long, user_id string", ("id", "user_id")))
    good, rejected = read(bundle_lines(spark, sf_dir))
    again, _ = read(variants.lines_of(good))
    rows = again.select("user_id", variants.field("$.kind", "string").alias("what"), variants.field("$.props.k", "long").alias("k")).groupBy("user_id", "what").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
    return rows.unionByName(rejected.select(F.lit(None).cast("string").alias("user_id"), F.col("reason").alias("what"), "n", F.lit(None).cast("long").alias("total")))


def links_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links by the table function, called in SQL."""
    tables_in_sql.register(spark)
    rows = "SELECT * FROM links_of(TABLE({chunks}) PARTITION BY chunk_order)"
    links = spark.sql(rows, chunks=b.link_chunks(spark, sf_dir))
    return links.groupBy("source_device", "source_port", "dest_device", "dest_port").agg(F.min_by("layer", F.struct("place", "spot")).alias("layer"))


def addresses_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all serials by the table function, called in SQL."""
    from .corpus import wanted

    tables_in_sql.register(spark)
    asked = wanted(spark, sf_dir).select("sn").distinct()
    lines = entities.line_serials(b.device_chunks(spark, sf_dir), asked)
    found = spark.sql("SELECT * FROM address_of(TABLE({lines}) PARTITION BY sn ORDER BY (chunk_order, line))", lines=lines)
    return asked.join(found, "sn", "left")


def stream_newest_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thousand rows of the log, kept up by a stream."""
    folder = scratch(spark)
    stream = keyed.log_stream(spark, sf_dir)
    keyed.keep_newest(stream, f"{folder}/out", f"{folder}/state")
    return keyed.newest(spark, f"{folder}/out").select("id", "response_time")


def stream_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the last seven days of the log, kept up by a stream, days without rows included."""
    folder = scratch(spark)
    keyed.keep_week(keyed.log_stream(spark, sf_dir), f"{folder}/out", f"{folder}/state")
    return keyed.week(spark, f"{folder}/out").select(F.col("day").cast("string").alias("day"), "label", "n")


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk counts after a stream of changes to documents: all come in, toxic ones are deleted by a later version, poor ones get another text."""
    folder = scratch(spark)
    docs, labels = b.table(spark, sf_dir, "documents"), b.table(spark, sf_dir, "labels")
    first = docs.select(F.col("doc_id").alias("document_id"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"), "text")
    later = labels.filter("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("document_id"), F.lit(2).cast("long").alias("version"), (F.col("toxic") == 1).alias("deleted"), F.lit("held back, but long enough to make a chunk of its own here").alias("text"))
    for part in (later, first, later):  # out of order, and once more
        part.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("document_id") % 1000)).write.mode("append").parquet(f"{folder}/feed")
        keyed.apply_changes(spark.readStream.schema(keyed.CHANGES).parquet(f"{folder}/feed"), f"{folder}/table", f"{folder}/state")
    return clustered.read(spark, f"{folder}/table/chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        clustered_lookup, durable_changes, indexed_keyword_search, category_closure_deep, top_questions_sketch, response_quantiles, variant_import, links_in_sql, addresses_in_sql, stream_newest_queries,
        stream_week, stream_upserts,
    )
}

_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"
_LOG = "(SELECT event_id AS id, props AS query, value AS response_time, ts FROM events WHERE event_type = 'view')"


def _sql() -> dict[str, str]:
    from . import corpus, retrieval

    return {
        "clustered_lookup": f"SELECT doc_id AS document_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS size, max(i)::INT AS last_index FROM {_LINES} WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1",
        "durable_changes": f"""SELECT l.doc_id AS document_id, count(*) AS n_chunks, sum(CASE WHEN i = 0 AND b.quality = 0 THEN 9 ELSE length(content) END)::BIGINT AS size FROM {_LINES} l LEFT JOIN labels b ON b.doc_id = l.doc_id
            WHERE coalesce(b.toxic, 0) <> 1 GROUP BY 1""",
        "indexed_keyword_search": retrieval.SQL["keyword_search_batch"],
        "category_closure_deep": "WITH RECURSIVE below AS (SELECT 1 AS key, 0 AS depth UNION ALL SELECT o_orderkey, depth + 1 FROM below JOIN orders ON o_orderkey = key + 3) SELECT key::VARCHAR AS id, depth FROM below",
        "top_questions_sketch": f"SELECT substr(trim(query), 1, 50) AS question, count(*) AS n FROM {_LOG} GROUP BY 1 ORDER BY n DESC, question LIMIT 5",
        "response_quantiles": f"SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share, count(response_time) AS n, true AS close FROM {_LOG}",
        "variant_import": """SELECT 'u' || user_id AS user_id, event_type AS what, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events WHERE event_id % 10 > 1 GROUP BY 1, 2
            UNION ALL SELECT NULL, CASE event_id % 10 WHEN 0 THEN 'not JSON' ELSE 'missing user_id' END, count(*), NULL FROM events WHERE event_id % 10 < 2 GROUP BY 2""",
        "links_in_sql": corpus.SQL["link_topology"],
        "addresses_in_sql": corpus.SQL["address_lookup"],
        "stream_newest_queries": f"SELECT id, response_time FROM {_LOG} ORDER BY ts DESC, id DESC LIMIT 1000",
        "stream_week": f"SELECT d::DATE::VARCHAR AS day, month(d) || '/' || day(d) AS label, count(l.id) AS n FROM (SELECT unnest(generate_series(max(ts)::DATE - 6, max(ts)::DATE, INTERVAL 1 DAY)) AS d FROM {_LOG}) s LEFT JOIN {_LOG} l ON l.ts::DATE = s.d::DATE GROUP BY 1, 2",
        "stream_upserts": """SELECT d.doc_id AS document_id, count(*) AS n_chunks, sum(CASE WHEN b.quality = 0 THEN 58 ELSE length(trim(d.text)) END)::BIGINT AS size FROM documents d LEFT JOIN labels b USING (doc_id)
            WHERE coalesce(b.toxic, 0) <> 1 AND (trim(d.text) <> '' OR b.quality = 0) GROUP BY 1""",
    }


SQL = _sql()

"""The given tables under the names of the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: source as filename, language as category, the text's start as preview."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("source").alias("filename"), F.col("lang").alias("category_id"), F.col("n_chars").alias("file_size"), F.substring("text", 1, 500).alias("content_preview"), "text")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk, with the embedding of the same number, if there is one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("filename"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.join(vectors, "chunk_id", "left")


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_chunks`` without the embedding: the same rows, but texts are joined to the few numbers only that several vectors share."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("filename"))
    vectors = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL").groupBy(F.col("vec_id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    several, _ = stored(vectors.filter("n > 1"))
    rows = docs.join(several, "chunk_id", "left")
    return rows.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.coalesce("n", F.lit(1)).cast("int")))).select("chunk_id", "content", "filename")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their source, of a kind by length."""
    size = F.col("n_chars")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.when(size > 3000, "parent").when(size < 1000, "child").otherwise("semantic").alias("chunk_type"))
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events as queries: the properties as the question, the value as the time in milliseconds."""
    events = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return events.select(F.col("event_id").alias("id"), F.col("props").alias("query"), F.col("value").alias("response_time"), F.col("ts").cast("timestamp").alias("ts"))


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a tree of three levels."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"))
    return region.unionByName(nation).unionByName(customer)


def golden_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query of every benchmark item: its three longest distinct words, the first in the alphabet of equal ones."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("size"), w.alias("word"))))
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: x["word"]), " ").alias("query"), F.col("text").alias("item_text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages; the turn's number is their time."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"))


def user_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as queries, with the turns before them as history."""
    from ..operators.conversations import rolling_context

    turns = rolling_context(messages(spark, sf_dir), 10)
    return turns.filter("role = 'user'").select(F.col("id").alias("query_id"), F.col("content").alias("query"), F.col("context").alias("history"))


def device_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as device lines, a chunk for each nation and thousand of customer numbers: serial, host, alias and two addresses; every third line has the serial
    and host only; every second host has an uplink line, by its nation."""
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    serial = F.concat(F.lit("AAA1X"), F.lpad(key.cast("string"), 9, "0"))
    host = F.concat(F.lit("MDC-XX1E-A"), nation.cast("string"), F.lit("-POD"), (nation % 4).cast("string"), F.lit("-GPU-"), key.cast("string"))
    address = lambda net: F.concat(F.lit(f"10.240.{net}."), (key % 250).cast("string"))
    full = F.concat(serial, F.lit(","), serial, F.lit(","), host, F.lit(",alias,"), address(8), F.lit(","), address(0))
    line = F.when(key % 3 == 0, F.concat(serial, F.lit(" "), host)).otherwise(full)
    uplink = F.when(key % 2 == 0, F.concat(F.lit("\n"), host, F.lit(",1,a,b,c,d,MDC-XX1E-A"), nation.cast("string"), F.lit("-IBLF-"), (key % 5).cast("string"), F.lit(",1/"), (key % 8).cast("string"))).otherwise("")
    lines = c.select((nation.cast("long") * 10_000_000_000 + F.floor(key / 1000)).alias("chunk_order"), F.struct(key.alias("key"), F.concat(line, uplink).alias("line")).alias("x"))
    return lines.groupBy("chunk_order").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("content"))


def link_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as link lines between spine and core devices, a chunk for each thousand order numbers; every other line names the core first."""
    o = table(spark, sf_dir, "orders")
    spine = F.concat(F.lit("POD"), (F.col("o_custkey") % 8).cast("string"), F.lit("-SPINE"), (F.col("o_custkey") % 5).cast("string"))
    core = F.concat(F.lit("CORE"), (F.col("o_custkey") % 3).cast("string"))
    a, b = F.concat(F.lit("p"), (F.col("o_orderkey") % 16).cast("string")), F.concat(F.lit("q"), (F.col("o_custkey") % 16).cast("string"))
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws(",", spine, a, core, b)).otherwise(F.concat_ws(",", core, b, spine, a))
    lines = o.select(F.floor(F.col("o_orderkey") / 1000).alias("chunk_order"), F.struct("o_orderkey", line.alias("line")).alias("x"))
    return lines.groupBy("chunk_order").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("content"))


def tenant_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as tenants, orders as conversations, line items as messages; parts of suppliers as documents and chunks."""
    conversations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("updated_at"))
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("conversation_id"), F.col("l_returnflag").alias("role"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("user_id"), F.col("s_name").alias("filename"))
    chunks = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_suppkey").alias("document_id"))
    return {"conversations": conversations, "messages": items, "documents": docs, "chunks": chunks}

"""Queries on chunking, entities, ingest, embedding, scans and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IPV4
from ..operators import chunking, embedding
from ..operators import entities as e
from ..sources import tables
from ..sources.shared import scratch
from ..streaming import jobs
from . import binding as b


def plain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")


def marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings: the language above the source, then the text."""
    docs = b.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("# "), "lang", F.lit("\n## "), "source", F.lit("\n"), "text").alias("text"))


def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk_corpus(marked_docs(spark, sf_dir))
    return found.select("id", "document_id", "chunk_index", "token_count", F.array_join("metadata.breadcrumbs", " > ").alias("breadcrumbs"), F.length("content").alias("size"), "content")


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of at least the least size, before packing."""
    found = chunking.sections(marked_docs(spark, sf_dir).withColumn("text", chunking.cleaned(F.col("text"))))
    return found.filter(F.length(F.trim("content")) >= chunking.MIN_SECTION).select("document_id", F.array_join("breadcrumbs", " > ").alias("breadcrumbs"), "content")


def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk_corpus(plain_docs(spark, sf_dir), strategy="paragraphs")
    return found.select("id", "document_id", "chunk_index", "token_count", "content")


def reassemble_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document from the lines of its whole text: of eight lines, the first two are parents of the even and odd ones below."""
    docs = b.table(spark, sf_dir, "documents")
    place = lambda n: F.concat_ws("-", "document_id", n.cast("string"))
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    index = F.col("chunk_index")
    top = index - F.pmod(index, F.lit(8)) + F.pmod(index, F.lit(2))
    chunks = lines.select(place(index).alias("id"), "document_id", "chunk_index", "content", F.when(top != index, place(top)).alias("parent_id"))
    return chunking.reassemble(docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename")), chunks)


def reassemble_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document from the chunks of its whole text."""
    owners = b.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "filename")
    return chunking.reassemble(owners, chunking.chunk_corpus(plain_docs(spark, sf_dir), strategy="paragraphs"))


def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.size(e.serials(F.col("text"))).alias("n_serials"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(IPV4), F.lit(0)))).alias("n_addresses"))
    return found.filter("n_serials > 0 OR n_addresses > 0")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host to link target edges of pages."""
    pages = b.table(spark, sf_dir, "pages")
    links = pages.select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("host").agg(F.count_distinct("target").alias("n_targets"), F.count(F.lit(1)).alias("n_links"))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serials asked for: one for each customer, every fifth unknown, every sixth asked twice."""
    key = F.col("c_custkey")
    raw = F.concat(F.lit(" aaa1x"), F.lpad(F.when(key % 5 == 0, key + 500_000_000).otherwise(key).cast("string"), 9, "0"))
    lists = b.table(spark, sf_dir, "customer").select(key.alias("key"), F.concat(raw, F.when(key % 6 == 0, F.concat(F.lit(",\n"), raw)).otherwise("")).alias("raw"))
    parts = lists.select("key", F.posexplode(F.split("raw", r"[\n,\s]+")).alias("place", "sn"))
    return parts.filter("sn <> ''").select((F.col("key") * 10 + F.col("place")).alias("position"), F.upper("sn").alias("sn"))


def serial_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.switch_lookup(b.device_chunks(spark, sf_dir), wanted(spark, sf_dir))
    return found.select("position", "sn", "hostname", F.array_join("iblfs", "|").alias("iblfs"))


def switch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.switch_groups(e.switch_lookup(b.device_chunks(spark, sf_dir), wanted(spark, sf_dir)))
    return found.select(F.array_join("iblfs", "|").alias("iblfs"), "n")


def switch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.lookup_summary(e.switch_lookup(b.device_chunks(spark, sf_dir), wanted(spark, sf_dir)))


def address_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All serials, with those whose line has only serial and host."""
    return e.address_lookup(b.device_chunks(spark, sf_dir), wanted(spark, sf_dir)).select("sn", "hostname", "outband", "inband")


def address_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``address_lookup``, under the name used while that query left some out."""
    return address_lookup(spark, sf_dir)


def link_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.topology_edges(b.link_chunks(spark, sf_dir)).drop("first")


def topology_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.topology_devices(e.topology_edges(b.link_chunks(spark, sf_dir)))
    return found.select("tier", "n", F.array_join("devices", ",").alias("devices"))


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = b.text_chunks(spark, sf_dir).select("chunk_id", "content")
    found = embedding.embed_chunks(chunks)
    return found.select("chunk_id", F.size("embedding").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


def scan_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "n_words": [len((t or "").split(" ")) for t in frame["content"]]})

    return embedding.scan(b.text_chunks(spark, sf_dir).select("chunk_id", "content"), words, "chunk_id long, n_words long")


def pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.pattern_scan(b.text_chunks(spark, sf_dir), "(?i)licensed under").select("chunk_id")


def file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their language's suffix; two of them have no decoder."""
    docs = b.table(spark, sf_dir, "documents")
    suffix = F.when(F.col("lang") == "de", "pdf").when(F.col("lang") == "fr", "bin").otherwise("txt")
    files = docs.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"), F.length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    good, rejected = tables.ingest(files)
    return good.select("filename", "file_type", "content_preview", F.lit(None).cast("string").alias("error_message")).unionByName(rejected.select("filename", "file_type", F.lit(None).cast("string").alias("content_preview"), "error_message"))


def table_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sheet"), F.col("s_suppkey").alias("at"), F.col("s_name"), F.col("s_nationkey").alias("nation"))
    return tables.tabular_text(rows, "sheet", "at").select(F.col("sheet").cast("long").alias("sheet"), "text")


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed days of the event stream."""
    folder = scratch(spark)
    schema = b.table(spark, sf_dir, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    stream = jobs.stream_table(spark, sf_dir, "events", schema).select(F.col("ts").cast("timestamp").alias("ts"))
    jobs.run_to_end(jobs.daily_stream(stream), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("day date, n long").parquet(f"{folder}/out").select(F.col("day").cast("string").alias("day"), "n")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents read as a stream."""
    folder = scratch(spark)
    docs = jobs.stream_table(spark, sf_dir, "documents", "doc_id long, text string").select(F.col("doc_id").alias("document_id"), "text")
    jobs.ingest_stream(docs, f"{folder}/out", f"{folder}/state")
    return spark.read.schema("document_id long").parquet(f"{folder}/out").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_corpus, chunk_sections, chunk_paragraph, reassemble_document, reassemble_chunks, entity_extract, page_links, serial_switches, switch_groups, switch_summary, address_lookup, address_lookup_all, link_topology, topology_devices, embed_chunks, scan_udf,
        pattern_scan, file_ingest, table_ingest, stream_daily_counts, stream_ingest,
    )
}

_HOST = "'MDC-XX1E-A' || c_nationkey || '-POD' || (c_nationkey % 4) || '-GPU-' || c_custkey"
_WANTED = """wanted AS (SELECT c_custkey, c_custkey * 10 + p AS position, 'AAA1X' || lpad((CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 500000000 ELSE c_custkey END)::VARCHAR, 9, '0') AS sn, c_custkey % 5 <> 0 AS known
      FROM customer, (VALUES (1), (2)) v(p) WHERE p = 1 OR c_custkey % 6 = 0)"""
_SWITCHES = f"""WITH {_WANTED}, found AS (SELECT w.position, w.sn, CASE WHEN known THEN {_HOST} END AS hostname,
      CASE WHEN NOT known THEN NULL WHEN c_custkey % 2 = 0 THEN 'MDC-XX1E-A' || c_nationkey || '-IBLF-' || (c_custkey % 5) ELSE '' END AS iblfs FROM wanted w JOIN customer USING (c_custkey))"""
_ADDRESSES = f"""WITH {_WANTED}, last AS (SELECT c_nationkey, c_custkey // 1000 AS thousand, max(c_custkey) % 250 AS part FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1, 2)
      SELECT DISTINCT w.sn, CASE WHEN known THEN {_HOST} END AS hostname, CASE WHEN known THEN coalesce('10.240.8.' || (CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 250 ELSE part END), '') END AS outband,
      CASE WHEN known THEN coalesce('10.240.0.' || (CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 250 ELSE part END), '') END AS inband
      FROM wanted w JOIN (SELECT *, c_custkey // 1000 AS thousand FROM customer) c USING (c_custkey) LEFT JOIN last USING (c_nationkey, thousand)"""
_LINKS = """links AS (SELECT DISTINCT 'spine-core' AS layer, 'POD' || (o_custkey % 8) || '-SPINE' || (o_custkey % 5) AS source_device, 'p' || (o_orderkey % 16) AS source_port, 'CORE' || (o_custkey % 3) AS dest_device, 'q' || (o_custkey % 16) AS dest_port FROM orders)"""
_ADDRESS = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"

SQL = {
    "chunk_sections": "SELECT doc_id AS document_id, lang || ' > ' || source AS breadcrumbs, regexp_replace('## ' || source || chr(10) || text, '\\n\\n\\n+', chr(10) || chr(10), 'g') AS content FROM documents WHERE length(trim('## ' || source || chr(10) || text)) >= 50",
    "chunk_paragraph": "SELECT doc_id || '-0' AS id, doc_id AS document_id, 0 AS chunk_index, ceil(round(length(text) * 0.3::DOUBLE, 6))::BIGINT AS token_count, trim(text) AS content FROM documents WHERE trim(text) <> ''",
    "reassemble_document": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
      bodies AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY i // 8, i % 2, i) AS body FROM l GROUP BY 1)
      SELECT doc_id AS document_id, concat_ws(chr(10) || chr(10), '# ' || source, body) AS markdown FROM documents LEFT JOIN bodies USING (doc_id)""",
    "entity_extract": f"""SELECT * FROM (SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\b[A-Z]{{3}}[A-Z0-9]{{8,12}}\\b'), lambda x: upper(x)))) AS n_serials, len(list_distinct(regexp_extract_all(text, '{_ADDRESS}'))) AS n_addresses FROM documents) WHERE n_serials > 0 OR n_addresses > 0""",
    "page_links": "SELECT host, count(DISTINCT target) AS n_targets, count(*) AS n_links FROM (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY 1",
    "serial_switches": f"{_SWITCHES} SELECT * FROM found",
    "switch_groups": f"{_SWITCHES} SELECT iblfs, count(*) AS n FROM found WHERE hostname IS NOT NULL GROUP BY 1",
    "switch_summary": f"{_SWITCHES} SELECT count(*) AS total, count(hostname) AS found, count(*) FILTER (hostname IS NULL) AS not_found, count(DISTINCT iblfs) FILTER (hostname IS NOT NULL) AS groups FROM found",
    "address_lookup": _ADDRESSES,
    "address_lookup_all": _ADDRESSES,
    "link_topology": f"WITH {_LINKS} SELECT * FROM links",
    "topology_devices": f"""WITH {_LINKS}, d AS (SELECT DISTINCT 'spine' AS tier, source_device AS device FROM links UNION SELECT 'core', dest_device FROM links) SELECT tier, count(*) AS n, string_agg(device, ',' ORDER BY device) AS devices FROM d GROUP BY 1""",
    "scan_udf": "SELECT doc_id AS chunk_id, len(string_split(text, ' ')) AS n_words FROM documents",
    "pattern_scan": "SELECT doc_id AS chunk_id FROM documents WHERE regexp_matches(text, '(?i)licensed under') ORDER BY 1 LIMIT 10",
    "file_ingest": """SELECT doc_id || '.' || CASE lang WHEN 'de' THEN 'pdf' WHEN 'fr' THEN 'bin' ELSE 'txt' END AS filename, CASE lang WHEN 'de' THEN 'pdf' WHEN 'fr' THEN 'unknown' ELSE 'text' END AS file_type,
      CASE WHEN lang NOT IN ('de', 'fr') THEN substr(trim(text), 1, 500) END AS content_preview, CASE lang WHEN 'de' THEN 'no decoder for this type' WHEN 'fr' THEN 'unknown type' END AS error_message FROM documents""",
    "table_ingest": "SELECT s_nationkey::BIGINT AS sheet, '【' || s_nationkey || '】' || chr(10) || string_agg(s_name || ',' || s_nationkey, chr(10) ORDER BY s_suppkey) AS text FROM supplier GROUP BY s_nationkey",
    "stream_daily_counts": "SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ts::DATE HAVING ts::DATE + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
}

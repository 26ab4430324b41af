"""Schemas, readers and writers of the engine's tables, and bulk ingest of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import staged, trimmed

DOCUMENTS = "id string, user_id string, filename string, file_type string, file_size long, category string, category_id string, category_path array<string>, content_preview string, uploaded_at timestamp, max_chunks int, status string, error_message string"
CHUNKS = "id string, document_id string, content string, embedding array<float>, chunk_index int, token_count long, created_at timestamp, parent_id string, chunk_type string, metadata struct<breadcrumbs:array<string>,header:string,summary:string>"
QUERY_LOG = "id string, query string, response_time long, ts timestamp"
CATEGORIES = "id string, parent_id string, name string, icon string"
CONVERSATIONS = "id string, user_id string, title string, created_at timestamp, updated_at timestamp"
MESSAGES = "id string, conversation_id string, role string, content string, metadata map<string,string>, created_at timestamp"
BUNDLE = "version string, timestamp string, user_id string, user_email string, data string"
#: Entities of a bundle with their schemas.
ENTITIES = {"conversations": CONVERSATIONS, "messages": MESSAGES, "documents": DOCUMENTS, "chunks": CHUNKS}


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table with a declared schema; unreadable files and rows are passed over."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true")
    return reader.option("mode", "PERMISSIVE").option("multiLine", "true").json(path) if kind == "json" else reader.format(kind).load(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks in files that hold whole documents in order, so that one document's chunks are found by row groups."""
    chunks.repartition("document_id").sortWithinPartitions("document_id", "chunk_index").write.mode("append").parquet(path)


def manual_chunk(document_id: Column, text: Column) -> Column:
    """A chunk row for text entered by hand: index 0, a token for four characters."""
    return F.struct(F.concat_ws("-", document_id, F.lit("0")).alias("id"), document_id.alias("document_id"), text.alias("content"), F.lit(0).alias("chunk_index"), F.ceil(F.length(text) / 4).alias("token_count"))


def export_bundle(tables: dict[str, DataFrame], path: str, user_id: str | None = None, user_email: str | None = None, version: str = "1.0.0") -> None:
    """Write each entity of a bundle as JSON lines, and a header with version, time, user and the names of the entities."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    header = spark.createDataFrame([(version, user_id, user_email, ",".join(sorted(tables)))], "version string, user_id string, user_email string, data string")
    header.withColumn("timestamp", F.current_timestamp().cast("string")).write.mode("overwrite").json(f"{path}/header")


def read_bundle(spark: SparkSession, path: str, schemas: dict[str, str] = ENTITIES, major: int = 1) -> dict[str, DataFrame]:
    """The entities of a bundle that ``export_bundle`` wrote, each with its schema in ``schemas``, as ``restore`` takes them.

    ValueError where the header lacks a required field, has another major version or does not name an entity asked for.
    """
    header = spark.read.schema(BUNDLE).json(f"{path}/header")
    found = violations(header, major=major).first().asDict()
    names = (header.first() or {"data": None})["data"]
    absent = sorted(set(schemas) - set((names or "").split(",")))
    wrong = [name for name, n in found.items() if n] + [f"missing_{name}" for name in absent]
    if wrong:
        raise ValueError(f"not a bundle of this version: {', '.join(wrong)}")
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def violations(bundle: DataFrame, required: tuple[str, ...] = ("version", "user_id", "data"), major: int = 1) -> DataFrame:
    """How many rows of a bundle lack a required field or have another major version."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") if c in bundle.columns else F.count(F.lit(1)).alias(f"missing_{c}") for c in required]
    version = F.count_if(F.split("version", r"\.")[0].cast("int") != major) if "version" in bundle.columns else F.count(F.lit(1))
    return bundle.agg(*missing, version.alias("other_version"))


def write_markdown(documents: DataFrame, path: str) -> None:
    """Write reassembled documents as text, one folder for each."""
    documents.select(F.col("markdown").alias("value"), "document_id").write.mode("overwrite").partitionBy("document_id").text(path)


def file_type(name: Column) -> Column:
    """Type of a file by the end of its name: the first rule that fits."""
    n = F.lower(name)
    rules = (("pdf", r"\.pdf$"), ("word", r"\.docx?$"), ("excel", r"\.xlsx?$|\.csv$"), ("text", r"\.(txt|md|markdown|json|log|html?)$"))
    out = F.lit("unknown")
    for kind, pattern in reversed(rules):
        out = F.when(n.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def repaired_name(name: Column) -> Column:
    """A filename read as Latin-1 by mistake, read again as UTF-8, if that gives CJK characters; else as it is."""
    narrow = name.rlike(r"^[\x00-\xff]*$")
    again = F.try_validate_utf8(F.encode(F.when(narrow, name), "ISO-8859-1").cast("string"))
    return F.when(narrow & again.rlike("[一-龥]"), again).otherwise(name)


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and rejected files from ``files`` (path, length, content: the binaryFile format).

    Text files are decoded and trimmed; the preview is the first 500 characters. Empty, undecodable and other kinds of files are rejected
    with an error message.
    """
    named = staged(files.select("path", "length", "content"), filename=repaired_name(F.regexp_extract("path", r"([^/]*)$", 1)))
    typed = staged(named, file_type=file_type(F.col("filename")), workbook=F.lower("filename").rlike(r"\.xlsx?$"))
    text = trimmed(F.try_validate_utf8(F.col("content").cast("string")))
    read = staged(typed, text=F.when(F.col("file_type").isin("text", "excel") & ~F.col("workbook"), text))
    error = F.when(F.col("file_type").isin("pdf", "word") | F.col("workbook"), "no decoder for this type").when(F.col("file_type") == "unknown", "unknown type").when(F.col("text").isNull(), "not UTF-8").when(F.col("text") == "", "empty")
    judged = read.withColumn("error_message", error)
    good = judged.filter("error_message IS NULL").select(F.sha2("path", 256).alias("id"), "filename", "file_type", F.col("length").alias("file_size"), F.substring("text", 1, 500).alias("content_preview"), F.lit("ready").alias("status"), "text")
    return good, judged.filter("error_message IS NOT NULL").select("path", "filename", "file_type", "error_message")


def tabular_text(rows: DataFrame, sheet: str, order: str) -> DataFrame:
    """sheet and text: rows of a table file as a heading and comma-joined lines, in order. Meant for one file's sheet."""
    fields = [c for c in rows.columns if c not in (sheet, order)]
    line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields))
    lines = rows.groupBy(sheet).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return lines.select(F.col(sheet).alias("sheet"), F.concat(F.lit("【"), F.col(sheet).cast("string"), F.lit("】\n"), "lines").alias("text"))

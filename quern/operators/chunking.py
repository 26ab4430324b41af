"""Documents to chunks: heading-aware, fence-safe, packed by paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import vocabulary as v
from ..functions.text import CJK, LEFT, RIGHT, trimmed

#: Largest chunk in characters, and least trimmed characters of a section that is kept.
MAX_CHUNK, MIN_SECTION = 4000, 50
#: A heading line; a carriage return or another line end of Unicode at its end is no part of the title.
HEADING = re.compile(r"(#{1,6})[ \t\x0b\f\r]+([^\r\x85\u2028\u2029]+)[\r\x85\u2028\u2029]?\Z")
#: A character that is not trimmed.
FILLED = r"[^\s\u00a0\ufeff]"
#: Texts split at a time.
ROWS = 256
FENCE = r"(?s)```.*?```"
SENTENCE_END = r"(?<=[。！？；.!?;])\s*"


def cleaned(text: Column) -> Column:
    """Collapsed blank lines, over-indented bullets set back to two spaces, stray formula marks as plain signs."""
    for pattern, into in ((r"\n\n\n+", "\n\n"), (r"(?m)^(\s{4,})(-|\*|\+)\s", r"  $2 "), (r"\$\\equiv\$", "="), (r"\$=\$", "=")):
        text = F.regexp_replace(text, pattern, into)
    return text


def table_rows(table: Column) -> Column:
    """The pipe rows of one html table, a rule after the first. Header cells are not read, so a header row comes out empty."""
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>.*?</td>"), F.lit(0)), lambda c: trimmed(F.regexp_replace(c, "<[^>]+>", "")))
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.greatest(F.size(F.split(lines[0], r"\|")) - 2, F.lit(0))), " | "), F.lit(" |"))
    return F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))


def tables_as_pipes(text: Column) -> Column:
    """Html tables in a text written as pipe tables; a table without rows stays."""
    pattern = r"(?is)<table[^>]*>.*?</table>"
    tables = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    written = F.transform(tables, lambda t: F.when(F.regexp_count(t, F.lit(r"(?is)<tr[^>]*>.*?</tr>")) == 0, t).otherwise(F.concat(F.lit("\n"), F.array_join(table_rows(t), "\n"), F.lit("\n"))))
    joined = F.array_join(F.zip_with(between, F.concat(written, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(F.lower(text), F.lit("<table")), joined).otherwise(text)


def split_sections(text: str) -> list[tuple[int, str, list[str]]]:
    """Number, content and breadcrumbs of each section of a text; what comes before the first heading is section 0."""
    if "#" not in text:
        return [(0, text, [])]
    total, before = text.count("```"), 0
    closed = total - total % 2  # a fence that is never closed protects nothing
    found, lines, open_heads, number = [], [], [], 0
    for line in text.split("\n"):
        fences = line.count("```")
        head = HEADING.match(line) if not fences and line.startswith("#") and not (before % 2 and before < closed) else None
        before += fences
        if head:
            if lines:
                found.append((number, "\n".join(lines), [title for _, title in open_heads]))
            level = len(head[1])
            open_heads = [h for h in open_heads if h[0] < level] + [(level, head[2])]
            number, lines = number + 1, []
        lines.append(line)
    return [*found, (number, "\n".join(lines), [title for _, title in open_heads])]


def sections(docs: DataFrame) -> DataFrame:
    """document_id, section, content and breadcrumbs from ``docs`` (document_id, text); fenced lines are never headings.

    A heading line opens a section; its breadcrumbs are the headings open above it. Each text is read once, where it lies; a null
    one has no section.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [(i, *s) for i, text in enumerate(part.column(1).to_pylist()) if text is not None for s in split_sections(text)]
                owner, number, content, trail = zip(*found) if found else ((), (), (), ())
                columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int64()), pa.array(content, pa.string()), pa.array(trail, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["document_id", "section", "content", "breadcrumbs"])

    rows = docs.select("document_id", "text")
    schema = StructType([rows.schema["document_id"]]).add("section", "long").add("content", "string").add("breadcrumbs", ArrayType(StringType()))
    return rows.mapInArrow(run, schema).withColumn("breadcrumbs", F.transform("breadcrumbs", trimmed))


def packed_sentences(text: Column, size: int) -> Column:
    """A long paragraph in pieces of at most ``size`` characters, broken after sentences, and inside one only if it is longer."""
    parts = F.split(text, SENTENCE_END)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    keep = lambda s: F.when(trimmed(s) != "", F.array(trimmed(s))).otherwise(F.array().cast("array<string>"))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda i: F.substring(s, i * size + 1, F.lit(size)))

    def step(state: Column, part: Column) -> Column:
        full = F.length(state["now"]) + F.length(part) > size
        return (
            F.when(full & (F.length(part) > size), F.struct(F.concat(state["done"], keep(state["now"]), cut(part)).alias("done"), F.lit("").alias("now")))
            .when(full, F.struct(F.concat(state["done"], keep(state["now"])).alias("done"), part.alias("now")))
            .otherwise(F.struct(state["done"].alias("done"), F.concat(state["now"], part).alias("now")))
        )

    return F.aggregate(parts, start, step, lambda s: F.concat(s["done"], keep(s["now"])))


def packed(content: Column, breadcrumbs: Column, size: int) -> Column:
    """An oversized section in chunks: fences whole, paragraphs joined by a blank line, each chunk led by the breadcrumbs."""
    prefix = F.when(F.size(breadcrumbs) > 0, F.concat(F.lit("["), F.array_join(breadcrumbs, " > "), F.lit("]\n\n"))).otherwise(F.lit(""))
    texts = F.transform(F.split(content, FENCE), lambda t: F.transform(F.filter(F.split(t, r"\n\n+"), lambda p: trimmed(p) != ""), lambda p: F.struct(F.lit(False).alias("code"), p.alias("value"))))
    codes = F.transform(F.regexp_extract_all(content, F.lit(FENCE), F.lit(0)), lambda c: F.array(F.struct(F.lit(True).alias("code"), c.alias("value"))))
    none = F.array().cast("array<struct<code:boolean,value:string>>")
    parts = F.flatten(F.zip_with(texts, F.concat(codes, F.array(none)), lambda a, b: F.concat(a, b)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    led = lambda s: F.when(trimmed(s) != "", F.array(F.concat(prefix, s))).otherwise(F.array().cast("array<string>"))
    state_of = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def step(state: Column, part: Column) -> Column:
        done, now, code, value = state["done"], state["now"], part["code"], part["value"]
        alone = F.length(value) > size
        over = F.length(now) + F.length(value) + F.when(code, 0).otherwise(2) > size
        pieces = F.when(code, F.array(F.concat(prefix, value))).otherwise(F.transform(packed_sentences(value, size), lambda s: F.concat(prefix, s)))
        joint = F.when(code | (now == ""), F.lit("")).otherwise(F.lit("\n\n"))
        return F.when(alone, state_of(F.concat(done, led(now), pieces), F.lit(""))).when(over, state_of(F.concat(done, led(now)), value)).otherwise(state_of(done, F.concat(now, joint, value)))

    return F.aggregate(parts, start, step, lambda s: F.concat(s["done"], led(s["now"])))


def token_estimate(text: Column) -> Column:
    """0.6 tokens a CJK character, 0.3 any other, rounded up."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.ceil(F.round(cjk * 0.6 + (F.length(text) - cjk) * 0.3, 6))


def summary(content: Column, breadcrumbs: Column) -> Column:
    """Header, first two device commands and first five technical terms of a chunk."""
    commands = F.slice(F.regexp_extract_all(content, F.lit("(?i)" + v.SUMMARY_COMMANDS), F.lit(0)), 1, 2)
    terms = F.array_distinct(F.concat(*(F.transform(F.regexp_extract_all(content, F.lit(f"{LEFT}(?i:{p}){RIGHT}"), F.lit(0)), F.upper) for p in v.SUMMARY_TERMS)))
    # an expression that stands twice is searched twice, so labels with nothing after them are dropped afterwards, and the result is bound once
    labels = ("NVUE: ", "关键词: ")
    parts = F.array(
        F.when(F.size(breadcrumbs) > 0, F.element_at(breadcrumbs, -1)),
        F.concat(F.lit(labels[0]), F.array_join(F.transform(commands, trimmed), "; ")),
        F.concat(F.lit(labels[1]), F.array_join(F.slice(terms, 1, 5), ", ")),
    )
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull() & ~p.isin(*labels)), " | ")
    return F.transform(F.array(joined), lambda j: F.when(j == "", F.lit("No summary")).otherwise(j))[0]


def finished(pieces: DataFrame) -> DataFrame:
    """Chunk columns from pieces (document_id, section, part, piece, breadcrumbs), numbered from 0 in each document."""
    order = Window.partitionBy("document_id").orderBy("section", "part")
    numbered = pieces.withColumn("chunk_index", F.row_number().over(order) - 1)
    header = F.when(F.size("breadcrumbs") > 0, F.element_at("breadcrumbs", -1))
    return numbered.select(
        F.concat_ws("-", F.col("document_id").cast("string"), "chunk_index").alias("id"), "document_id", trimmed(F.col("piece")).alias("content"), "chunk_index",
        token_estimate(F.col("piece")).cast("long").alias("token_count"), F.lit("semantic").alias("chunk_type"), F.lit(None).cast("string").alias("parent_id"),
        F.struct("breadcrumbs", header.alias("header"), summary(F.col("piece"), F.col("breadcrumbs")).alias("summary")).alias("metadata"),
    )


def chunk_corpus(docs: DataFrame, max_size: int = MAX_CHUNK, strategy: str = "sections") -> DataFrame:
    """Chunks of every document (document_id, text): id, content, chunk_index, token_count, chunk_type, parent_id and metadata.

    ``strategy`` is "sections" or, without regard to headings, "paragraphs". Blank documents give no chunk. The one shuffle, by
    document, comes before packing and numbering, as documents differ much in length.
    """
    filled = docs.select("document_id", "text").filter(F.col("text").rlike(FILLED))
    if strategy == "paragraphs":
        parts = filled.repartition("document_id").select("document_id", F.posexplode(packed_paragraphs(F.col("text"), max_size)).alias("part", "piece"))
        return finished(parts.withColumn("section", F.lit(0)).withColumn("breadcrumbs", F.array().cast("array<string>")))
    ready = filled.withColumn("text", cleaned(F.col("text"))).withColumn("text", tables_as_pipes(F.col("text")))
    kept = sections(ready).filter(F.length(trimmed(F.col("content"))) >= MIN_SECTION).repartition("document_id")
    pieces = F.when(F.length("content") <= max_size, F.array("content")).otherwise(packed(F.col("content"), F.col("breadcrumbs"), max_size))
    return finished(kept.select("document_id", "section", "breadcrumbs", F.posexplode(pieces).alias("part", "piece")))


def packed_paragraphs(text: Column, size: int) -> Column:
    """Paragraphs packed greedily to about ``size`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    keep = lambda s: F.when(trimmed(s) != "", F.array(trimmed(s))).otherwise(F.array().cast("array<string>"))
    step = lambda s, p: F.when((F.length(s["now"]) + F.length(p) > size) & (s["now"] != ""), F.struct(F.concat(s["done"], keep(s["now"])).alias("done"), p.alias("now"))).otherwise(F.struct(s["done"].alias("done"), F.when(s["now"] == "", p).otherwise(F.concat(s["now"], F.lit("\n\n"), p)).alias("now")))
    return F.aggregate(F.split(text, r"\n\n+"), start, step, lambda s: F.concat(s["done"], keep(s["now"])))


def reassemble(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id and markdown of every document: its top-level chunks in order, each followed by its children."""
    children = chunks.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n").alias("below"))
    tops = chunks.filter("parent_id IS NULL").join(children.withColumnRenamed("parent_id", "id"), "id", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.concat_ws("\n\n", "content", "below").alias("content")))), lambda c: c["content"])
    bodies = tops.groupBy("document_id").agg(F.array_join(ordered, "\n\n").alias("body"))
    return documents.join(bodies, "document_id", "left").select("document_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "filename"), "body").alias("markdown"))

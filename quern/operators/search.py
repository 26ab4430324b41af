"""Lexical, vector and hybrid search over chunks, for one query or a table of queries."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import contains_any, occurrences, staged
from ..sources.shared import stored

#: Constant of reciprocal rank fusion.
RRF = 60
FENCE = "```"


def query_tokens(query: str) -> list[str]:
    """ASCII alphanumeric and CJK runs of a lower-cased query; single characters only if CJK."""
    found = re.findall(r"[a-z0-9]+|[一-龥]+", query.lower())
    return [w for w in found if len(w) >= 2 or not w.isascii()]


def expanded_terms(query: str, expansions: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Tokens, and the expansions of every key that equals a token or lies inside one, without repeats."""
    table = v.EXPANSIONS if expansions is None else expansions
    tokens = query_tokens(query)
    more = (s for t in tokens for key, words in table.items() if key in t for s in words)
    return list(dict.fromkeys([*tokens, *more]))


def query_flags(query: str) -> dict[str, bool]:
    """Whether a query asks for a command, a concept or help with trouble."""
    q = query.lower()
    return {
        "command": any(w in q for w in v.COMMAND_WORDS) or re.search(v.COMMAND_PATTERN, q) is not None,
        "concept": any(w in q for w in v.CONCEPT_WORDS),
        "trouble": any(w in q for w in v.TROUBLE_WORDS),
    }


def is_technical(term: Column) -> Column:
    return term.rlike("^[a-z0-9]+$")


def boost_of(content: Column, query: Column, command: Column, concept: Column, trouble: Column) -> Column:
    """What a chunk's kind of content adds to a score that is above 2 already."""
    has = lambda c, *words: contains_any(c, words)
    commands = has(content, *v.COMMAND_CONTENT) | content.rlike(v.COMMAND_CONTENT_PATTERN) | has(content, FENCE)
    plus = lambda condition, points: F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))
    for_command = (
        F.lit(10.0)
        + plus(has(query, "show", "显示") & has(content, "show"), 5)
        + plus(has(query, "config", "配置") & has(content, "config", "nv set"), 5)
        + plus(has(query, "set") & has(content, "nv set"), 8)
        + plus(has(query, "mlag", "clag") & has(content, "nv set") & has(content, "mlag", "bond"), 15)
    )
    return F.when(command & commands, for_command).otherwise(F.lit(0.0)) + plus(concept & content.rlike(v.CONCEPT_CONTENT_PATTERN), 15) + plus(concept & content.startswith("#"), 10) + plus(trouble & has(content, *v.TROUBLE_CONTENT), 15)


def keyword_search(chunks: DataFrame, query: str, limit: int = 30, expansions: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The ``limit`` best chunks (chunk_id, content, filename) for one query, with score.

    The query's terms become literal column expressions, so scoring is one projection and the result one ordered take. The text is
    lower-cased once and each term counted once.
    """
    terms = expanded_terms(query, expansions)
    flags = query_flags(query)
    lowered = staged(chunks, _content=F.lower("content"), _name=F.lower(F.coalesce("filename", F.lit(""))))
    content = F.col("_content")
    counts = {f"_n{i}": occurrences(content, term) for i, term in enumerate(terms)}
    counted = staged(lowered, **counts) if counts else lowered
    points = F.when(F.contains(content, F.lit(query.lower())), F.lit(10.0)).otherwise(F.lit(0.0))
    matched = F.lit(0)
    score = reduce(lambda a, t: a + F.when(F.contains("_name", F.lit(t)), F.lit(2.0)).otherwise(F.lit(0.0)), terms, F.lit(0.0)) + points
    for name, term in zip(counts, terms):
        count = F.col(name)
        weight = 3.0 if re.fullmatch("[a-z0-9]+", term) else 1.0
        score = score + F.when(count > 0, (F.lit(1.0) + F.log(count.cast("double"))) * weight).otherwise(F.lit(0.0))
        matched = matched + F.when((count > 0) | F.lit(term == ""), 1).otherwise(0)
    based = staged(counted, _score=score, _matched=matched)
    scored = staged(based, _base=F.col("_score") + F.when(F.col("_matched") > 1, F.col("_matched") * 1.5).otherwise(F.lit(0.0)))
    boost = boost_of(content, F.lit(query.lower()), *(F.lit(flags[k]) for k in ("command", "concept", "trouble")))
    found = staged(scored, score=F.col("_base") + F.when(F.col("_base") > 2, boost).otherwise(F.lit(0.0)))
    return found.filter("score > 0").select(*chunks.columns, "score").orderBy(F.desc("score"), "chunk_id").limit(limit)


def term_matches(chunks: DataFrame, patterns: list[str]) -> DataFrame:
    """chunk_id, term and n: non-overlapping occurrences of every pattern in the lower-cased contents, in one pass over the text."""
    shared = chunks.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for i, p in enumerate(shared.value):
            found.add_word(p, (i, len(p)))
        found.make_automaton()
        for batch in batches:
            ids, terms, counts = [], [], []
            for chunk_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                free: dict[int, int] = {}
                count: dict[int, int] = {}
                for end, (i, size) in found.iter((content or "").lower()):
                    if end - size >= free.get(i, -1):
                        free[i] = end
                        count[i] = count.get(i, 0) + 1
                ids += [chunk_id] * len(count)
                terms += [shared.value[i] for i in count]
                counts += count.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["chunk_id", "term", "n"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "content").mapInArrow(run, f"chunk_id {kind}, term string, n long")


def keyword_search_batch(chunks: DataFrame, queries: DataFrame, limit: int = 30, expansions: dict[str, tuple[str, ...]] | None = None, block: int = 20_000) -> DataFrame:
    """query_id, chunk_id, score and rank: the ``limit`` best chunks of every row of ``queries`` (query_id, query).

    All terms of all queries are found in one pass over the chunks and one over the distinct filenames, stored, and joined to the queries by
    term; queries go through in blocks of ``block``, which bounds what is broadcast. A filename counts for queries
    whose terms it holds even where the content holds none.
    """
    out = None
    rows = queries.select("query_id", "query").toLocalIterator()
    while part := [r for _, r in zip(range(block), rows)]:
        found = _search_block(chunks, part, queries, expansions)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = _search_block(chunks, [], queries, expansions)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _search_block(chunks: DataFrame, rows: list, queries: DataFrame, expansions: dict | None) -> DataFrame:
    spark = chunks.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = [(r["query_id"], (r["query"] or "").lower(), expanded_terms(r["query"] or "", expansions), query_flags(r["query"] or "")) for r in rows]
    patterns = sorted({p for _, q, terms, _ in asked for p in [q, *terms] if p}) or [" "]
    terms = spark.createDataFrame([(i, t) for i, _, ts, _ in asked for t in ts], f"query_id {kind}, term string")
    about = spark.createDataFrame([(i, q, f["command"], f["concept"], f["trouble"]) for i, q, _, f in asked], f"query_id {kind}, query string, command boolean, concept boolean, trouble boolean")
    matches, _ = stored(term_matches(chunks, patterns))
    weight = F.when(is_technical(F.col("term")), 3.0).otherwise(1.0)
    points = matches.join(F.broadcast(terms), "term").groupBy("query_id", "chunk_id").agg(F.sum((1 + F.log("n")) * weight).alias("points"), F.count(F.lit(1)).alias("matched"))
    whole = matches.join(F.broadcast(about.select("query_id", F.col("query").alias("term"))), "term").select("query_id", "chunk_id", F.lit(10.0).alias("whole"))
    names = chunks.select(F.lower("filename").alias("name")).filter("name IS NOT NULL").distinct()
    in_names = term_matches(names.select(F.col("name").alias("chunk_id"), F.col("name").alias("content")), patterns).select(F.col("chunk_id").alias("name"), "term")
    held = in_names.join(F.broadcast(terms), "term").select("query_id", "name")
    if any("" in ts for _, _, ts, _ in asked):  # every name holds an empty term
        held = held.union(names.join(F.broadcast(terms.filter("term = ''")), F.contains("name", "term")).select("query_id", "name"))
    bonus = held.groupBy("query_id", "name").agg((F.count(F.lit(1)) * 2.0).alias("bonus"))
    named = chunks.select("chunk_id", F.lower("filename").alias("name")).join(bonus, "name").select("query_id", "chunk_id", "bonus")
    base = points.join(whole, ["query_id", "chunk_id"], "full_outer").join(named, ["query_id", "chunk_id"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = base.select("query_id", "chunk_id", (zero("points") + F.when(F.col("matched") > 1, F.col("matched") * 1.5).otherwise(0.0) + zero("whole") + zero("bonus")).alias("base"))
    if not any(any(flags.values()) for *_, flags in asked):  # no query that content of a kind adds to
        return scored.select("query_id", "chunk_id", F.col("base").alias("score")).filter("score > 0")
    scored, _ = stored(scored)
    boosted = scored.join(F.broadcast(about.filter("command OR concept OR trouble")), "query_id").filter("base > 2").join(chunks.select("chunk_id", F.lower("content").alias("content")), "chunk_id")
    boosts = boosted.select("query_id", "chunk_id", boost_of(F.col("content"), F.col("query"), F.col("command"), F.col("concept"), F.col("trouble")).alias("boost"))
    return scored.join(boosts, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", (F.col("base") + zero("boost")).alias("score")).filter("score > 0")


def norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def vector_search(chunks: DataFrame, query: list[float], limit: int = 30, least: float = 0.2) -> DataFrame:
    """The ``limit`` chunks (chunk_id, embedding) of largest cosine with ``query`` above ``least``, with score.

    A zero vector has cosine 0; null vectors and those of another length than the query are left out.
    """
    own = float(np.sqrt(np.dot(query, query)))
    literal = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with("embedding", literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    below = norm("embedding") * F.lit(own)
    good = chunks.filter(F.size("embedding") == len(query))
    return good.withColumn("score", F.when(below > 0, dot / below).otherwise(0.0)).filter(F.col("score") > least).orderBy(F.desc("score"), "chunk_id").limit(limit)


def vector_search_batch(chunks: DataFrame, queries: DataFrame, limit: int = 30, least: float = 0.2, block: int = 4096) -> DataFrame:
    """query_id, chunk_id, score and rank for every row of ``queries`` (query_id, vector), by matrix products of batches.

    Queries go through in blocks of ``block`` with vectors of one length, which bounds the broadcast; every batch hands on its own best only.
    """
    kind, query_kind = (d.schema[c].dataType.simpleString() for d, c in ((chunks, "chunk_id"), (queries, "query_id")))
    rows = queries.filter("vector IS NOT NULL").select("query_id", "vector").orderBy(F.size("vector")).toLocalIterator()
    out = None
    spark = chunks.sparkSession
    parts = (part for _, alike in itertools.groupby(rows, key=lambda r: len(r["vector"])) for part in itertools.batched(alike, block))
    for part in parts:
        matrix, ids = np.array([r["vector"] for r in part], float), [r["query_id"] for r in part]
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for frame in frames:
                frame = frame[[e is not None and len(e) == q.shape[1] for e in frame["embedding"]]]
                if not len(frame):
                    continue
                x = np.stack(frame["embedding"].to_numpy()).astype(float)
                size = np.linalg.norm(x, axis=1)
                scores = (x @ q.T) / np.where(size > 0, size, np.inf)[:, None]
                n = min(limit, len(x))
                edge = np.partition(scores, len(x) - n, axis=0)[len(x) - n]
                at, asked = np.nonzero((scores > least) & (scores >= edge))
                yield pd.DataFrame({"query_id": [ids[i] for i in asked], "chunk_id": frame["chunk_id"].to_numpy()[at], "score": scores[at, asked]})

        found = chunks.select("chunk_id", "embedding").mapInPandas(run, f"query_id {query_kind}, chunk_id {kind}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id {query_kind}, chunk_id {kind}, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fuse(keyword: DataFrame, vector: DataFrame, queries: DataFrame, limit: int = 30, k: int | Column = RRF) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists.

    ``keyword`` has query_id, chunk_id, score, rank and content, ``vector`` query_id, chunk_id, score and rank; ``queries`` has query_id
    and query. ``k`` may be a number or, for a constant by intent, a column of ``queries``. Returns query_id, chunk_id, score,
    rank, sources and debug (both scores); ties go to the better keyword rank, then vector rank, then chunk_id.
    """
    q = F.lower("query")
    command = q.rlike(v.FUSION_COMMAND_PATTERN) | contains_any(q, v.FUSION_COMMAND_WORDS)
    shifted = command | contains_any(q, v.FUSION_TECH_WORDS)
    constant = k if isinstance(k, Column) else F.lit(k)
    about = queries.select("query_id", q.alias("q"), command.alias("is_command"), shifted.alias("shifted"), constant.alias("k"))
    left = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"), F.lower("content").alias("content"))
    right = vector.select("query_id", "chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    both = left.join(right, ["query_id", "chunk_id"], "full_outer").join(about, "query_id")
    plus = lambda condition, points: F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    has = lambda *words: contains_any(F.coalesce("content", F.lit("")), words)
    from_keyword = (
        F.lit(1.0) / (F.col("k") + F.col("keyword_rank")) * F.when(F.col("shifted"), 1.5).otherwise(1.0)
        + plus(F.col("keyword_score") > 10, 0.05)
        + plus(F.col("is_command") & has("nv set", "nv show", FENCE), 0.08)
        + plus(F.col("is_command") & F.contains("q", F.lit("mlag")) & has("mlag"), 0.1)
    )
    from_vector = F.lit(1.0) / (F.col("k") + F.col("vector_rank")) * F.when(F.col("shifted"), 0.8).otherwise(1.0) + plus(F.col("vector_score") > 0.85, 0.05)
    fused = both.withColumn("score", F.coalesce(from_keyword, F.lit(0.0)) + F.coalesce(from_vector, F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("keyword_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), "chunk_id")
    sources = F.filter(F.array(F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("vector_rank").isNotNull(), "vector")), lambda s: s.isNotNull())
    ranked = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "chunk_id", "score", "rank", sources.alias("sources"), F.struct("keyword_score", "vector_score").alias("debug"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, limit: int = 30, candidates: int = 60, k: int | Column = RRF) -> DataFrame:
    """Fused search for every row of ``queries`` (query_id, query, vector) over ``chunks`` (chunk_id, content, filename, embedding)."""
    keyword = keyword_search_batch(chunks, queries, candidates).join(chunks.select("chunk_id", "content"), "chunk_id")
    vector = vector_search_batch(chunks, queries, candidates)
    return fuse(keyword, vector, queries, limit, k)


def intent_constant(intent: Column) -> Column:
    """The fusion constant of an intent; a small one favours the tops of the lists."""
    out = F.lit(RRF)
    for name, k in v.FUSION_CONSTANTS.items():
        out = F.when(intent == name, F.lit(k)).otherwise(out)
    return out


def adaptive_threshold(results: DataFrame, base: float = 0.3, of_max: float = 0.85, of_mean: float = 1.5) -> DataFrame:
    """Results (query_id, score, ...) that reach max(base, min(of_max * largest, of_mean * mean)) of their query's scores."""
    own = Window.partitionBy("query_id")
    limit = F.greatest(F.lit(base), F.least(F.max("score").over(own) * of_max, F.avg("score").over(own) * of_mean))
    return results.withColumn("threshold", limit).filter("score >= threshold")


def assemble_context(results: DataFrame, passages: int = 3, cut: int = 200, gate: float = 0.02) -> DataFrame:
    """query_id, context and fallback from ranked results (query_id, rank, score, content).

    The best ``passages`` contents, cut to ``cut`` characters, are numbered and joined; fallback tells that no score exceeds ``gate``.
    """
    top = results.filter(F.col("rank") <= passages)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), F.substring(x["content"], 1, cut)))
    return top.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context"), (F.coalesce(F.max("score"), F.lit(0.0)) <= gate).alias("fallback"))


def retrieval_benchmark(results: DataFrame, golden: DataFrame) -> DataFrame:
    """query_id, kind, found_rank, score and passed of each golden case (query_id, kind, expected, min_rank).

    The first rank whose content holds an expected phrase decides: at min_rank or better the case passes with 1 + 0.5 * (1 -
    rank / min_rank), beyond it it counts a half, and nothing if no result holds a phrase.
    """
    holds = F.exists("expected", lambda e: F.contains(F.lower("content"), F.lower(e)))
    first = results.join(golden.select("query_id", "expected"), "query_id").filter(holds).groupBy("query_id").agg(F.min("rank").alias("found_rank"))
    passed = F.coalesce(F.col("found_rank") <= F.col("min_rank"), F.lit(False))
    score = F.when(F.col("found_rank").isNull(), 0.0).when(passed, 1 + 0.5 * (1 - F.col("found_rank") / F.col("min_rank"))).otherwise(0.5)
    return golden.join(first, "query_id", "left").select("query_id", "kind", "found_rank", score.alias("score"), passed.alias("passed"))


def benchmark_report(cases: DataFrame, kind: str | None = None) -> DataFrame:
    """kind (null: all), cases, passed, pass_rate, total and best possible total of benchmark cases."""
    chosen = cases if kind is None else cases.filter(F.col("kind") == kind)
    return chosen.rollup("kind").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.round(F.sum("score"), 4).alias("total"), (F.count(F.lit(1)) * 1.5).alias("best_total"))

"""Queries on search, fusion, context and query understanding."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import first_of
from ..operators import search as s
from ..operators import understanding as u
from . import binding as b

QUERY = "show thention config onand ther"
TOP = 30


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(b.table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = b.text_chunks(spark, sf_dir).drop("embedding")
    return s.keyword_search(chunks, QUERY, TOP).select("chunk_id", F.round("score", 6).alias("score"))


def keyword_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.keyword_search_batch(b.text_chunks(spark, sf_dir), b.golden_queries(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return s.vector_search(chunks, query_vector(spark, sf_dir), TOP).select("chunk_id", F.round("score", 6).alias("score"))


def vector_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = chunks.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return s.vector_search_batch(chunks, asked, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def golden_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return b.golden_queries(spark, sf_dir).join(vectors, "query_id")


def fused(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    return s.hybrid_search(b.text_chunks(spark, sf_dir), golden_with_vectors(spark, sf_dir), limit, candidates=30)


def hybrid_search_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fused(spark, sf_dir)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), F.array_join("sources", "+").alias("sources"))


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fused(spark, sf_dir).join(b.text_chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    return s.assemble_context(found)


def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.vector_search_batch(b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), golden_with_vectors(spark, sf_dir), 10)
    return s.adaptive_threshold(found, 0.25).select("query_id", "chunk_id", F.round("threshold", 5).alias("threshold"))


def golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as golden cases: a result must hold the item's text, or its first 60 characters."""
    items = b.table(spark, sf_dir, "benchmark")
    kind = F.when(F.col("item_id") % 2 == 0, "command").otherwise("concept")
    return items.select(F.col("item_id").alias("query_id"), kind.alias("kind"), F.array("text", F.substring("text", 1, 60)).alias("expected"), (F.col("item_id") % 5 + 1).alias("min_rank"))


def retrieval_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = b.text_chunks(spark, sf_dir)
    found = s.keyword_search_batch(chunks, b.golden_queries(spark, sf_dir), 20).join(chunks.select("chunk_id", "content"), "chunk_id")
    return s.benchmark_report(s.retrieval_benchmark(found, golden_cases(spark, sf_dir)))


def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = u.query_intent(b.user_queries(spark, sf_dir))
    return found.select("query_id", "intent", F.round("confidence", 6).alias("confidence"), F.array_join("sub_intents", ",").alias("sub_intents"), "has_error", "has_command", "has_parameter", "complexity")


def intent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy against a plain rule: the intent of the first keyword list that fits."""
    q = F.lower("query")
    expected = first_of([(name, reduce(lambda a, w: a | F.contains(q, F.lit(w)), words, F.lit(False))) for name, _, words, _ in v.INTENTS], "general")
    found = u.query_intent(b.user_queries(spark, sf_dir)).withColumns({"expected_intent": expected, "category": F.when(F.length("query") > 200, "long").otherwise("short")})
    return u.intent_accuracy(found)


def intent_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = u.retrieval_parameters(u.query_intent(b.user_queries(spark, sf_dir))).withColumn("fusion_constant", s.intent_constant(F.col("intent")))
    return found.groupBy("intent", "retrieve_limit", "rerank_candidates", "min_score", "fusion_constant").agg(F.count(F.lit(1)).alias("n"))


def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = u.query_keywords(b.user_queries(spark, sf_dir))
    return found.select("query_id", F.size("addresses").alias("n_addresses"), F.array_join("keywords", " ").alias("keywords"), "coarse_intent")


def query_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = u.query_keywords(b.user_queries(spark, sf_dir))
    return found.select("query_id", F.array_join(F.transform("commands", lambda c: F.concat_ws(" ", c["command"], c["action"], c["target"])), ",").alias("commands"), F.array_join(F.transform("groups", lambda g: g["type"]), ",").alias("groups"))


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.expanded_query(b.user_queries(spark, sf_dir)).select("query_id", "routed", "enhanced", "domain_intent")


QUERIES = {
    f.__name__: f
    for f in (
        keyword_search, keyword_search_batch, vector_search, vector_search_batch, hybrid_search_rrf, context_assembly, adaptive_threshold, retrieval_benchmark, query_intent, intent_accuracy, intent_parameters, query_keywords,
        query_commands, query_expansion,
    )
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(w)})" for w in words) + ")"


def _count(column: str, term: str) -> str:
    return f"((length({column}) - length(replace({column}, {term}, ''))) // length({term}))"


def _keyword_sql() -> str:
    terms = s.expanded_terms(QUERY)
    parts, matched, named = [], [], []
    for term in terms:
        n = _count("t", _text(term))
        parts.append(f"CASE WHEN {n} > 0 THEN (1 + ln({n})) * {3 if term.isascii() and term.isalnum() else 1} ELSE 0 END")
        matched.append(f"contains(t, {_text(term)})::INT")
        named.append(f"2.0 * contains(lower(source), {_text(term)})::INT")
    commands = f"({_any('t', v.COMMAND_CONTENT)} OR regexp_matches(t, {_text(v.COMMAND_CONTENT_PATTERN)}) OR contains(t, '```'))"
    return f"""WITH scored AS (
        SELECT doc_id, t, {' + '.join(named)} + {' + '.join(parts)} + CASE WHEN contains(t, {_text(QUERY)}) THEN 10 ELSE 0 END AS points, {' + '.join(matched)} AS matched
        FROM (SELECT doc_id, source, lower(text) AS t FROM documents)),
      based AS (SELECT *, points + CASE WHEN matched > 1 THEN 1.5 * matched ELSE 0 END AS base FROM scored),
      boosted AS (SELECT doc_id, base + CASE WHEN base > 2 AND {commands} THEN 10 + 5 * contains(t, 'show')::INT + 5 * (contains(t, 'config') OR contains(t, 'nv set'))::INT ELSE 0 END AS score FROM based)
      SELECT doc_id AS chunk_id, round(score, 6) AS score FROM boosted WHERE score > 0 ORDER BY boosted.score DESC, doc_id LIMIT {TOP}"""


_GOLDEN = """golden AS (
      SELECT item_id AS query_id, text AS item_text, array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: {'size': -length(w), 'word': w}))[1:3], lambda x: x.word), ' ') AS query FROM benchmark)"""


def _batch_sql(limit: int) -> str:
    """Keyword scores of the golden queries: their words have no expansions, as none holds a vocabulary key, but may ask for a kind."""
    keys = "[" + ", ".join("{'key': %s, 'words': [%s]}" % (_text(k), ", ".join(map(_text, ws))) for k, ws in v.EXPANSIONS.items()) + "]"
    command = f"({_any('query', v.COMMAND_WORDS)} OR regexp_matches(query, {_text(v.COMMAND_PATTERN)}))"
    commands = f"({_any('t', v.COMMAND_CONTENT)} OR regexp_matches(t, {_text(v.COMMAND_CONTENT_PATTERN)}) OR contains(t, '```'))"
    boost = f"""CASE WHEN base > 2 THEN
          CASE WHEN {command} AND {commands} THEN 10 + 5 * (contains(query, 'show') AND contains(t, 'show'))::INT + 5 * (contains(query, 'config') AND (contains(t, 'config') OR contains(t, 'nv set')))::INT
             + 8 * (contains(query, 'set') AND contains(t, 'nv set'))::INT ELSE 0 END
          + CASE WHEN {_any('query', v.CONCEPT_WORDS)} THEN 15 * regexp_matches(t, {_text(v.CONCEPT_CONTENT_PATTERN)})::INT + 10 * starts_with(t, '#')::INT ELSE 0 END
          + CASE WHEN {_any('query', v.TROUBLE_WORDS)} THEN 15 * {_any('t', v.TROUBLE_CONTENT)}::INT ELSE 0 END ELSE 0 END"""
    return f"""{_GOLDEN}, tokens AS (SELECT query_id, query, list_filter(string_split(query, ' '), lambda w: length(w) >= 2) AS tokens FROM golden),
      terms AS (SELECT query_id, query, unnest(list_distinct(list_concat(tokens, flatten(list_transform(list_filter({keys}, lambda k: len(list_filter(tokens, lambda w: contains(w, k.key))) > 0), lambda k: k.words))))) AS term FROM tokens),
      docs AS (SELECT doc_id, lower(text) AS t, lower(source) AS name FROM documents),
      hits AS (SELECT query_id, query, doc_id, any_value(t) AS t, sum(CASE WHEN contains(t, term) THEN (1 + ln({_count('t', 'term')})) * CASE WHEN regexp_full_match(term, '[a-z0-9]+') THEN 3 ELSE 1 END ELSE 0 END) AS points,
        sum(contains(t, term)::INT) AS matched, sum(2.0 * contains(name, term)::INT) AS named FROM terms JOIN docs ON contains(t, term) OR contains(name, term) GROUP BY ALL),
      based AS (SELECT *, points + named + CASE WHEN matched > 1 THEN 1.5 * matched ELSE 0 END + CASE WHEN contains(t, query) THEN 10 ELSE 0 END AS base FROM hits),
      keyword AS (SELECT query_id, query, doc_id, t, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT *, base + {boost} AS score FROM based) WHERE score > 0 QUALIFY rank <= {limit})"""


def _vector_sql(limit: int, asked: str, rows: str = "embeddings") -> str:
    return f"""asked AS ({asked}),
      vector AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
        SELECT a.query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], a.v) AS score FROM asked a, {rows} e) WHERE score > 0.2 QUALIFY rank <= {limit})"""


_GOLDEN_VECTORS = "SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id"


def _fused_sql(limit: int) -> str:
    command = f"(regexp_matches(query, {_text(v.FUSION_COMMAND_PATTERN)}) OR {_any('query', v.FUSION_COMMAND_WORDS)})"
    return f"""WITH {_batch_sql(30)}, {_vector_sql(30, _GOLDEN_VECTORS, "(SELECT vec_id, embedding FROM embeddings JOIN documents ON doc_id = vec_id)")},
      flags AS (SELECT query_id, {command} AS is_command, {command} OR {_any('query', v.FUSION_TECH_WORDS)} AS shifted FROM golden),
      pairs AS (SELECT coalesce(k.query_id, x.query_id) AS query_id, coalesce(k.doc_id, x.vec_id) AS chunk_id, k.score AS ks, k.rank AS kr, k.t, x.score AS vs, x.rank AS vr
        FROM (SELECT * FROM keyword WHERE query_id IN (SELECT query_id FROM asked)) k FULL JOIN vector x ON x.query_id = k.query_id AND x.vec_id = k.doc_id),
      summed AS (SELECT p.*, coalesce(1.0 / (60 + kr) * CASE WHEN shifted THEN 1.5 ELSE 1 END + CASE WHEN ks > 10 THEN 0.05 ELSE 0 END + CASE WHEN is_command AND (contains(t, 'nv set') OR contains(t, 'nv show') OR contains(t, '```')) THEN 0.08 ELSE 0 END, 0)
          + coalesce(1.0 / (60 + vr) * CASE WHEN shifted THEN 0.8 ELSE 1 END + CASE WHEN vs > 0.85 THEN 0.05 ELSE 0 END, 0) AS score FROM pairs p JOIN flags USING (query_id)),
      fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, kr NULLS LAST, vr NULLS LAST, chunk_id) AS rank FROM summed QUALIFY rank <= {limit})"""


def _list(words) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def _distinct(items: str) -> str:
    """A list's items, each once, where it comes first."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def _keyword_parts_sql() -> str:
    """What is found in each user turn: addresses, commands, groups with their words, and basic keywords."""
    octet = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    address = rf"(?:{octet}\.){{3}}{octet}"
    spelled = lambda words: "\\b(?i:" + "|".join(re.escape(w) for w in words) + ")\\b"
    first = lambda rules, other: "CASE " + " ".join(f"WHEN {_any('q', words)} THEN '{name}'" for name, words in rules) + f" ELSE '{other}' END"
    all_of = lambda pattern, column="text": f"regexp_extract_all({column}, {_text(pattern)})"
    groups = ", ".join(f"{{'type': '{name}', 'elements': {_distinct('g_' + name)}}}" for name in v.SEMANTIC_GROUPS)
    found_groups = ", ".join(f"list_transform({all_of(spelled(words))}, lambda x: lower(x)) AS g_{name}" for name, words in v.SEMANTIC_GROUPS.items())
    return f"""WITH asked AS (SELECT conv_id || '-' || turn AS query_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS q FROM conversations WHERE role = 'user'),
      plain AS (SELECT *, trim(regexp_replace(regexp_replace(text, '[，。！？；："''（）【】《》]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain, {found_groups},
        {all_of(rf"\b{address}/\d{{1,2}}\b")} AS nets, {all_of(rf"\b{address}\b")} AS singles, {all_of(rf"\b{address}\s*-\s*{address}\b")} AS ranges,
        list_transform({all_of(spelled(v.COMMANDS))}, lambda x: lower(x)) AS commands, {first(v.ACTIONS, "show")} AS action, {first(v.TARGETS, "general")} AS target FROM asked),
      listed AS (SELECT *, list_concat({_distinct("nets")}, list_filter({_distinct("singles")}, lambda x: NOT contains(text, x || '/')), {_distinct("ranges")}) AS addresses,
        list_filter([{groups}], lambda g: len(g.elements) > 0) AS groups,
        list_concat({all_of(r"\b[A-Z]{2,}\b", "plain")}, {all_of(r"\b[A-Z][a-z]+\b", "plain")}, {all_of(r"\b(?:[A-Z]+[a-z]*|[a-z]+[A-Z]+)\d*\b", "plain")}) AS named,
        list_filter(regexp_split_to_array(regexp_replace(lower(plain), '[^一-龥a-zA-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2 AND NOT list_contains({_list(v.STOP_WORDS)}, w)) AS words FROM plain),
      found AS (SELECT *, list_concat(list_transform(named, lambda x: lower(x)), words, addresses, commands, flatten(list_transform(groups, lambda g: g.elements))) AS every FROM listed)"""


_COARSE_INTENT = f"""CASE WHEN len(addresses) > 0 AND len(commands) > 0 THEN 'network_config' WHEN len(commands) > 0 OR {_any("q", ("命令", "command"))} THEN 'command_reference'
      WHEN {_any("q", ("问题", "故障", "error", "失败"))} THEN 'troubleshooting'
      WHEN list_has_any(list_transform(groups, lambda g: g.type), ['network_config', 'access_control']) THEN 'network_config' ELSE 'general' END"""


def _expansion_sql() -> str:
    """Each user turn with its domain terms, and the words that they and its own keywords add."""
    held = lambda words: f"list_filter({_list(words)}, lambda w: contains(q, w))"
    adds = lambda condition, words: f"CASE WHEN {condition} THEN {_list(words)} ELSE [] END"
    acl = f"CASE WHEN {_any('q', ('acl', 'access control list'))} THEN ['acl', 'access control list'] ELSE [] END"
    flags = ", ".join(f"list_has_any(tech, {_list(words)}) AS {name}" for name, words in v.DOMAIN_FLAGS)
    domain = ", ".join(
        [
            *(adds(flag, words) for flag, words in v.DOMAIN_ADDS),
            adds("list_has_any(tech, ['acl', 'access control list'])", v.ACL_ADDS),
            adds("has_qos OR has_pfc OR has_ecn OR has_roce", v.QOS_ADDS),
            adds("list_contains(vendors, 'nvidia')", v.VENDOR_ADDS),
            _list(v.ALWAYS_ADDS),
            adds("domain_intent = 'network_config'", v.CONFIG_ADDS),
            "CASE WHEN len(own) > 0 THEN own ELSE keywords END",
        ]
    )
    return f"""{_keyword_parts_sql()},
      terms AS (SELECT *, {_distinct("every")} AS keywords, list_concat({", ".join(map(held, v.DOMAIN_TERMS.values()))}, {acl}) AS tech_rows, {held(v.VENDORS)} AS vendors, {held(v.CONFIG_TERMS)} AS config,
        list_filter(regexp_extract_all(text, '[一-龥]+'), lambda w: length(w) >= 2 AND NOT list_contains({_list(v.DOMAIN_STOP_WORDS)}, w)) AS cjk, list_filter(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: length(w) >= 2) AS latin FROM found),
      tech AS (SELECT *, {_distinct("tech_rows")} AS tech, list_concat(tech_rows, vendors, config, cjk, latin) AS own_rows FROM terms),
      flagged AS (SELECT *, {_distinct("own_rows")} AS own, {flags}, CASE WHEN len(tech) > 0 AND len(config) > 0 THEN 'network_config' WHEN len(tech) > 0 THEN 'tech_reference'
        WHEN len(vendors) > 0 THEN 'vendor_specific' ELSE 'general' END AS domain_intent FROM tech),
      added AS (SELECT *, list_concat({domain}) AS domain_rows, {_any("q", v.ROUTING_WORDS)} AS routed,
        list_concat(addresses, list_transform(commands, lambda c: c || ' ' || action), flatten(list_transform(groups, lambda g: g.elements)), keywords) AS general FROM flagged)"""


def _intent_sql() -> str:
    """The intent scores from the same fixed values."""
    context = "CASE " + " ".join(f"WHEN regexp_matches(recent, {_text(p)}) THEN {_text(n)}" for n, p in v.CONTEXT_INTENTS) + " END"
    rows = []
    for place, (name, weight, words, patterns) in enumerate(v.INTENTS):
        hits = " + ".join(f"regexp_matches(q, {_text(p)})::INT" for p in patterns)
        keywords = " + ".join(f"contains(q, {_text(w)})::INT" for w in words)
        own = f"(({keywords}) * 0.3::DOUBLE + ({hits}) * 0.5::DOUBLE) * {weight}::DOUBLE"
        rows.append(f"SELECT query_id, {place} AS place, {_text(name)} AS name, round({own} + CASE WHEN {own} > 0 AND context = {_text(name)} THEN 0.2 ELSE 0 END, 9) AS score FROM told")
    return f"""WITH turns AS (
        SELECT conv_id || '-' || turn AS query_id, role, text, lower(text) AS q, coalesce(lag(text, 2) OVER w || ' ', '') || coalesce(lag(text, 1) OVER w, '') AS recent_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      told AS (SELECT *, {context} AS context FROM (SELECT *, lower(recent_text) AS recent FROM turns WHERE role = 'user')),
      scores AS ({' UNION ALL '.join(rows)}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS r, max(score) OVER (PARTITION BY query_id) AS top FROM scores WHERE score > 0),
      best AS (SELECT query_id, max(name) FILTER (r = 1) AS intent, least(1.0, max(top) / greatest(max(top), 1.0)) AS confidence, coalesce(string_agg(name, ',' ORDER BY r) FILTER (r IN (2, 3) AND score > top * 0.6), '') AS sub_intents FROM ranked GROUP BY 1),
      intents AS (SELECT t.query_id, t.text, t.q, coalesce(b.intent, 'general') AS intent, coalesce(b.confidence, 0.5) AS confidence, coalesce(b.sub_intents, '') AS sub_intents,
        (length(text) > 50)::INT + (len(regexp_split_to_array(text, '\\s+')) > 10)::INT + regexp_matches(text, {_text(v.CONDITION_PATTERN)})::INT + regexp_matches(text, {_text(v.PARAMETER_PATTERN)})::INT AS points FROM told t LEFT JOIN best b USING (query_id))"""


_EXPECTED = "CASE " + " ".join(f"WHEN {_any('q', words)} THEN {_text(name)}" for name, _, words, _ in v.INTENTS) + " ELSE 'general' END"
_PARAMETERS = ", ".join(f"({_text(n)}, {a}, {c}, {least}, {v.FUSION_CONSTANTS.get(n, 60)})" for n, (a, c, least) in v.RETRIEVAL.items())

SQL = {
    "keyword_search": _keyword_sql(),
    "keyword_search_batch": f"WITH {_batch_sql(10)} SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, rank FROM keyword",
    "vector_search": "SELECT vec_id AS chunk_id, round(score, 6) AS score FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE score > 0.2 ORDER BY score DESC, vec_id LIMIT 30",
    "vector_search_batch": f"WITH {_vector_sql(10, 'SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0')} SELECT query_id, vec_id AS chunk_id, round(score, 6) AS score, rank FROM vector",
    "hybrid_search_rrf": f"{_fused_sql(10)} SELECT query_id, chunk_id, rank, round(score, 6) AS score, concat_ws('+', CASE WHEN kr IS NOT NULL THEN 'keyword' END, CASE WHEN vr IS NOT NULL THEN 'vector' END) AS sources FROM fused",
    "context_assembly": f"{_fused_sql(10)} SELECT query_id, string_agg('[' || rank || '] ' || substr(text, 1, 200), chr(10) ORDER BY rank) AS context, max(score) <= 0.02 AS fallback FROM fused JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY 1",
    "adaptive_threshold": f"WITH {_vector_sql(10, _GOLDEN_VECTORS)} SELECT query_id, chunk_id, round(threshold, 5) AS threshold FROM (SELECT query_id, vec_id AS chunk_id, score, greatest(0.25, least(max(score) OVER (PARTITION BY query_id) * 0.85, avg(score) OVER (PARTITION BY query_id) * 1.5)) AS threshold FROM vector) WHERE score >= threshold",
    "retrieval_benchmark": f"""WITH {_batch_sql(20)},
      firsts AS (SELECT k.query_id, min(k.rank) AS found_rank FROM keyword k JOIN benchmark b ON b.item_id = k.query_id WHERE contains(k.t, lower(b.text)) OR contains(k.t, lower(substr(b.text, 1, 60))) GROUP BY 1),
      cases AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'command' ELSE 'concept' END AS kind, found_rank, item_id % 5 + 1 AS min_rank FROM benchmark b LEFT JOIN firsts f ON f.query_id = b.item_id),
      scored AS (SELECT kind, CASE WHEN found_rank IS NULL THEN 0 WHEN found_rank <= min_rank THEN 1 + 0.5::DOUBLE * (1 - found_rank::DOUBLE / min_rank) ELSE 0.5 END AS score, coalesce(found_rank <= min_rank, false) AS passed FROM cases)
      SELECT kind, count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 4) AS pass_rate, round(sum(score), 4) AS total, count(*) * 1.5 AS best_total FROM scored GROUP BY ROLLUP (kind)""",
    "query_intent": f"""{_intent_sql()} SELECT query_id, intent, round(confidence, 6) AS confidence, sub_intents, regexp_matches(q, {_text(v.ERROR_PATTERN)}) AS has_error, regexp_matches(q, {_text(v.COMMAND_HINT_PATTERN)}) AS has_command,
      regexp_matches(text, {_text(v.PARAMETER_PATTERN)}) AS has_parameter, CASE WHEN points >= 3 THEN 'complex' WHEN points >= 1 THEN 'medium' ELSE 'simple' END AS complexity FROM intents""",
    "intent_accuracy": f"""{_intent_sql()}, judged AS (SELECT CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS category, (intent = {_EXPECTED})::INT AS hit FROM intents)
      SELECT category, count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 4) AS accuracy, round(avg(hit), 4) >= 0.8 AS passed FROM judged GROUP BY ROLLUP (category)""",
    "intent_parameters": f"""{_intent_sql()} SELECT intent, p.a AS retrieve_limit, p.c AS rerank_candidates, round(p.least::DOUBLE + CASE WHEN confidence < 0.5 THEN -0.05 WHEN confidence > 0.8 THEN 0.05 ELSE 0 END, 4) AS min_score, p.k AS fusion_constant, count(*) AS n
      FROM intents JOIN (VALUES {_PARAMETERS}) p(name, a, c, least, k) ON p.name = intent GROUP BY ALL""",
    "query_keywords": f"""{_keyword_parts_sql()} SELECT query_id, len(addresses)::INT AS n_addresses, array_to_string({_distinct("every")}, ' ') AS keywords, {_COARSE_INTENT} AS coarse_intent FROM found""",
    "query_commands": f"""{_keyword_parts_sql()} SELECT query_id, array_to_string(list_transform(commands, lambda c: c || ' ' || action || ' ' || target), ',') AS commands,
      array_to_string(list_transform(groups, lambda g: g.type), ',') AS groups FROM found""",
    "query_expansion": f"""{_expansion_sql()} SELECT query_id, routed, array_to_string(CASE WHEN routed THEN {_distinct("domain_rows")} ELSE general END, ' ') AS enhanced, domain_intent FROM added""",
}

"""Queries on conversations, retention, tenants and answer audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversations as c
from ..operators.grounding import answer_grounding as audit
from . import binding as b

TENANT = "7"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations named by their first turn's start; every tenth is starred; the last turn is their time."""
    turns = b.messages(spark, sf_dir)
    firsts = turns.groupBy("conversation_id").agg(F.min_by("content", "created_at").alias("first"), F.max("created_at").alias("updated_at"))
    star = F.when(F.col("conversation_id") % 10 == 0, "⭐ ").otherwise("")
    return firsts.select(F.col("conversation_id").alias("id"), F.concat(star, F.substring("first", 1, 60)).alias("title"), "updated_at")


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.conversation_list(titled(spark, sf_dir), b.messages(spark, sf_dir), "the ").select("id", "title", "updated_at")


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy hits of a word that no title need hold exactly."""
    return titled(spark, sf_dir).filter(c.fuzzy_match(F.col("title"), "thention")).select("id")


def starred_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.conversation_list(titled(spark, sf_dir), b.messages(spark, sf_dir), favourites=True).select("id")


def conversation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.previews(b.messages(spark, sf_dir))


def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.rolling_context(b.messages(spark, sf_dir), 3)
    return found.select("id", F.size("context").alias("n_turns"), F.aggregate("context", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("n_chars"))


def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.tenant_tables(spark, sf_dir)
    conversations, messages = c.retain(t["conversations"], t["messages"], keep=5)
    kept = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return conversations.join(kept, F.col("id") == F.col("conversation_id"), "left").select("id", "user_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def tenant_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.manifest(c.tenant_rows(TENANT, **b.tenant_tables(spark, sf_dir)))


def tenant_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.manifest(c.purge(TENANT, **b.tenant_tables(spark, sf_dir)))


def tenant_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations after a purge and the restore of what was saved before: all as they were."""
    t = b.tenant_tables(spark, sf_dir)
    return c.restore(TENANT, t, c.tenant_rows(TENANT, **t))["conversations"].select("id", "user_id")


def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = c.rolling_context(b.messages(spark, sf_dir), 10).filter("role = 'assistant'")
    found = audit(turns.select("id", F.col("content").alias("answer"), F.col("context").alias("references")))
    return found.select("id", "n_sentences", F.size("missing_sentences").alias("n_missing"), F.size("suspicious_commands").alias("n_suspicious"), F.round("confidence", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (conversation_list, conversation_search, starred_conversations, conversation_preview, rolling_context, retention_sweep, tenant_export, tenant_purge, tenant_restore, answer_grounding)}

_TITLED = """titled AS (SELECT conv_id AS id, CASE WHEN conv_id % 10 = 0 THEN '⭐ ' ELSE '' END || substr(arg_min(text, turn), 1, 60) AS title, max(turn) AS updated_at FROM conversations GROUP BY conv_id)"""
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '[代码]', 'g'), '`[^`]+`', '[代码]', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '[#*_~]', '', 'g'), '<[^>]+>', '', 'g'))"
_SPLIT = r"list_filter(regexp_split_to_array(text, '[。！？\n]'), lambda s: length(s) > 10)"

SQL = {
    "conversation_list": f"WITH {_TITLED} SELECT id, title, updated_at FROM titled WHERE contains(lower(title), 'the ') OR list_bool_and([contains(lower(title), c) FOR c IN ['t', 'h', 'e']]) AND len(list_filter(range(1, length(title) - 2), lambda i: levenshtein('the ', substr(lower(title), i, 4)) <= 1)) > 0",
    "conversation_search": f"WITH {_TITLED} SELECT id FROM titled WHERE contains(lower(title), 'thention') OR list_bool_and([contains(lower(title), c) FOR c IN ['t', 'h', 'e', 'n', 'i', 'o']]) AND (len(list_filter(range(1, length(title) - 6), lambda i: levenshtein('thention', substr(lower(title), i, 8)) <= 2)) > 0 OR length(title) <= 16 AND levenshtein('thention', lower(title)) <= 3)",
    "starred_conversations": "SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id % 10 = 0",
    "conversation_preview": f"""SELECT conv_id AS conversation_id, string_agg(CASE WHEN role = 'user' THEN '你' ELSE 'AI' END || ': ' || CASE WHEN length(clean) > 80 THEN substr(clean, 1, 80) || '...' ELSE clean END, ' | ' ORDER BY turn) AS preview
      FROM (SELECT *, {_CLEAN} AS clean FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY 1""",
    "rolling_context": "SELECT conv_id || '-' || turn AS id, count(*) OVER w AS n_turns, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    "retention_sweep": "SELECT o.o_orderkey AS id, o.o_custkey::VARCHAR AS user_id, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_messages FROM orders o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5",
    "tenant_export": f"""SELECT 'conversations' AS entity, count(*) AS n FROM orders WHERE o_custkey = {TENANT} UNION ALL SELECT 'messages', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = {TENANT})
      UNION ALL SELECT 'documents', count(*) FROM supplier WHERE s_nationkey = {TENANT} UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = {TENANT})""",
    "tenant_purge": f"""SELECT 'conversations' AS entity, count(*) AS n FROM orders WHERE o_custkey <> {TENANT} UNION ALL SELECT 'messages', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey <> {TENANT})
      UNION ALL SELECT 'documents', count(*) FROM supplier WHERE s_nationkey <> {TENANT} UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> {TENANT})""",
    "tenant_restore": "SELECT o_orderkey AS id, o_custkey::VARCHAR AS user_id FROM orders",
    "answer_grounding": f"""WITH turns AS (SELECT conv_id || '-' || turn AS id, role, text, lower(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '')) AS known FROM conversations),
      sentences AS (SELECT id, known, unnest({_SPLIT}) AS s FROM turns WHERE role = 'assistant'),
      judged AS (SELECT id, count(*) AS n, count(*) FILTER (len(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda w: length(w) > 2 AND contains(known, w))) = 0) AS missing FROM sentences GROUP BY 1)
      SELECT t.id, coalesce(n, 0) AS n_sentences, coalesce(missing, 0) AS n_missing, 0 AS n_suspicious, round(greatest(0, 1 - coalesce(missing, 0) / greatest(coalesce(n, 0), 1)), 6) AS confidence FROM turns t LEFT JOIN judged USING (id) WHERE t.role = 'assistant'""",
}

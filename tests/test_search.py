import math

from pyspark.sql import functions as F

from quern.operators import search as s

CHUNKS = [
    (1, "nv set mlag bond one\n```nv set```", "mlag guide", [1.0, 0.0]),
    (2, "MLAG is a kind of link aggregation", "other", [0.8, 0.6]),
    (3, "unrelated words", None, [0.0, 1.0]),
    (4, "error: link down, debug it", "mlag faults", [0.0, 0.0]),
    (5, None, "x", None),
]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id int, content string, filename string, embedding array<float>").withColumn("content", F.coalesce("content", F.lit("")))


def by_hand(query, content, name):
    terms, flags = s.expanded_terms(query), s.query_flags(query)
    t, q = content.lower(), query.lower()
    score = sum(2 for w in terms if w in (name or "").lower()) + 10 * (q in t)
    hits = [w for w in terms if w in t]
    score += sum((1 + math.log(t.count(w))) * (3 if w.isascii() and w.isalnum() else 1) for w in hits) + (1.5 * len(hits) if len(hits) > 1 else 0)
    if score > 2:
        if flags["command"] and (any(w in t for w in ("nv config", "nv show", "nv set")) or "```" in t):
            score += 10 + 5 * (("show" in q or "显示" in q) and "show" in t) + 5 * (("config" in q or "配置" in q) and ("config" in t or "nv set" in t)) + 8 * ("set" in q and "nv set" in t) + 15 * ("mlag" in q and "nv set" in t and ("mlag" in t or "bond" in t))
        if flags["concept"]:
            score += 15 * (" is a " in t) + 10 * t.startswith("#")
        if flags["trouble"]:
            score += 15 * any(w in t for w in ("error", "fail", "down", "drop", "debug", "log", "problem", "issue"))
    return score


def test_tokens_and_expansion():
    assert s.query_tokens("MLAG 是 a swp1!") == ["mlag", "是", "swp1"]
    assert "clag" in s.expanded_terms("mlag") and "config" in s.expanded_terms("怎样配置它")


def test_expansion_table_is_whole():
    assert {"save", "write", "commit", "store"} < set(s.expanded_terms("保存"))
    assert {"1588", "trap", "relay", "passwd", "syslog", "reload"} < set(s.expanded_terms("ptp snmp dhcp 密码 日志 重启"))


def test_keyword_scores_match_the_formula_for_one_query_and_for_tables(spark):
    for query in ("nv set mlag", "what is mlag", "mlag error fix", "配置 mlag"):
        want = {i: by_hand(query, t or "", n) for i, t, n, _ in CHUNKS}
        want = {i: round(v, 6) for i, v in want.items() if v > 0}
        one = {r.chunk_id: round(r.score, 6) for r in s.keyword_search(chunks(spark), query).collect()}
        many = {r.chunk_id: round(r.score, 6) for r in s.keyword_search_batch(chunks(spark), spark.createDataFrame([(7, query)], "query_id int, query string")).collect()}
        assert one == want and many == want


def test_fewer_results_are_a_prefix(spark):
    few, more = ([r.chunk_id for r in s.keyword_search(chunks(spark), "mlag link", n).collect()] for n in (2, 3))
    assert more[:2] == few


def test_vector_search_is_strict_and_skips_bad_vectors(spark):
    found = {r.chunk_id: r.score for r in s.vector_search(chunks(spark), [1.0, 0.0]).collect()}
    assert set(found) == {1, 2} and abs(found[2] - 0.8) < 1e-6
    batch = s.vector_search_batch(chunks(spark), spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id int, vector array<double>")).collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in sorted(batch, key=lambda r: r["rank"])] == [(9, 1, 1), (9, 2, 2)]
    assert s.vector_search_batch(chunks(spark), spark.createDataFrame([], "query_id int, vector array<double>")).count() == 0


def test_fusion_weights_bonuses_and_ties(spark):
    keyword = spark.createDataFrame([(1, "a", 10.1, 1, "nv set mlag"), (1, "b", 10.0, 2, "plain")], "query_id int, chunk_id string, score double, rank int, content string")
    vector = spark.createDataFrame([(1, "b", 0.86, 1), (1, "c", 0.85, 2)], "query_id int, chunk_id string, score double, rank int")
    queries = spark.createDataFrame([(1, "config mlag")], "query_id int, query string")
    rows = {r.chunk_id: r for r in s.fuse(keyword, vector, queries).collect()}
    assert abs(rows["a"].score - (1.5 / 61 + 0.05 + 0.08 + 0.1)) < 1e-12 and rows["a"].sources == ["keyword"]
    assert abs(rows["b"].score - (1.5 / 62 + 0.8 / 61 + 0.05)) < 1e-12 and rows["b"].sources == ["keyword", "vector"]
    assert abs(rows["c"].score - 0.8 / 62) < 1e-12
    tied = s.fuse(keyword.limit(0), spark.createDataFrame([(1, "y", 0.5, 1), (1, "x", 0.5, 1)], vector.schema), queries).orderBy("rank").collect()
    assert [r.chunk_id for r in tied] == ["x", "y"]


def test_threshold_context_and_benchmark(spark):
    results = spark.createDataFrame([(1, 1, 1.0, "First " * 50), (1, 2, 0.5, "beta"), (2, 1, 0.01, "gamma")], "query_id int, rank int, score double, content string")
    assert [r["rank"] for r in s.adaptive_threshold(results.filter("query_id = 1")).collect()] == [1]
    context = {r.query_id: r for r in s.assemble_context(results).collect()}
    assert context[1].context == "[1] " + ("First " * 50)[:200] + "\n[2] beta" and not context[1].fallback and context[2].fallback
    golden = spark.createDataFrame([(1, "a", ["BETA"], 4), (2, "a", ["gamma"], 1), (3, "b", ["none"], 1)], "query_id int, kind string, expected array<string>, min_rank int")
    cases = s.retrieval_benchmark(results, golden)
    assert {r.query_id: r.score for r in cases.collect()} == {1: 1.25, 2: 1.0, 3: 0.0}
    assert {r.kind: (r.cases, r.passed) for r in s.benchmark_report(cases).collect()} == {None: (3, 2), "a": (2, 2), "b": (1, 0)}

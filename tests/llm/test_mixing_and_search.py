"""Mixing against its SQL and its promises, nearest vectors against exact search, the pipeline against its parts."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, nearest, oracles
from quern.llm.queries import quality_weights


def test_mix_matches_sql(spark, docs, corpus):
    documents = pd.DataFrame(corpus, columns=["doc_id", "text", "source"])
    labels = pd.DataFrame({"doc_id": [1, 2, 2, 3, 500], "quality": [1, 0, 1, None, 1], "toxic": 0})
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", labels)
    want = sorted(con.execute(oracles.OP10_MIXING).fetchall())
    spark_labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (500, 1)], "doc_id long, quality int")
    for bins in (4096, 5):
        got = sorted(tuple(r) for r in mixing.mix_sources(docs, quality=quality_weights(spark_labels), rows_per_bin=bins).collect())
        assert got == [pytest.approx(w) for w in want]


def test_mix_promises(docs):
    rows = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 + 1e-9 and r.over <= 0 and r.target <= 2 * r["size"] for r in rows)
    assert sum(r.target for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_weighted_sampling_prefers_good_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix_sources(docs, share=0.5, quality=docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0).alias("weight"))).collect()
    good, poor = (sum(r.taken > 0 for r in rows if r.doc_id % 2 == p) for p in (0, 1))
    # keys below t: 1 - exp(-3t) against 1 - exp(-t), half of all together
    assert abs(good / 2000 - 0.682) < 0.04 and abs(poor / 2000 - 0.318) < 0.04


def test_mix_odd_tables(spark):
    schema = "doc_id long, text string, source string, size int, key int, bin int, weight string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "a", 1, 1, 1, ""), (2, "", None, 1, 1, 1, ""), (None, "x y", "b", 1, 1, 1, ""), (3, "x", "b", 1, 1, 1, ""), (3, "x", "b", 1, 1, 1, "")]
    found = mixing.mix_sources(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 5 and sum(r.taken for r in found) == 6


def vectors():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 32))
    x = (centres[rng.integers(0, 6, 3000)] * 0.4 + rng.standard_normal((3000, 32))).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_ranks_and_scores(spark):
    x = vectors()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = nearest.nearest_vectors(table, every=100, block_rows=1000, least=150).collect()
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -9)
    found: dict = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12
    assert sorted(found) == list(range(0, 3000, 100))
    hits = [len({v for _, v, _ in found[q]} & set(np.argsort(-exact[q])[:20].tolist())) / 20 for q in found]
    assert np.mean(hits) >= 0.9
    assert all([r for r, *_ in sorted(found[q])] == list(range(1, 21)) and [s for *_, s in sorted(found[q])] == sorted((s for *_, s in found[q]), reverse=True) for q in found)


def test_every_code_in_the_radius_is_found():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 16, (2000, 4)).astype(np.uint16)
    codes[:300] = codes[0] ^ np.left_shift(1, rng.integers(0, 16, (300, 4))).astype(np.uint16)
    index = nearest.SubstringIndex(codes)
    for query in codes[:20]:
        far = np.bitwise_count(codes ^ query).sum(axis=1, dtype=int)
        rows = index.within(query, 60)
        assert set(rows.tolist()) == set(np.flatnonzero(far <= np.sort(far)[59]).tolist())


def test_vectors_out_of_order(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("block", F.lit(1))
    found = sorted(tuple(r) for r in nearest.nearest_vectors(table, k=2).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert nearest.nearest_vectors(table.limit(0)).count() == 0


def test_pipeline_stages(spark, smallest):
    import corpus_pipeline
    from quern.llm import decontam, lines, minhash, toxicity
    from quern.llm.common import stored, table

    docs = table(spark, smallest, "documents")
    columns = docs.columns
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, smallest))
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    start, clean, deduped, distinct, uncontaminated = kept
    raw = table(spark, smallest, "documents")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(raw, toxicity.learn_lexicon(raw, table(spark, smallest, "labels"))).collect()}
    assert set(clean) == {i for i in start if scores[i] < 0.7}
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id: (r.text, r.n_removed) for r in lines.dedupe_lines(frame(clean)).collect()}
    assert deduped == {i: t for i, (t, n) in left.items() if not (n and not t.strip(" "))}
    assert set(distinct) == {r.doc_id for r in minhash.near_duplicates(frame(deduped)).filter("kept").collect()}
    assert set(uncontaminated) == {r.doc_id for r in decontam.decontaminate(frame(distinct), table(spark, smallest, "benchmark")).filter("NOT contaminated").collect()}
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, smallest).collect()
    assert {r.doc_id for r in mix} <= set(uncontaminated) and all(0 < r.taken <= 2 * r["size"] for r in mix)
    assert sorted(map(tuple, mix)) == sorted(map(tuple, corpus_pipeline.run(spark, smallest).collect()))


def test_pipeline_stages_on_odd_rows(spark, smallest):
    import corpus_pipeline

    schema = "doc_id long, text string, source string, lang string, n_chars int, score double, kept boolean"
    plain = "several ordinary words that stand in one document and nowhere else in this table"
    rows = [(1, None, "a", "en", 0, 1.0, False), (2, "", None, "en", 0, 1.0, False), (None, plain[8:], "a", None, 9, None, None), (4, plain.upper(), "b", "en", 9, 0.0, True)]
    docs, want = spark.createDataFrame(rows, schema), sorted(rows, key=str)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        if stage is not corpus_pipeline.drop_repeated_lines:
            assert sorted(map(tuple, stage(spark, docs, smallest).collect()), key=str) == want
        none = stage(spark, docs.limit(0), smallest)
        assert none.columns == docs.columns and not none.collect()
    twice = spark.createDataFrame([rows[3], rows[3], (9, plain, "b", "en", 9, 0.0, True)], schema)
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, twice, smallest).collect()] == [4, 4]
    mixed = corpus_pipeline.mix(spark, docs.select("doc_id", "text", "source", "lang", "n_chars"), smallest).collect()
    assert mixed and all(r.size > 0 and r.taken <= 2 * r.size for r in mixed)
    assert not corpus_pipeline.mix(spark, docs.limit(0), smallest).collect()

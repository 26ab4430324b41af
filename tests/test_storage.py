"""Deep categories, gram index, sketches, bundles with unknown fields, table functions and keyed streams on small frames."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import catalog, entities, gram_index, search, sketches, tables_in_sql
from quern.plans import binding
from quern.sources import clustered, variants
from quern.streaming import keyed

from test_clustered import rows_read


# categories


def test_a_chain_of_5000_levels(spark):
    tree = spark.range(6000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    found = {r["id"]: r["depth"] for r in catalog.category_closure(tree, "999").collect()}
    assert found == {str(i): i - 999 for i in range(999, 6000)}


def test_circles_are_left_out_or_refused(spark):
    rows = [("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("o", "nowhere"), (None, "r")]
    tree = spark.createDataFrame(rows, "id string, parent_id string")
    assert {(r["id"], r["depth"]) for r in catalog.category_closure(tree, "r").collect()} == {("r", 0), ("a", 1), ("b", 2)}
    assert catalog.category_closure(tree, "absent").collect() == []
    with pytest.raises(ValueError):
        catalog.category_closure(tree, "x")
    assert catalog.category_closure(tree.limit(0), "r").collect() == []


# gram index


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(4)
    letters = ["ka", "lo", "mi", "交换", "机", "é", "x1"]
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(30)) + (" Zebra42 show" if i % 500 == 7 else ""), f"file-{'rare' if i == 3 else i % 5}.md") for i in range(2000)]
    rows += [(5000, None, "none.md"), (5001, "", None), (5002, "Z", "z.md"), (None, "zebra42", "null.md")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, filename string")
    path = str(tmp_path_factory.mktemp("index") / "grams")
    gram_index.build(chunks, path, buckets=16, rows_per_file=2000)
    return chunks.filter("chunk_id IS NOT NULL"), path


def test_candidates_hold_all_hits(spark, indexed):
    chunks, path = indexed
    terms = ["zebra42", "kalo", "交", "交换机", "é", "mi x1", "x1x1x1", "never", "z", "lo", ""]
    found = {(r["term"], r["chunk_id"]) for r in gram_index.candidates(spark, path, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    hits = {(t, r["chunk_id"]) for r in chunks.collect() for t in terms if t and t in (r["content"] or "").lower()}
    assert hits <= found
    assert {c for t, c in found if t in ("zebra42", "never")} == {c for t, c in hits if t == "zebra42"}


def test_indexed_search_gives_the_rows_of_the_plain_one(spark, indexed):
    chunks, path = indexed
    queries = spark.createDataFrame([(1, "zebra42"), (2, "kalo 交换机"), (3, "show é"), (4, "file-rare"), (5, None), (6, "never seen"), (7, "zebra42 show")], "query_id long, query string")
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    assert rows(gram_index.keyword_search(spark, path, queries, 20)) == rows(search.keyword_search_batch(chunks, queries, 20))


def test_few_contents_are_read_for_a_rare_term(spark, indexed):
    _, path = indexed
    found = gram_index.candidates(spark, path, spark.createDataFrame([("zebra42",)], "term string")).select("chunk_id")
    assert found.count() == 4
    assert rows_read(clustered.lookup_all(spark, f"{path}/contents", found)) <= 4 * 2004 / 16 * 1.5


def test_many_candidates_are_joined_without_being_sent(spark, indexed, monkeypatch):
    chunks, path = indexed
    queries = spark.createDataFrame([(1, "zebra42"), (2, "kalo show"), (3, "file-rare")], "query_id long, query string")
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    sent = rows(gram_index.keyword_search(spark, path, queries, 20))
    monkeypatch.setattr(gram_index, "_SENT", 3)
    assert sent == rows(gram_index.keyword_search(spark, path, queries, 20)) == rows(search.keyword_search_batch(chunks, queries, 20))


def test_packed_postings_come_back():
    rng = random.Random(5)
    for of in (1, 7, 8, 9, 500, 4096):
        for n in {1, of // 40 + 1, of // 16, of // 2 + 1, of} - {0}:
            numbers = np.array(sorted(rng.sample(range(of), n)), np.uint16)
            data = gram_index.packed(numbers, of)
            assert gram_index.unpacked(data).tolist() == numbers.tolist() and len(data) <= 1 + min(2 * n, -(-of // 8))


def test_grams_are_all_runs_of_up_to_three_characters():
    for text in ("", "a", "ab", "abcabc", "aaaa", "交换机 x1é", "\0\0a\0", "a\0", "\U0001f600b\U0010ffff", "x" * 50 + "yxx"):
        want = {text[i : i + size] for size in (1, 2, 3) for i in range(len(text) - size + 1)}
        found = gram_index.spelled(gram_index.grams_of(text))
        assert len(found) == len(set(found)) and set(found) == want, text


def test_postings_are_worked_out_by_block(spark):
    """A gram has a row for each block, and rows that share a chunk_id a number: the chunks of all blocks are those of a plain count."""
    rng = random.Random(8)
    rows = [(i % 350, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 12))) if i % 9 else None) for i in range(400)]
    frame = spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)
    want: dict = {}
    for i, content in rows:
        for size in (1, 2, 3):
            for at in range(len(content or "") - size + 1):
                want.setdefault(content[at : at + size], set()).add(i)
    ids = {r["block"]: sorted(r["ids"]) for r in frame.groupBy(gram_index.block_of(5)).agg(F.collect_set("chunk_id").alias("ids")).collect()}
    found: dict = {}
    postings = gram_index.block_postings(frame, 5).collect()
    for r in postings:
        numbers = gram_index.unpacked(r["chunks"]).tolist()
        assert len(numbers) == r["n"]
        found.setdefault(r["gram"], set()).update(ids[r["block"]][n] for n in numbers)
    assert found == want and len(ids) == 5 and len(postings) == len({(r["gram"], r["block"]) for r in postings})


def test_an_index_is_built_without_one_task_for_all(spark, tmp_path, monkeypatch):
    """Until round 4 one task wrote a million rows, and the postings, a row for each gram and chunk, were worked out three times."""
    monkeypatch.setattr(gram_index, "BLOCK", 50)
    runs = spark.sparkContext.accumulator(0)
    plain = gram_index.block_postings

    def counted(contents, blocks):
        def seen(batches):
            for batch in batches:
                runs.add(batch.num_rows)
                yield batch

        return plain(contents.mapInArrow(seen, contents.schema), blocks)

    monkeypatch.setattr(gram_index, "block_postings", counted)
    rows = [(i, f"common words and own{i}", f"f{i % 3}") for i in range(600)]
    gram_index.build(spark.createDataFrame(rows, "chunk_id long, content string, filename string"), str(tmp_path / "grams"), buckets=4)
    assert runs.value <= 2 * len(rows)
    files = clustered.read(spark, str(tmp_path / "grams" / "contents")).select(F.col("_metadata.file_path")).distinct().collect()
    assert len({r[0].rpartition("/")[2].split("-")[1] for r in files}) >= 3
    queries = spark.createDataFrame([(1, "own17"), (2, "common own599")], "query_id long, query string")
    assert {(r["query_id"], r["chunk_id"]) for r in gram_index.keyword_search(spark, str(tmp_path / "grams"), queries, 1).collect()} == {(1, 17), (2, 599)}


def test_texts_of_chunks_are_the_rows_with_vectors(spark, tmp_path):
    """Numbers that are null, that no vector has and that several have."""
    spark.createDataFrame([(1, "a", "f"), (1, "a", "f"), (2, "b", None), (3, None, "g"), (None, "c", "g")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, [1.0]), (1, [1.0]), (1, None), (2, [0.5]), (None, [1.0]), (9, [1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = lambda df: sorted(map(str, df.select("chunk_id", "content", "filename").collect()))
    assert rows(binding.chunk_texts(spark, str(tmp_path))) == rows(binding.text_chunks(spark, str(tmp_path))) and binding.chunk_texts(spark, str(tmp_path)).count() == 9


# sketches


def test_questions_are_within_the_bound(spark):
    rng = random.Random(2)
    words = [f"question {int(rng.paretovariate(0.8))}" for _ in range(40_000)]
    log = spark.createDataFrame([(w, dt.datetime(2024, 1, 1 + i % 5)) for i, w in enumerate(words)] + [(None, dt.datetime(2024, 1, 1))], "query string, ts timestamp")
    exact = {w: words.count(w) for w in set(words[:50]) | {f"question {i}" for i in range(1, 12)}}
    days = sketches.question_sketches(log, tracked=256)
    assert days.count() == 5
    found = sketches.frequent_questions(days, 10, tracked=256).collect()
    assert len(found) == 10 and all(abs(r["n"] - exact.get(r["question"], words.count(r["question"]))) <= r["error"] for r in found)
    assert {w for w, n in exact.items() if n > 2 * found[0]["error"]} <= {r["question"] for r in sketches.frequent_questions(days, 256, tracked=256).collect()}
    assert sketches.frequent_questions(days.limit(0)).collect() == []
    small = sketches.frequent_questions(sketches.question_sketches(log.limit(500)), 3).collect()
    top = sorted({(-words[:500].count(w), w) for w in words[:500]})[:3]
    assert len(small) == 3 and [r["n"] for r in small] == [-n for n, _ in top] or log.limit(500).count() != 500


def test_quantiles_are_within_the_bound(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(5, 2) for _ in range(30_000)]
    log = spark.createDataFrame([(v, dt.datetime(2024, 1, 1 + i % 7)) for i, v in enumerate(values)] + [(None, dt.datetime(2024, 2, 1))], "response_time double, ts timestamp").repartition(6)
    days = sketches.response_sketches(log)
    for r in sketches.response_quantiles(days, (0.01, 0.5, 0.95, 0.99)).collect():
        assert r["n"] == 30_000 and abs(sum(v <= r["response_time"] for v in values) / 30_000 - r["share"]) < 0.015
    report = sketches.service_report(log, days).first()
    assert report["n"] == 30_001 and report["p95_ms"] > report["avg_ms"] / 10
    assert sketches.response_quantiles(days.limit(0)).collect() == []


# bundles


SCHEMA = "id long, title string, score double, tags array<string>"


def test_unknown_fields_survive_and_bad_rows_are_counted(spark):
    lines = [
        '{"id": 1, "title": "a", "score": 0.5, "tags": ["x", "y"], "mood": {"k": [1, 2]}, "z": null}', '{"id": 2}', '{"title": "b"}', '{"id": null}', '{"id": "many"}', "[1, 2]", "{broken", "", "  ", None, '7', '{"id": 3, "tags": "none"}',
        '{"id": 4, "other": "é 漢"}',
    ]
    rows = variants.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), SCHEMA, ("id",))
    good, rejected = variants.split(rows)
    assert {r["reason"]: r["n"] for r in rejected.collect()} == {"missing id": 2, "id is no bigint": 1, "not an object": 2, "not JSON": 1, "tags is no array<string>": 1}
    found = {r["id"]: r for r in good.select("id", "title", "score", "tags", F.to_json("extra").alias("extra"), variants.field("$.mood.k[1]", "int").alias("k")).collect()}
    assert set(found) == {1, 2, 4} and found[1]["k"] == 2 and found[1]["tags"] == ["x", "y"]
    assert found[1]["extra"] == '{"mood":{"k":[1,2]},"z":null}' and found[2]["extra"] is None
    again, none = variants.split(variants.parsed(variants.lines_of(good), SCHEMA, ("id",)))
    flat = lambda df: sorted(map(str, df.select("id", "title", "score", "tags", F.to_json("extra")).collect()))
    assert flat(again) == flat(good) and none.isEmpty()
    assert variants.parsed(spark.createDataFrame([], "value string"), SCHEMA).collect() == []


def test_variants_live_in_files_and_tell_their_schema(spark, tmp_path):
    lines = spark.createDataFrame([('{"id": 1, "more": {"a": 1}}',), ('{"id": 2, "more": {"b": "x"}}',), ("{no",)], "value string")
    assert variants.discovered(lines) == "OBJECT<id: BIGINT, more: OBJECT<a: BIGINT, b: STRING>>"
    good, _ = variants.split(variants.parsed(lines, "id long"))
    good.write.parquet(str(tmp_path / "v"))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "v")).select(variants.field("$.more.b", "string")).collect()} == {None, "x"}


# table functions


def test_table_functions_equal_the_frames(spark):
    host, switch = "MDC-AA-GPU-", "MDC-AA-IBLF-"
    lines = [f"AAA1X00000000{i},AAA1X00000000{i},{host}{i},alias,10.240.8.{i},10.240.0.{i}\n{host}{i},1,a,b,c,d,{switch}{i % 2},1/{i}" for i in range(6)]
    lines += [f"{switch}1,p1,POD1-SPINE1,p2\nPOD1-SPINE1,p3,CORE1,p4\nCORE1,p5,POD2-SPINE1,p6", "CORE1,p7,EDGE1,p8\nCORE1,p9,HSS-LEAF1,p10\nOOB-SPINE1,a,OOB-LEAF1,b", None, f"AAA1X000000001 {host}9", "AAA1X000000003"]
    chunks = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "chunk_order long, content string").repartition(3)
    tables_in_sql.register(spark)
    links = spark.sql("SELECT * FROM links_of(TABLE({chunks}) PARTITION BY chunk_order)", chunks=chunks)
    plain = entities.topology_edges(chunks)
    assert {tuple(r)[:5] for r in links.collect()} == {tuple(r)[:5] for r in plain.collect()}
    assert {r["layer"] for r in links.collect()} == {"server-iblf", "iblf-spine", "spine-core", "core-edge", "oob"}
    assert {r["tier"] for r in entities.topology_devices(plain).collect()} == {"server", "iblf", "spine", "core", "edge", "leaf", "oob"}
    ups = spark.sql("SELECT DISTINCT * FROM uplinks_of(TABLE({chunks}) PARTITION BY chunk_order)", chunks=chunks)
    assert {tuple(r) for r in ups.collect()} == {tuple(r) for r in entities.host_uplinks(chunks).collect()}
    asked = spark.createDataFrame([(f"AAA1X00000000{i}",) for i in range(8)], "sn string")
    found = spark.sql("SELECT * FROM address_of(TABLE({lines}) PARTITION BY sn ORDER BY (chunk_order, line))", lines=entities.line_serials(chunks, asked))
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in entities.address_lookup(chunks, asked).filter("hostname IS NOT NULL").collect())


# streams


def events(spark, rows, path):
    spark.createDataFrame(rows, "id long, response_time double, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id long, response_time double, ts timestamp").parquet(path)


def test_a_stopped_log_goes_on_where_it_was(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, float(i), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(14 * 24 * 60))) for i in range(900)]
    place = lambda name: str(tmp_path / name)
    for part in (rows[:300], rows[300:600], [], rows[600:], rows[:50]):
        stream = events(spark, part, place("in"))
        keyed.keep_newest(stream, place("newest"), place("s1"), rows=40, shards=3)
    whole = spark.createDataFrame(rows, "id long, response_time double, ts timestamp")
    assert [tuple(r) for r in keyed.newest(spark, place("newest"), 40).collect()] == [tuple(r) for r in catalog.newest(whole, 40).collect()]


def test_a_week_with_late_rows_and_empty_days(spark, tmp_path):
    place = lambda name: str(tmp_path / name)
    at = lambda day, hour=1: dt.datetime(2024, 1, day, hour)
    parts = [[(1, 1.0, at(10)), (2, 1.0, at(10, 23)), (3, 1.0, at(3))], [(4, 1.0, at(12))], [(5, 1.0, at(7)), (6, 1.0, at(10)), (7, 1.0, at(1))], [(8, 1.0, at(12, 5))]]
    for part in parts:
        keyed.keep_week(events(spark, part, place("in")), place("week"), place("state"), shards=2)
    found = {(r["label"], r["n"]) for r in keyed.week(spark, place("week")).collect()}
    assert found == {("1/6", 0), ("1/7", 1), ("1/8", 0), ("1/9", 0), ("1/10", 3), ("1/11", 0), ("1/12", 2)}
    rows = [r for part in parts for r in part if r[0] != 7]
    batch = catalog.daily_counts(spark.createDataFrame(rows, "id long, response_time double, ts timestamp"), "2024-01-12")
    assert found == {(r["label"], r["n"]) for r in batch.collect()}


def test_changes_in_any_order_and_again(spark, tmp_path):
    place = lambda name: str(tmp_path / name)
    ts = dt.datetime(2024, 1, 1)
    parts = [[(1, 1, False, "one", ts), (2, 1, False, "two\n\n" + "long " * 2000, ts), (3, 2, True, None, ts)], [(1, 3, False, "one again", ts), (3, 1, False, "too late", ts), (None, 1, False, "none", ts)], [(1, 2, False, "older", ts), (2, 2, True, None, ts), (2, 2, True, None, ts)]]
    for part in [*parts, parts[0]]:
        spark.createDataFrame(part, keyed.CHANGES).write.mode("append").parquet(place("feed"))
        keyed.apply_changes(spark.readStream.schema(keyed.CHANGES).parquet(place("feed")), place("table"), place("state"), buckets=4)
    assert [(r["document_id"], r["content"]) for r in clustered.read(spark, place("table/chunks")).collect()] == [(1, "one again")]
    assert {(r["document_id"], r["version"], r["deleted"]) for r in clustered.read(spark, place("table/documents")).collect()} == {(1, 3, False), (2, 2, True), (3, 2, True)}
    # all of it once more, from the start: nothing changes
    keyed.apply_changes(spark.readStream.schema(keyed.CHANGES).parquet(place("feed")), place("table"), place("other"), buckets=4)
    assert [(r["document_id"], r["content"]) for r in clustered.read(spark, place("table/chunks")).collect()] == [(1, "one again")]

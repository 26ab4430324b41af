"""Catalog, understanding, entities, conversations, grounding, embedding, sources and streams on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.operators import catalog, conversations, embedding, entities, grounding, understanding
from quern.plans.queries import queries
from quern.sources import tables
from quern.streaming import keyed


def test_category_delete_moves_only_its_own_documents(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("z", None)], "id string, parent_id string")
    docs = spark.createDataFrame([(1, "a"), (2, "c"), (3, "z")], "id int, category_id string")
    left, moved, dangling = catalog.delete_category(tree, docs, "a")
    assert [r.id for r in left.collect()] == ["z"]
    assert {r.id: r.category_id for r in moved.collect()} == {1: "default", 2: "c", 3: "z"}
    assert [r.id for r in dangling.collect()] == [2]
    assert catalog.add_category(tree.withColumn("name", F.lit("n")), spark.createDataFrame([("q", "nowhere", "x"), ("p", "z", "y")], "id string, parent_id string, name string")).count() == 5


def test_category_key_falls_back(spark):
    docs = spark.createDataFrame([("a", None), ("", "b"), (None, None)], "category_id string, category string")
    assert {r.category: r.n for r in catalog.documents_by_category(docs).collect()} == {"a": 1, "b": 1, "default": 1}


def test_patch_overlays_and_ignores_unknown_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, p string, q string")
    updates = spark.createDataFrame([(1, None, "new", 1), (1, "last", None, 2), (9, "no", "no", 1)], "id int, p string, q string, seq int")
    assert sorted(map(tuple, catalog.patch(rows, updates, "id").collect())) == [(1, "last", "new"), (2, "b", "y")]


def test_favourite_flips(spark):
    rows = spark.createDataFrame([(1, "⭐ t"), (2, "u"), (3, "v")], "id int, title string")
    assert {r.id: r.title for r in catalog.toggle_favourite(rows, spark.createDataFrame([(1,), (2,)], "id int")).collect()} == {1: "t", 2: "⭐ u", 3: "v"}


def test_log_statistics(spark):
    log = spark.createDataFrame([(1, " q ", 0, dt.datetime(2024, 1, 7)), (2, "q", 1500, dt.datetime(2024, 1, 7, 23, 59, 59)), (3, "r", 2600, dt.datetime(2023, 12, 30))], "id int, query string, response_time int, ts timestamp")
    days = {str(r.day): r.n for r in catalog.daily_counts(log, "2024-01-07").collect()}
    assert len(days) == 7 and days["2024-01-07"] == 2 and sum(days.values()) == 2
    assert [(r.question, r.n) for r in catalog.top_questions(log).collect()] == [("q", 2), ("r", 1)]
    assert catalog.mean_response(log).first().avg_seconds == 2.1 and catalog.mean_response(log.limit(0)).first().avg_seconds == 0.0
    assert [r.id for r in catalog.newest(log, 1).collect()] == [2]


def test_intents(spark):
    rows = [(1, "nv show interface", None), (2, "什么是MLAG", None), (3, "PFC和ECN的区别是什么", None), (4, "hmm", None), (5, "display it", ["error there"])]
    found = {r.query_id: r for r in understanding.query_intent(spark.createDataFrame(rows, "query_id int, query string, history array<string>")).collect()}
    assert found[1].intent == "command" and found[2].intent == "explanation" and found[3].intent == "comparison"
    assert (found[4].intent, found[4].confidence, found[4].sub_intents) == ("general", 0.5, [])
    assert found[1].sub_intents == ["verification"] and found[2].complexity == "simple"
    plain = understanding.query_intent(spark.createDataFrame([(1, "why fail")], "query_id int, query string")).first()
    assert plain.intent == "troubleshoot"


def test_context_adds_to_scored_intents_only(spark):
    frame = spark.createDataFrame([(1, "fail again", ["x", "y error"]), (2, "fail again", ["error", "x", "y"])], "query_id int, query string, history array<string>")
    assert {r.query_id: "context" in r.reasons for r in understanding.query_intent(frame).collect()} == {1: True, 2: False}


def test_addresses_and_commands(spark):
    text = "配置acl允许 10.0.0.0/24 和 10.0.0.9 还有 10.0.0.0 以及 10.0.0.1-10.0.0.9, 1.2.3.4.5"
    row = understanding.query_keywords(spark.createDataFrame([(text,)], "query string")).first()
    assert [(a.address, a.type, a.mask) for a in row.addresses if a.type == "cidr"] == [("10.0.0.0/24", "cidr", "24")]
    assert "10.0.0.9" in [a.address for a in row.addresses] and "10.0.0.0" not in [a.address for a in row.addresses if a.type == "ipv4"]
    assert [a.address for a in row.addresses if a.type == "range"] == ["10.0.0.1-10.0.0.9"]
    assert [(c.command, c.action, c.target) for c in row.commands] == [("acl", "configure", "access-control")] and row.coarse_intent == "network_config"


def test_domain_expansion(spark):
    row = understanding.expanded_query(spark.createDataFrame([("configure pfc on nvidia",), ("hello world",)], "query string")).collect()
    assert row[0].routed and row[0].enhanced.startswith("pfc priority flow control") and "nv set" in row[0].enhanced and "mellanox" in row[0].enhanced
    assert not row[1].routed and row[1].enhanced == "hello world"


DEVICES = [
    (1, "AAA1X0000A0001,AAA1X0000A0001,MDC-XX1E-A01-POD1-GPU-001,alias1,192.0.2.1,198.51.100.1\nAAA1X0000A0002 MDC-XX1E-A01-POD1-GPU-002 10.240.8.7 10.240.0.9"),
    (2, "AAA1X0000A0001 MDC-XX1E-A01-POD9-GPU-999\nMDC-XX1E-A01-POD1-GPU-001,1,a,b,c,d,MDC-XX1E-A01-POD1-IBLF-01,1/1"),
    (3, "POD1-SPINE1,p1,CORE1,p2\nPOD1-SPINE2,p1,CORE1,p3\nCORE1,p2,POD1-SPINE1,p1\nCORE1,p3,EDGE1,p4\nOOB-SPINE1,p1,OOB-LEAF1,p2"),
]


def device_chunks(spark):
    return spark.createDataFrame(DEVICES, "chunk_order int, content string")


def test_serial_lookups(spark):
    wanted = entities.lookup_list(spark.createDataFrame([("aaa1x0000a0001, AAA1X0000A0002\n\nAAA1X0000A0001 ZZZ1X0000A0009",)], "raw string"))
    found = entities.switch_lookup(device_chunks(spark), wanted)
    rows = [(r.sn, r.hostname, r.iblfs) for r in found.orderBy("position").collect()]
    host = "MDC-XX1E-A01-POD1-GPU-001"
    assert rows == [("AAA1X0000A0001", host, ["MDC-XX1E-A01-POD1-IBLF-01"]), ("AAA1X0000A0002", "MDC-XX1E-A01-POD1-GPU-002", []), ("AAA1X0000A0001", host, ["MDC-XX1E-A01-POD1-IBLF-01"]), ("ZZZ1X0000A0009", None, None)]
    assert [(r.iblfs, r.n) for r in entities.switch_groups(found).collect()] == [(["MDC-XX1E-A01-POD1-IBLF-01"], 2), ([], 1)]
    assert tuple(entities.lookup_summary(found).first()) == (4, 3, 1, 2)
    addresses = {r.sn: (r.outband, r.inband) for r in entities.address_lookup(device_chunks(spark), wanted).collect()}
    assert addresses == {"AAA1X0000A0001": ("192.0.2.1", "198.51.100.1"), "AAA1X0000A0002": ("10.240.8.7", "10.240.0.9"), "ZZZ1X0000A0009": (None, None)}


def test_topology(spark):
    rows = [tuple(r) for r in entities.topology(device_chunks(spark)).collect()]
    assert ("spine-core", "POD1-SPINE1", "p1", "CORE1", "p2") in rows and ("spine-core", "POD1-SPINE2", "p1", "CORE1", "p3") in rows and len(rows) == 5
    tiers = {r.tier: r.devices for r in entities.topology_devices(entities.topology(device_chunks(spark))).collect()}
    assert tiers["oob"] == ["OOB-LEAF1", "OOB-SPINE1"] and tiers["spine"] == ["POD1-SPINE1", "POD1-SPINE2"]


def test_fuzzy_titles(spark):
    cases = [("Bgp neighbours", "bgp", True), ("abc", "xy", False), ("network", "netwrok", True), ("n e t w o r k over there", "network", False), ("bgp", "bgpx", False), ("ospf area", "opsf", False), ("ospf", "osppf", True)]
    frame = spark.createDataFrame(cases, "title string, query string, expected boolean")
    for title, query, expected in cases:
        assert frame.filter(F.col("title") == title).select(conversations.fuzzy_match(F.col("title"), query).alias("m")).first().m == expected, (title, query)


def test_preview_cleans_and_shortens(spark):
    turns = spark.createDataFrame([(i, 1, "user" if i % 2 else "assistant", t) for i, t in enumerate(["old", "**b** `x` [l](u) <i>t</i>", "```\ncode\n``` z", "w" * 90])], "id int, conversation_id int, role string, content string").withColumn("created_at", F.col("id"))
    assert conversations.previews(turns).first().preview == "你: b [代码] l t | AI: [代码] z | 你: " + "w" * 80 + "..."


def test_purge_then_restore_gives_back_all(spark):
    t = {
        "conversations": spark.createDataFrame([(1, "a"), (2, "b")], "id int, user_id string"),
        "messages": spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "id int, conversation_id int"),
        "documents": spark.createDataFrame([(5, "a"), (6, "b")], "id int, user_id string"),
        "chunks": spark.createDataFrame([(7, 5), (8, 6)], "id int, document_id int"),
    }
    saved = conversations.tenant_rows("a", **t)
    purged = conversations.purge("a", **t)
    assert [r.id for r in purged["messages"].collect()] == [2]
    back = conversations.restore("a", t, saved)
    assert {n: sorted(map(tuple, d.collect())) for n, d in back.items()} == {n: sorted(map(tuple, d.filter("id <> 3").collect() if n == "messages" else d.collect())) for n, d in t.items()}


def test_bundle_violations(spark):
    bundle = spark.createDataFrame([("1.2", "u", "{}"), ("2.0", None, "{}")], "version string, user_id string, data string")
    assert tuple(tables.violations(bundle).first()) == (0, 1, 0, 1)


def test_bundle_round_trip(spark, tmp_path):
    schemas = {"conversations": "id int, user_id string", "messages": "id int, conversation_id int"}
    rows = {"conversations": [(1, "a"), (2, None)], "messages": [(7, 1)]}
    saved = {n: spark.createDataFrame(r, schemas[n]) for n, r in rows.items()}
    tables.export_bundle(saved, str(tmp_path), user_id="a")
    back = tables.read_bundle(spark, str(tmp_path), schemas)
    assert {n: sorted(map(tuple, d.collect())) for n, d in back.items()} == rows
    with pytest.raises(ValueError, match="missing_chunks"):
        tables.read_bundle(spark, str(tmp_path), schemas | {"chunks": "id int"})
    with pytest.raises(ValueError, match="other_version"):
        tables.read_bundle(spark, str(tmp_path), schemas, major=2)
    tables.export_bundle(saved, str(tmp_path))
    with pytest.raises(ValueError, match="missing_user_id"):
        tables.read_bundle(spark, str(tmp_path), schemas)


def test_query_log_keeps_the_newest(spark):
    log = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, query string, ts int")
    more = spark.createDataFrame([(3, "c", 2), (4, "d", 0)], "id int, query string, ts int")
    assert [r.id for r in catalog.append_query(log, more, 2).collect()] == [3, 2]
    assert [r.id for r in catalog.append_query(log, more.limit(0)).collect()] == [2, 1]


def test_serials_of_any_shape(spark):
    content = "1234567890 x MDC-XX1E-A1-GPU-7\nab-12,MDC-XX1E-A1-GPU-8\nQQ1234567890 MDC-XX1E-A1-GPU-9\n10.240.8.1 10.240.0.2 10.240.9.3"
    chunks = spark.createDataFrame([(1, content), (2, "AB-12 MDC-XX1E-A1-GPU-1"), (3, None), (4, "")], "chunk_order int, content string")
    wanted = entities.lookup_list(spark.createDataFrame([("1234567890, ab-12 34567890 ",), (None,)], "raw string"))
    found = {r.sn: (r.hostname, r.iblfs) for r in entities.switch_lookup(chunks, wanted).collect()}
    assert found == {"1234567890": ("MDC-XX1E-A1-GPU-7", []), "AB-12": ("MDC-XX1E-A1-GPU-8", []), "34567890": (None, None)}
    addresses = {r.sn: (r.outband, r.inband) for r in entities.address_lookup(chunks, wanted).collect()}
    assert addresses == {"1234567890": ("10.240.9.3", "10.240.0.2"), "AB-12": ("10.240.9.3", "10.240.0.2"), "34567890": (None, None)}


def test_grounding(spark):
    answer = "$ nv show interface brief\n# rm everything now please\n根据参考内容可以这样做是没有问题的\nUnfounded zebra quagga statement."
    row = grounding.answer_grounding(spark.createDataFrame([(answer, ["Use NV show interface here"])], "answer string, references array<string>")).first()
    assert row.suspicious_commands == ["rm everything now please"] and row.n_sentences == 4
    assert row.missing_sentences == ["# rm everything now please", "Unfounded zebra quagga statement."] and row.confidence == 0.25


def test_embedding_retries_and_gives_up(spark):
    def fails(texts):
        raise RuntimeError

    rows = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "chunk_id int, content string")
    assert {r.chunk_id: r.embedding is not None for r in embedding.embed_chunks(rows).collect()} == {1: True, 2: False, 3: False}
    assert all(r.embedding is None for r in embedding.embed_chunks(rows, fails, attempts=2, wait=0).collect())


def test_ingest_and_names(spark):
    broken = "配置".encode().decode("latin-1")
    files = spark.createDataFrame([("/in/a.txt", 4, b" hi "), ("/in/b.pdf", 1, b"x"), ("/in/c.txt", 1, b" "), ("/in/d.txt", 1, b"\xff"), (f"/in/{broken}.md", 2, b"ok")], "path string, length long, content binary")
    good, bad = tables.ingest(files)
    assert {r.filename: r.text for r in good.collect()} == {"a.txt": "hi", "配置.md": "ok"}
    assert {r.filename: r.error_message for r in bad.collect()} == {"b.pdf": "no decoder for this type", "c.txt": "empty", "d.txt": "not UTF-8"}


def test_address_lookup_query_returns_every_serial(spark, smallest):
    nation = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{smallest}/customer.parquet").select("c_custkey", "c_nationkey").collect()}
    last = {n: key for key, n in sorted(nation.items()) if key % 3}
    want = {}
    for key, n in nation.items():
        if key % 5 == 0:
            want[f"AAA1X{key + 500_000_000:09}"] = (None, None, None)
        else:
            shown = key if key % 3 else last.get(n)
            ends = ("", "") if shown is None else (f"10.240.8.{shown % 250}", f"10.240.0.{shown % 250}")
            want[f"AAA1X{key:09}"] = (f"MDC-XX1E-A{n}-POD{n % 4}-GPU-{key}", *ends)
    rows = queries()["address_lookup_all"](spark, smallest).collect()
    assert len(rows) == len(want) and {r.sn: (r.hostname, r.outband, r.inband) for r in rows} == want


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    """Until round 4 a table that is a folder of files gave no row, and stream_ingest failed."""
    text = "a line that is long enough to make a chunk of its own in this test, number "
    rows = [(i, f"# one\n{text}{i}\n# two\n{text}{i}") for i in range(20)] + [(20, None), (21, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for place, files in (("many", 5), ("none", 0)):
        docs.limit(len(rows) if files else 0).repartition(max(1, files)).write.parquet(str(tmp_path / place / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "written"))
    for folder in (tmp_path / "one", tmp_path / "deep" / "below"):
        folder.mkdir(parents=True)
        (folder / "documents.parquet").write_bytes(next((tmp_path / "written").glob("*.parquet")).read_bytes())
    (tmp_path / "bare" / "documents.parquet").mkdir(parents=True)
    ingested = lambda place: {r.document_id: r.n_chunks for r in queries()["stream_ingest"](spark, str(tmp_path / place)).collect()}
    assert [len(list((tmp_path / place / "documents.parquet").glob("*.parquet"))) for place in ("many", "bare")] == [5, 0]
    assert ingested("one") == ingested("many") == ingested("deep") == {i: 2 for i in range(20)}
    assert ingested("none") == ingested("bare") == {}


def test_streamed_tables_of_many_files_grow(spark, tmp_path):
    """Events that came as one more file of the table's folder are read by the next run."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for day in (1, 5):
        rows = [(i, dt.datetime(2024, 1, day, 1), "view", 1.0) for i in range(day)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.mode("append").parquet(str(tmp_path / "in" / "events.parquet"))
        keyed.keep_week(keyed.log_stream(spark, str(tmp_path / "in")), out, state, shards=2)
    assert {r["label"]: r["n"] for r in keyed.week(spark, out).collect() if r["n"]} == {"1/1": 1, "1/5": 5}

from pyspark.sql import functions as F

from quern.operators import chunking as c
from quern.plans.queries import queries

MARKDOWN = "# Top\nIntro text that is long enough to be kept as a section of its own, surely.\n## First\nbody " + "x" * 60 + "\n```bash\n# not a heading\nnv set interface swp1\n```\n### Deep\n" + "deep " * 20 + "\n## Second\n" + "second " * 12


def chunks_of(spark, text, **options):
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    return c.chunk_corpus(docs, **options).orderBy("chunk_index").collect()


def test_breadcrumbs_follow_open_headings_and_fences_are_opaque(spark):
    rows = chunks_of(spark, MARKDOWN)
    assert [r.metadata.breadcrumbs for r in rows] == [["Top"], ["Top", "First"], ["Top", "First", "Deep"], ["Top", "Second"]]
    assert "# not a heading" in rows[1].content and rows[1].metadata.summary == "First | NVUE: nv set interface swp1 | 关键词: SWP1"
    assert [r.id for r in rows] == ["d-0", "d-1", "d-2", "d-3"]


def test_shallower_heading_closes_deeper_ones(spark):
    body = "\n" + "words " * 12 + "\n"
    rows = chunks_of(spark, f"# A{body}## B{body}### C{body}# D{body}### E{body}## F{body}")
    assert [r.metadata.breadcrumbs for r in rows] == [["A"], ["A", "B"], ["A", "B", "C"], ["D"], ["D", "E"], ["D", "F"]]


def test_short_sections_and_blank_documents_are_dropped(spark):
    assert chunks_of(spark, "# Tiny\nfew words") == [] and chunks_of(spark, "  \n ") == [] and chunks_of(spark, None) == []


def test_plain_text_is_one_section(spark):
    rows = chunks_of(spark, "plain " * 20)
    assert len(rows) == 1 and rows[0].metadata.breadcrumbs == [] and rows[0].metadata.header is None


def test_large_sections_are_packed_and_fences_stay_whole(spark):
    fence = "```\n" + "code line\n" * 30 + "```"
    text = "# A\n" + "\n\n".join(["para " * 12] * 4) + "\n\n" + fence + "\n\n" + "One sentence here. " * 20
    rows = chunks_of(spark, text, max_size=120)
    assert all(r.content.startswith("[A]\n\n") for r in rows)
    assert any(fence in r.content for r in rows)
    assert all(len(r.content) <= 120 + len("[A]\n\n") or fence in r.content for r in rows)
    letters = lambda s: s.replace(" ", "").replace("\n", "")
    assert letters("".join(r.content.removeprefix("[A]") for r in rows)) == letters(text)


def test_sentence_longer_than_a_chunk_is_cut(spark):
    df = spark.createDataFrame([("abc. " + "y" * 25 + ". z",)], "t string")
    assert df.select(c.packed_sentences(F.col("t"), 10).alias("p")).first().p == ["abc.", "y" * 10, "y" * 10, "yyyyy.", "z"]


def test_html_tables_become_pipes_with_an_empty_header_row(spark):
    html = "a<table><tr><th>h1</th><th>h2</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>b<table>none</table>"
    text = spark.createDataFrame([(html,)], "t string").select(c.tables_as_pipes(F.col("t")).alias("t")).first().t
    assert text == "a\n|  |\n| --- |\n| 1 | 2 |\nb<table>none</table>"


def test_clean_up(spark):
    text = spark.createDataFrame([("a\n\n\n\nb\n\n      * c $=$ $\\equiv$",)], "t string").select(c.cleaned(F.col("t")).alias("t")).first().t
    assert text == "a\n\nb\n  * c = ="


def test_repartitioning_changes_nothing(spark):
    docs = spark.createDataFrame([(i, MARKDOWN * (i + 1)) for i in range(6)], "document_id int, text string")
    a, b = (sorted(map(str, c.chunk_corpus(d).collect())) for d in (docs, docs.repartition(5)))
    assert a == b


def test_reassemble_nests_children(spark):
    chunks = spark.createDataFrame([("a", "d", 1, "second", None), ("b", "d", 0, "first", None), ("c", "d", 2, "child", "b")], "id string, document_id string, chunk_index int, content string, parent_id string")
    docs = spark.createDataFrame([("d", "file"), ("e", "bare")], "document_id string, filename string")
    assert {r.document_id: r.markdown for r in c.reassemble(docs, chunks).collect()} == {"d": "# file\n\nfirst\n\nchild\n\nsecond", "e": "# bare"}


def test_reassemble_query_keeps_whole_texts(spark, tmp_path):
    texts = ["word " * 3000, "One sentence. " * 900 + "\n\n" + "x" * 5000, "short", "", "a\n\nb " * 400 + "end"]
    spark.createDataFrame([(i, f"src{i % 2}", "en", len(t), t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.document_id: r.markdown for r in queries()["reassemble_chunks"](spark, str(tmp_path)).collect()}
    assert {i: "".join(m.split()) for i, m in found.items()} == {i: f"#src{i % 2}" + "".join(t.split()) for i, t in enumerate(texts)}


def test_odd_headings_and_fences(spark):
    texts = {
        1: "before\n# A\r\n####### seven\n#none\n## B \n```\n# fenced\n```\n# C ``` d\n### ﻿D",
        2: "```\n# a fence that is never closed protects nothing",
        3: "# 𝒶 more\n#\tTab",
        4: "",
        5: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "document_id int, text string")
    found = {}
    for r in c.sections(docs).orderBy("document_id", "section").collect():
        found.setdefault(r.document_id, []).append((r.section, r.content, r.breadcrumbs))
    assert found == {
        1: [(0, "before", []), (1, "# A\r\n####### seven\n#none", ["A"]), (2, "## B \n```\n# fenced\n```\n# C ``` d", ["A", "B"]), (3, "### ﻿D", ["A", "B", "D"])],
        2: [(0, "```", []), (1, "# a fence that is never closed protects nothing", ["a fence that is never closed protects nothing"])],
        3: [(0, "# 𝒶 more", []), (1, "#\tTab", ["Tab"])],
        4: [(0, "", [])],
    }
    assert c.sections(docs.filter("document_id = 5")).collect() == [] and c.sections(docs.limit(0)).collect() == []

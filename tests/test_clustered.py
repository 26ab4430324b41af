"""Clustered tables: bounded reads, compaction, and changes that an interruption leaves whole."""

import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from quern.sources import clustered


def made(spark, n=2000, documents=100):
    return spark.range(n).select(F.concat(F.lit("d"), F.col("id") % documents).alias("document_id"), F.concat(F.lit("c"), "id").alias("id"), (F.col("id") / documents).cast("int").alias("chunk_index"), F.concat(F.lit("text "), "id").alias("content"), F.array(F.col("id").cast("float")).alias("embedding"))


@pytest.fixture
def place(spark, tmp_path):
    path = str(tmp_path / "table")
    clustered.create(made(spark), path, order=("chunk_index",), buckets=8, rows_per_file=500, row_group=4096)
    return path


def digests(path, but=()):
    return {str(f): hashlib.sha256(f.read_bytes()).hexdigest() for f in pathlib.Path(path).rglob("*.parquet") if not any(f"bucket={b}/" in str(f) for b in but)}


def rows_read(df):
    """Rows that the scan itself gave out, after pruning."""
    df.collect()

    def leaves(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves(plan.plan())
        children = plan.children()
        below = [x for i in range(children.size()) for x in leaves(children.apply(i))]
        return below or [plan]

    frame = df._jdf
    frame.collect()
    return sum(p.metrics().apply("numOutputRows").value() for p in leaves(frame.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "FileSourceScanExec")


def rows_of(spark, path):
    return sorted(map(tuple, clustered.read(spark, path).drop("embedding").collect()))


def test_a_document_is_found_in_few_row_groups(spark, place):
    found = clustered.lookup(spark, place, "d7")
    assert sorted(r["id"] for r in found.collect()) == sorted(f"c{i}" for i in range(7, 2000, 100))
    assert 20 <= rows_read(found) <= 400  # of 2,000: its bucket's row groups at most
    assert clustered.lookup(spark, place, "absent").collect() == []
    keys = spark.createDataFrame([("d7",), ("d8",), (None,), ("d7",)], "document_id string")
    assert clustered.lookup_all(spark, place, keys).count() == 40


def test_small_appends_are_compacted_and_found(spark, place):
    for i in range(6):
        clustered.append(spark, place, made(spark, 40, 4).withColumn("id", F.concat("id", F.lit(f"-{i}"))))
    before = rows_of(spark, place)
    assert len(before) == 2240
    touched = {b for b in range(8) if len(list(pathlib.Path(place, f"bucket={b}").glob("*.parquet"))) > 4}
    others = digests(place, touched)
    assert clustered.compact(spark, place) == len(touched) > 0
    assert rows_of(spark, place) == before
    assert all(len(list(pathlib.Path(place, f"bucket={b}").glob("*.parquet"))) <= 4 for b in range(8))
    assert digests(place, touched) == others
    assert clustered.compact(spark, place) == 0


def test_delete_rewrites_only_touched_buckets(spark, place):
    gone = spark.createDataFrame([("d1",), ("d1",), (None,), ("absent",)], "document_id string")
    bucket = spark.range(1).select(clustered.opened(spark, place).bucket_of(F.lit("d1"))).first()[0]
    others = digests(place, [bucket])
    assert clustered.delete(spark, place, gone) == 1
    assert clustered.read(spark, place).count() == 1980 and clustered.lookup(spark, place, "d1").isEmpty()
    assert digests(place, [bucket]) == others
    every = digests(place)
    assert clustered.delete(spark, place, gone) == 0
    assert digests(place) == every


def test_embeddings_are_written_back(spark, place):
    updates = spark.createDataFrame([("d2", "c2", [9.0], 1), ("d2", "c2", [8.0], 2), ("d2", "nowhere", [7.0], 1), ("d3", "c2", [6.0], 1)], "document_id string, id string, embedding array<float>, seq int")
    assert clustered.patch(spark, place, updates) == 1
    assert {r["id"]: r["embedding"] for r in clustered.lookup(spark, place, "d2").filter("id IN ('c2', 'c102')").collect()} == {"c2": [8.0], "c102": [102.0]}
    assert clustered.read(spark, place).count() == 2000
    assert clustered.patch(spark, place, updates) == 0


def test_replace_is_repeatable_and_may_empty_a_bucket(spark, place):
    keys = spark.createDataFrame([(f"d{i}",) for i in range(100)], "document_id string")
    new = made(spark, 3, 3).withColumn("document_id", F.concat(F.lit("n"), "id"))
    for _ in range(2):
        clustered.replace(spark, place, keys.unionByName(new.select("document_id")), new)
        assert [r[0] for r in rows_of(spark, place)] == ["nc0", "nc1", "nc2"]


def test_a_change_that_fails_while_writing_leaves_the_old_table(spark, place):
    before, every = rows_of(spark, place), digests(place)
    broken = made(spark, 50, 5).withColumn("content", F.when(F.col("id") == "c33", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        clustered.replace(spark, place, broken.select("document_id"), broken)
    assert rows_of(spark, place) == before
    assert digests(place) == every


@pytest.mark.parametrize("renames", range(6))
def test_a_change_that_is_cut_off_while_swapping_is_completed(spark, place, monkeypatch, renames):
    rename, done = clustered.Files.rename, []

    def limited(self, old, new):
        if len(done) == renames:
            raise OSError("lost")
        done.append(new)
        rename(self, old, new)

    gone = spark.createDataFrame([(f"d{i}",) for i in range(40)], "document_id string")
    monkeypatch.setattr(clustered.Files, "rename", limited)
    with pytest.raises(OSError):
        clustered.delete(spark, place, gone)
    monkeypatch.undo()
    assert {r[0] for r in rows_of(spark, place)} == {f"d{i}" for i in range(40, 100)}
    assert clustered.read(spark, place).count() == 1200


def test_a_hot_document_is_dealt_over_files(spark, tmp_path):
    path = str(tmp_path / "hot")
    clustered.create(made(spark, 3000, 1), path, order=("chunk_index",), buckets=4, rows_per_file=500)
    sizes = [spark.read.parquet(str(f)).count() for f in pathlib.Path(path).rglob("part-*.parquet")]
    assert len(sizes) >= 5 and max(sizes) < 1200
    with pytest.raises(ValueError):
        clustered.create(made(spark), path)

"""Tables of Parquet files clustered by a key: one key's rows are found in few row groups, and changes rewrite only the buckets they touch.

Rows lie in a folder for each bucket (a hash of the key), so a key's bucket is known before any file is opened; inside, files are sorted by the key
and carry its smallest and largest value and a Bloom filter for each row group. Spark's own partition pruning and filter pushdown do the rest.

Changes are written beside the table and then swapped in, bucket by bucket, by renames. What a run has finished writing is completed by whoever opens the table next;
what it has not is thrown away: readers find the table as it was or as it should be. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket"
_STAGED = "_staged"
_LAYOUT = "_layout"


@dataclass(frozen=True)
class Layout:
    """Where a table lies and how it is cut. ``row_group`` is in bytes."""

    path: str
    key: str
    order: tuple[str, ...]
    buckets: int
    rows_per_file: int
    row_group: int
    schema: str

    def bucket_of(self, key: Column) -> Column:
        """The bucket of a key; of a literal it is a constant, by which the scan's folders are pruned."""
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets).cast("bigint")).cast("int")


class Files:
    """The few calls on a Hadoop file system that swaps and streams need."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.make = jvm.org.apache.hadoop.fs.Path
        self.fs = self.make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.make(path))

    def is_folder(self, path: str) -> bool:
        return self.exists(path) and self.fs.getFileStatus(self.make(path)).isDirectory()

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.make(path))) if self.exists(path) else []

    def folder(self, path: str) -> None:
        self.fs.mkdirs(self.make(path))

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.make(old), self.make(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.make(path), True)


def create(rows: DataFrame, path: str, key: str = "document_id", order: tuple[str, ...] = (), buckets: int = 64, rows_per_file: int = 1_000_000, row_group: int = 16 << 20, parts: int | None = None) -> Layout:
    """A new table of ``rows``; they are ordered by ``key`` and ``order`` inside a file. ValueError if there is one already.

    With ``parts``, so many tasks write it, and ``rows`` are not counted before, which would work them out once more.
    """
    spark = rows.sparkSession
    layout = Layout(path.rstrip("/"), key, tuple(order), buckets, rows_per_file, row_group, rows.schema.json())
    if exists(spark, path):
        raise ValueError(f"there is a table at {path}")
    files = Files(spark, layout.path)
    for name in files.names(layout.path):  # what a creation that was cut off left
        if name == _LAYOUT or name.startswith(f"{BUCKET}="):
            files.delete(f"{layout.path}/{name}")
    _write(layout, rows, layout.path, "append", parts)
    described = spark.createDataFrame([(key, ",".join(order), buckets, rows_per_file, row_group, layout.schema)], "key string, sorted string, buckets int, rows_per_file long, row_group long, columns string")
    described.coalesce(1).write.json(f"{layout.path}/{_LAYOUT}")
    return layout


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was created at ``path``, to the end."""
    return Files(spark, path).exists(f"{path.rstrip('/')}/{_LAYOUT}/_SUCCESS")


def opened(spark: SparkSession, path: str) -> Layout:
    """The layout of the table at ``path``, after completing or undoing what an interrupted change left."""
    path = path.rstrip("/")
    row = spark.read.schema("key string, sorted string, buckets int, rows_per_file long, row_group long, columns string").json(f"{path}/{_LAYOUT}").first()
    layout = Layout(path, row["key"], tuple(c for c in row["sorted"].split(",") if c), row["buckets"], row["rows_per_file"], row["row_group"], row["columns"])
    recover(spark, layout)
    return layout


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows."""
    return _scan(spark, opened(spark, path)).drop(BUCKET)


def lookup(spark: SparkSession, path: str, value) -> DataFrame:
    """The rows of one key: one bucket's files are listed, and of these only row groups that may hold the key are read."""
    layout = opened(spark, path)
    return _scan(spark, layout).filter((F.col(BUCKET) == layout.bucket_of(F.lit(value))) & (F.col(layout.key) == F.lit(value))).drop(BUCKET)


def lookup_all(spark: SparkSession, path: str, keys: DataFrame, most_sent: int = 0) -> DataFrame:
    """The rows of all keys in the first column of ``keys``; the buckets that occur there are the only ones read.

    Up to ``most_sent`` keys are sent to every task, so that no row of the table is shuffled.
    """
    layout = opened(spark, path)
    wanted = keys.select(F.col(keys.columns[0]).alias(layout.key)).filter(F.col(layout.key).isNotNull()).distinct()
    buckets = _numbers(wanted.select(layout.bucket_of(F.col(layout.key))))
    if most_sent and wanted.count() <= most_sent:
        wanted = F.broadcast(wanted)
    return _scan(spark, layout).filter(F.col(BUCKET).isin(buckets)).join(wanted, layout.key, "left_semi").drop(BUCKET)


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Add rows as files of their own. Many small appends are put together by ``compact``."""
    _write(opened(spark, path), rows, path.rstrip("/"), "append")


def delete(spark: SparkSession, path: str, keys: DataFrame) -> int:
    """Delete all rows of the keys in the first column of ``keys``; returns how many buckets were rewritten.

    Only buckets that hold such a row change. Run again, it finds none and changes nothing.
    """
    layout = opened(spark, path)
    wanted = keys.select(F.col(keys.columns[0]).alias(layout.key)).filter(F.col(layout.key).isNotNull()).distinct()
    rows = _possible(spark, layout, wanted)
    touched = _numbers(rows.join(wanted, layout.key, "left_semi").select(BUCKET))
    return _rewrite(spark, layout, touched, _buckets(spark, layout, touched).join(wanted, layout.key, "left_anti").drop(BUCKET))


def patch(spark: SparkSession, path: str, updates: DataFrame, by: str = "id") -> int:
    """Lay the non-null values of ``updates`` (the table's key, ``by``, changed columns, and perhaps seq) over the rows with the same key and ``by``.

    The last of several updates of a row (by seq) wins, column by column; updates of unknown rows change nothing. Returns how many
    buckets were rewritten: those whose rows now differ, so a repeated patch rewrites none.
    """
    layout = opened(spark, path)
    fields = [c for c in updates.columns if c not in (layout.key, by, "seq")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))) if "seq" in updates.columns else F.max(c) for c in fields]
    last = updates.groupBy(layout.key, by).agg(*(n.alias(f"_new_{c}") for n, c in zip(newest, fields)))
    rows = _possible(spark, layout, updates.select(layout.key))
    differs = [F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)) for c in fields]
    changed = F.lit(False)
    for one in differs:
        changed = changed | one
    touched = _numbers(rows.join(last, [layout.key, by]).filter(changed).select(BUCKET))
    joined = _buckets(spark, layout, touched).join(last, [layout.key, by], "left")
    return _rewrite(spark, layout, touched, joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in _columns(spark, layout))))


def replace(spark: SparkSession, path: str, keys: DataFrame, rows: DataFrame) -> int:
    """In one swap, delete all rows of the keys in the first column of ``keys`` and add ``rows``. Run again, it gives the same table."""
    layout = opened(spark, path)
    wanted = keys.select(F.col(keys.columns[0]).alias(layout.key)).filter(F.col(layout.key).isNotNull()).distinct()
    touched = _numbers(wanted.unionByName(rows.select(layout.key)).select(layout.bucket_of(F.col(layout.key))))
    kept = _buckets(spark, layout, touched).join(wanted, layout.key, "left_anti").drop(BUCKET)
    return _rewrite(spark, layout, touched, kept.unionByName(rows.select(*kept.columns)))


def compact(spark: SparkSession, path: str, most_files: int = 4) -> int:
    """Rewrite each bucket that lies in more than ``most_files`` files and more than its rows need; returns how many there were."""
    layout = opened(spark, path)
    files = _scan(spark, layout).groupBy(BUCKET).agg(F.count_distinct(F.col("_metadata.file_path")).alias("files"), F.count(F.lit(1)).alias("rows"))
    touched = _numbers(files.filter((F.col("files") > most_files) & (F.col("files") > F.ceil(F.col("rows") / layout.rows_per_file))).select(BUCKET))
    return _rewrite(spark, layout, touched, _buckets(spark, layout, touched).drop(BUCKET))


def recover(spark: SparkSession, layout: Layout) -> None:
    """Complete changes that were written in full, throw away the others."""
    files = Files(spark, layout.path)
    for run in files.names(f"{layout.path}/{_STAGED}"):
        staged = f"{layout.path}/{_STAGED}/{run}"
        if files.exists(f"{staged}/touched/_SUCCESS"):
            _swap(spark, layout, staged)
        else:
            files.delete(staged)


def _scan(spark: SparkSession, layout: Layout) -> DataFrame:
    schema = StructType.fromJson(json.loads(layout.schema))
    return spark.read.schema(schema.add(BUCKET, "integer")).option("basePath", layout.path).parquet(layout.path)


def _columns(spark: SparkSession, layout: Layout) -> list[str]:
    return [c for c in _scan(spark, layout).columns if c != BUCKET]


def _numbers(buckets: DataFrame) -> list[int]:
    """Distinct bucket numbers: at most as many as the table has buckets."""
    return sorted(r[0] for r in buckets.distinct().collect())


def _possible(spark: SparkSession, layout: Layout, keys: DataFrame) -> DataFrame:
    """The buckets in which the keys may lie."""
    return _buckets(spark, layout, _numbers(keys.filter(F.col(layout.key).isNotNull()).select(layout.bucket_of(F.col(layout.key)))))


def _buckets(spark: SparkSession, layout: Layout, numbers: list[int]) -> DataFrame:
    return _scan(spark, layout).filter(F.col(BUCKET).isin(numbers))


def _write(layout: Layout, rows: DataFrame, path: str, mode: str, parts: int | None = None) -> None:
    """Write rows to the buckets' folders: range by range, so that a bucket or a key of any size is dealt over several files."""
    placed = rows.withColumn(BUCKET, layout.bucket_of(F.col(layout.key)))
    within = [BUCKET, layout.key, *layout.order]
    parts = max(1, -(-rows.count() // layout.rows_per_file)) if parts is None else max(1, parts)
    dealt = placed.repartitionByRange(parts, *within).sortWithinPartitions(*within)
    writer = dealt.write.mode(mode).partitionBy(BUCKET).option("parquet.block.size", layout.row_group).option("maxRecordsPerFile", layout.rows_per_file)
    writer = writer.option(f"parquet.bloom.filter.enabled#{layout.key}", "true")
    writer.option(f"parquet.bloom.filter.expected.ndv#{layout.key}", min(layout.rows_per_file, 1_000_000)).parquet(path)


def _rewrite(spark: SparkSession, layout: Layout, touched: list[int], rows: DataFrame) -> int:
    """Give the touched buckets the rows of ``rows``: write these beside the table, note the buckets, swap."""
    if touched:
        staged = f"{layout.path}/{_STAGED}/{uuid.uuid4().hex}"
        _write(layout, rows, f"{staged}/rows", "append")
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.json(f"{staged}/touched")
        _swap(spark, layout, staged)
    return len(touched)


def _swap(spark: SparkSession, layout: Layout, staged: str) -> None:
    """Put the staged buckets in place of the old ones. Interrupted anywhere and started again, it does the rest."""
    files = Files(spark, layout.path)
    files.folder(f"{staged}/old")
    for (number,) in spark.read.schema("bucket int").json(f"{staged}/touched").collect():
        name = f"{BUCKET}={number}"
        live, new, old = f"{layout.path}/{name}", f"{staged}/rows/{name}", f"{staged}/old/{name}"
        if not files.exists(old):
            if files.exists(live):
                files.rename(live, old)
            else:
                files.folder(old)
        if files.exists(new):
            files.rename(new, live)
    files.delete(staged)

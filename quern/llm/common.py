"""What the operators of this subpackage share: inputs, intermediate tables, word hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Multipliers of the 64-bit mixing function.
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Rows that an Arrow batch of an operator's input holds at most. They decide on memory alone.
_BATCH_CONF, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only a purely local session, where driver and
    executors are one process, may fall back to a temporary folder, which is then set for later calls.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives executors.

    The driver's garbage is collected first, as Spark deletes the shuffle files of a finished query only when its plan is.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries deleted before the next large shuffle: the first collection only finds that their plans are gone."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later result reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table read in fewer partitions than there are cores over all of them, and hand it to Python in batches of ``_BATCH_ROWS`` rows.

    Spark's 10,000 rows are some 20 MB of texts, held by the executor and by each worker of it; a session that asks for fewer keeps its number.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= _BATCH_ROWS:
        conf.set(_BATCH_CONF, str(_BATCH_ROWS))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that a task's memory follows a few texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows whose texts in ``column`` have about ``most`` bytes, or one row."""
    for batch in slices(batches, rows):
        size = np.cumsum(np.fromiter((x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


class WordHash(dict):
    """64-bit hash of each word, remembered; emptied when it has grown to ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        for m in _MIX:
            values = (values ^ (values >> np.uint64(33))) * m
        return values ^ (values >> np.uint64(33))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words; of fewer words, the one of the whole run."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(n, k)
    with np.errstate(over="ignore"):
        acc = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            acc = acc * _BASE + words[i : n - size + 1 + i]
    return np.unique(mixed(acc))

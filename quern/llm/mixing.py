"""Mixing sources to target weights, with DataFrame functions only.

Weighted sampling without replacement after Efraimidis and Spirakis: each document draws an exponential key, divided by its
quality weight, and a source's documents are taken in the order of their keys until the source's token budget is used up.
A budget beyond the source's size first takes complete epochs of the whole source; only the fraction is selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources are broadcast when there are at most this many; beyond it the join is left to Spark.
BROADCAST_SOURCES = 10_000


def uniform(key: Column) -> Column:
    """A repeatable number in (0, 1) for a key: 48 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size and target of each row of ``sources`` (source, source_size).

    Sources in code-point order (null last) get the weights in turn. ``share`` times all sizes is dealt out by weight; what
    exceeds ``cap`` times a source's size is dealt again to the others. The level at which this settles is found without
    iteration: by rising cap per weight, the capped sources come first, and of the levels that leave the next source uncapped
    the first is the largest.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("turn", F.row_number().over(turn) - 1)
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double"))
    bounded = weighted.withColumn("bound", F.lit(cap) * F.col("source_size"))
    rising = Window.orderBy(F.col("bound") / F.col("weight"), "turn")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("budget") - F.col("capped")) / F.col("open")
    levels = (
        bounded.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("bound").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("bound"), level)).over(everything))
    )
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("bound")), F.col("bound"))
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: DataFrame | None = None, rows_per_bin: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs`` (doc_id, source, text).

    ``quality`` (doc_id, weight > 0) scales a document's chance; others weigh 1. A document is taken ``floor(target /
    source_size)`` whole epochs plus, in the order of the keys, as many of its words as the rest of the budget still holds: all,
    none, or for one document per source a part. So a source's taken words equal its target rounded to a word.

    A null or empty text has size 0 and takes 0; a source without words has target 0. A null source is a source of its own.
    Ties in the key fall to the smaller doc_id, then the smaller size; rows alike in all of these are interchangeable. Other
    columns are ignored; an empty table gives an empty result. No source is ever gathered in one task: keys are binned, the bins
    summed, and only the bin in which the budget ends is ordered.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"))
    if quality is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        best = quality.groupBy("doc_id").agg(F.max("weight").cast("double").alias("weight"))
        sized = sized.join(best, "doc_id", "left").withColumn("weight", F.coalesce(F.when(F.col("weight") > 0, F.col("weight")), F.lit(1.0)))
    drawn = sized.withColumn("key", -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / F.col("weight"))
    keyed = stored(drawn.drop("weight"))

    sources = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(
        targets.alias("t")
        .join(sources.select(F.col("source").alias("s"), "n_docs"), F.col("t.source").eqNullSafe(F.col("s")))
        .select("source", "source_size", "target", epochs.alias("epochs"), (F.round("target").cast("long") - epochs * F.col("source_size")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / rows_per_bin)).cast("long").alias("n_bins"))
    )
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = F.broadcast(plan) if few else plan

    def with_plan(df: DataFrame, *columns: str) -> DataFrame:
        own = plan.select(F.col("source").alias("plan_source"), *columns)
        return df.join(own, df["source"].eqNullSafe(F.col("plan_source"))).drop("plan_source")

    # 1 - exp(-key) rises with the key and is nearly uniform, so bins follow the order of the keys and are nearly even
    spot = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("n_bins")), F.col("n_bins") - 1).cast("long")
    binned = with_plan(keyed, "source_size", "target", "epochs", "rest", "n_bins").withColumn("bin", spot)
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.min("rest").alias("rest"))
    before = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")
    ends = (
        sums.withColumn("before", before)
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest")))
        .select(F.col("source").alias("end_source"), F.col("bin").alias("end_bin"), "before")
    )
    ends = F.broadcast(ends) if few else ends
    placed = binned.join(ends, binned["source"].eqNullSafe(F.col("end_source")), "left")
    whole = placed.filter(F.col("end_bin").isNull() | (F.col("bin") != F.col("end_bin")))
    whole = whole.withColumn("part", F.when(F.col("end_bin").isNull() & (F.col("rest") > 0) | (F.col("bin") < F.col("end_bin")), F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.col("before") - (F.sum("size").over(inside) - F.col("size"))
    last = placed.filter(F.col("bin") == F.col("end_bin")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    columns = ["doc_id", "size", "source_size", "target", taken]
    return whole.select(*columns).unionByName(last.select(*columns))

"""Mergeable summaries of a query log: one small row a day answers for any range of days without the log.

Both are Spark's own sketches. A day's row is written once; a report combines the rows of the days it asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Questions that a day's sketch keeps counts of.
TRACKED = 10_000
#: Size parameter of the quantile sketch.
QUANTILE_K = 400


def question_sketches(log: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """day, sketch and n of a log (ts, query): the frequent questions of each day, equal in their first 50 trimmed characters."""
    rows = log.filter("query IS NOT NULL").select(F.to_date("ts").alias("day"), F.substring(trimmed(F.col("query")), 1, 50).alias("question"))
    return rows.groupBy("day").agg(F.expr(f"approx_top_k_accumulate(question, {tracked})").alias("sketch"), F.count(F.lit(1)).alias("n"))


def frequent_questions(sketches: DataFrame, k: int = 5, tracked: int = TRACKED) -> DataFrame:
    """question, n and error: the ``k`` most frequent questions of all days in ``sketches``.

    A count is off by ``error`` at most, 3.5 times all rows over ``tracked`` (the sketch's guarantee): a question that occurs more often than twice that
    cannot be missing. Where the days hold no more different questions than three quarters of ``tracked``, counts are exact and ``error`` is no
    more than that bound. Ties go to the first question in the alphabet. No rows give no rows.
    """
    # a group of its own, since nothing can be combined from no sketches
    merged = sketches.groupBy(F.lit(1).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.sum("n").alias("rows"))
    items = merged.select("rows", F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("x"))
    return items.select(F.col("x.item").alias("question"), F.col("x.count").alias("n"), F.ceil(3.5 * F.col("rows") / tracked).alias("error")).orderBy(F.desc("n"), "question").limit(k)


def response_sketches(log: DataFrame, k: int = QUANTILE_K) -> DataFrame:
    """day and sketch of a log (ts, response_time): the distribution of each day's response times; null times do not count."""
    return log.filter("response_time IS NOT NULL").groupBy(F.to_date("ts").alias("day")).agg(F.kll_sketch_agg_double(F.col("response_time").cast("double"), k).alias("sketch"))


def response_quantiles(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """share, response_time and n for each share, from all days in ``sketches``; no rows give no rows.

    With the default size a result's share of smaller values is off by one hundredth at most in 99 of 100 sketches, however many values there are.
    """
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.count(F.lit(1)).alias("days")).filter("days > 0")
    quantile = lambda s: F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("response_time"))
    return merged.select(F.explode(F.array(*map(quantile, shares))).alias("q"), F.kll_sketch_get_n_double("sketch").alias("n")).select("q.*", "n")


def service_report(log: DataFrame, sketches: DataFrame) -> DataFrame:
    """Mean response time and the rates of a log, with the 95th percentile from its days' ``sketches`` instead of an exact one, which would hold all values."""
    from .catalog import service_metrics

    exact = service_metrics(log, percentile=False)
    tail = response_quantiles(sketches, (0.95,)).agg(F.round(F.max("response_time"), 3).alias("p95_ms"))
    return exact.join(tail)

"""Hard negatives from exact inner products: shared candidate lists for clusters of anchors, walked until certified.

Anchors that point the same way form a cluster. A block's candidates are sorted once for each cluster by an upper bound of their inner product with any unit vector of
the cluster: their length times the cosine of the angle to the cluster's centre less the widest angle of a member. Each member walks that list and stops
where its own length times the bound is below all that could still enter its result, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Candidates whose inner products a member computes between two looks at the bound.
_STEP = 1024
#: Inner products of doubles are exact below this.
_EXACT = 2.0**52
_LIMIT = 2**63 - 1


def whole_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers, given as doubles."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 1))


def products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where no sum can lose a bit, else as integers of any size."""
    most = np.abs(rows).max(initial=0) * np.abs(anchor).max(initial=0) * max(1, len(anchor))
    if most < _EXACT:
        return rows @ anchor
    as_whole = lambda a: np.array([int(x) for x in a.ravel()], object).reshape(a.shape)
    return as_whole(rows) @ as_whole(anchor)


def centres_of(sample: np.ndarray, clusters: int, rounds: int = 15) -> np.ndarray:
    """Unit vectors in the middle of groups of directions: seeded k-means on the sphere."""
    norm = np.linalg.norm(sample, axis=1)
    points = sample[norm > 0] / norm[norm > 0, None]
    if not len(points):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    centres = points[np.random.default_rng(5).choice(len(points), min(clusters, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


class SharedLists:
    """The candidates of a block with the list of each anchor cluster, sorted when it is first needed."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, centres: np.ndarray):
        self.ids, self.labels, self.rows, self.centres = ids, labels, rows, centres
        self.length = np.linalg.norm(rows, axis=1)
        self.walked = 0

    def of(self, centre: int, widest: float) -> tuple[np.ndarray, np.ndarray]:
        """Candidates in order of their bound, and the bounds, a little raised for rounding."""
        cosine = (self.rows @ self.centres[centre]) / np.maximum(self.length, 1e-300)
        apart = np.maximum(0.0, np.arccos(np.clip(cosine, -1, 1)) - widest)
        bound = self.length * (np.cos(apart) + 1e-7)
        bound[np.isnan(bound)] = np.inf  # lengths beyond doubles: nothing is known, so it comes first
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def walk(self, order: np.ndarray, bound: np.ndarray, anchor: np.ndarray, own: int, wanted: Wanted) -> None:
        """Offer the candidates of a list to ``wanted`` until what follows cannot enter."""
        length = float(np.linalg.norm(anchor))
        for at in range(0, len(order), _STEP):
            if length * bound[at] < wanted.floor():
                return
            part = order[at : at + _STEP]
            part = part[self.ids[part] != own]
            self.walked += len(part)
            wanted.offer(products(self.rows[part], anchor), self.ids[part])


class Wanted:
    """The best rows offered so far whose scores lie between ``least`` and ``most``: higher scores first, ties to the smaller id."""

    def __init__(self, size: int, slots: list[tuple[float, float]]):
        self.size, self.slots = size, slots
        self.best: list[list[tuple]] = [[] for _ in slots]

    def floor(self) -> float:
        """A score below this can enter nowhere."""
        return min((max(least, best[-1][0]) if len(best) == self.size else least for (least, _), best in zip(self.slots, self.best)), default=np.inf)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for slot, ((least, most), best) in enumerate(zip(self.slots, self.best)):
            edge = max(least, best[-1][0]) if len(best) == self.size else least
            if scores.dtype != object:
                edge, most = (float(min(max(x, -_LIMIT), _LIMIT)) for x in (edge, most))
            at = np.flatnonzero((scores >= edge) & (scores <= most))
            if len(at):
                if scores.dtype != object:
                    at = at[np.lexsort((ids[at], -scores[at]))[: self.size]]
                self.best[slot] = sorted([*best, *((int(s), i) for s, i in zip(scores[at].tolist(), ids[at].tolist()))], key=lambda x: (-x[0], x[1]))[: self.size]


def members(ids: np.ndarray, rows: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, float, np.ndarray]]:
    """Each cluster with the widest angle of its members and their places."""
    length = np.linalg.norm(rows, axis=1)
    cosine = np.nan_to_num((rows @ centres.T) / np.maximum(length, 1e-300)[:, None], nan=-1.0)
    nearest = cosine.argmax(axis=1)
    for c in np.unique(nearest):
        at = np.flatnonzero(nearest == c)
        yield int(c), float(np.arccos(np.clip(cosine[at, c], -1, 1)).max()), at


def searched(group: pa.Table, centres: np.ndarray, size: int, share: tuple[int, int] | None) -> tuple[list, ...]:
    """anchor, slot, score and id of what the anchors of a group find among its candidates.

    Without ``share`` these are the best rows of the anchor's own label. With it, for each of the anchor's positive scores p, the best rows of
    other labels with scores from share[0] / share[1] * p to p.
    """
    asks = group.column("ask").to_numpy()
    ids, labels = group.column("vec_id").to_numpy(), np.unique(np.array(group.column("label").to_pylist()), return_inverse=True)[1]
    rows = whole_matrix(group.column("v"))
    lists = SharedLists(ids[~asks], labels[~asks], rows[~asks], centres)
    places = np.flatnonzero(asks)
    positives = group.column("positives").to_pylist() if share else None
    out: tuple[list, ...] = ([], [], [], [])
    for centre, widest, at in members(ids[places], rows[places], centres) if len(places) and len(lists.ids) else ():
        order, bound = lists.of(centre, widest)
        here = places[at]
        for label in np.unique(labels[here]):
            pick = (lists.labels[order] == label) == (share is None)
            part, limits = order[pick], bound[pick]
            for i in here[labels[here] == label].tolist():
                if share is None:
                    slots = [(-np.inf, np.inf)]
                else:
                    # 100 s >= 80 p is s >= ceil(80 p / 100); a positive below 0 leaves no room
                    slots = [(-(-p * share[0] // share[1]) if p >= 0 else np.inf, p) for p in map(int, positives[i])]
                wanted = Wanted(size, slots)
                lists.walk(part, limits, rows[i], int(ids[i]), wanted)
                for slot, best in enumerate(wanted.best):
                    for score, found in best:
                        for column, value in zip(out, (int(ids[i]), slot, int(score), found)):
                            column.append(value)
    return out


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), clusters: int = 64, sample_rows: int = 20_000, block_rows: int = 32_768, anchor_rows: int = 65_536) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Of ``vectors`` (vec_id, label, embedding) each component x becomes floor(256 x). Rows whose vec_id is divisible by ``every`` are anchors; an anchor's positives are the
    ``positives`` other rows of its label with the largest inner product; for each positive follow the best ``negatives`` rows of other labels whose score is
    at least share[0] / share[1] of the positive's and at most the positive's. Higher scores come first, ties go to the smaller vec_id. Scores are whole numbers and compared
    exactly whatever their size; the columns are long, and a score beyond is shown as the nearest long.

    Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part, nor do those of another length than most. Rows
    that repeat a vec_id count as one (the first by label and value). A zero vector scores 0. Fewer rows than wanted are all
    returned; a positive without negatives gives no row; other columns are ignored; an empty table gives an empty result.

    Candidates are dealt once into blocks of about ``block_rows``; anchors go to every block, ``anchor_rows`` at a time, so a task holds one block and one group of anchors whatever the
    size of the table. Cluster centres come from at most ``sample_rows`` rows; they only decide how far the lists are walked.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.transform("embedding", lambda v: v.cast("double")).alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if common is None:
        return spark.createDataFrame([], columns)
    good = good.filter(F.size("v") == common["n"]).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    good = stored(good.mapInArrow(floored, good.schema))
    total = good.count()
    centres = centres_of(np.array([r["v"] for r in good.filter(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()] or np.empty((0, common["n"]))), clusters)
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-total // block_rows), min(cores, -(-total // 1024)))
    groups = -(-total // (every * anchor_rows))
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    several = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = good.select("vec_id", "label", "v", F.lit(False).alias("ask"), spot(blocks).alias("block"), several(groups).alias("part"))
    anchors = good.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "v", F.lit(True).alias("ask"), spot(groups).alias("part"))

    def found(asking: DataFrame, size: int, share: tuple[int, int] | None) -> DataFrame:
        def run(group: pa.Table) -> pa.Table:
            anchor, slot, score, other = searched(group, centres, size, share)
            return pa.table([pa.array(anchor, pa.int64()), pa.array(slot, pa.int32()), pa.array([str(s) for s in score], pa.string()), pa.array(other, pa.int64())], ["anchor_id", "slot", "score", "vec_id"])

        dealt = candidates.unionByName(asking.withColumn("block", several(blocks)), allowMissingColumns=True).repartition(max(cores, 2 * blocks * groups), "block", "part")
        rows = dealt.groupBy("block", "part").applyInArrow(run, "anchor_id long, slot int, score string, vec_id long")
        # scores are digits: below 0 last, then by how many there are, then digit by digit
        below, size_of = F.col("score").startswith("-"), F.length("score")
        order = Window.partitionBy("anchor_id", "slot").orderBy(below, F.desc(F.when(below, -size_of).otherwise(size_of)), F.when(below, F.col("score")), F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)

    best = stored(found(anchors, positives, None).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")))
    asked = best.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.col("positive_score").alias("p")))), lambda x: x["p"]).alias("positives"))
    asking = anchors.join(asked, anchors["vec_id"] == asked["anchor_id"]).drop("anchor_id")
    hard = found(asking, negatives, share).select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    shown = lambda c: F.coalesce(F.col(c).try_cast("long"), F.when(F.col(c).startswith("-"), F.lit(-_LIMIT)).otherwise(F.lit(_LIMIT))).alias(c)
    return hard.join(best, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", shown("positive_score"), shown("negative_score"))


def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors (last column) with floor(256 x) for each component x."""
    for batch in batches:
        v = batch.column(2)
        values = v.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            whole = np.minimum(np.maximum(np.floor(256 * values), -np.finfo(float).max), np.finfo(float).max)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, len(values) + 1, max(1, len(values) // max(1, len(v))), dtype=np.int32), pa.array(whole))], schema=batch.schema)

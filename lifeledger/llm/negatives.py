"""Hard-negative mining: threshold joins in the manner of L2AP over blocks of vectors.

Vectors are whole numbers, a score is an inner product. For every anchor first its best rows of the same label
(the positives) are found, then for each positive the best rows of another label whose scores lie in a window that
the positive's score sets. Both are one search: anchors with score windows, against all rows, for the ``k`` best
of each window. Rows are dealt to blocks by the hash of their id, anchors to chunks, and each pair of block and
chunk is one group of a cogrouped job:

* The index of a block holds, per dimension, the rows that have it indexed. Dimensions are ordered by their
  weight in the block. Of each row the light dimensions in front are left out as long as the norm of that part times
  the largest anchor norm stays below the threshold: alone they cannot reach it.
* Dimensions are accumulated from the heavy end, ``SEGMENT`` at a time. A pair goes once its partial score plus
  the product of the remaining norms stays below the anchor's threshold. When few pairs are left they are finished one by one.
* Thresholds start high and are lowered, for anchors whose windows are not full only, down to the windows' floor.
  Full windows raise their floor to their k-th score, for the following rows of the block.
* Before the search of all rows one over every ``SEED``-th row (by hash) gives each window a floor, so that the groups
  return few rows. A window that it can't fill keeps its own floor. It only saves work.

Results are exact; ties go to the smaller id. All anchors meet all rows, in blocks, since anchors are the stated
query set; no pair is a row before it is among the ``k`` best of its window in its block. Rows with a null id, label or
vector, or a component that is null or not finite, take no part. Of rows that share an id the one with the smallest label,
then the smallest vector, takes part. Missing components of a shorter vector are 0. Scores beyond 64 bits are cut to
their range in the output. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import by_value, stored

#: Most rows of a block and anchors of a chunk, and rows worth a block of their own while there are free tasks.
BLOCK_ROWS, CHUNK_ANCHORS, LEAST_ROWS = 1 << 17, 1 << 15, 1 << 11
#: Rows and anchors that are scored at once, and dimensions accumulated between two prunings.
ROWS_AT_ONCE, ANCHORS_AT_ONCE, SEGMENT = 4096, 512, 8
#: Thresholds as shares of the highest possible score, lowered in this order; then the floor.
LADDER = (0.5, 0.25, 0.125)
SEED = 32
#: Largest product of norms that doubles add up exactly.
EXACT = float(1 << 52)

POSITIVES, NEGATIVES = 5, 10
#: Window of negative scores, in percent of the positive's score.
LOWEST, HIGHEST = 30, 90


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector) that take part, one row per id."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(finite)
    one = F.min(F.struct(F.col("label").cast("long").alias("label"), v.alias("vector"))).alias("one")
    return rows.groupBy("vec_id").agg(one).select(F.col("vec_id").cast("long").alias("vec_id"), "one.label", "one.vector")


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """floor(256 x) of lists as rows of a matrix; whole numbers as doubles, or Python ones where doubles are too short."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(np.asarray(lists.flatten(), dtype=np.float64) * 256)
    out = np.zeros((len(n), width))
    if (n == width).all():
        return flat.reshape(len(n), width)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Index:
    """Postings of a block of rows for one threshold; rows sorted by the number of dimensions left out."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, largest: float, threshold: float):
        # norms[:, s] is the norm of the first s segments; leaving s out keeps every score below the threshold.
        out = (norms * largest < threshold).sum(axis=1) - 1 if threshold > 0 else np.zeros(len(x), int)
        self.order = np.argsort(out, kind="stable")
        self.out = out[self.order]
        self.x, self.norms = x[self.order], norms[self.order]

    def pairs(self, a: np.ndarray, a_norms: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) with a score of at least ``low`` of the anchor."""
        segments = self.norms.shape[1] - 1
        held = int(np.searchsorted(self.out, segments))
        score = np.zeros((len(a), held))
        for s in range(segments - 1, -1, -1):
            k = int(np.searchsorted(self.out, s, "right"))
            if k:
                at = slice(s * SEGMENT, (s + 1) * SEGMENT)
                score[:, :k] += a[:, at] @ self.x[:k, at].T
            rest = np.maximum(self.out[:held], s)
            reach = score + a_norms[:, rest] * self.norms[np.arange(held), rest] >= low[:, None] - 0.5
            if s == 0 or np.count_nonzero(reach) * 8 < reach.size:
                i, j = np.nonzero(reach)
                found = score[i, j]
                left = rest[j]
                for t in range(int(left.max(initial=0))):
                    some = left > t
                    at = slice(t * SEGMENT, (t + 1) * SEGMENT)
                    found[some] += np.einsum("ij,ij->i", a[i[some], at], self.x[j[some], at])
                hit = found >= low[i]
                return i[hit], self.order[j[hit]], found[hit]
        return np.empty(0, int), np.empty(0, int), np.empty(0)


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k first of each (anchor, window) by falling score, then id. ``found`` = anchor, window, id, score."""
    order = np.lexsort((found[2], -found[3], found[1], found[0]))
    found = [f[order] for f in found]
    new = np.ones(len(order), bool)
    new[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
    start = np.flatnonzero(new)
    rank = np.arange(len(order)) - start[np.cumsum(new) - 1]
    return [f[rank < k] for f in found]


def fill(
    rows: tuple[np.ndarray, np.ndarray, np.ndarray], anchors: tuple[np.ndarray, np.ndarray, np.ndarray],
    low: np.ndarray, high: np.ndarray, same: bool, k: int,
) -> list[np.ndarray]:
    """For each anchor and window the k best rows: arrays anchor, window, id, score.

    ``rows`` and ``anchors`` are (id, label, matrix); ``low`` and ``high`` have a row per anchor and a column per window,
    a window that does not exist has ``low`` above ``high``.
    """
    (ids, labels, x), (a_ids, a_labels, a) = rows, anchors
    low = low.copy()
    norms = np.sqrt(np.square(x).sum(axis=1)).max(initial=0.0) * np.sqrt(np.square(a).sum(axis=1)).max(initial=0.0)
    if norms < EXACT:
        weight = np.argsort(np.square(x).sum(axis=0), kind="stable")
        width = -(-max(x.shape[1], 1) // SEGMENT) * SEGMENT
        x, a = (np.pad(m[:, weight], ((0, 0), (width - m.shape[1], 0))) for m in (x, a))
        parts = lambda m: np.sqrt(np.cumsum(np.square(m).reshape(len(m), -1, SEGMENT).sum(axis=2), axis=1))
        x_norms, a_norms = (np.pad(parts(m), ((0, 0), (1, 0))) for m in (x, a))
    best = [np.empty(0, int), np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.float64 if norms < EXACT else object)]
    for at in range(0, len(a), ANCHORS_AT_ONCE):
        us = np.arange(at, min(at + ANCHORS_AT_ONCE, len(a)))
        mine = [b[:0] for b in best]
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = slice(start, start + ROWS_AT_ONCE)
            missing, floor = us, np.where(low[us] <= high[us], low[us], np.inf).min(axis=1)
            top = np.where(low[us] <= high[us], high[us], -np.inf).max(axis=1)
            if norms < EXACT:
                reach = a_norms[us, -1] * x_norms[part, -1].max(initial=0.0)
                top = np.minimum(top, reach)
                floor = np.maximum(floor, -reach - 1)
            new = [b[:0] for b in best]
            for share in (*LADDER, None) if norms < EXACT else (None,):
                open_ = np.isin(us, missing) & (floor <= top)
                chosen = us[open_]
                if not len(chosen):
                    break
                bound = floor[open_] if share is None else np.maximum(floor[open_], top[open_] * share)
                if norms < EXACT:
                    index = Index(x[part], x_norms[part], a_norms[chosen, -1].max(), bound.min())
                    i, j, score = index.pairs(a[chosen], a_norms[chosen], bound)
                else:
                    whole = np.array([[int(p) for p in r] for r in x[part]], object) @ np.array([[int(p) for p in r] for r in a[chosen]], object).T
                    j, i = (m.ravel() for m in np.indices(whole.shape))
                    score = whole.ravel()
                j = j + start
                fits = ((labels[j] == a_labels[chosen[i]]) == same) & (ids[j] != a_ids[chosen[i]])
                i, j, score = i[fits], j[fits], score[fits]
                full = np.ones(len(chosen), bool)
                found = [b[:0] for b in best]
                for w in range(low.shape[1]):
                    inside = (score >= low[chosen[i], w]) & (score <= high[chosen[i], w])
                    own = [chosen[i[inside]], np.full(int(inside.sum()), w), ids[j[inside]], score[inside]]
                    found = [np.concatenate([f, o]) for f, o in zip(found, own)]
                    have = np.bincount(i[inside], minlength=len(chosen))
                    full &= (have >= k) | (low[chosen, w] > high[chosen, w]) | (bound <= low[chosen, w])
                found = _best(found, k)
                done = full | (bound <= floor[open_])
                ends = np.isin(found[0], chosen[done])
                new = [np.concatenate([n, f[ends]]) for n, f in zip(new, found)]
                missing = chosen[~done]
            mine = _best([np.concatenate([m, n]) for m, n in zip(mine, new)], k)
            # The k-th score of a full window is its new floor.
            group = mine[0] * low.shape[1] + mine[1]
            last = np.flatnonzero(np.diff(group, append=-1) != 0)
            count = np.diff(last, prepend=-1)
            for r in last[count == k]:
                low[mine[0][r], mine[1][r]] = max(low[mine[0][r], mine[1][r]], mine[3][r])
        best = [np.concatenate([b, m]) for b, m in zip(best, mine)]
    return best


def search(rows: DataFrame, anchors: DataFrame, same: bool, k: int, block_rows: int = BLOCK_ROWS, chunk_anchors: int = CHUNK_ANCHORS) -> DataFrame:
    """(anchor_id, window, vec_id, score): of each window of each anchor the ``k`` best rows.

    ``rows`` has (vec_id, label, vector), ``anchors`` besides ``windows``, an array of (low, high) scores.
    ``same`` looks among rows of the anchor's label, else among rows of all others; the anchor itself is never found.
    """
    spark = rows.sparkSession
    free = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    # Rows of a label meet only anchors of that label, rows of a hot label are dealt to several blocks.
    buckets = max(-(-total // block_rows), min(free, -(-total // LEAST_ROWS)), 1) if same else 1
    least = min(max(-(-total // free), LEAST_ROWS), block_rows)
    if same:
        bucket = F.pmod(F.xxhash64("label"), F.lit(buckets))
        rows, anchors = rows.withColumn("bucket", bucket), anchors.withColumn("bucket", bucket)
        sizes = stored(
            rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(least)).alias("blocks")).join(
                anchors.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk_anchors)).alias("chunks")), "bucket"), "sizes"
        )
        rows, anchors = rows.join(sizes, "bucket"), anchors.join(sizes, "bucket")
    else:
        counts = {"bucket": 0, "blocks": max(-(-total // least), 1), "chunks": max(-(-anchors.count() // chunk_anchors), 1)}
        counts = {k: F.lit(v).cast("long") for k, v in counts.items()}
        rows, anchors = rows.withColumns(counts), anchors.withColumns(counts)
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["bucket", "block", "chunk"]
    left = rows.select("vec_id", "label", "vector", "bucket", part("blocks").alias("block"), every("chunks").alias("chunk"))
    right = anchors.select(
        F.col("vec_id").alias("a_id"), F.col("label").alias("a_label"), F.col("vector").alias("a_vector"), F.col("windows").alias("a_windows"),
        *[c.alias(f"a_{k}") for k, c in zip(keys, (F.col("bucket"), every("blocks"), part("chunks")))],
    )

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        lists = [t.column(name).combine_chunks() for t, name in ((one, "vector"), (two, "a_vector"))]
        width = max(int(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for x in lists)
        if not one.num_rows or not two.num_rows:
            found = [np.empty(0, int)] * 4
        else:
            sides = [
                (t[f"{name}_id"].to_numpy(), t[label].to_numpy(), _matrix(x, width))
                for t, name, label, x in ((one, "vec", "label", lists[0]), (two, "a", "a_label", lists[1]))
            ]
            windows = two["a_windows"].to_pylist()
            most = max(map(len, windows), default=0)
            low, high = np.full((len(windows), most), np.inf), np.full((len(windows), most), -np.inf)
            for r, own in enumerate(windows):
                for w, span in enumerate(own):
                    low[r, w], high[r, w] = span["low"], span["high"]
            found = fill(*sides, low, high, same, k)
            found[0] = sides[1][0][found[0]]
        score = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in found[3]], np.int64)
        return pa.table({
            "anchor_id": pa.array(found[0], pa.int64()), "window": pa.array(found[1], pa.int32()),
            "vec_id": pa.array(found[2], pa.int64()), "score": pa.array(score),
        })

    near = left.groupBy(*keys).cogroup(right.groupBy(*[f"a_{k}" for k in keys])).applyInArrow(run, "anchor_id bigint, window int, vec_id bigint, score bigint")
    return first_of(near, ["anchor_id", "window"], k, "rank")


def first_of(df: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The k rows of highest score, then smallest id, numbered from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks."""
    rows = stored(usable(vectors), "vectors")
    anchors = rows.where(anchor)
    everything = F.array(F.struct(F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high")))
    found = search(rows, anchors.withColumn("windows", everything), True, positives)
    # Window of each positive; the whole numbers in it, so that the bounds compare exactly.
    score = F.col("score")
    pairs = stored(found.select(
        "anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"),
        F.ceil(score * F.lit(lowest) / F.lit(100)).cast("double").alias("low"), F.floor(score * F.lit(highest) / F.lit(100)).cast("double").alias("high"),
    ), "positives")
    windowed = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("window", "low", "high"))), lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows")
    )
    asked = stored(anchors.join(windowed, "vec_id"), "asked")
    some = search(rows.where(F.pmod(F.hash("vec_id"), F.lit(SEED)) == 0), asked, False, negatives)
    floors = some.where(F.col("rank") == negatives).select(F.col("anchor_id").alias("vec_id"), F.struct(F.col("window").alias("w"), F.col("score").alias("s")).alias("floor"))
    floors = floors.groupBy("vec_id").agg(F.map_from_entries(F.collect_list("floor")).alias("floors"))
    raised = F.transform("windows", lambda w, i: F.struct(F.greatest(w["low"], F.element_at("floors", i).cast("double")).alias("low"), w["high"].alias("high")))
    sharper = stored(asked.join(floors, "vec_id", "left").withColumn("windows", raised).drop("floors"), "sharper")
    best = search(rows, sharper, False, negatives)
    return best.join(pairs, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """The contract's labels: every seventh vector takes the next one."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


by_value(__name__)

#: All anchors against all rows.
SQL = """WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, v) AS k FROM u),
  r AS (SELECT vec_id, label, list_transform(v, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM o WHERE k = 1),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
      CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER
    (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) t WHERE k <= 5),
  n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER
    (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

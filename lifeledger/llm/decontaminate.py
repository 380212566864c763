"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Texts are lower-cased and cut into runs of letters and digits. A seed is the hash of ``WORDS`` adjacent
words. An equi join on seeds gives, for each pair of document and test item, the document positions at
which some seed of the item starts, each with one place in the item that holds it. From these places a
task lays out the stretches of the document that the item may match, and tiles the pair: the longest
match of unmarked words is marked again and again until none of at least ``WORDS`` words is left. The
longest match is looked for by Karp-Rabin hashes of all unmarked windows of one length, which follow from
running sums, and by halving the range of lengths; a match is marked only after its words were compared.
The share of the item's words under tiles is its coverage. The order of tiles plays no part, so a
passage whose sentences were moved around is caught as well.

Seeds meet by an equi join, so only documents that share a seed with an item leave their task. The test
items are broadcast only if their seeds have been counted to be few. Each pair is tiled on its own, so
a passage in a third of all documents is spread like any other. A pair holds at most one place for each
position of its document, however often a passage is repeated in either text, and its tiling needs memory
in proportion to the two texts.

Null and empty texts match nothing; items with fewer words than a seed match a document only as a
whole item of that many adjacent words. Items without words are never covered. Words are compared as
64-bit hashes. Rows with a null id take no part. Repeated rows count once. Of different texts that share
an id, of documents or of items, the pair of the highest coverage is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import bounded, by_value

#: Words of a seed, which is also the shortest tile; share of the item that must be covered.
WORDS = 5
COVERAGE = 0.6
#: Base of the Karp-Rabin hashes and its inverse, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _hashes(text: Column) -> Column:
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seeds(hashes: str, n: int) -> Column:
    """Array of the hashes of all windows of ``n`` words, by position."""
    found = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - n),
        lambda i: F.xxhash64(F.lit(n), *[F.get(hashes, i + k) for k in range(n)]),
    )
    return F.when(F.size(hashes) >= n, found).otherwise(F.array().cast("array<bigint>"))


class Windows:
    """Karp-Rabin hashes of the unmarked windows of a sequence of words."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        powers = np.cumprod(np.full(len(words), BASE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.view(np.uint64) * powers)])
        self.shift = np.cumprod(np.full(len(words), INVERSE, np.uint64))

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of ``n`` unmarked words, in order, and their hashes."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        starts = np.flatnonzero(marked[n:] == marked[:-n])
        return starts, (self.sums[starts + n] - self.sums[starts]) * self.shift[starts]


def tiles(doc: np.ndarray, item: np.ndarray, least: int, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length) of two arrays of word hashes.

    Of equally long matches the one first in the document, then in the item, is marked. Words that are not
    ``free`` belong to no tile of the document.
    """
    one = Windows(doc, np.ones(len(doc), bool) if free is None else free.copy())
    two = Windows(item, np.ones(len(item), bool))
    shared = lambda n: bool(np.isin(two.hashes(n)[1], one.hashes(n)[1]).any())
    out: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= least and shared(least):
        # A match holds shorter ones, so the longest is found by halving.
        n, high = least, most
        while n < high:
            middle = (n + high + 1) // 2
            n, high = (middle, high) if shared(middle) else (n, middle - 1)
        _mark(one, two, n, out)
        most = n - 1
    return out


def _mark(one: Windows, two: Windows, n: int, out: list[tuple[int, int, int]]) -> None:
    """Mark all matches of ``n`` words, of which none is longer, in order."""
    starts, hashes = two.hashes(n)
    places: dict[int, list[int]] = {}
    for i, h in zip(starts[::-1].tolist(), hashes[::-1].tolist()):
        places.setdefault(h, []).append(i)
    starts, found = one.hashes(n)
    known = np.isin(found, hashes)
    for d, h in zip(starts[known].tolist(), found[known].tolist()):
        left = places[h]
        # Marks are never taken back, so a place that is marked in part is gone for good.
        while left and not two.free[left[-1] : left[-1] + n].all():
            left.pop()
        if not left or not one.free[d : d + n].all():
            continue
        for i in reversed(left):
            if two.free[i : i + n].all() and np.array_equal(one.words[d : d + n], two.words[i : i + n]):
                one.free[d : d + n] = two.free[i : i + n] = False
                out.append((d, i, n))
                break


def _tiled(doc_at: np.ndarray, item_at: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles of a pair, whose document is known by its seed places only: a word that no seed holds ends a match."""
    steps = np.arange(least)
    at, first = np.unique((doc_at[:, None] + steps).ravel(), return_index=True)
    held = item[(item_at[:, None] + steps).ravel()[first]]
    # Words that lie apart are laid out with one marked word between them.
    local = np.arange(len(at)) + np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
    size = int(local[-1]) + 1
    words, free, origin = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, np.int64)
    words[local], free[local], origin[local] = held, True, at
    return [(int(origin[d]), i, n) for d, i, n in tiles(words, item, least, free)]


def overlaps(docs: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each pair that shares a seed: ids, number of tiles, words covered, item words, coverage, tiles.

    ``tiles`` lists document position, item position and length of each tile, in words from 0.
    """
    tests = items.select(F.col(item_col).alias("item"), _hashes(F.col(item_text_col)).alias("hashes")).select(
        "item", F.xxhash64("hashes").alias("item_key"), "hashes", F.size("hashes").alias("item_words")
    ).where("item IS NOT NULL AND item_words > 0")
    whole = F.least(F.col("item_words"), F.lit(words))
    every = F.lit(None).cast("array<bigint>")
    for n in range(1, words + 1):
        every = F.when(whole == n, _seeds("hashes", n)).otherwise(every)
    index = tests.select("item", "item_key", F.posexplode(every).alias("item_at", "seed"))
    # One place of a seed stands for all: it tells the words, and the tiling finds the other places.
    index = index.groupBy("item", "item_key", "seed").agg(F.min("item_at").alias("item_at"))
    # Short items need their own, shorter windows over the documents.
    sizes = sorted(r[0] for r in tests.select(whole.alias("n")).distinct().collect())
    texts = docs.select(F.col(id_col).alias("doc"), _hashes(F.col(text_col)).alias("hashes")).where("doc IS NOT NULL")
    texts = texts.withColumn("doc_key", F.xxhash64("hashes"))
    index = bounded(index)
    pairs = None
    for n in sizes or [words]:
        seeds = texts.select("doc", "doc_key", F.posexplode(_seeds("hashes", n)).alias("doc_at", "seed"))
        found = seeds.join(index, "seed").select("doc", "doc_key", "item", "item_key", "doc_at", "item_at")
        pairs = found if pairs is None else pairs.unionByName(found)
    grouped = pairs.groupBy("doc", "doc_key", "item", "item_key").agg(
        F.collect_set(F.struct("doc_at", "item_at")).alias("places")
    )
    held = bounded(tests.dropDuplicates(["item", "item_key"]))
    grouped = grouped.join(held, ["item", "item_key"]).select("doc", "item", "item_words", "hashes", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = []
            for n, item, places in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                at = places.values.flatten()
                marked.append(_tiled(np.asarray(at[0]), np.asarray(at[1]), np.asarray(item.values), min(n, words)))
            listed = pa.array(
                [[{"doc_at": d, "item_at": i, "length": n} for d, i, n in sorted(x)] for x in marked],
                pa.list_(pa.struct([(name, pa.int64()) for name in ("doc_at", "item_at", "length")])),
            )
            covered = [sum(n for *_, n in x) for x in marked]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in marked], pa.int64()),
                 pa.array(covered, pa.int64()), batch.column(2).cast(pa.int64()), listed],
                names=["doc", "item", "n_tiles", "covered_words", "item_words", "tiles"],
            )

    kinds = dict(grouped.dtypes)
    tiled = grouped.mapInArrow(
        run, f"doc {kinds['doc']}, item {kinds['item']}, n_tiles bigint, covered_words bigint, item_words bigint, "
        "tiles array<struct<doc_at:bigint,item_at:bigint,length:bigint>>"
    )
    best = F.max(F.struct(
        (F.col("covered_words") / F.col("item_words")).alias("coverage"), "n_tiles", "covered_words", "item_words", "tiles"
    )).alias("best")
    return tiled.groupBy("doc", "item").agg(best).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col),
        *[f"best.{c}" for c in ("n_tiles", "covered_words", "item_words", "coverage", "tiles")],
    )


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, **columns: str) -> DataFrame:
    """The pairs of ``overlaps`` whose item is covered to at least ``coverage``."""
    return overlaps(docs, items, **columns).where(F.col("coverage") >= coverage)


by_value(__name__)

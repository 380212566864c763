"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

A document is the set of its distinct word shingles, as 64-bit hashes. Equal sets form one class, of
which the smallest id stands for all. Sets are ordered by one global order that puts shingles known to
be frequent last. Two sets with a Jaccard similarity of ``percent`` must share at least one of their
first n - T + 1 shingles, where T is the overlap that any partner must reach; so the T - 1 longest
lists of a document are set aside and only its short ones are merged:

1. Short lists are merged in their order and counted per pair. A pair stays if its count, with all it
   could still gain from the lists set aside, reaches the required overlap.
2. Long lists (longer than ``SHORT``, or of a frequent shingle) are never paired out. Their members
   are compared with the first and last of the list only.
3. The pairs that stay are decided exactly, by binary search of the smaller set in the larger one.
4. Links so far are closed to components. What long lists may still hold is pairs across components;
   the merged shingles a document has outside them bound its partners' sizes, and similarity distance
   is a metric, so the distances to the list's first and last member exclude pairs, for whole
   components first and for single members then. The pairs not excluded are decided exactly.

No link between different texts is lost. The frequent shingles come from a bounded sample; they only
choose the order, which the result does not depend on. Null and empty texts have no shingles and no
links. A text of fewer words than a shingle is one shingle. Repeated rows and copies share a class.
Further columns are ignored. Rows with a null id keep it and have no component.

The method departs from DivideSkip in two points, both without loss: short lists are not merged with a heap, they are
paired out within a bound and counted, and long lists are not probed by binary search for each candidate; pairs
of their members are excluded by distances or decided exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifeledger.llm.common import bounded, by_value, stored
from lifeledger.llm.components import components

WORDS = 5
PERCENT = 75
#: Longest list whose pairs are formed; documents sampled for the order; most frequent shingles named.
SHORT = 128
ORDER_SAMPLE = 16_384
FREQUENT = 500_000
#: Distinct words whose hashes a task remembers; pairs handed on at once.
WORD_CACHE = 500_000
PAIRS_OUT = 1 << 19


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.known, self.hash = words, {}, xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        # Bytes are lower-cased and split at white space in ASCII only.
        parts = (text or "").encode().lower().split()
        if not parts:
            return np.empty(0, np.int64)
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known = self.known
        for w in parts:
            if w not in known:
                known[w] = self.hash(w)
        one = np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))
        k = min(self.words, len(parts))
        out = np.full(len(parts) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + one[j : len(one) - k + 1 + j]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        return np.unique(out.view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *values]))


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, shingles) for (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(words)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists([sets(x) for x in part.column(1).to_pylist()])], names=["id", "shingles"]
                )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, shingles array<bigint>")


def frequent_shingles(docs: DataFrame, words: int, sample: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles whose lists a sample of documents shows to be long, and their ranks, rarest first."""
    every = max(1, docs.count() // sample)
    least = max(3, short // (2 * every))
    some = shingle_sets(docs.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), words)
    top = some.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= least)
    rows = top.orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    often, counts = np.asarray(rows.column(0)), np.asarray(rows.column(1))
    order = np.argsort(often)
    ranks = np.empty(len(often), np.int64)
    ranks[np.lexsort((often[order], counts[order]))] = np.arange(len(often))
    return often[order], ranks


def signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """Set size, class hashes and the shingles to merge, split into cold and frequent, of each (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sets, (often, ranks) = Shingler(words), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                n, c1, c2, cold, hot = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    s = sets(text)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                    at = np.minimum(np.searchsorted(often, s), max(len(often) - 1, 0))
                    is_hot = often[at] == s if len(often) else np.zeros(len(s), bool)
                    last = s[is_hot][np.argsort(ranks[at[is_hot]])] if is_hot.any() else s[:0]
                    first = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    n.append(len(s))
                    c1.append(digest[0])
                    c2.append(digest[1])
                    cold.append(s[~is_hot][:first])
                    hot.append(last[: first - len(cold[-1])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                     _lists(cold), _lists(hot)],
                    names=["id", "n", "c1", "c2", "cold", "hot"],
                )

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, n int, c1 bigint, c2 bigint, cold array<bigint>, hot array<bigint>")


def _list_pairs(entries: DataFrame, short: int, percent: int) -> DataFrame:
    """Walk entries (s, id, n, slack), sorted by s: pairs (a, b, ...) of short lists; members of long ones.

    A member of a long list comes out with its shingle in ``s`` and no b.
    """

    def pairs_of(size: int, starts: np.ndarray, cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        i, j = np.triu_indices(size, 1)
        step = max(1, PAIRS_OUT // len(i))
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None]
            left, right = (at + i).ravel(), (at + j).ravel()
            n = cols[2]
            near = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
            near &= cols[1][left] != cols[1][right]
            left, right = left[near], right[near]
            yield [cols[1][left], cols[1][right], n[left], n[right], cols[3][left], cols[3][right]]

    def batch_of(pair: list[np.ndarray]) -> pa.RecordBatch:
        nulls = pa.nulls(len(pair[0]), pa.int64())
        return pa.RecordBatch.from_arrays(
            [nulls, *[pa.array(x) for x in pair]], names=["s", "a", "b", "na", "nb", "slack_a", "slack_b"]
        )

    def members(cols: list[np.ndarray]) -> pa.RecordBatch:
        size = len(cols[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0]), pa.array(cols[1]), pa.nulls(size, pa.int64()), pa.array(cols[2]),
             pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32())],
            names=["s", "a", "b", "na", "nb", "slack_a", "slack_b"],
        )

    def walk(cols: list[np.ndarray], last: bool, long_one: list) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
        """Batches for the lists that are complete, and the entries to carry over."""
        out: list[pa.RecordBatch] = []
        starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(cols[0])]]))
        if long_one and cols[0][0] != long_one[0]:
            long_one.clear()
        whole = np.ones(len(starts), bool)
        whole[-1] = last
        is_long = sizes > short
        if long_one:
            is_long[0] = True
        for k in np.flatnonzero(is_long):
            out.append(members([c[starts[k] : starts[k] + sizes[k]] for c in cols]))
        if is_long[-1]:
            long_one[:] = [cols[0][-1]]
            carry = [c[:0] for c in cols]
        else:
            carry = [c[:0] if last else c[starts[-1] :] for c in cols]
        for size in np.unique(sizes[whole & ~is_long & (sizes > 1)]):
            for pair in pairs_of(int(size), starts[whole & ~is_long & (sizes == size)], cols):
                out.append(batch_of(pair))
        return out, carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        long_one: list = []
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if carry is not None and len(carry[0]):
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            if len(cols[0]):
                out, carry = walk(cols, False, long_one)
                yield from out
        if carry is not None and len(carry[0]):
            yield from walk(carry, True, long_one)[0]

    return entries.repartition("s").sortWithinPartitions("s", "id").mapInArrow(
        run, "s bigint, a bigint, b bigint, na int, nb int, slack_a int, slack_b int"
    )


def _verified(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(a, b, na, nb, both): exact overlap of each pair (a, b)."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(shingle_sets(docs.join(bounded(ids), "id", "left_semi"), words).dropDuplicates(["id"]), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, both = [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.asarray(x.values), np.asarray(y.values)
                na.append(len(x))
                nb.append(len(y))
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(many, few)
                both.append(int((many[np.minimum(at, len(many) - 1)] == few).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in (na, nb, both)]],
                names=["a", "b", "na", "nb", "both"],
            )

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, both bigint")


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _similar_sizes(m: Column, n: Column, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _short_candidates(lists: DataFrame, lost: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists whose count, and what the lists set aside could add, reach the required overlap.

    A shared shingle that is merged for one document only lies beyond the merged ones of the other.
    ``lost`` counts the shingles (id, extra) of a document whose lists turned out long.
    """
    pairs = lists.where("b IS NOT NULL").groupBy("a", "b", "na", "nb", "slack_a", "slack_b").agg(
        F.count(F.lit(1)).alias("shared")
    )
    lost = bounded(lost)
    for side in "ab":
        more = lost.select(F.col("id").alias(side), F.col("extra").alias(f"extra_{side}"))
        pairs = pairs.join(more, side, "left")
    aside = lambda n: F.floor((percent * F.col(n) + 99) / 100) - 1
    gain = F.least(*[F.col(f"slack_{s}") + F.coalesce(F.col(f"extra_{s}"), F.lit(0)) for s in "ab"])
    most = F.col("shared") + gain + F.greatest(aside("na"), aside("nb"))
    return pairs.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _members(docs: DataFrame, lost: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Entries (s, id, n, most) of long lists that could still hold a link; ``most`` is the largest partner.

    A pair that shares a short list is settled there. Any other pair shares none of the shingles that
    were merged for either side, so its overlap is at most what they leave of each set. That bounds
    the size of a partner, and whoever fits no other size in a list leaves it.
    """
    docs = docs.join(lost, "id", "left").select(
        "id", "n", F.floor(
            (100 + percent) * (F.col("n") - F.col("merged") + F.coalesce("extra", F.lit(0))) / percent - F.col("n")
        ).cast("int").alias("most")
    )
    rows = lists.join(docs, "id")
    least = rows.groupBy("s").agg(F.min("n").alias("least"), F.max("most").alias("best"))
    return rows.join(least, "s").where("most >= least AND n <= best").select("s", "id", "n", "most")


def _ends(members: DataFrame) -> DataFrame:
    """First and last member of each list of more than one."""
    return members.groupBy("s").agg(
        F.min(F.struct("id", "n", "most")).alias("first"), F.max(F.struct("id", "n", "most")).alias("last")
    ).where("first.id != last.id")


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    ends = _ends(members).select("s", F.explode(F.array("first", "last")).alias("p"))
    pairs = members.join(ends, "s").where("id != p.id AND n <= p.most AND p.n <= most").where(_similar_sizes(F.col("n"), F.col("p.n"), percent))
    return pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _cross_pairs(members: DataFrame, checked: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists in different components that the distances to both list ends do not exclude."""
    most = (100 - percent) / 100 + 1e-9
    away = checked.select("a", "b", (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("d"))
    away = away.unionByName(away.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    rows = members.join(nodes.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    mixed = rows.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    rows = rows.join(mixed.select("s"), "s").join(_ends(members), "s")
    for end, d in (("first", "d1"), ("last", "d2")):
        to_end = away.select(F.col("a").alias("id"), F.col("b").alias("end"), F.col("d").alias("d"))
        rows = rows.withColumn("end", F.col(f"{end}.id")).join(to_end, ["id", "end"], "left").withColumn(
            d, F.when(F.col("id") == F.col("end"), 0.0).otherwise(F.col("d"))
        ).drop("end", "d")
    rows = stored(rows.select("s", "id", "n", "most", "component", "d1", "d2"), "long-lists")
    spans = [F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("most").alias("most")]
    for d in ("d1", "d2"):
        spans += [F.min(F.coalesce(d, F.lit(0.0))).alias(f"{d}0"), F.max(F.coalesce(d, F.lit(1.0))).alias(f"{d}1")]
    groups = rows.groupBy("s", "component").agg(*spans)
    x, y = groups.alias("x"), groups.alias("y")
    apart = lambda d: (F.col(f"x.{d}0") - F.col(f"y.{d}1") > most) | (F.col(f"y.{d}0") - F.col(f"x.{d}1") > most)
    close = x.join(y, F.col("x.s") == F.col("y.s")).where("x.component < y.component").where(
        ~apart("d1") & ~apart("d2") & (100 * F.col("x.n1") >= percent * F.col("y.n0"))
        & (100 * F.col("y.n1") >= percent * F.col("x.n0"))
    ).where("x.n0 <= y.most AND y.n0 <= x.most").select(
        "x.s", F.col("x.component").alias("cx"), F.col("y.component").alias("cy"),
        # A member has to suit the whole other component before it is paired with its members.
        *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("n0", "most", "d10", "d11", "d20", "d21")],
    )
    mine = rows.select("s", F.col("component").alias("cx"), F.col("id").alias("i"), F.col("n").alias("ni"),
                       F.col("most").alias("mi"), F.col("d1").alias("i1"), F.col("d2").alias("i2"))
    other = rows.select("s", F.col("component").alias("cy"), F.col("id").alias("j"), F.col("n").alias("nj"),
                        F.col("most").alias("mj"), F.col("d1").alias("j1"), F.col("d2").alias("j2"))
    within = lambda p, q: F.coalesce(F.abs(F.col(p) - F.col(q)) <= most, F.lit(True))
    suits = lambda n, m, one, two, side: (
        (F.col(n) <= F.col(f"{side}_most")) & (F.col(f"{side}_n0") <= F.col(m))
        & F.coalesce(F.col(one).between(F.col(f"{side}_d10") - most, F.col(f"{side}_d11") + most), F.lit(True))
        & F.coalesce(F.col(two).between(F.col(f"{side}_d20") - most, F.col(f"{side}_d21") + most), F.lit(True))
    )
    halves = close.join(mine, ["s", "cx"]).where(suits("ni", "mi", "i1", "i2", "y"))
    whole = halves.join(other, ["s", "cy"]).where(suits("nj", "mj", "j1", "j2", "x"))
    pairs = whole.where("ni <= mj AND nj <= mi").where(
        within("i1", "j1") & within("i2", "j2") & _similar_sizes(F.col("ni"), F.col("nj"), percent)
    )
    pairs = pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    return pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether any id names more than one row."""
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count()
    return not ids.where("count > 1").isEmpty()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
            percent: int = PERCENT, short: int = SHORT, sample: int = ORDER_SAMPLE) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id``, the smallest id reachable by links, of every row.

    Where ids repeat or are no whole numbers, a 64-bit hash of id and text stands for the row, so rows that share
    an id but not a text have links of their own.
    """
    docs = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    plain = isinstance(docs.schema["own"].dataType, T.IntegralType) and not ids_repeat(docs, "own")
    key = F.col("own").cast("long") if plain else F.when(F.col("own").isNotNull(), F.xxhash64("own", "text"))
    keyed = docs.select(key.alias("id"), "text", "own")
    found = _classes(keyed.select("id", "text"), words, percent, short, sample)
    if plain:
        return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")
    found, names = stored(found, "found"), keyed.select("id", "own").where("id IS NOT NULL").distinct()
    named = found.join(names, "id", "left")
    least = named.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min("own").alias("least"))
    return named.join(least, "component_id", "left").select(
        F.col("own").alias(id_col), "n_shingles", F.col("least").alias("component_id")
    )


def _classes(docs: DataFrame, words: int, percent: int, short: int, sample: int) -> DataFrame:
    """id, n_shingles and component_id of rows (id, text), whose ids differ or stand for the same text."""
    known = docs.where("id IS NOT NULL")
    frequent = frequent_shingles(known, words, sample, short)
    signed = stored(signatures(docs, frequent, words, percent), "signatures")
    reps = stored(
        signed.where("n > 0 AND id IS NOT NULL").groupBy("c1", "c2", "n").agg(F.min("id").alias("rep")), "classes"
    )
    mine = signed.join(
        bounded(reps.select(F.col("rep").alias("id"), "c1", "c2", "n")), ["id", "c1", "c2", "n"], "left_semi"
    ).dropDuplicates(["id"]).select("id", "n", F.size("hot").alias("slack"), "cold", "hot")
    lists = stored(
        _list_pairs(mine.select(F.explode("cold").alias("s"), "id", "n", "slack"), short, percent), "lists"
    )
    turned_long = lists.where("b IS NULL").select("s", F.col("a").alias("id"), F.col("na").alias("n"))
    lost = turned_long.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("extra"))
    members = stored(_members(
        mine.select("id", "n", F.size("cold").alias("merged")), lost,
        mine.select(F.explode("hot").alias("s"), "id").unionByName(turned_long.select("s", "id")), percent,
    ), "long-members")
    pairs = _short_candidates(lists, lost, percent).unionByName(_star_pairs(members, percent)).distinct()
    checked = stored(_verified(stored(pairs, "pairs"), known, words), "checked")
    links = checked.where(_linked(percent)).select("a", "b")
    nodes = components(links)
    rest = stored(_cross_pairs(members, checked, nodes, percent), "pairs")
    if not rest.isEmpty():
        more = stored(_verified(rest, known, words).where(_linked(percent)).select("a", "b"), "links")
        if not more.isEmpty():
            nodes = components(links.unionByName(more))
    whole = reps.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").select(
        "c1", "c2", "n", F.coalesce("component", "rep").alias("component")
    )
    return signed.select("id", "n", "c1", "c2").join(whole, ["c1", "c2", "n"], "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


by_value(__name__)

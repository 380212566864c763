"""Substring deduplication by seed and extend: repeats of ``WINDOW`` or more words that an earlier document has.

1. Anchors. Of the ``GRAM``-word sequences of every window the one with the least hash is the window's anchor
   (winnowing; the first of equal ones). It depends on the window's words only, so a window that two documents
   share has the same anchor in both, and about one place in five is an anchor.
2. Seeds. Documents are joined on anchors: an anchor that two documents hold is a seed at each of its places.
3. Extension. Each seed is extended to both sides, over every window that it is the anchor of, and the windows are
   matched with the smallest id that holds the same one.
4. Windows of a document that a smaller id holds as well are merged to its maximal repeats, and covered.

Counts of documents per anchor and smallest ids per window are aggregates with partial sums in each task, so a
passage of a third of all documents makes neither pairs nor a large group; the joins back to the places read
stored tables, so that adaptive execution splits a hot key. A seed only selects windows; windows are equal if
their 64-bit hashes are. Nothing is capped.

Windows of rows with the same id do not remove each other; such rows keep their own texts and may differ. Null and empty texts
have no words; a text of fewer words than a window has no window. A row without id removes nothing and loses
nothing. Further columns are ignored unless they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import bounded, by_value, stored
from lifeledger.llm.wordhash import Powers, Words, gram_hashes, least_of, parts

WINDOW = 13
GRAM = 5


def _lengths(lists: pa.ListArray) -> np.ndarray:
    """Lengths of the lists; 0 for null."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _marked(runs: pa.ListArray, first: np.ndarray, size: int, longer: int = 0) -> np.ndarray:
    """True at the places in the rows' runs, each run ``longer`` by some; row r begins at place first[r]."""
    ends = np.asarray(runs.flatten()).reshape(-1, 2) + np.repeat(first, _lengths(runs) // 2)[:, None]
    depth = np.zeros(size + 1, int)
    np.add.at(depth, ends[:, 0], 1)
    np.add.at(depth, ends[:, 1] + 1 + longer, -1)
    return np.cumsum(depth[:-1]) > 0


def runs_of(lists: DataFrame, name: str) -> DataFrame:
    """Replace lists of whole numbers by their runs: first and last of each stretch of successive numbers.

    Shared anchors and covered windows come in stretches, so a document's list becomes a few numbers.
    """
    keys = [c for c in lists.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(name))
            size = _lengths(column)
            row, value = np.repeat(np.arange(len(size)), size), np.asarray(column.flatten())
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            breaks = np.flatnonzero((np.diff(row) != 0) | (np.diff(value) != 1))
            first, last = np.append([0], breaks + 1)[: len(value)], np.append(breaks, len(value) - 1)[: len(value)]
            ends = np.column_stack([value[first], value[last]]).ravel().astype(np.int32)
            offsets = 2 * np.searchsorted(row[first], np.arange(len(size) + 1))
            packed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], packed], names=[*keys, name])

    ordered = lists.select(*keys, name)
    kinds = dict(ordered.dtypes)
    return ordered.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{name} array<int>"]))


def _anchored(table: Words, window: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's anchor, and the hash at every place."""
    grams = gram_hashes(table.hashes, gram, powers)
    span = window - gram + 1
    if len(grams) < span:
        return np.empty(0, int), np.empty(0, int), grams
    least = least_of(grams, span)
    anchor = np.zeros(len(least), int)
    for shift in range(span - 1, -1, -1):
        anchor = np.where(grams[shift : shift + len(least)] == least, shift, anchor)
    # Windows that reach over the end of a row are none.
    inside = np.zeros(len(least) + 1, int)
    has = table.counts() >= window
    np.add.at(inside, table.first[:-1][has], 1)
    np.add.at(inside, np.minimum(table.first[1:][has] - window + 1, len(least)), -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    return starts, starts + anchor[starts], grams


def _rows(docs: DataFrame) -> DataFrame:
    """(id, tag, text) of rows with an id. The tag tells rows of one id apart, and is 0 if no id repeats."""
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    repeated = known.groupBy("doc_id").count().where("count > 1").limit(1).count()
    tag = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return known.withColumn("tag", tag).select("doc_id", "tag", "text")


def anchors(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(anchor, doc_id, tag, place) of every anchor of (doc_id, tag, text); places number a text's anchors from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in parts(batch, 2):
                table = Words(part.column(2), powers)
                _, anchor, grams = _anchored(table, window, gram, powers)
                chosen = np.zeros(len(grams), bool)
                chosen[anchor] = True
                place = np.flatnonzero(chosen)
                row = np.searchsorted(table.first, place, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[place].view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array((np.arange(len(place)) - np.searchsorted(place, table.first)[row]).astype(np.int32))],
                    names=["anchor", "doc_id", "tag", "place"],
                )

    return rows.mapInArrow(run, f"anchor bigint, doc_id {dict(rows.dtypes)['doc_id']}, tag bigint, place int")


def extended(seeded: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(hash, doc_id, tag, start) of every window over a seed, from (doc_id, tag, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in parts(batch, 2):
                table = Words(part.column(2), powers)
                starts, anchor, grams = _anchored(table, window, gram, powers)
                places = np.unique(anchor)
                seeds = np.zeros(len(grams), bool)
                seeds[places] = _marked(part.column(3), np.searchsorted(places, table.first[:-1]), len(places))
                starts = starts[seeds[anchor]]
                hashes = gram_hashes(table.hashes, window, powers)[starts]
                row = np.searchsorted(table.first, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array((starts - table.first[row]).astype(np.int32))],
                    names=["hash", "doc_id", "tag", "start"],
                )

    return seeded.mapInArrow(run, f"hash bigint, doc_id {dict(seeded.dtypes)['doc_id']}, tag bigint, start int")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept_text) of every row.

    ``repeats`` holds (start, length) of each maximal repeat, in word numbers; ``kept_text`` is the other words
    joined by one space.
    """
    rows = _rows(docs)
    keys = ["doc_id", "tag"]
    found = anchors(rows, window, gram)
    seeds = stored(
        found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "seeds"
    )
    # A document's places, at most one for each of its words.
    places = found.join(seeds.hint("merge"), "anchor").groupBy(*keys).agg(F.collect_list("place").alias("places"))
    places = stored(runs_of(places, "places"), "places")
    windows = extended(rows.join(bounded(places), keys), window, gram)
    first = stored(
        windows.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("hash", "low"), "first"
    )
    later = windows.join(first.hint("merge"), "hash").where("doc_id > low")
    starts = stored(runs_of(later.groupBy(*keys).agg(F.collect_list("start").alias("starts")), "starts"), "starts")
    return covered(docs, rows, starts, window)


def covered(docs: DataFrame, rows: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """Merge window starts per document and cut what they cover."""
    marked = rows.join(bounded(starts), ["doc_id", "tag"], "left").unionByName(
        docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("long").alias("tag"), F.col("text").cast("string").alias("text")),
        allowMissingColumns=True,
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in parts(batch, 1):
                table = Words(part.column(1), powers)
                gone = _marked(part.column(2), table.first[:-1], table.first[-1], window - 1)
                spans, removed, texts = [], [], []
                for r in range(part.num_rows):
                    cut = gone[table.first[r] : table.first[r + 1]]
                    n = int(cut.sum())
                    removed.append(n)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))) if n else np.empty(0, int)
                    spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
                    texts.append(table.text(r, ~cut if n else None) if n < len(cut) else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(table.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "repeats", "kept_text"],
                )

    return marked.select("doc_id", "text", "starts").mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_removed bigint, "
        "repeats array<struct<start:bigint,length:bigint>>, kept_text string"
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


by_value(__name__)

#: Every window of every document with the smallest id that has it.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT id, doc_id, w, unnest(range(len(w) - 12)) AS i FROM d),
  g AS (SELECT id, doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS g FROM s),
  f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
  c AS (SELECT DISTINCT id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE doc_id > low),
  x AS (SELECT id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
  k AS (SELECT x.id, count(c.i) AS n_removed, string_agg(x.x, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS t
    FROM x LEFT JOIN c USING (id, i) GROUP BY x.id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (id)"""

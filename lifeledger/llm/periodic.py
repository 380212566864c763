"""Periodic runs: stretches of words that repeat with a period, found through multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q and at least max(``LEAST``, ``TIMES`` q) words
that no neighbouring word extends. A batch of texts is one array of word hashes with a mark of its own after
each text, so no match crosses two texts.

* Scale (S, T] takes the periods from S + 1 to T = 3 S / 2. Every T words have a hash, and a place is a minimizer
  if its hash is the least of some S / 2 neighbours. Inside a run both depend on the place modulo q only. As a run
  has 3 q words, some minimizer m and its neighbour m + q both lie in it, and since T >= q words occur again
  inside a run only whole periods away, m + q is the next place with m's hash. So each run shows as a pair of
  successive equal minimizers at distance q.
* Each pair is a seed, extended word by word to both sides.
* Periods up to ``DIRECT`` are too short for minimizers: every lag is scanned. Matches of length L cover a
  multiple of L and one of the places L / 2 away from it, so two samples choose where to extend.

Periods are visited from short to long, and a stretch found again with a longer period is a multiple. No word
is skipped and no period capped; equality is that of 64-bit word hashes. Null and empty texts have no words.
Repeated rows each give a row. Further columns are ignored unless they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import by_value, words
from lifeledger.llm.wordhash import Powers, Words, least_of, mix, parts

LEAST = 24
TIMES = 3
#: Longest period that is scanned directly; at least two, so that each scale has a longer period than the last.
DIRECT = 8


def extent(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest [a, b) around ``at`` in which x[i] equals x[i + lag]."""
    b, size = at, 64
    while b + lag < len(x):
        part = x[b : b + size]
        other = x[b + lag : b + lag + size]
        n = min(len(part), len(other))
        differs = np.flatnonzero(part[:n] != other[:n])
        if len(differs):
            b += int(differs[0])
            break
        b, size = b + n, 2 * size
    a, size = at, 64
    while a > 0:
        low = max(a - size, 0)
        differs = np.flatnonzero(x[low:a] != x[low + lag : a + lag])
        if len(differs):
            a = low + int(differs[-1]) + 1
            break
        a, size = low, 2 * size
    return a, b


def _minimizer_pairs(grams: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of successive equal minimizers whose distance is in (low, high]."""
    width = max(low // 2, 1)
    if len(grams) < width:
        return np.empty(0, int), np.empty(0, int)
    # A place is chosen if it is the least of some window, that is, if it equals the greatest of its windows' minima.
    edge = np.full(width - 1, 2**64 - 1, np.uint64)
    chosen = np.flatnonzero(least_of(np.concatenate([edge, ~least_of(grams, width), edge]), width) == ~grams)
    value = grams[chosen]
    order = np.argsort(value, kind="stable")
    place, value = chosen[order], value[order]
    gap = np.diff(place)
    found = np.flatnonzero((value[1:] == value[:-1]) & (gap > low) & (gap <= high))
    place, gap = place[found], gap[found]
    order = np.lexsort((place, gap))
    return place[order], gap[order]


def find_runs(hashes: np.ndarray, first: np.ndarray, powers: Powers, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text by start, then period; text r has the words first[r] ... first[r + 1] - 1."""
    if times < 3:
        raise ValueError("minimizers need three periods")
    n_words = np.diff(first)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in n_words]
    # Long texts come first, so that the longer periods look at the head of the array only.
    ranked = np.argsort(-n_words, kind="stable")
    size = n_words[ranked]
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    x = np.empty(begin[-1], np.uint64)
    x[begin[1:] - 1] = mix(~np.arange(1, len(size) + 1, dtype=np.uint64))
    for r, b, n in zip(ranked, begin, size):
        x[b : b + n] = hashes[first[r] : first[r] + n]
    seen: set[tuple[int, int]] = set()

    def keep(at: int, lag: int) -> tuple[int, int]:
        a, b = extent(x, at, lag)
        length = b - a + lag
        if length >= max(least, times * lag) and (a, b + lag) not in seen:
            seen.add((a, b + lag))
            row = int(np.searchsorted(begin, a, "right")) - 1
            runs[ranked[row]].append((a - int(begin[row]), length, lag))
        return a, b

    for lag in range(1, DIRECT + 1):
        end = begin[np.searchsorted(-size, -max(least, times * lag), "right")] - lag
        match = max(least, times * lag) - lag
        half = match // 2
        done = 0
        if end <= 0:
            break
        at = np.arange(0, end, match)
        at = at[x[at] == x[at + lag]]
        near = np.zeros(len(at), bool)
        for other in (at - half, at + half):
            fits = (other >= 0) & (other < end)
            near[fits] |= x[other[fits]] == x[other[fits] + lag]
        for i in at[near]:
            if i >= done:
                done = keep(int(i), lag)[1]
    # Prefix sums of the polynomial; a gram of any length is a difference.
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=sums[1:])
    low = DIRECT
    while times * (low + 1) <= (size[0] if len(size) else 0):
        high = low + max(low // 2, 1)
        end = int(begin[np.searchsorted(-size, -times * (low + 1), "right")])
        grams = mix((sums[high : end + 1] - sums[: end + 1 - high]) * down[: end + 1 - high])
        lag, done = 0, 0
        for at, gap in zip(*_minimizer_pairs(grams, low, high)):
            if gap != lag:
                lag, done = int(gap), 0
            if at >= done:
                done = keep(int(at), lag)[1]
        low = high
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in runs]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(``keep``, n_words, runs, collapsed) of each text, every row where it lies: no shuffle.

    ``runs`` holds (start, length, period) by start, then period, in word numbers. ``collapsed`` is the text
    with one period of each run left, words joined by one space.
    """
    kept = list(keep)
    source = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in parts(batch, len(kept)):
                table = Words(part.column(len(kept)), powers)
                found = find_runs(table.hashes, table.first, powers, least, times)
                collapsed = []
                for row, (n, own) in enumerate(zip(table.counts(), found)):
                    stays = None
                    if own:
                        stays = np.ones(n, bool)
                        for start, length, period in own:
                            stays[start + period : start + length] = False
                    collapsed.append(table.text(row, stays))
                lists = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(table.counts(), pa.int64()), pa.array(lists, kind), pa.array(collapsed, pa.string())],
                    names=[*kept, "n_words", "runs", "collapsed"],
                )

    types = [f"`{c}` {t}" for c, t in source.select(*kept).dtypes]
    return source.mapInArrow(run, ", ".join([*types, "n_words bigint", f"runs {RUNS}", "collapsed string"]))


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: of every tenth document by hash, words from one place on repeat with a period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    w = words(text)
    n = F.size(w).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    period = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    again = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
    all_words = F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(all_words, " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest exponent, and SHA-256 of the runs and of the collapsed text."""
    # Fractions compare exactly as products; the earlier start, then the shorter period, wins a tie.
    better = lambda r, s: (r["length"] * s["period"]) > (s["length"] * r["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda s, r: F.when(better(r, s), r).otherwise(s))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col("_best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


by_value(__name__)

#: CRC-32 from its generator polynomial, the planted texts, all pairs of equal words up to a third of the text
#: apart, gaps and islands per distance, and of equal islands the shortest period.
SQL = r"""WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
  steps AS (SELECT list(v ORDER BY i) AS s FROM bits WHERE k = 8),
  crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS t, CAST(4294967295 AS BIGINT) AS v, 1 AS k
      FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d UNION ALL
    SELECT doc_id, t, xor(v >> 8, s[xor(v & 255, ascii(substr(t, k, 1))) + 1]), k + 1 FROM crc, steps WHERE k <= length(t)),
  h AS (SELECT doc_id, xor(v, 4294967295) AS h, xor(v, 4294967295) // 10 AS g FROM crc WHERE k > length(t)),
  d AS (SELECT row_number() OVER () AS id, doc_id,
      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  n AS (SELECT d.*, h, g, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM d LEFT JOIN h USING (doc_id)),
  p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM n),
  o AS (SELECT id, doc_id, n, unnest(w) AS x, unnest(range(n)) AS i, h, a, p FROM p),
  x AS (SELECT o.id, o.n, o.i, coalesce(s.x, o.x) AS x FROM o LEFT JOIN o s
      ON o.h % 10 = 0 AND o.i >= o.a AND s.id = o.id AND s.i = o.a + (o.i - o.a) % o.p),
  e AS (SELECT l.id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.id = r.id AND l.x = r.x AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
  b AS (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM e),
  m AS (SELECT id, q, min(i) AS start, count(*) + q AS length FROM b GROUP BY id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
  r AS (SELECT id, start, length, CAST(min(q) AS BIGINT) AS period FROM m GROUP BY id, start, length),
  gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
  kept AS (SELECT x.id, string_agg(x.x, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN gone USING (id, i) WHERE gone.i IS NULL GROUP BY x.id),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r) t
    WHERE k = 1),
  s AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
    FROM r GROUP BY id)
SELECT d.doc_id, coalesce(s.n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, best.period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(s.t, '')) AS runs_sha256,
  sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN s USING (id) LEFT JOIN best USING (id) LEFT JOIN kept USING (id)"""

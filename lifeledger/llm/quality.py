"""Quality rules: word statistics, and a log-likelihood ratio of hashed n-grams.

The words and word pairs of a text are hashed into buckets. Two multinomials over the buckets are
counted: one over all documents (raw corpus), one over the trusted target. A document's score is the
mean, over its n-grams, of log(target / raw) of their buckets, so it does not depend on length.
Documents below a fixed threshold are rejected. All work is column expressions on one row; only the
bucket counts are shuffled, pre-aggregated, and only one array of ``buckets`` weights is sent around.

Null text has no words; documents without an n-gram score 0 and fail the base rules. Repeated rows
count as often as they occur. An empty target gives every bucket weight 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import bounded, words

# The base rules.
SYMBOLS = "#*$%&|<>"
WHITE_CHARS = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: Number of hash buckets, and the lowest mean log ratio that is kept.
BUCKETS = 1 << 15
MIN_SCORE = -0.3


def _buckets(hashes: str, buckets: int) -> Column:
    """Bucket of every word and of every pair of adjacent words."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights``, the log ratio of each bucket, with one count added everywhere.

    ``target`` holds ids of trusted documents. All documents are counted.
    """
    ids = target.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("trusted", F.lit(1))
    # Other columns are left out, so their names cannot clash.
    rows = docs.select(F.col(id_col).alias("id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.join(bounded(ids), "id", "left")
    counts = (
        rows.select("trusted", F.explode(_buckets("hashes", buckets)).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("good"))
    )
    # The table of all buckets has a fixed size, so one row may hold it.
    dense = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    packed = dense.na.fill(0).agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("at"),
        F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"),
    )
    ratio = F.transform("at", lambda x: F.log((x["good"] + 1) / (F.col("n_good") + buckets))
                        - F.log((x["raw"] + 1) / (F.col("n_raw") + buckets)))
    return packed.select(F.when(F.col("n_good") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("weights"))


def windows_of(hashes: str) -> Column:
    """64-bit hash of every window of adjacent words."""
    found = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(hashes) >= WINDOW, found).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: str) -> Column:
    """Words inside windows that occur twice or more: the size of the union of those windows.

    Sorted (hash, position) pairs put equal windows side by side; the positions that have an equal
    neighbour are then walked in order.
    """
    place = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    # The sorted list is named by a one-step aggregate, so that it is not computed once per use.
    twice = F.aggregate(
        F.array(F.array_sort(place)), F.array().cast("array<int>"),
        lambda _, pairs: F.transform(
            F.filter(pairs, lambda p, k: F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))
                     | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))),
            lambda p: p["i"],
        ),
    )
    return F.aggregate(
        F.array_sort(twice),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n")
        ),
        lambda acc: acc["n"],
    )


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          buckets: int = BUCKETS, min_score: float = MIN_SCORE, keep: list[str] | None = None) -> DataFrame:
    """Word statistics, ``base_failed``, ``score`` and ``kept`` of every row of ``docs``.

    ``model`` is the result of ``weights``. ``keep`` names further columns of ``docs`` to carry along
    in one struct column ``row``.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []),
    )
    rows = rows.withColumn("words", words(F.col("text"))).withColumn(
        "hashes", F.transform("words", lambda w: F.xxhash64(w))
    )
    has_word = lambda line: F.length(F.translate(line, WHITE_CHARS, "")) > 0
    rows = rows.withColumns({
        "lines": F.filter(F.split("text", "\n"), has_word),
        "windows": windows_of("hashes"),
        "features": _buckets("hashes", buckets),
    }).select(
        *(["row"] if keep else []), "id", "features", "windows",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # Most texts have no repeated window; only the others pay for the sort.
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered("windows")).otherwise(0)
    total = F.aggregate("features", F.lit(0.0), lambda acc, b: acc + F.get("weights", b))
    rows = rows.withColumn("weights", model.scalar()).withColumns({
        "n_repeat_words": repeats.cast("long"),
        "score": F.when(F.size("features") > 0, total / F.size("features")).otherwise(0.0),
    })
    # The row number is always true here. It keeps a filter on ``kept`` above this projection: pushed below,
    # the nested array expressions would be repeated in it again and again.
    here = F.monotonically_increasing_id() >= 0
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        *(["row"] if keep else []), F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= min_score) & here).alias("kept"), "score",
    )


def accepted(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return score(docs, model, id_col, text_col, keep=docs.columns).where("kept").select("row.*")

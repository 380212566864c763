"""Language identification by error-correcting output codes over hashed byte n-grams.

Every learned language gets a codeword of bits. For each bit a binary classifier is counted: the log
ratio of hashed n-gram frequencies in the languages whose bit is 1 to those whose bit is 0. A text's
margin for a bit is the mean of its n-grams' log ratios. Decoding takes the codeword with the least
exponential loss over all margins. A text is ambiguous if the runner-up is nearly as close.

The fit uses at most about ``FIT_ROWS`` documents with a language, chosen by a hash of the id among
those whose crc32(id) mod 3 is not 1. Each language has an equal part of them, ``LEAST_ROWS`` at least, and a
language with fewer documents than that is learned from all it has, so none is lost as the table
grows. Counts are summed per task, then shuffled. Prediction reads the whole text alone. Null texts and
texts without a letter are ``und`` with score 0, and so is all text if no language was learned. With one
language all other text is predicted as it. Of codewords at equal loss the first language in order
counts. Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import bounded, by_value
from lifeledger.llm.toxicity import is_held_out

FIT_ROWS, LEAST_ROWS = 20_000, 100
#: Bits of a hash bucket, bytes of an n-gram, bytes of a text that are handled at once.
BITS, GRAM, BLOCK = 14, 3, 1 << 20
#: Most languages with all splits as codewords; beyond, the best of some random codes of this many bits per doubling.
EXHAUSTIVE, BITS_PER_DOUBLING, CODES = 8, 12, 20
#: Loss ratio to the runner-up above which a text is ambiguous.
AMBIGUOUS = 0.8


def codewords(languages: int) -> np.ndarray:
    """Matrix of +1 and -1, a row for each language; every bit splits the languages, no two bits alike."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 2 ** (languages - 1))
        rows = [np.ones(len(splits))] + [np.where((splits >> k) & 1, -1.0, 1.0) for k in range(languages - 1)]
        return np.array(rows)
    bits = BITS_PER_DOUBLING * math.ceil(math.log2(languages))
    codes = [_random_code(languages, bits, seed) for seed in range(CODES)]
    return max(codes, key=lambda code: min(np.count_nonzero(code[i] != code[:i], axis=1).min() for i in range(1, languages)))


def _random_code(languages: int, bits: int, seed: int) -> np.ndarray:
    """Different splits into halves. Nine languages have 126, more than the bits asked for, and more languages have more."""
    rng, splits = np.random.default_rng([languages, seed]), {}
    while len(splits) < bits:
        half = rng.permutation(np.arange(languages)) < languages // 2
        # A split and its complement tell the same.
        code = np.where(half == half[0], 1.0, -1.0)
        splits[code.tobytes()] = code
    return np.array(list(splits.values())).T


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte n-grams of the lower-cased text, with a blank at both ends."""
    data = f" {text.lower()} ".encode("utf-8", "replace")
    out = np.zeros(1 << BITS, np.int64)
    starts = len(data) - GRAM + 1
    for k in range(0, starts, BLOCK):
        part = np.frombuffer(data[k : k + BLOCK + GRAM - 1], np.uint8).astype(np.uint32)
        code = np.zeros(min(BLOCK, starts - k), np.uint32)
        for j in range(GRAM):
            code = code * np.uint32(257) + part[j : j + len(code)]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Languages in order, their codewords, and the log ratios [bucket, bit]."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out("doc_id"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = max(rows // max(sizes.count(), 1), LEAST_ROWS)
    slots = sizes.select("lang", F.ceil(F.col("n") / F.lit(share)).alias("slots"))
    some = known.join(bounded(slots), "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("slots")) == 0).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + gram_counts(text)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    found = some.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    languages = sorted(set(table.column(0).to_pylist()))
    counts = np.zeros((len(languages), 1 << BITS))
    place = {x: k for k, x in enumerate(languages)}
    rows_at = np.array([place[x] for x in table.column(0).to_pylist()], dtype=np.int64)
    counts[rows_at, np.asarray(table.column(1))] = np.asarray(table.column(2))
    # Every language weighs the same in a bit, however many documents it has.
    rates = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if languages else counts
    words = codewords(len(languages))
    ratios = np.zeros((1 << BITS, words.shape[1]))
    for b in range(words.shape[1]):
        one, zero = rates[words[:, b] > 0], rates[words[:, b] < 0]
        if len(one) and len(zero):
            ratios[:, b] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
    return {"languages": languages, "codewords": words, "ratios": ratios}


def decode(model: dict, margins: np.ndarray) -> tuple[str, float, bool]:
    """Language, score and ambiguity of bit margins: least exponential loss, each bit weighed by its margin."""
    weight = np.abs(margins) / max(np.abs(margins).sum(), 1e-12)
    loss = (weight * np.exp(-model["codewords"] * margins)).sum(axis=1)
    order = np.argsort(loss, kind="stable")
    best = model["languages"][order[0]]
    likely = np.exp(-(loss - loss[order[0]]) * 4)
    unsure = len(order) > 1 and loss[order[0]] >= AMBIGUOUS * loss[order[1]]
    return best, float(1 / likely.sum()), bool(unsure)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if not known["languages"] or not text or not any(c.isalpha() for c in text):
                    out.append(("und", 0.0, True))
                    continue
                counts = gram_counts(text)
                at = np.flatnonzero(counts)
                out.append(decode(known, counts[at] @ known["ratios"][at] / counts.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                 pa.array([x[2] for x in out], pa.bool_())],
                names=["id", "lang_pred", "score", "ambiguous"],
            )

    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, lang_pred string, score double, ambiguous boolean")
    return rows.select(
        F.col("id").alias("doc_id"), F.coalesce(is_held_out("id"), F.lit(False)).alias("held_out"),
        "lang_pred", "score", "ambiguous",
    )


by_value(__name__)

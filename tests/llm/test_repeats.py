"""Substring deduplication, hard negatives and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lifeledger.llm import negatives, periodic, substring, wordhash

DOCS = "doc_id long, text string, tag string, low int, place int"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Word hashes


def test_word_hashes_follow_the_words():
    texts = ["", None, " a  b\n", "b a", "é\x0b漢 a", "\x1c x", "a" * 5000]
    table = wordhash.Words(pa.array(["skipped", *texts]).slice(1), wordhash.Powers())
    expected = [(t or "").encode().split() for t in texts]
    assert table.counts().tolist() == [len(w) for w in expected]
    known = {}
    for word, value in zip([w for own in expected for w in own], table.hashes):
        assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    assert [table.text(r) for r in range(len(texts))] == [b" ".join(w).decode() for w in expected]


def test_slices_keep_all_rows(monkeypatch):
    monkeypatch.setattr(wordhash, "PART_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "", "bb", "c" * 9, "d" * 11])], names=["t"])
    cut = list(wordhash.parts(batch, 0))
    assert [x for p in cut for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(cut) > 2


# Periodic runs


def brute_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def periodic_texts(seed, n=250):
    rng = random.Random(seed)
    texts = ["", None, " \n", "x " * 1000, "é a b\t" * 30, "a b " * 12, "a b " * 11 + "a"]
    for k in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            alphabet = rng.choice([1, 2, 3, 50])
            base = [f"{rng.choice('abcdefghij')}{rng.randrange(alphabet)}" for _ in range(rng.randint(1, 60))]
            words += [base[i % len(base)] for i in range(int(len(base) * rng.choice([1, 1.5, 2.9, 3, 3.2, 5])))]
            words += [str(rng.random()) for _ in range(rng.choice([0, 0, 1, 30]))]
        texts.append(" ".join(words if k % 7 else ["a" if rng.random() < 0.9 else "b" for _ in range(rng.randint(0, 400))]))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(seed):
    texts = periodic_texts(seed)
    table = wordhash.Words(pa.array(texts), wordhash.Powers())
    got = periodic.find_runs(table.hashes, table.first, wordhash.Powers())
    assert got == [brute_runs((t or "").encode().split()) for t in texts]
    assert sum(map(len, got)) > 100


def test_long_periods_of_a_long_text():
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(9_000)]
    words = base[:500] + base * 3 + base[:77] + ["end"] + base[:20] * 4
    table = wordhash.Words(pa.array([" ".join(words), "short text", " ".join(base[:100] * 3)]), wordhash.Powers())
    got = periodic.find_runs(table.hashes, table.first, wordhash.Powers())
    # The 500 words before equal the first 500, not the last 500 of the base: they do not extend the run.
    assert got == [[(500, 27_077, 9_000), (27_578, 80, 20)], [], [(0, 300, 100)]]


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.empty(0, np.uint64), np.zeros(1, int), wordhash.Powers(), times=2)


def test_periodic_query(spark):
    rng = random.Random(4)
    texts = periodic_texts(5, 60)
    rows = list(enumerate(texts)) + [(None, "a b " * 40), (3, texts[3])]
    rows += [(1000 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200)))) for i in range(60)]
    table = docs(spark, rows)
    found = periodic.digests(periodic.periodic_runs(table.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))))
    expected = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        n = len(w)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            if h % 10 == 0:
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        expected.append((doc_id, len(runs), *best, milli, sha(lines), sha(kept)))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)
    assert periodic.digests(periodic.periodic_runs(table.limit(0))).count() == 0


# Substring deduplication


def brute_repeats(rows, window=13):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def shared_texts(seed, n=120):
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(rng.choice([12, 13, 14, 40, 200]))] for k in range(8)]
    rows = [(500, None), (501, ""), (502, "one two"), (503, "same " * 60), (504, "same " * 40), (None, " ".join(passages[3]))]
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.6 else [str(rng.randrange(3)) for _ in range(rng.randint(1, 30))]
            words += [str(rng.random()) for _ in range(rng.choice([0, 1, 9]))]
        rows.append((rng.randrange(80), " ".join(words)))
        if rng.random() < 0.2:
            rows.append((rows[-1][0] if rng.random() < 0.5 else rng.randrange(80), rows[-1][1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = shared_texts(seed)
    found = substring.repeats(docs(spark, rows).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found), key=repr) == brute_repeats(rows)
    for r in found:
        spans = [(s["start"], s["length"]) for s in r["repeats"]]
        assert sum(n for _, n in spans) == r["n_removed"] and all(n >= 13 for _, n in spans)
        assert all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_repeats_of_tables_without_repeated_ids(spark):
    rows = [(i, t) for i, (_, t) in enumerate(shared_texts(7, 60))]
    found = substring.digests(substring.repeats(docs(spark, rows)))
    expected = [(i, n, gone, sha(t)) for i, n, gone, t in brute_repeats(rows)]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert substring.repeats(docs(spark, rows).limit(0)).count() == 0


# Hard negatives


def brute_negatives(rows, every):
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[i] = min(usable.get(i, (label, v)), (label, v))
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in usable.items()}
    out = []
    for a in (i for i in q if i % every == 0):
        label, v = q[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in q.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            window = [(n, i) for n, i, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(window, 1)]
    return sorted(out)


def vectors(seed, n=400, scale=1.0):
    rng = random.Random(seed)
    common = [round(rng.gauss(0, 0.2), 2) for _ in range(20)]
    rows = []
    for i in range(n):
        own = [scale * round(rng.gauss(0, 0.2), 2) for _ in range(20)]
        v = common if i % 3 == 0 else own[: rng.choice([20, 20, 20, 5, 0])]
        rows.append((i, rng.choice([0, 0, 0, 1, 2]), v))
    return rows + [(900, None, common), (901, 1, None), (None, 1, common), (902, 1, [math.nan, 1.0]), (903, 1, [None, 1.0]),
                   (904, 1, [math.inf]), (7, 2, common), (8, rows[8][1], rows[8][2])]


SCHEMA = "vec_id long, label int, embedding array<double>, windows int, score int"


@pytest.mark.parametrize("seed,scale,block,chunk", [(1, 1.0, 1 << 17, 1 << 15), (2, 1.0, 60, 7), (3, 1e12, 200, 30)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, scale, block, chunk):
    rows = vectors(seed, 300 if scale > 1 else 400, scale)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(negatives.search, "__defaults__", (block, chunk))
    monkeypatch.setattr(negatives, "SEED", 4)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 50)
    got = sorted(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 9 == 0).collect())
    assert got == brute_negatives(rows, 9)
    assert len(got) > 1000


def test_negatives_of_no_rows(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(table, F.col("vec_id") % 9 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], 1, 1)], SCHEMA)
    assert negatives.mine(one, F.col("vec_id") % 9 == 0).count() == 0


def test_pruned_blocks_find_every_pair_above_the_threshold():
    rng = np.random.default_rng(5)
    x, a = (np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)) for v in (rng.normal(size=(700, 64)), rng.normal(size=(40, 64))))
    x[:50] = np.floor(x[:50] * 0.1)
    norms = lambda m: np.pad(np.sqrt(np.cumsum(np.square(m).reshape(len(m), -1, negatives.SEGMENT).sum(axis=2), axis=1)), ((0, 0), (1, 0)))
    for threshold in (-70_000.0, 0.0, 5_000.0, 15_000.0, 30_000.0):
        low = np.full(40, threshold)
        index = negatives.Index(x, norms(x), norms(a)[:, -1].max(), threshold)
        i, j, score = index.pairs(a, norms(a), low)
        exact = a @ x.T
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(exact >= threshold))) and (exact[i, j] == score).all()
        assert threshold < 30_000 or (index.out > 0).mean() > 0.5

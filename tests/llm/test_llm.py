"""Operators for training data against brute force, on small fixtures with nulls, ties, copies and long texts."""

import hashlib
import html
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lifeledger.llm import bpe, chat, decontaminate, extract, jaccard, language, quality, secrets, toxicity, urls
from lifeledger.llm.components import components
from lifeledger.llm.queries import TOKENIZER
from tests.check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables are not there")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    """Rows of ``documents``; with ``extra`` also columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    out = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("id", "words", "hashes", "score", "kept", "spans", "row", "ids", "n", "doc", "seed", "weights"):
            out = out.withColumn(name, F.lit("x"))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Chat formatting


def test_snapshots_collapse_into_the_longest(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
        (3, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "b"),
        (4, 0, "user", "ab"), (4, 1, None, None), (None, 0, "user", "a"), (5, None, "user", "a"), (5, 0, "user", "z"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hashes", F.lit(1))
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chat.format_chats(turns).collect()}
    assert got[2] == (3, 2, "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n")
    assert set(got) == {2, 4, 5}
    assert got[4][2] == "<|user|>\nab\n<||>\n\n"
    assert chat.format_chats(turns.limit(0)).count() == 0


# Quality rules


def base_rules(text):
    found = words(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    n = len(found)
    return (
        n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside),
        n < 10 or 100 * len(inside) > 20 * n,
    )


TEXTS = [
    None, "", " \n\t", "one", "a b c d e a b c d e f g", "### é$$$ 漢字 | <b>\nline\nline\n\nline\x0bx", "w " * 40,
    " ".join(f"w{i}" for i in range(300)) + "\n" + " ".join(f"w{i}" for i in range(40)), "x\x85y\xa0z " * 4,
    " ".join(f"t{i % 977}" for i in range(30000)),
]


def test_word_statistics_and_likelihood_ratio(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("the of and it in x# y# z#".split()) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = documents(spark, texts, extra=True)
    trusted = [i for i, t in enumerate(texts) if t and "x#" not in t] + list(range(10, 40))
    target = spark.createDataFrame([(i,) for i in [*trusted, trusted[0], None, 10**6]], "doc_id long")
    buckets = 512
    got = {r["doc_id"]: r for r in quality.score(docs, quality.weights(docs, target, buckets=buckets), buckets=buckets).collect()}
    signed = lambda u: u - (1 << 64) if u >= 1 << 63 else u

    def features(text):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words(text)]
        fold = lambda a, b: signed(xxhash.xxh64_intdigest(int(b).to_bytes(8, "little", signed=True), seed=xxhash.xxh64_intdigest(int(a).to_bytes(8, "little", signed=True), seed=42)))  # noqa: E731, E501
        return [x % buckets for x in h] + [fold(a, b) % buckets for a, b in zip(h, h[1:])]

    raw, good = np.zeros(buckets), np.zeros(buckets)
    for i, t in enumerate(texts):
        for b in features(t):
            raw[b] += 1
            good[b] += i in set(trusted)
    weight = np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    for i, t in enumerate(texts):
        r, f = got[i], features(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_rules(t), i
        want = float(np.mean(weight[f])) if f else 0.0
        assert r["score"] == pytest.approx(want, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and want >= quality.MIN_SCORE)
    kept = quality.accepted(docs, quality.weights(docs, target))
    assert kept.columns == docs.columns
    empty = docs.limit(0)
    assert quality.score(empty, quality.weights(empty, target)).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.weights(docs, target.limit(0))).collect()} == {0.0}


# Secret scan


def base_spans(text):
    key = "|".join("".join(f"[{c}{c.upper()}]" for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    assign = re.compile(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secrets(spark):
    rng = random.Random(6)
    noise = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    alnum = secrets.DIGITS + secrets.LOWER + secrets.UPPER
    keys = [noise(40, alnum) for _ in range(30)]
    texts = [
        None, "", 'token=token": value123 API_KEY : "abcdefgh🙂 tok', "é" * 50 + " secret: abcdef12345 AKIA" + "A" * 20,
        "toKen='" + "0123456789abcdef" * 3 + "' AKIAAKIA" + "B" * 17, "token=abc; SECRET:x passwd = 'ab=c/d+e'",
        " ".join(f"token={noise(32, '0123456789abcdef')}" for _ in range(300)),
        *[f"say 🙂 {k} end aaaaabbbbbcccccddddd11111 thehethethehethethe2020the" for k in keys],
    ]
    docs = documents(spark, texts, extra=True)
    scanned = secrets.scan(docs)
    found = secrets.found(scanned, secrets.cutoffs(scanned)).withColumn("clean", secrets.redacted("text", "spans"))
    report = {r["doc_id"]: r for r in secrets.report(found).collect()}
    clean = {r["id"]: r["clean"] for r in found.select("id", "clean").collect()}
    hits = 0
    for i, t in enumerate(texts):
        want, r = base_spans(t or ""), report[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), i
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [":".join(s) for s in spans if s[0] != "random"] == want
        marked = {k for _, s, e in spans for k in range(int(s), int(e))}
        assert clean[i].replace("<secret>", "") == "".join(c for k, c in enumerate(t or "") if k not in marked)
        extra = [(t or "")[int(s) : int(e)] for kind, s, e in spans if kind == "random"]
        hits += sum(x in keys for x in extra)
        assert all(x in keys for x in extra)
    assert hits >= 27
    assert secrets.report(secrets.found(scanned.limit(0), secrets.cutoffs(scanned.limit(0)))).count() == 0


def test_every_run_of_key_characters_is_tested(spark):
    rng = random.Random(7)
    noise = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    letters = secrets.LOWER + secrets.UPPER
    token = "Ab3dE5fG7hJ9kL2mN4pQ"
    keys = [noise(n, a) for a in (secrets.LOWER, secrets.UPPER, letters, letters + secrets.DIGITS) for n in (20, 45) * 5]
    texts = [
        f"see https://example.com/reset-link/{token} 🙂", f"a_b/{token}-c/d", "-" * 30 + " " + "+-" * 15,
        *[f"{k} say/it-as/{k}_x {k}+{k}-" for k in keys], *[noise(rng.randint(20, 60), letters + "0123+/-_") for _ in range(40)],
    ]
    scanned = secrets.scan(documents(spark, texts))
    rows = {r["id"]: r for r in secrets.found(scanned, secrets.cutoffs(scanned)).select("id", "candidates", "spans").collect()}
    runs = mixed = 0
    for i, t in enumerate(texts):
        assert not base_spans(t)
        got = sorted((c["start"], c["end"]) for c in rows[i]["candidates"])
        assert all(c["stratum"] and c["step"] >= 0 for c in rows[i]["candidates"])
        want = set()
        for run in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t):
            runs += 1
            whole = not (re.search("[+/]", run[0]) and re.search("[_-]", run[0]))
            mixed += not whole
            cuts = [r"[A-Za-z0-9+/_-]+"] if whole else [r"[A-Za-z0-9]+", r"[A-Za-z0-9+/]+", r"[A-Za-z0-9_-]+"]
            parts = [(run.start() + m.start(), run.start() + m.end()) for c in cuts for m in re.finditer(c, run[0])]
            want |= {(a, b) for a, b in parts if b - a >= 20 and re.search("[A-Za-z0-9]", t[a:b])}
        assert got == sorted(want), t
    assert runs >= 60 and mixed >= 40
    marked = lambda i: {k for s in rows[i]["spans"] for k in range(s["start"], s["end"])}
    assert all(set(range(texts[i].index(token), texts[i].index(token) + 20)) <= marked(i) for i in (0, 1))
    assert sum(set(range(len(k))) <= marked(3 + i) for i, k in enumerate(keys)) >= 0.85 * len(keys)


def brute_step(found, alphabet):
    """Grid step of Simes' p-value of the three tests, from their definitions."""
    n, k, codes = len(found), len(alphabet), [alphabet.index(c) for c in found]
    upper = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((codes.count(c) - n / k) ** 2 / (n / k) for c in range(k))
    spread = 2 / 9 * (n - 1) / n / (k - 1)
    high = [2 * c >= k for c in codes]
    n1, n2 = sum(high), n - sum(high)
    mean = 2 * n1 * n2 / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    lagged = sum((x - (k - 1) / 2) * (y - (k - 1) / 2) for x, y in zip(codes, codes[1:]))
    p = sorted([
        upper((((chi / (k - 1)) ** (1 / 3)) - (1 - spread)) / math.sqrt(spread)),
        min(1, 2 * upper(abs(runs - mean) / math.sqrt(variance))) if n1 and n2 and variance > 0 else 0.0,
        min(1, 2 * upper(abs(lagged) / (math.sqrt(n - 1) * (k * k - 1) / 12))),
    ])
    simes = min(3 * p[0], 1.5 * p[1], p[2])
    return max(0, min(secrets.GRID, math.floor(-math.log2(max(simes, 2.0**-secrets.GRID)))))


def brute_cut(steps, rate):
    m, first = len(steps), steps.count(0)
    bh = [s for s in range(secrets.GRID + 1) if m * 2.0**-s <= rate * sum(x >= s for x in steps)]
    most = min(m, 2 * (first + secrets.CONFIDENCE * math.sqrt(first + 1)))
    part = lambda s: 1 if s > secrets.GRID else 1 - 2.0**-s
    enough = [s for s in range(secrets.GRID + 2) if sum(x < s for x in steps) * (1 - rate) <= most * part(s)]
    return min([*bh, secrets.GRID + 1, max(enough)])


def test_randomness_statistics_equal_brute_force(spark):
    rng = random.Random(21)
    noise = ["".join(rng.choice(secrets.LOWER) for _ in range(n)) for n in (20, 25, 39, 40, 90, 400) for _ in range(8)]
    ordinary = ["".join(rng.choice(("tion", "ver", "ein", "heit", "qu")) for _ in range(9)) for _ in range(60)]
    texts = [x if any(x.count(c) for c in secrets.LOWER[6:]) else x + "z" for x in noise + ordinary]
    scanned = secrets.scan(documents(spark, texts))
    got = {texts[r["id"]]: r["candidates"] for r in scanned.select("id", "candidates").collect()}
    want: dict[str, list[int]] = {}
    for text in texts:
        (one,) = got[text]
        assert one["step"] == brute_step(text, secrets.LOWER), text
        assert one["stratum"] == f"lower:{math.floor(math.log2(len(text) / 20))}"
        want.setdefault(one["stratum"], []).append(one["step"])
    cuts = secrets.cutoffs(scanned).first()["cuts"]
    assert cuts == {k: brute_cut(v, secrets.RATE) for k, v in want.items()}


def test_ordinary_strings_are_left_alone_and_keys_found(spark):
    rng = random.Random(5)
    pieces = ["ein", "schlich", "ver", "heit", "tion", "keit", "ung", "zu", "pfau", "men", "quet", "er"]
    ordinary = ["".join(rng.choice(pieces) for _ in range(7))[:26] for _ in range(300)]
    ordinary = [x for x in ordinary if len(x) >= 20]
    keys = ["".join(rng.choice(secrets.DIGITS + secrets.LOWER + secrets.UPPER) for _ in range(30)) for _ in range(60)]
    scanned = secrets.scan(documents(spark, ordinary + keys))
    found = {r["id"] for r in secrets.found(scanned, secrets.cutoffs(scanned)).where("size(spans) > 0").select("id").collect()}
    assert len([i for i in found if i >= len(ordinary)]) >= 0.95 * len(keys)
    # Those that Benjamini-Hochberg alone would let through, as no test is sure of them.
    steps = [c["step"] for r in scanned.where(F.col("id") < len(ordinary)).select("candidates").collect() for c in r["candidates"]]
    m = len(steps)
    first = min(s for s in range(secrets.GRID + 1) if m * 2.0**-s <= secrets.RATE * sum(x >= s for x in steps))
    assert 3 * len([i for i in found if i < len(ordinary)]) <= sum(x < first for x in steps)


# Toxicity


def test_lexicon_finds_terms_misspellings_and_beginnings():
    trie = toxicity.Lexicon([("idiot", False), ("achlich", True), ("scum", False)])
    exact = {"idiot", "Idiot", "achlichste", "scum"}
    fuzzy = {"idjot", "idiott", "idot", "idiots", "aclichste"}
    assert all(trie.kind(w) and trie.kind(w) % 2 == 0 for w in exact)
    assert all(trie.kind(w) % 2 for w in fuzzy)
    assert all(trie.kind(w) == 0 for w in ("idea", "scam", "", "theidiot", "achlxx", "achl", "x" * 5000))
    distance = lambda a, b: _edits(a, b) <= 1
    rng = random.Random(1)
    for _ in range(3000):
        w = "".join(rng.choice("idotsx") for _ in range(rng.randint(4, 6)))
        want = 2 if w == "idiot" else int(distance(w, "idiot"))
        assert toxicity.Lexicon([("idiot", False)]).kind(w) == want, w


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_quotation():
    text = 'they said "you idiot" there, idiot'
    assert toxicity.quoted(text, 15, 20) and not toxicity.quoted("you are an idiot", 11, 16)


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "do", "ke", "lu") for b in ("ra", "mi", "tu") for c in ("n", "s", "lo", "pe")]
    texts, marks = [None, ""], [0, 0]
    for i in range(600):
        mark = int(i % 4 == 0)
        found = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        if mark:
            for _ in range(3):
                found[rng.randrange(len(found))] = rng.choice(["idiot", "moron", "zworga" + rng.choice("abcdef")])
        texts.append(" ".join(found))
        marks.append(mark)
    docs = documents(spark, texts, extra=True)
    labels = spark.createDataFrame([*enumerate(marks), (None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}
    model = {"terms": [("idiot", False, 9)], "rates": [1e-3, 1e-6], "shares": [0.05, 0.3], "heads": {"id": 1e-3}, "prior": -2.0}
    trie = toxicity.Lexicon([("idiot", False)])
    rate = lambda t: toxicity.rate_text(trie, model, t)[0]
    assert rate("you idiot") > rate('he said "idiot"') > rate("you")


# Benchmark decontamination


def brute_tiles(a, b, seed):
    """Greedy string tiling by comparing all unmarked places."""
    marked_a, marked_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return out
        out.append((i, j, n))
        marked_a.update(range(i, i + n))
        marked_b.update(range(j, j + n))


def test_tiles_are_greedy():
    rng = random.Random(9)
    for letters in ("abcd", "ab", "a"):
        for _ in range(100):
            a = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
            b = [rng.choice(letters) for _ in range(rng.randint(0, 25))]
            one, two = (np.array([hash(w) for w in x], dtype=np.int64) for x in (a, b))
            assert decontaminate.tiles(one, two, 3) == [(i, j, n) for i, j, n in brute_tiles(a, b, 3)]


def test_tiles_from_seed_places_equal_those_of_whole_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("a", "b", "c", "dd")) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    tests = [" ".join(rng.choice(("a", "b", "c")) for _ in range(n)) for n in (3, 4, 9, 20, 40)]
    items = spark.createDataFrame(list(enumerate(tests)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): [tuple(t) for t in r["tiles"]]
           for r in decontaminate.overlaps(documents(spark, texts), items, words=4).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(tests):
            found = brute_tiles(text.split(), item.split(), min(4, len(item.split())))
            if found:
                want[d, i] = sorted(found)
    assert got == want


def test_hash_collisions_are_not_marked():
    # Two Thue-Morse sequences that are complements have equal polynomial hashes modulo 2 ** 64 under any base.
    one = np.array([bin(i).count("1") % 2 for i in range(2048)], dtype=np.int64)
    found = decontaminate.tiles(one, 1 - one, 200)
    assert all((one[d : d + n] == 1 - one[i : i + n]).all() for d, i, n in found)
    assert found[0][2] == 1024


def test_long_repeats_and_shared_ids(spark):
    rows = [(1, "la " * 200_000), (2, "one two three four five six"), (2, "seven eight nine ten eleven twelve"),
            (2, "seven eight nine ten eleven twelve"), (None, "la " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(
        [(1, "la " * 30), (2, "seven eight nine ten eleven twelve"), (2, "one two three four five seven"), (3, "la la")],
        "item_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]): (r["n_tiles"], r["covered_words"], r["item_words"])
           for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 1): (1, 30, 30), (1, 3): (1, 2, 2), (2, 2): (1, 6, 6)}


def test_reordered_passages_are_caught(spark):
    item = [f"q{i}" for i in range(30)]
    moved = item[20:] + ["x"] + item[10:20] + ["y", "z"] + item[:10]
    clean = [f"c{i}" for i in range(100)]
    texts = [
        None, "", " ".join(clean), " ".join(clean[:9] + item + clean[9:]), " ".join(moved).upper().replace(" ", ", "),
        " ".join(item[:12] + clean), " ".join(item), " ".join(item), " ".join(clean * 300 + item), "Q0 what q1 short one",
    ]
    items = spark.createDataFrame(
        [(1, " ".join(item)), (2, None), (3, ""), (4, "short one"), (None, " ".join(clean))], "item_id long, text string"
    ).withColumn("seed", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(documents(spark, texts, extra=True), items).collect()}
    assert {k for k, r in got.items() if r["coverage"] >= decontaminate.COVERAGE} == {(3, 1), (4, 1), (6, 1), (7, 1), (8, 1), (9, 4)}
    assert (got[4, 1]["n_tiles"], got[4, 1]["covered_words"], got[5, 1]["covered_words"]) == (3, 30, 12)
    assert decontaminate.overlaps(documents(spark, texts), items.limit(0)).count() == 0
    assert decontaminate.overlaps(documents(spark, []), items).count() == 0


# Language identification


def test_language_held_out_accuracy(spark):
    rng = random.Random(3)
    syllables = {"aa": "ba be bo", "bb": "shi sho sha", "cc": "ñu ñe ñi", "dd": "tz pf ßa"}
    rows = [(0, None, "aa"), (1, "123 !", "aa"), (2, "", None)]
    for i in range(3, 400):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choices(syllables[lang].split(), k=3)) for _ in range(rng.randint(3, 30)))
        rows.append((i, text, lang if i % 7 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert {got[k]["lang_pred"] for k in (0, 1, 2)} == {"und"}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[3:] if lang)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("n", range(2, 65))
def test_codewords_differ(n):
    code = language.codewords(n)
    assert code.shape[0] == n and len({tuple(bit * bit[0]) for bit in code.T}) == code.shape[1]
    distances = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(distances) >= max(1, code.shape[1] // 4)


def test_gram_counts_do_not_depend_on_blocks(monkeypatch):
    text = "".join(random.Random(5).choice("abc é漢") for _ in range(5000))
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "BLOCK", 100)
    assert (language.gram_counts(text) == whole).all()


@pytest.mark.parametrize("text", ["", "a", "ab", "Ab c", "é漢" * 5, "x" * 97])
@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_gram_counts_equal_brute_force(monkeypatch, text, block):
    monkeypatch.setattr(language, "BLOCK", block)
    data = f" {text.lower()} ".encode()
    want = Counter()
    for k in range(len(data) - 2):
        code = (data[k] * 257 * 257 + data[k + 1] * 257 + data[k + 2]) * 2654435761 % 2**32
        want[code >> (32 - language.BITS)] += 1
    got = language.gram_counts(text)
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want)


def test_decoding_equals_brute_force_and_breaks_ties_by_order():
    rng = np.random.default_rng(3)
    for n in (2, 5, 9):
        model = {"languages": [f"l{k}" for k in range(n)], "codewords": language.codewords(n)}
        for _ in range(30):
            margins = rng.normal(size=model["codewords"].shape[1])
            total = sum(abs(m) for m in margins)
            loss = [sum(abs(m) / total * np.exp(-c * m) for c, m in zip(word, margins)) for word in model["codewords"]]
            best, score, _ = language.decode(model, margins)
            assert best == model["languages"][int(np.argmin(loss))] and 0 < score <= 1
        best, score, unsure = language.decode(model, np.zeros(model["codewords"].shape[1]))
        assert best == "l0" and unsure and score == pytest.approx(1 / n)


def test_a_rare_language_keeps_its_documents(spark, monkeypatch):
    monkeypatch.setattr(language, "LEAST_ROWS", 5)
    rare = {f"q{k}": " ".join([c * 3, (c + d) * 2, d * 4]) for k, (c, d) in enumerate(["qz", "jx", "kw", "vy", "fö", "gß", "pü"])}
    rows = [(i, f"the cat and dog number {i} is here", "en") for i in range(3000)]
    rows += [(10_000 + 10 * k + j, text, lang) for k, (lang, text) in enumerate(rare.items()) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, rows=100)
    assert model["languages"] == sorted(["en", *rare]) and model["codewords"].shape == (8, 127)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    assert language.identify(docs, language.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


# BPE


def test_bpe_equals_the_library(spark):
    rng = random.Random(8)
    alphabet = "ab the'sS re’   　\n\t\x1c\x85\xa0éß漢字🙂123<|endoftext|>_-=+²Ⅷ"
    texts = [None, "", "a" * 3000, " " * 300, "<|endoftext|>x<|endoftext|>", "they'll  we've 's", "x" * 200_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(0, 800))) for _ in range(40)]
    library = Tokenizer.from_file(TOKENIZER)
    encoded = bpe.encode(documents(spark, texts, extra=True), TOKENIZER)
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, TOKENIZER).collect()}
    sums = {r["doc_id"]: r for r in bpe.digests(encoded).collect()}
    for r in encoded.collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids, repr(texts[r["doc_id"]])
        assert r["decoded"] == again[r["doc_id"]] == library.decode(ids, skip_special_tokens=False)
        s = sums[r["doc_id"]]
        assert (s["n_tokens"], s["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert s["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


# N-gram Jaccard join


def brute_components(rows):
    sets, inverted, parent = {}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        w = [x.decode() for x in (text or "").encode().lower().split()]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i
        shared = Counter(j for g in sets[i] for j in inverted.get(g, []))
        for g in sets[i]:
            inverted.setdefault(g, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("short, sample", [(2, 10), (4, 100), (jaccard.SHORT, jaccard.ORDER_SAMPLE)])
def test_jaccard_components_equal_all_pairs(spark, short, sample):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 100))] for _ in range(12)]
    rows = []
    for i in range(300):
        text = list(rng.choice(bases[:3] if i % 2 else bases))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text + [f"license {k}" for k in range(12)] * (i % 3 == 0))))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  B"), (1005, "a b c"), (1006, "É x"), (1007, "é x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("n", F.lit(1))
    got = jaccard.classes(docs.unionByName(docs.limit(5)), short=short, sample=sample).distinct().collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_jaccard_of_no_rows(spark):
    assert jaccard.classes(documents(spark, [])).count() == 0
    one = jaccard.classes(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == [(None, 1, None)]


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(500, 540)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {k: find(k) for k in parent}


def test_rows_that_share_an_id_keep_their_links(spark):
    rng = random.Random(6)
    text = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(60)) for _ in range(4)]
    near = text[1] + " end"
    rows = [(5, text[0]), (5, text[1]), (9, text[2]), (8, near), (9, text[2]), (4, text[3]), (None, text[0]), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs).collect()), key=repr)
    want = [(5, 56, 5), (5, 56, 5), (9, 56, 9), (8, 57, 5), (9, 56, 9), (4, 56, 4), (None, 56, None), (7, 0, 7), (7, 0, 7)]
    assert got == sorted(want, key=repr)
    named = docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.classes(named).collect())
    assert got == sorted((f"d{i}", f"d{c}") for i, _, c in want if i is not None)


def test_near_duplicates_of_repeated_rows_leave_one(spark):
    rng = random.Random(7)
    text = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(60)) for _ in range(3)]
    rows = [(5, text[0]), (5, text[0]), (5, text[1]), (6, text[1] + " end"), (8, text[2]), (None, text[2]), (None, text[2]), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("component_id", F.lit("x"))
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert all(r["component_id"] == "x" for r in kept)
    texts = sorted((str(r["doc_id"]), (r["text"] or "")[:-4] if (r["text"] or "").endswith(" end") else r["text"] or "") for r in kept)
    assert [t for _, t in texts].count(text[0]) == 1 and [t for _, t in texts].count(text[1]) == 1
    assert ("8", text[2]) in texts and texts.count(("None", text[2])) == 2 and ("7", "") in texts and len(kept) == 6
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


# URL filter


def test_url_rules_and_aliases(spark):
    canonical = '<link rel="canonical" href="https://x.net/a"><p>'
    rows = [
        (1, "https://M.Example.NET/en/1?utm_source=a", None), (2, "http://a.net/x", ""), (3, "http://example.com/de/1", ""),
        (4, "http://x.org/fr/1", ""), (5, None, None), (6, "no address", ""), (7, "http://free.com/p", canonical),
        (8, "https://FREE.com/p#x", ""), (9, "http://free.com/q", ""), (10, "ftp://notnet", ""), (11, "http://good.io/", '<link href="http://x.org/fr/9" rel=canonical>'),
        (12, "http://good.io", ""), (13, "http://UP.net?x=://y/z", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("group", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got[1] == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[11][2:] == got[12][2:] == (None, "allow") and got[10][2:] == (None, "allow")
    assert got[13] == ("up.net", "", None, "allow")
    redirects = spark.createDataFrame([("http://free.com/q", "http://free.com/p"), (None, "x")], "a string, b string")
    more = {r["page_id"]: r["verdict"] for r in urls.judge(pages, redirects=redirects).collect()}
    assert more[9] == "block"
    assert urls.judge(pages.limit(0)).count() == 0


def test_targets_are_decoded_and_resolved(spark):
    base, bare = "https://u.com/a/b?q=1#f", "https://u.com"
    pairs = [
        ("/de/5", base, "https://u.com/de/5"), ("//x.net/a", base, "https://x.net/a"), ("?r=2", base, "https://u.com/a/b?r=2"),
        ("c?x=://y", base, "https://u.com/a/c?x=://y"), ("../c/./d/..", base, "https://u.com/c/"), ("/go?u=http://z.net/", base, "https://u.com/go?u=http://z.net/"),
        ("#g", base, "https://u.com/a/b?q=1#g"), ("c", bare, "https://u.com/c"), ("http://v.com/a/../b", base, "http://v.com/a/../b"),
        ("mailto:a", base, None), ("/c", "no address", None), ("//x.net/a", None, None), ("http://v.com/", None, "http://v.com/"), ("../../..", base, "https://u.com/"),
    ]
    frame = spark.createDataFrame(pairs, "t string, base string, want string")
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", urls.resolved(F.col("t"), F.col("base"))).collect())
    texts = ["a?x=1&amp;y=2", "&#47;de&#x2F;5&#X2f", "&eacute;&nope;&copy=1&", "&#55296;&#0;&#128578;", "&amp;amp;", "", "&#99999999;&;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(urls.decoded(F.col("t"))).collect()]
    assert got == ["a?x=1&y=2", "/de/5/", "é&nope;&copy=1&", "&#55296;&#0;🙂", "&amp;", "", texts[-1]]


def test_relative_targets_make_aliases(spark):
    link = lambda t: f'<link rel="canonical" href="{t}"><p>'
    rows = [
        (1, "http://example.com/en/5", link("/de/5")), (2, "http://free.com/a", link("//x.net/a")),
        (3, "http://free.com/b", link("?k=1&amp;l=2")), (4, "http://free.com/b?k=1&l=2", '<meta http-equiv="refresh" content="0;url=http:&#47;/x.net/b">'),
        (5, "http://example.com/fr/6", '<meta http-equiv=refresh content="0; url=../de/6">'), (6, "http://example.com/fr/7", "<base href='/de/'>" + link("7")),
        (7, "http://free.com/c", link("/d")), (8, "http://free.com/e", link("mailto:a@x.net")), (9, None, link("/de/5")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert got == {**dict.fromkeys(range(1, 7), "block"), 7: "allow", 8: "allow", 9: "allow"}


LINK = '<link rel="canonical" href="http://x.net/{}">'
LINKED = [
    (1, "http://a.com/1", f"<!-- {LINK.format(1)} --><p>"), (2, "http://a.com/2", f"<script>var t = '{LINK.format(2)}';</script>"),
    (3, "http://a.com/3", '<link rel="x Canonical  y" href=http://x.net/3>'), (4, "http://a.com/4", '<link rel=canonical data-href="http://x.net/4">'),
    (5, "http://a.com/5", '<link title=" rel=canonical " href="http://x.net/5">'), (6, "http://a.com/6", "<link rel=canonical href='http://y.com/'>" + LINK.format(6)),
    (7, "http://m.io/a", ""), (8, "http://www.io/a", LINK.format(8)), (9, "http://www.m.io/a", ""), (10, "https://a.com/2.html?ref=1", ""),
    (11, "http://a.com/11", '<META CONTENT="0; URL=\'http://x.net/11\'" http-equiv="Refresh">'), (12, "http://a.com/12", '<link href="http://x.net/12" rel="canonicals">'),
    (13, "http://a.com", LINK.format(13)), (14, "http://A.com/#top", ""), (15, "http://a.com/15", '<base href="/de/"><base href="/x/"><link rel=canonical href="../en/./7?a=1&amp;b=2">'),
    (16, "http://a.com/en/7?a=1&b=2", LINK.format(16)), (17, "http://a.com/17", "<textarea>" + LINK.format(17) + "</textarea>"),
    (18, "http://a.com/18", "<link rel=canonical href='//x.net/&#47;18&eacute;'>"), (19, "http://a.com/19", "<link rel=canonical href='/fr/20'>"),
    (20, "http://x.org/fr/20", ""), (21, "http://a.org/21", "<link rel=canonical href=http://x.org/fr/20>" + LINK.format(21)), (22, None, LINK.format(22)),
    (23, "http://a.com/23", "<link rel='canonical' title='a > b' href='http://x.net/23'"), (24, "http://a.com/24", None), (24, "http://a.com/24", None),
]


def test_linked_pages_equal_the_sql(spark):
    pages = spark.createDataFrame(LINKED, "page_id long, url string, html string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(LINKED, columns=["page_id", "url", "html"]))
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.sql()})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    verdicts = {r[0]: r[4] for r in got}
    blocked = {3, 6, 8, 11, 13, 14, 15, 16, 18}
    assert {k for k, v in verdicts.items() if v == "block"} == blocked


# HTML extraction


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
    <nav><a href=/x>Home</a></nav><div class="cookie-notice">We use cookies of the kind that is good for all of you.</div>
    <article><header><h1>Head &amp; tail</h1></header><p>The first block of the article is long and has stop words.
    <p>Short.</p><ul><li>one</li></ul><form>Sign up</form><script>var t="</p>";</script><p>a<b>b</b>&nbsp;c<br>next
    <div class=comments><p>The reader of the page is not a part of the article at all.</p></div></article>
    <aside><p>The side bar of the page is not a part of the article at all.</p></aside><footer>&copy; x</footer>"""
    assert extract.main_text(page) == (
        "Head & tail\nThe first block of the article is long and has stop words.\nShort.\none\nab c\nnext"
    )
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<script>x") == ""
    assert extract.main_text("<article><p>cut &am") == "cut &am"
    assert extract.main_text('<article><p>cut <a href="/x') == "cut"
    assert extract.main_text("<article><p>1 < 2 and 3</p>") == "1 < 2 and 3"
    plain = "<p>The words of this page are in no article and it is long.</p>"
    assert extract.main_text(plain + "<p>Short.</p><p><a href=x>only a link</a></p>").endswith("Short.")


def test_broken_markup_keeps_the_main_text():
    long = "The words of this page are the main text and it is long."
    for tag in ('p class="a""', "p data-x=it's", 'p class="a"b', "p 'x", 'p "', "p a=b/", "p = x", "p class='", "p a = 'b' c"):
        if tag == "p class='":
            # An open quotation ends at the next mark, by the rules of HTML.
            assert extract.main_text(f"<article><{tag}>{long}</p><p title='x'>{long}</p>") == long
            continue
        assert extract.main_text(f"<article><{tag}>{long}</p><p>{long}</p></article>") == f"{long}\n{long}", tag
    assert extract.main_text(f'<article><p class="ad">x<div>{long}</div></article>') == long
    assert extract.main_text(f'<article><ul><li class="ad">x<li>{long}<li>{long}</ul></article>') == f"{long}\n{long}"
    assert extract.main_text(f'<article><dl><dt class=ad>x<dd>{long}</dl><table><tr><td class=ad>x<td>{long}<tr class=ad><td>x<tr><td>{long}</table>') == "\n".join([long] * 3)
    assert extract.main_text("<article><p>" + "<a b='" * 20_000) == ""
    assert extract.main_text(f"<article><p>{'<' * 20_000} {long}") == "<" * 20_000 + " " + long


def test_names_in_an_article_are_whole_tokens():
    long = "The words of this page are the main text and it is long."
    for tag in ("section class=social-history", "p class=legal-basis", "p class=share-price", "div class=related", "p class='notice x'", "div id=header"):
        name = tag.split()[0]
        assert extract.main_text(f"<article><{tag}>{long}</{name}></article>") == long, tag
    for tag in ("div class='x comments'", "div id=disqus_thread", "div class=share-buttons", "div class='AD'", "p style='color:red; display: none'"):
        assert extract.main_text(f"<article><p>{long}</p><{tag}>{long} No.</{tag.split()[0]}></article>") == long, tag
    assert extract.main_text(f"<article><p>{long} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>") == f"{long} x=1"
    assert extract.main_text(f"<p>{long}</p><div style='display:none'><p>{long} No.</p></div>") == long


def test_reader_comments_under_a_heading():
    long = "The words of this page are the main text and it is long."
    page = f"<article><p>{long}</p><h2>{{}}</h2><p>{long} I agree.</p><h3>Anna</h3><p>{long} I do not.</p><h2>Sources</h2><p>{long}</p></article>"
    for head in ("Responses", "3 Comments", "Kommentare (2)", "Reader comments", "Leave a reply"):
        assert extract.main_text(page.format(head)) == f"{long}\nSources\n{long}", head
    assert extract.main_text(page.format("Responses to the plan")).count("\n") == 6
    inner = f"<article><p>{long}</p><div><h2>Comments</h2><p>{long} I agree.</p></div><p>{long}</p></article>"
    assert extract.main_text(inner) == f"{long}\n{long}"


def test_ordinary_markup_keeps_the_main_text():
    long = "The words of this page are the main text and it is long."
    for tag in (
        'div style="overflow:hidden"', 'p title="the hidden truth"', 'div data-hidden="false"', 'div data-id="nav"',
        "div title='a > b' alt=\"role=navigation\"", "div/data-role=banner", "div aria-hidden=false", "p data-x=1/class=menu",
    ):
        assert extract.main_text(f"<{tag}>{long}</{tag.split()[0].split('/')[0]}>") == long, tag
    for tag in ("div hidden", 'p HIDDEN=""', "div class='x menu'", 'div id="nav"', "div role = Navigation", "div aria-hidden='true'"):
        assert extract.main_text(f"<{tag}>{long}</div>") == "", tag
    assert extract.main_text(f'<html class="no-js nav"><body class="no-sidebar"><p>{long}</p>') == long
    for name in ("article", "main"):
        inner = f'<{name} class="widget post"><h1><a href=/x>Title</a></h1><p>{long}<p><a href=/y>See this</a></{name}>'
        want = f"Title\n{long}\nSee this"
        assert extract.main_text(inner) == want
        assert extract.main_text(f'<div class="layout right-sidebar"><div id=social>{inner}</div></div>') == want
        assert extract.main_text(f'<div class="layout right-sidebar">{inner}<div class=menu><p>{long}</div></div>') == want
        assert extract.main_text(f'<div class="menu"><p>{long}</div>{inner}<nav class=x><article>{long}</article></nav>') == want
    other = "Questo testo parla dei cani che corrono sulla spiaggia mentre piove forte da ore."
    page = f"<p><a href=/>Home</a></p><h2>Cani</h2><p>{other}</p><p>{other}</p><p><a href=/x>Tutti</a></p>"
    assert extract.main_text(page).endswith(f"{other}\n{other}")
    assert extract.main_text("<div>" + "犬が海辺を走る。" * 8 + "</div>") == "犬が海辺を走る。" * 8
    # Beside text of a known language, a long block without stop words takes the label of its neighbours.
    mixed = f"<p>{long}</p><p>{'zyx ' * 12}</p><p>{long}</p>"
    assert extract.main_text(mixed) == f"{long}\n{('zyx ' * 12).strip()}\n{long}"


@with_tables
def test_extraction_equals_the_article(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in extract.extract(pages.withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:h1|p|br)>", re.sub(r"<(?!/?(?:h1|p|br)>)/?\w*>?|<[^>]*\Z", "", body[1] if body else ""))
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        text = "\n".join(b for b in want if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (text, len(text))


# Queries and pipeline


@with_tables
@pytest.mark.parametrize("name", ["op1_chat", "op9_urls"])
def test_query_equals_sql(spark, name):
    status, _, n = compare(spark, connect(SMALL), name, SMALL)
    assert status == "ok" and n > 0


@with_tables
def test_pipeline_equals_its_steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = quality.score(docs, quality.weights(docs, spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1")))
    keep = {r["doc_id"] for r in good.where("kept").collect()}
    assert keep <= {i for i, t in texts.items() if not base_rules(t)[-1]} and len(keep) > 0.7 * len(texts)
    groups = brute_components([(i, texts[i]) for i in sorted(keep)])
    keep = {i for i, (_, c) in groups.items() if c == i}
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    keep = {i for i in keep if not any(" " + " ".join(w) + " " in " " + " ".join(re.findall(r"[^\W_]+", texts[i].lower())) + " " for w in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == keep
    library = Tokenizer.from_file(TOKENIZER)
    for i in keep:
        if not base_spans(texts[i]):
            assert got[i]["ids"] == library.encode(texts[i], add_special_tokens=False).ids
        else:
            assert "<secret>" in library.decode(got[i]["ids"])


def test_registered():
    assert sum(bool(re.match(r"op\d+_", n)) for n in entry.queries()) == 13
    assert "pipeline" in entry.queries() and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5

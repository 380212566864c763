"""Toxicity scores from a lexicon trie searched by Levenshtein automata.

Terms are learned from labelled documents: whole words and word beginnings that are common in toxic
and rare in other documents. They form a trie. For each distinct word a Levenshtein automaton runs
along the trie: its state is a row of the edit-distance table, and branches whose row exceeds the
allowed distance are left. So misspelled terms are found without a list of misspellings. Exact hits
need no context; a fuzzy hit must be of a long term and lie within ``MAX_EDITS``.

Each hit is seen in its context window: inside quotation marks, or shortly after a word that reports
speech, it counts as quotation, else as use. What speaks for the label is that toxic documents often
hold a term, against the chance that a clean text of the same length holds it as often; log odds add
up over the terms found.

The fit uses at most about ``FIT_ROWS`` labelled documents, chosen by a hash of the id: rows of
``labels`` whose crc32(id) mod 3 is not 1. Scoring reads the text alone, whole. Null and empty texts
have no hits and score as any text without one. Without labelled
rows there are no terms. Repeated rows are scored one by one; repeated labels count once per row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import by_value, stored, words
from lifeledger.llm.quality import windows_of

FIT_ROWS = 20_000
THRESHOLD = 0.7
#: Terms: shortest, longest, least ratio of the rates, and the chance (as a natural log) that a term of no
#: meaning is among them.
SHORTEST, LONGEST, LEAST_RATIO, CHANCE = 4, 12, 20.0, -4.0
#: Fuzzy matching: least letters of a word and of a beginning, edits.
FUZZY_FROM, FUZZY_START_FROM, MAX_EDITS = 5, 7, 1
#: Letters before a hit that are searched for a reporting word or an opening quotation mark.
WINDOW = 40
WORD_CACHE = 400_000
#: Share of toxic documents taken to hold a misspelled term; weight of a hit that is only quoted; and what a
#: document without a hit loses in log odds.
FUZZY_SHARE, QUOTED, NO_HIT = 0.02, 0.4, 3.0
#: Letters by which the words that begin like a term are counted.
HEAD = 2

WORD = re.compile(r"[^\W\d_]+")
# Quotation marks, and words that report speech.
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
REPORTS = re.compile(
    r"\b(said|says|wrote|writes|quoted?|called|according|sagte|schrieb|zitierte|nannte|a dit|écrit|selon|dijo|escribió|según)\b", re.I
)


def is_held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


class Lexicon:
    """Trie of terms; a term either is a whole word or begins one."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.root: dict = {}
        for number, (term, begins) in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            # The end of a term holds its number; as a whole word it goes before the beginning.
            node.setdefault("", {}).setdefault(begins, number)
        self.known: dict[str, int] = {}

    def exact(self, word: str) -> int | None:
        """Number of the term that is this word, else of the longest term that begins it."""
        node, found = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                return found
            found = node.get("", {}).get(True, found)
        return node.get("", {}).get(False, found)

    def fuzzy(self, word: str) -> int | None:
        """Number of a long term that the word, or for beginnings a start of it, is within ``MAX_EDITS`` of.

        States are (letters read, trie node, edits, depth, last letter read as it is). Without an edit
        left a state has one way on, so the search dies as soon as the word leaves the trie.
        """
        size = len(word)
        stack = [(0, self.root, 0, 0, True)]
        while stack:
            at, node, edits, depth, clean = stack.pop()
            ends = node.get("", ())
            if False in ends and depth >= FUZZY_FROM and size - at <= MAX_EDITS - edits:
                return ends[False]
            # Beginnings need their last letter, else any longer word would do.
            if True in ends and depth >= FUZZY_START_FROM and clean:
                return ends[True]
            letter = word[at] if at < size else None
            child = node.get(letter) if letter else None
            if child is not None:
                stack.append((at + 1, child, edits, depth + 1, True))
            if edits < MAX_EDITS:
                if letter:
                    stack.append((at + 1, node, edits + 1, depth, False))
                for c, other in node.items():
                    if c:
                        stack.append((at, other, edits + 1, depth + 1, False))
                        if letter and c != letter:
                            stack.append((at + 1, other, edits + 1, depth + 1, False))
        return None

    def kind(self, word: str) -> int:
        """0 for no hit; odd for a fuzzy, even for an exact hit of term (kind - 1) // 2."""
        found = self.known.get(word)
        if found is None:
            low = word.lower()
            found = self.exact(low)
            if found is not None:
                found = 2 * found + 2
            else:
                found = self.fuzzy(low) if len(low) >= FUZZY_FROM - 1 else None
                found = 0 if found is None else 2 * found + 1
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def hits(self, text: str) -> tuple[list[str], dict[int, list[int]]]:
        """All words, and by kind of hit the numbers of different words used and only quoted.

        A word counts once, however often a text repeats it.
        """
        words, out, known = WORD.findall(text), {}, self.known
        found = {w: k for w in set(words) if (k := known.get(w, -1)) and (k > 0 or (k := self.kind(w)))}
        if found:
            said: dict[str, bool] = {}
            for m in WORD.finditer(text):
                if (w := m.group()) in found and said.get(w, True):
                    said[w] = quoted(text, m.start(), m.end())
            for w, only_quoted in said.items():
                out.setdefault(found[w], [0, 0])[only_quoted] += 1
        return words, out


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands in quotation marks or shortly after a word that reports speech."""
    line = text.rfind("\n", 0, start) + 1
    before = text[max(line, start - WINDOW) : start]
    after = text[end : end + WINDOW].split("\n", 1)[0]
    inside = (before[-1:] and before[-1] in OPENING) or (
        any(c in OPENING for c in before) and any(c in CLOSING for c in after) and before.count('"') % 2 == 1
    )
    return bool(inside or REPORTS.search(before))


def learn_terms(fit: DataFrame) -> list[tuple[str, bool, int]]:
    """Terms (text, begins, toxic documents) from (text, toxic): all that pass, none covered by another.

    The rows are a bounded sample, so its words that are frequent in toxic and rare in other texts are, too.
    """

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in {x.lower() for x in WORD.findall(text or "")}:
                    counts.setdefault(w, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.string()), *[pa.array((c[k] for c in counts.values()), pa.int64()) for k in (0, 1)]],
                names=["word", "clean", "toxic"],
            )

    vocabulary = fit.select("text", "toxic").mapInArrow(words_of, "word string, clean bigint, toxic bigint")
    vocabulary = vocabulary.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = fit.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    whole = vocabulary.select(F.col("word").alias("term"), F.lit(False).alias("begins"), "clean", "toxic")
    words_long = vocabulary.where(F.length("word") >= SHORTEST)
    starts = words_long.select(
        F.explode(F.expr(f"transform(sequence({SHORTEST}, least(length(word), {LONGEST})), k -> substring(word, 1, k))")).alias("term"),
        F.lit(True).alias("begins"), "clean", "toxic",
    )
    whole = whole.where(F.length("term") >= SHORTEST)
    if not n.get(1) or not n.get(0):
        return []
    # A term that is only by chance in toxic documents alone has the share of toxic ones to its count as odds.
    base = n[1] / (n[0] + n[1])
    least = math.ceil((math.log(max(vocabulary.count(), 1) * (LONGEST - SHORTEST)) - CHANCE) / -math.log(base))
    ratio = (F.col("toxic") / max(n.get(1, 0), 1)) / ((F.col("clean") + 0.5) / max(n.get(0, 0), 1))
    top = whole.unionByName(starts).groupBy("term", "begins").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    ).where((F.col("toxic") >= least) & (ratio >= LEAST_RATIO)).orderBy(F.desc("toxic"), "begins", F.desc(F.length("term")), "term")
    chosen: list[tuple[str, bool, int]] = []
    heads: set[str] = set()
    covered: Counter[str] = Counter()
    for r in top.collect():
        term = r["term"]
        # A term that begins with a chosen beginning adds nothing; of equal counts the longest came first.
        if any(term[:k] in heads for k in range(SHORTEST, len(term) + 1)):
            continue
        # Nor does a beginning whose words have been chosen one by one.
        if r["begins"] and r["toxic"] <= 1.2 * covered[term]:
            continue
        chosen.append((term, r["begins"], r["toxic"]))
        covered.update({term[:k]: r["toxic"] for k in range(SHORTEST, len(term) + 1)})
        if r["begins"]:
            heads.add(term)
    return chosen


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents that are not held out, one of each group of copies.

    Copies and near copies would make any rare word of theirs look like a term; documents of one label
    whose least shingle hash is the same count as such.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out("doc_id")).select(
        F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic")
    ).dropDuplicates(["id"])
    # A share of all ids that gives the wanted number, so the side that is broadcast has a bound.
    slots = max(1, -(-known.count() // rows))
    some = known.where(F.pmod(F.xxhash64("id"), F.lit(slots)) == 0)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows_of = texts.join(F.broadcast(some), "id").withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return rows_of.withColumn("group", F.coalesce(F.array_min(windows_of("hashes")), F.xxhash64("text"))).dropDuplicates(
        ["toxic", "group"]
    ).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Terms, how often clean texts hold them by chance, and how many toxic documents have them."""
    sample = stored(fit_sample(docs, labels, rows), "fit-sample")
    terms = learn_terms(sample)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits of each kind in clean texts, and under kind 0 their words."""
        trie, counts = Lexicon([t[:2] for t in shared.value]), Counter()
        # Words that begin like a term are counted under the term's first number below 0.
        numbers: dict[str, int] = {}
        for number, term in enumerate(shared.value):
            numbers.setdefault(term[0][:HEAD], -1 - number)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words, found = trie.hits(text)
                counts[0] += len(words)
                counts.update({k: sum(v) for k, v in found.items()})
                counts.update(k for w in words if (k := numbers.get(w[:HEAD].lower())))
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(counts.values(), pa.int64())], names=["kind", "n"])

    hits = {r["kind"]: r["n"] for r in sample.where("toxic = 0").select("text").mapInArrow(
        chance, "kind bigint, n bigint").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    heads: dict[str, float] = {}
    for number, term in enumerate(terms):
        heads.setdefault(term[0][:HEAD], (hits.get(-1 - number, 0) + 1) / (hits.get(0, 0) + 1))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    rates = [(hits.get(k, 0) + 0.5) / (hits.get(0, 0) + 1) for k in range(1, 2 * len(terms) + 1)]
    shares = [x for t in terms for x in (FUZZY_SHARE, min(1.0, (t[2] + 0.5) / (toxic + 1)))]
    return {"terms": terms, "rates": rates, "shares": shares, "heads": heads, "prior": math.log((toxic + 0.5) / (clean + 0.5))}


def rate_text(trie: Lexicon, model: dict, text: str) -> tuple[float, int, int, int]:
    """Score, and the numbers of exact, fuzzy and quoted hits.

    For each kind of hit, what speaks for the label is the share of toxic documents that have it, against
    the chance that a clean text of this length holds it as often (a Poisson tail). A kind that is only
    quoted counts for ``QUOTED`` of that.
    """
    words, found = trie.hits(text)
    logit, exact, fuzzy, in_quotes = 0.0, 0, 0, 0
    heads = Counter(w[:HEAD].lower() for w in words) if found else {}
    for kind, (used, said) in found.items():
        times = used or said
        head = model["terms"][(kind - 1) // 2][0][:HEAD]
        # A text in which many words begin like the term, as in one language of several, holds it more often.
        lean = max(1.0, (heads[head] - times) / len(words) / model["heads"][head])
        expected = max(model["rates"][kind - 1] * len(words) * lean, 1e-12)
        odds = math.log(model["shares"][kind - 1]) + max(0.0, -times * math.log(expected) + math.lgamma(times + 1))
        logit += max(0.0, odds) * (1.0 if used else QUOTED)
        in_quotes += said
        if kind % 2:
            fuzzy += used + said
        else:
            exact += used + said
    # Without evidence the prior is lowered by what toxic documents without a hit are worth.
    logit = logit + model["prior"] if logit > 0 else model["prior"] - NO_HIT
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), exact, fuzzy, in_quotes


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, held_out, score, predicted and the numbers of hits of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The broadcast value lives as long as the worker, and so do the trie and its cache of words.
        state = shared.value
        if "trie" not in state:
            state["trie"] = Lexicon([t[:2] for t in state["terms"]])
        for batch in batches:
            found = [rate_text(state["trie"], state, x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()),
                 *[pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)]],
                names=["id", "score", "n_exact", "n_fuzzy", "n_quoted"],
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(
        run, f"id {dict(texts.dtypes)['id']}, score double, n_exact bigint, n_fuzzy bigint, n_quoted bigint"
    )
    return rows.select(
        F.col("id").alias(id_col), F.coalesce(is_held_out("id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_exact", "n_fuzzy", "n_quoted",
    )


by_value(__name__)

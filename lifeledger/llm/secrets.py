"""Secret scan: patterns with known shapes, and a battery of randomness tests on other key-like strings.

Spans of the known shapes (``assign``, ``access``, ``hex``) are always reported. Every other maximal
run of key characters is a candidate. Its encoding (digits, hex, letters, base32, digits with letters,
base64) is inferred from its characters. A run that no alphabet holds, since it has ``+`` or ``/`` beside
``-`` or ``_``, is cut: its longest parts without any of the four, without the first two and without
the last two are candidates, which can overlap. Runs and parts of nothing but these marks are none.
Three tests ask whether a candidate could be uniform noise over its alphabet: chi-squared of the
symbol counts, Wald-Wolfowitz runs around the middle of the alphabet, and lag-1 serial correlation.
Simes' rule combines the three p-values. Short strings give weak tests, so candidates are ranked
among those of the same encoding and length band only, on a fixed grid of p-values. A candidate is
reported as ``random`` if it passes two rules, both at ``rate``:

* Benjamini-Hochberg: it is not among those that are surely not random.
* False discoveries among the reported: random strings have uniform p-values, so those beyond one half
  tell how many random ones a stratum holds at most (at ``CONFIDENCE``, so a stratum of few candidates is
  not judged on chance). What is reported beyond their expected number is ordinary text, and its share
  may not exceed ``rate``. Invented words, whose p-values crowd near zero, are thus left alone.

Only counts per (encoding, band, grid step) are shuffled, and the cut-offs, at most one per stratum,
come back as one small map. All expressions; positions are code points, ends exclusive. Null text
counts as empty and has no spans. Repeated rows are scanned one by one but count for the cut-offs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifeledger.llm.common import named

from lifeledger.functions.special import normal_sf

# The known shapes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
# Encodings from the narrowest to the widest, with their symbols in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "digits": DIGITS,
    "hex_lower": DIGITS + LOWER[:6],
    "hex_upper": DIGITS + UPPER[:6],
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "alnum_lower": DIGITS + LOWER,
    "alnum_upper": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "alnum": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Shortest candidate, false discovery rate, steps of the p-value grid (a factor of two each).
MIN_CANDIDATE = 20
RATE = 0.05
GRID = 40
#: Normal quantile of the upper limit, 99 %, of the number of random candidates of a stratum.
CONFIDENCE = 2.326
CANDIDATE = "[A-Za-z0-9+/_-]{%d,}" % MIN_CANDIDATE
#: What a run that no alphabet holds is cut into.
PARTS = ["[A-Za-z0-9%s]{%d,}" % (marks, MIN_CANDIDATE) for marks in ("", "+/", "_-")]


def _running(values: Column, join: Callable[[Column, Column], Column], start: int) -> Column:
    """Running sums or maxima of an array of int, by doubling steps: n log n, where appending would be n squared."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    before = lambda acc, i, d: F.coalesce(F.get(acc, i - F.pow(F.lit(2), d).cast("int")), F.lit(start))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: join(x, before(acc, i, d))))


def _matches(text: str | Column, pattern: str, kind: str, rank: int) -> Column:
    """Array of (start, end, rank, kind, found) of the leftmost non-overlapping matches of a pattern."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
    ends = _running(lengths, lambda x, y: x + y, 0)
    spans = F.zip_with(found, ends, lambda m, end: F.struct(
        (end - F.length(m)).alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
        m.alias("found"),
    ))
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,found:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(empty)


def _p_normal(z: Column) -> Column:
    """Two-sided p-value."""
    return named(F.abs(z), lambda a: F.least(F.lit(1.0), 2 * normal_sf(a)))


def _p_values(codes: Column, n: Column, k: Column) -> Column:
    """Sorted p-values of the three tests for symbol indexes ``codes`` over an alphabet of ``k``."""
    real = lambda c: c.cast("double")
    # Chi-squared against equal frequencies. Expected counts are small, so the exact mean and variance
    # of the statistic are used (k - 1 and 2 (k - 1) (n - 1) / n), on the cube root scale.
    squares = F.aggregate(
        F.array_distinct(codes), F.lit(0.0),
        lambda acc, c: acc + F.pow(real(F.size(F.filter(codes, lambda x: x == c))), 2.0),
    )
    chi = squares * real(k) / real(n) - real(n)
    spread = F.lit(2.0) / 9.0 * (real(n) - 1) / real(n) / (real(k) - 1)
    chi_z = (F.cbrt(F.greatest(chi, F.lit(0.0)) / (real(k) - 1)) - (1 - spread)) / F.sqrt(spread)
    # Runs above and below the middle of the alphabet.
    high = F.transform(codes, lambda c: 2 * c >= k)
    n1 = real(F.size(F.filter(high, lambda h: h)))
    n2 = real(n) - n1
    runs = 1.0 + real(F.size(F.filter(high, lambda h, i: (i > 0) & (h != F.get(high, i - 1)))))
    mean = 2 * n1 * n2 / real(n) + 1
    variance = (mean - 1) * (mean - 2) / (real(n) - 1)
    runs_p = F.when((n1 > 0) & (n2 > 0) & (variance > 0), _p_normal((runs - mean) / F.sqrt(variance))).otherwise(0.0)
    # Lag-1 serial correlation around the mean of the alphabet.
    middle = (real(k) - 1) / 2
    lagged = F.aggregate(
        F.transform(codes, lambda c, i: F.when(i > 0, (real(c) - middle) * (real(F.get(codes, i - 1)) - middle)).otherwise(0.0)),
        F.lit(0.0), lambda acc, x: acc + x,
    )
    serial_z = lagged / (F.sqrt(real(n) - 1) * (real(k) * real(k) - 1) / 12)
    return F.array_sort(F.array(named(chi_z, normal_sf), runs_p, _p_normal(serial_z)))


def _encoding(found: Column) -> Column:
    """Narrowest encoding that holds all characters; null if none does, or without a digit or letter."""
    out = F.lit(None).cast("string")
    for name, symbols in reversed(ENCODINGS.items()):
        out = F.when(F.length(F.translate(found, symbols, "")) == 0, F.lit(name)).otherwise(out)
    return F.when(found.rlike("[A-Za-z0-9]"), out)


def _tested(span: Column) -> Column:
    """A candidate with its stratum and the grid step of its combined p-value."""
    symbols = F.create_map(*[F.lit(x) for pair in ENCODINGS.items() for x in pair])

    def stratum(encoding: Column) -> Column:
        alphabet = symbols[encoding]
        n = F.length(span["found"])
        codes = F.transform(F.split(span["found"], ""), lambda c: F.instr(alphabet, c) - 1)
        codes = F.filter(codes, lambda c: c >= 0)
        simes = lambda p: F.least(3 * F.get(p, 0), 1.5 * F.get(p, 1), F.get(p, 2))
        p = named(codes, lambda c: named(_p_values(c, n, F.length(alphabet)), simes))
        step = F.least(F.lit(GRID), F.floor(-F.log2(F.greatest(p, F.lit(2.0 ** -GRID)))).cast("int"))
        return F.struct(
            span["start"].alias("start"), span["end"].alias("end"), F.lit(3).alias("rank"), F.lit("random").alias("kind"),
            # Length bands double: 20-39, 40-79 and so on.
            F.concat_ws(":", encoding, F.floor(F.log2(n / F.lit(float(MIN_CANDIDATE)))).cast("string")).alias("stratum"),
            F.greatest(step, F.lit(0)).alias("step"),
        )

    return named(_encoding(span["found"]), stratum)


def _candidates(rest: Column) -> Column:
    """Runs that an alphabet holds, and the parts of the others."""
    loose = lambda text, pattern: _matches(text, pattern, "random", 3)
    held = lambda runs: F.filter(runs, lambda c: _encoding(c["found"]).isNotNull())
    cut = lambda text: held(F.array_distinct(F.concat(*[loose(text, pattern) for pattern in PARTS])))
    # Parts are looked for in what the whole candidates leave.
    mixed = lambda text, whole: redacted(text, whole, lambda n: F.repeat(F.lit(" "), n))
    both = lambda text, runs, whole: F.when(
        F.size(whole) < F.size(runs), F.concat(whole, named(mixed(text, whole), cut))
    ).otherwise(whole)
    # Named inside one expression: columns of their own would be copied into the filter that explode brings.
    return named(rest, lambda text: named(
        loose(text, CANDIDATE), lambda runs: named(held(runs), lambda whole: both(text, runs, whole))
    ))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``base`` spans and tested ``candidates`` of every row; ``keep`` columns ride along in ``row``."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []),
    )
    # Group 2 is what stands after the last quote, sign or blank that the pattern allows.
    value = lambda found: F.regexp_extract(found, ASSIGN, 2)
    rows = rows.withColumns({
        "assign": F.filter(_matches("text", ASSIGN, "assign", 0), lambda s: F.length(value(s["found"])) >= ASSIGN_MIN),
        "access": _matches("text", ACCESS, "access", 1),
        "hex": _matches("text", HEX, "hex", 2),
    }).withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    # Candidates are looked for in what the base spans leave, at unchanged positions.
    rows = rows.withColumn("rest", redacted("text", "base", lambda n: F.repeat(F.lit(" "), n)))
    return rows.select(
        *(["row"] if keep else []), "id", "text", "assign", "access", "hex", "base",
        F.transform(_candidates(F.col("rest")), _tested).alias("candidates"),
    )


def cutoffs(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """One row: ``cuts``, a map from stratum to the first grid step at which a candidate is not reported.

    At grid step s, p <= 2 ** -s. With m candidates of a stratum and r of them at s or beyond, the first
    rule rejects randomness from the smallest s with m * 2 ** -s <= rate * r. With c candidates at step 0
    at most 2 (c + CONFIDENCE sqrt(c + 1)) are random, and (1 - 2 ** -s) of these lie before s; the second
    rule reports up to the largest s before which no more than ``rate`` of all lie beyond that number.
    """
    counts = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.step").count()
    strata = counts.groupBy("stratum").agg(
        F.sum("count").alias("m"), F.collect_list(F.struct("step", "count")).alias("at"),
        F.sum(F.when(F.col("step") == 0, F.col("count")).otherwise(0)).alias("first"),
    )
    some = lambda chosen: F.aggregate(
        "at", F.lit(0).cast("long"), lambda acc, x: acc + F.when(chosen(x["step"]), x["count"]).otherwise(0)
    )
    steps = F.sequence(F.lit(0), F.lit(GRID + 1))
    surely_not = F.filter(steps, lambda s: (s <= GRID) & (
        F.col("m") * F.pow(F.lit(2.0), -s) <= F.lit(rate) * some(lambda step: step >= s)
    ))
    most = F.least(F.col("m").cast("double"), 2 * (F.col("first") + CONFIDENCE * F.sqrt(F.col("first") + 1)))
    # The last step of the grid has no end: all random candidates lie before what follows it.
    expected = lambda s: most * F.when(s > GRID, 1.0).otherwise(1 - F.pow(F.lit(2.0), -s))
    enough = F.filter(steps, lambda s: some(lambda step: step < s) * (1 - rate) <= expected(s))
    cut = F.least(F.coalesce(F.array_min(surely_not), F.lit(GRID + 1)), F.array_max(enough))
    return strata.select("stratum", cut.alias("cut")).agg(
        F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("cuts")
    )


def found(scanned: DataFrame, cuts: DataFrame) -> DataFrame:
    """``scanned`` with ``spans``: base spans and candidates that are reported as random, in order."""
    short = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"))
    rows = scanned.withColumn("cuts", cuts.scalar())
    random = F.filter("candidates", lambda c: c["step"] < F.coalesce(F.col("cuts")[c["stratum"]], F.lit(GRID + 1)))
    return rows.withColumn("spans", F.sort_array(F.concat(F.transform("base", short), F.transform(random, short)))).drop("cuts")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, checksum and span list of the result of ``found``."""
    return rows.select(
        F.col("id").alias(id_col),
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def redacted(text: str | Column, spans: str | Column, mask: Callable[[Column], Column] = lambda _: F.lit("<secret>")) -> Column:
    """The text with each span replaced by ``mask(its length)``; of a span that runs into an earlier one, what is left.

    Spans come in order of start; a span inside an earlier one is gone with it.
    """

    text = F.col(text) if isinstance(text, str) else text

    def cut(reach: Column) -> Column:
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        pieces = F.transform(spans, lambda s, i: F.when(s["end"] <= before(i), F.lit("")).otherwise(F.concat(
            F.substring(text, before(i) + 1, F.greatest(s["start"] - before(i), F.lit(0))),
            F.when(s["start"] < before(i), mask(s["end"] - before(i))).otherwise(mask(s["end"] - s["start"])),
        )))
        return F.concat(F.array_join(pieces, ""), F.substring(text, before(F.size(spans)) + 1, F.length(text)))

    reach = _running(F.transform(spans, lambda s: s["end"]), F.greatest, 0)
    return F.when(F.size(spans) > 0, named(reach, cut)).otherwise(text)

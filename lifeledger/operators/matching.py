"""Propensity scores and nearest-neighbour matching without replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeledger.functions import inclusive_days, later
from lifeledger.operators.aggregates import rank_within
from lifeledger.operators.relational import stack
from lifeledger.session import by_value, cut_lineage

# The study's matching ratio and caliper in standard deviations of the distance.
RATIO = 4
CALIPER = 0.25
#: Distinct scores of a block of the matching.
BLOCK_SCORES = 50_000


def _logistic_sums(cells: DataFrame, by: str, terms: Sequence[Column], beta: Mapping[object, np.ndarray]) -> dict:
    """Log-likelihood, score and information of every group at its coefficients, in one aggregation."""
    kind = cells.schema[by].dataType.simpleString()
    rows = cells.sparkSession.createDataFrame([(g, [float(v) for v in b]) for g, b in beta.items()], f"`{by}` {kind}, _beta array<double>")
    x = [F.lit(1.0), *terms]
    data = cells.join(F.broadcast(rows), on=by).withColumns({f"_x{i}": v for i, v in enumerate(x)})
    data = data.withColumn("_eta", sum((F.col("_beta")[i] * F.col(f"_x{i}") for i in range(1, len(x))), F.col("_beta")[0]))
    n, share, eta = F.col("n"), F.col("share"), F.col("_eta")
    data = data.withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))
    weight = n * F.col("_p") * (F.lit(1.0) - F.col("_p"))
    # ln(1 + e^eta) without overflow.
    soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    sums = {"l": n * (share * eta - soft)} | {f"g{i}": n * (share - F.col("_p")) * F.col(f"_x{i}") for i in range(len(x))}
    sums |= {f"h{i}_{j}": weight * F.col(f"_x{i}") * F.col(f"_x{j}") for i in range(len(x)) for j in range(i + 1)}
    out = {}
    for r in data.groupBy(by).agg(*[F.sum(v).alias(k) for k, v in sums.items()]).collect():
        information = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(len(x))] for i in range(len(x))])
        out[r[by]] = (r["l"], np.array([r[f"g{i}"] for i in range(len(x))]), information)
    return out


def fit_logistic(cells: DataFrame, by: str, terms: Sequence[Column], max_rounds: int = 50, tol: float = 1e-10) -> dict:
    """Coefficients of every group by iteratively reweighted sums; all groups advance in the same rounds.

    ``cells`` has ``n`` rows and their ``share`` with the outcome per covariate cell. A round is one job; one row per
    group reaches the driver. A group whose outcome the covariates separate has no finite optimum: its steps
    are taken until they gain nothing.
    """
    groups = [r[0] for r in cells.select(by).where(F.col(by).isNotNull()).distinct().collect()]
    beta = {g: np.zeros(len(terms) + 1) for g in groups}
    best: dict = {}
    active = dict(beta)
    for _ in range(max_rounds):
        if not active:
            break
        for g, (loglik, gradient, information) in _logistic_sums(cells, by, terms, active).items():
            if g in best and not loglik >= best[g][0] - 1e-12 * (1 + abs(best[g][0])):
                step = best[g][2] / 2
                best[g] = (*best[g][:2], step)
            else:
                scale = np.sqrt(np.maximum(np.diag(information), 1e-300))
                step = (np.linalg.pinv(information / np.outer(scale, scale), rcond=1e-12) @ (gradient / scale)) / scale
                gained = loglik - best[g][0] if g in best else np.inf
                best[g] = (loglik, active[g], step)
                if gained < 1e-13 * (1 + abs(loglik)) and np.abs(step).max() > 1:
                    step = np.zeros_like(step)
            if np.abs(step).max() < tol * (1 + np.abs(best[g][1]).max()):
                beta[g] = best[g][1] + step
                del active[g]
            else:
                active[g] = best[g][1] + step
    for g in active:
        beta[g] = best[g][1]
    return beta


def propensity(
    df: DataFrame, arm: str, numeric: Sequence[str], binary: dict[str, str], by: str, name: str = "ps"
) -> DataFrame:
    """Fitted probability of ``arm`` = 1 by logistic regression, one model per value of ``by``.

    ``binary`` maps a two-level column to its level coded 1. The fit reads counts per covariate cell, so its cost
    follows the distinct covariates, not the rows. Rows without a group have no score.
    """
    covariates = [*numeric, *binary]
    cells = cut_lineage(df.groupBy(by, *covariates).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(arm).cast("double")).alias("share")
    ))
    terms = [F.col(c).cast("double") for c in numeric]
    terms += [(F.col(c) == F.lit(v)).cast("double") for c, v in binary.items()]
    beta = fit_logistic(cells, by, terms)
    kind = df.schema[by].dataType.simpleString()
    rows = df.sparkSession.createDataFrame([(g, [float(v) for v in b]) for g, b in beta.items()], f"`{by}` {kind}, _beta array<double>")
    eta = sum((F.col("_beta")[i] * x for i, x in enumerate(terms, 1)), F.col("_beta")[0])
    scored = df.join(F.broadcast(rows), on=by, how="left").withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))
    return scored.select(*df.columns, name)


def _serve(
    cells: pd.DataFrame, taken: pd.DataFrame, ratio: int, width: float, ends: tuple[bool, bool]
) -> tuple[list[tuple], bool]:
    """Greedy assignment of one block's cases: turn by turn, from the highest score down, nearest control first.

    ``cells`` has a row for each distinct score in reach, with the block's own ``cases`` and all ``controls``. ``taken`` has
    what other blocks take (score, turn, amount, before): ``before`` tells whether that block is served earlier in
    the same turn. Used-up cells are skipped through two path-compressed pointer arrays. ``ends`` tells whether
    the scores end below and above the reach; the second result is whether a case might have found its
    control beyond it.
    """
    cells = cells.sort_values("score")
    score, cases = cells["score"].to_numpy(), cells["cases"].to_numpy()
    left = cells["controls"].to_numpy().copy()
    up, down = np.arange(len(score) + 1), np.arange(len(score) + 1)
    # Amounts that others have taken before this block's turn, per cell: their earlier turns, and this one if they come first.
    foreign = np.zeros((ratio + 1, len(score)), dtype=np.int64)
    if len(taken):
        at = np.searchsorted(score, taken["score"].to_numpy())
        first_seen = taken["turn"].to_numpy() + np.where(taken["before"].to_numpy(), 0, 1)
        seen = first_seen <= ratio
        np.add.at(foreign, (first_seen[seen], at[seen]), taken["amount"].to_numpy()[seen])

    def find(link: np.ndarray, i: int) -> int:
        root = i
        while link[root] != root:
            root = link[root]
        while link[i] != root:
            link[i], i = root, link[i]
        return root

    def close(i: int) -> None:
        # ``down`` is shifted by one so that index 0 means "nothing below".
        up[i], down[i + 1] = i + 1, i

    out: list[tuple] = []
    beyond = False
    for i in np.flatnonzero(left <= 0):
        close(i)
    for turn in range(1, ratio + 1):
        for i in np.flatnonzero(foreign[turn]):
            if left[i] > 0:
                left[i] -= foreign[turn][i]
                if left[i] <= 0:
                    close(i)
        for i in np.flatnonzero(cases)[::-1]:
            served = 0
            while served < cases[i]:
                above, below = find(up, i), find(down, i + 1) - 1
                gap_above = score[above] - score[i] if above < len(score) else np.inf
                gap_below = score[i] - score[below] if below >= 0 else np.inf
                # Controls out of reach lie beyond its last score on that side.
                best = min(gap_above, gap_below, width)
                if (above >= len(score) and not ends[1] and score[-1] - score[i] <= best) or (
                    below < 0 and not ends[0] and score[i] - score[0] <= best
                ):
                    beyond = True
                if min(gap_above, gap_below) > width:
                    break
                j = above if gap_above <= gap_below else below
                take = int(min(cases[i] - served, left[j]))
                out.append((score[i], served + 1, score[j], take, turn))
                served += take
                left[j] -= take
                if left[j] == 0:
                    close(j)
    return out, beyond


def _blocks(cells: DataFrame, by: str, size: int) -> DataFrame:
    """Add ``block``: numbers of score ranges of about ``size`` distinct scores, rising with the score."""
    n = max(1, -(-cells.count() // size))
    ranged = cells.repartitionByRange(n, by, "score") if n > 1 else cells
    numbered = ranged.withColumn("block", (F.spark_partition_id() if n > 1 else F.lit(0)).cast("int"))
    # Which partition a score lies in is fixed here: later reads take the stored number.
    return cut_lineage(numbered)


def serve(cells: DataFrame, widths: DataFrame, by: str, ratio: int, block_size: int) -> DataFrame:
    """Who is served by whom: (by, case_score, case_from, control_score, size, match_no), on distinct scores.

    Scores are cut into ranges, the blocks. A block serves its own cases exactly as the sequential procedure would, given
    what the blocks served before it take: in a turn those are the blocks of higher scores, and all blocks
    in earlier turns. All blocks work at once on what the others took in the last round, from nothing at first; when a
    round changes nothing, every block has served in the right order. (By induction the highest block is right after
    the first round, and each next one a round after those before it at the latest.) A block sees its neighbours' controls,
    one more block on either side whenever a case might reach beyond them. Each round is stored.
    """
    kind = cells.schema[by].dataType.simpleString()
    cells = _blocks(cells, by, block_size)
    spans = cut_lineage(cells.groupBy(by).agg(F.min("block").alias("lowest"), F.max("block").alias("highest")).join(widths, by))
    reach = cut_lineage(
        cells.where(F.col("cases") > 0).select(by, "block").distinct().join(spans, by).select(
            "*", F.lit(1).alias("span")
        )
    )
    taken, mark = None, None
    while True:
        asked = reach.select(
            by, F.col("block").alias("asker"), "width", "lowest", "highest", "span",
            F.explode(F.sequence(
                F.greatest(F.col("block") - F.col("span"), "lowest"), F.least(F.col("block") + F.col("span"), "highest")
            )).alias("block"),
        )
        seen = cells.join(asked, [by, "block"]).select(
            by, "asker", "width", "lowest", "highest", "span", "score", F.when(F.col("block") == F.col("asker"), F.col("cases")).otherwise(0).alias("cases"),
            "controls", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("amount"), F.lit(False).alias("before"),
        )
        if taken is not None:
            others = taken.join(asked, [by, "block"]).where(F.col("source") != F.col("asker"))
            seen = seen.unionByName(others.select(
                by, "asker", "width", "lowest", "highest", "span", F.col("control_score").alias("score"), F.lit(0).cast("long").alias("cases"),
                F.lit(0).cast("long").alias("controls"), F.col("match_no").alias("turn"), F.col("size").alias("amount"),
                (F.col("source") > F.col("asker")).alias("before"),
            ))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            head = pdf.iloc[0]
            own, others = pdf[pdf["turn"] == 0], pdf[pdf["turn"] > 0]
            ends = (head["asker"] - head["span"] <= head["lowest"], head["asker"] + head["span"] >= head["highest"])
            rows, beyond = _serve(own, others, ratio, float(head["width"]), ends)
            out = pd.DataFrame(rows, columns=["case_score", "case_from", "control_score", "size", "match_no"])
            # A row without a turn carries the news that the reach was too short.
            if beyond:
                out.loc[len(out)] = (np.nan, 0, np.nan, 0, 0)
            out.insert(0, "source", head["asker"])
            out.insert(0, by, head[by])
            return out

        found = cut_lineage(seen.groupBy(by, "asker").applyInPandas(
            run, f"`{by}` {kind}, source int, case_score double, case_from long, control_score double, size long, match_no int"
        ))
        short = found.where(F.col("match_no") == 0).select(by, F.col("source").alias("block"))
        now = found.where(F.col("match_no") > 0)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*now.columns).cast("decimal(38,0)"))).first()
        n_short = short.count()
        alone = spans.where(F.col("lowest") < F.col("highest")).limit(1).count() == 0
        if not n_short and (alone or state == mark):
            return now.drop("source")
        mark = state
        if n_short:
            reach = cut_lineage(reach.join(short.withColumn("_short", F.lit(1)), [by, "block"], "left").withColumn(
                "span", F.col("span") + F.coalesce("_short", F.lit(0))
            ).drop("_short"))
        places = cells.select(by, F.col("score").alias("control_score"), "block")
        taken = cut_lineage(now.join(places, [by, "control_score"]))


def match_nearest(
    df: DataFrame, key: str, arm: str, score: str, by: str, ratio: int = RATIO, caliper: float = CALIPER,
    block_size: int = BLOCK_SCORES,
) -> DataFrame:
    """1:``ratio`` nearest-neighbour matching on a score, without replacement, within ``by``.

    Cases are served from the highest score down and each gets its first control before any gets
    a second. A control further away than ``caliper`` standard deviations of the score is never
    used. Equal distances prefer the control with the higher score; equal scores are served in the
    order of :func:`rank_within`. Returns the matched rows with ``subclass`` (the key of the case),
    ``match_no`` (0 for the case itself), ``distance`` and ``weight``: 1 for a case, and for a control
    1 / (controls of its case), scaled within ``by`` so that the controls' weights sum to their number.

    Only the number of cases and controls per distinct score decides who is served by whom. That part runs on
    distinct scores in blocks of about ``block_size``, see :func:`serve`, and the rows follow through equi joins
    on their number within the score; neither sees a whole cohort in one task.
    """
    ranked = cut_lineage(rank_within(df.where(F.col(score).isNotNull()), [by, score, arm], key, "_no"))
    cells = ranked.groupBy(by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(arm) == 1).alias("cases"), F.count_if(F.col(arm) == 0).alias("controls")
    )
    widths = ranked.groupBy(by).agg((F.stddev_samp(score) * F.lit(caliper)).alias("width")).where("width IS NOT NULL")
    served = serve(cells, widths, by, ratio, block_size)
    # Number of the first control that each case takes: those of a score go in the order of the turns, higher cases first.
    order = Window.partitionBy(by, "control_score").orderBy("match_no", F.desc("case_score"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    served = cut_lineage(served.withColumn("control_from", before + 1))
    cases = ranked.where(F.col(arm) == 1)
    controls = ranked.where(F.col(arm) == 0)
    # Number of the case inside its score, for every control that was used.
    placed = (
        controls.alias("c")
        .join(
            served.alias("s"),
            (F.col(f"c.{by}") == F.col(f"s.{by}"))
            & (F.col(f"c.{score}") == F.col("s.control_score"))
            & (F.col("c._no") >= F.col("s.control_from"))
            & (F.col("c._no") < F.col("s.control_from") + F.col("s.size")),
        )
        .select(
            "c.*", "s.case_score", "s.match_no",
            (F.col("s.case_from") + F.col("c._no") - F.col("s.control_from")).alias("_case_no"),
        )
    )
    subclass = cases.select(
        by, F.col(score).alias("case_score"), F.col("_no").alias("_case_no"), F.col(key).alias("subclass")
    )
    matched = cut_lineage(placed.join(subclass, on=[by, "case_score", "_case_no"]).withColumn(
        "distance", F.abs(F.col(score) - F.col("case_score"))
    ))
    per_case = matched.groupBy(by, "subclass").agg(F.count(F.lit(1)).alias("_controls"))
    scale = per_case.groupBy(by).agg((F.sum("_controls") / F.count(F.lit(1))).alias("_scale"))
    weights = per_case.join(scale, on=by).select("subclass", (F.col("_scale") / F.col("_controls")).alias("weight"))
    # Every served case got a first control, so its own row is kept once.
    first = matched.where(F.col("match_no") == 1).select(F.col("subclass").alias(key))
    kept = cases.join(first, on=key, how="left_semi").withColumns({
        "subclass": F.col(key), "match_no": F.lit(0), "distance": F.lit(0.0), "weight": F.lit(1.0)
    })
    columns = [*df.columns, "subclass", "match_no", "distance", "weight"]
    return stack([kept.select(*columns), matched.join(weights, on="subclass").select(*columns)])


def match_strata(
    df: DataFrame, key: str, arm: str, strata: Sequence[str], ratio: int = RATIO
) -> DataFrame:
    """1:``ratio`` matching on equal strata, without replacement; every case is kept.

    Cases and controls of a stratum are numbered in the order of :func:`rank_within`. Control j goes
    to case (j - 1) mod cases + 1, so each case gets its first control before any gets a second;
    controls beyond ``ratio`` per case stay out, and a case for whom none is left stands alone.
    Returns the matched rows with ``subclass`` (the key of the case) and ``match_no`` (0 for the case).
    No stratum is sorted in one task, and the numbers meet by equi joins.
    """
    ranked = cut_lineage(rank_within(df, [*strata, arm], key, "_no"))
    cases = ranked.where(F.col(arm) == 1)
    sizes = cases.groupBy(*strata).agg(F.count(F.lit(1)).alias("_cases"))
    turn = F.floor((F.col("_no") - 1) / F.col("_cases"))
    placed = (
        ranked.where(F.col(arm) == 0).join(sizes, on=list(strata)).where(turn < ratio)
        .withColumns({"_case_no": (F.col("_no") - 1) % F.col("_cases") + 1, "match_no": (turn + 1).cast("int")})
    )
    subclass = cases.select(*strata, F.col("_no").alias("_case_no"), F.col(key).alias("subclass"))
    columns = [*df.columns, "subclass", "match_no"]
    return stack([
        cases.withColumns({"subclass": F.col(key), "match_no": F.lit(0)}).select(*columns),
        placed.join(subclass, on=[*strata, "_case_no"]).select(*columns),
    ])


def share_case_date(
    df: DataFrame, arm: str = "progressed", date: str = "progression_date", group: Sequence[str] = ("cohort_year", "subclass")
) -> DataFrame:
    """Give every row of a matched group the date of its case, raised to the row's own entry date."""
    case = df.where(F.col(arm) == 1).groupBy(*group).agg(F.max(date).alias("_case_date"))
    joined = df.join(case, on=list(group), how="left")
    return joined.withColumn(date, later(F.col("_case_date"), F.col("entry_date"))).drop("_case_date")


def stack_cohorts(frames: Sequence[DataFrame]) -> DataFrame:
    """Matched cohorts under each other, with the shared date as index date and the period from there."""
    stacked = stack(frames).withColumnRenamed("progression_date", "index_date")
    return stacked.withColumn("follow_up_days", inclusive_days(F.col("index_date"), F.col("follow_up_end")))


by_value(__name__)

"""Product-limit estimates and observed event counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a horizon of i cycles is i times this many whole days.
HORIZON_DAYS = 365
#: Time units, whole days as a rule, whose sums and products are formed together.
SPAN = 64.0


def kaplan_meier(df: DataFrame, by: Sequence[str] = (), time: str = "days", span: float = SPAN) -> DataFrame:
    """(by, time, n_risk, n_event, n_censor, survival) at every distinct time.

    Rows are counted per (stratum, time) first. Sums and products over the times then go in two levels: inside
    spans of ``span`` time units, and over the totals of the spans, so no task sees all times of a stratum.
    """
    keys = list(by)
    place = F.coalesce(F.floor(F.col(time) / F.lit(span)), F.lit(-1))
    counts = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n"), F.sum("event").alias("n_event")).withColumn("_span", place)
    inside = Window.partitionBy(*keys, "_span").orderBy(time)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per span from here on: what lies before it, and everything.
    spans = Window.partitionBy(*[F.col(c) for c in keys] or [F.lit(0)])
    before = spans.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)

    def with_totals(rows: DataFrame, totals: dict) -> DataFrame:
        sums = rows.groupBy(*keys, "_span").agg(*[v.alias(k) for k, (v, _) in totals.items()])
        carried = {f"{k}_before": carry(F.col(k)).over(before) for k, (_, carry) in totals.items()}
        if "_all" in totals:
            carried["_total"] = F.sum("_all").over(spans)
        safe = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "_span"]]
        right = sums.withColumns(carried).select(*keys, "_span", *carried)
        return rows.alias("l").join(right.alias("r"), reduce(lambda a, b: a & b, safe)).select("l.*", *carried)

    counted = with_totals(counts, {"_all": (F.sum("_n"), F.sum)})
    gone = F.coalesce("_all_before", F.lit(0)) + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    at_risk = counted.withColumn("n_risk", F.col("_total") - gone).drop("_all_before", "_total")
    # The curve stays at zero once everybody at risk has failed: ln(0) would be skipped as null.
    stepped = at_risk.withColumns({
        "_empty": (F.col("n_event") == F.col("n_risk")).cast("int"),
        "_step": F.when(F.col("n_event") < F.col("n_risk"), F.log1p(-F.col("n_event") / F.col("n_risk"))),
    })
    done = with_totals(stepped, {"_emptied": (F.max("_empty"), F.max), "_steps": (F.sum("_step"), F.sum)})
    emptied = F.greatest(F.max("_empty").over(so_far), F.coalesce("_emptied_before", F.lit(0)))
    total = F.coalesce(F.sum("_step").over(so_far), F.lit(0.0)) + F.coalesce("_steps_before", F.lit(0.0))
    return done.select(
        *keys, time, "n_risk", "n_event", (F.col("_n") - F.col("n_event")).alias("n_censor"),
        F.when(emptied == 1, F.lit(0.0)).otherwise(F.exp(total)).alias("survival"),
    )


def events_by(
    df: DataFrame, horizons: Sequence[int], by: Sequence[str] = (), days: str = "days"
) -> DataFrame:
    """(by, cycle, n_event): events observed up to each horizon, in one pass."""
    counts = df.groupBy(*by).agg(*[
        F.count_if((F.col("event") == 1) & (F.col(days) <= HORIZON_DAYS * i)).alias(str(i)) for i in horizons
    ])
    return counts.unpivot(list(by), [f"`{i}`" for i in horizons], "cycle", "n_event").withColumn(
        "cycle", F.col("cycle").cast("int")
    )

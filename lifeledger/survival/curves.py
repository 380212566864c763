"""Curves of fitted models."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeledger.functions import normal_quantile, normal_sf
from lifeledger.regression.negbin import CostModel
from lifeledger.survival.fit import SurvivalModel


def survival(model: SurvivalModel, time: Column) -> Column:
    """S(time) for the covariates of the row."""
    eta = model.design.linear(model.beta)
    if model.dist == "gompertz":
        a = model.shape
        base = time if abs(a) < 1e-12 else F.expm1(F.lit(a) * time) / F.lit(a)
        return F.exp(-F.exp(eta) * base)
    z = (F.log(time) - eta) / F.lit(model.scale)
    if model.dist == "lognormal":
        return normal_sf(z)
    if model.dist == "loglogistic":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(z))
    return F.exp(-F.exp(z))


def level_grid(spark: SparkSession, model: SurvivalModel | CostModel) -> DataFrame:
    """One row per covariate combination, last covariate moving fastest."""
    columns = model.design.columns
    rows = list(product(*model.design.levels.values()))
    types = ["int" if isinstance(rows[0][i], int) else "string" for i in range(len(columns))]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(columns, types)))


def survival_grid(spark: SparkSession, model: SurvivalModel, times: Sequence[int] = range(1, 11)) -> DataFrame:
    """S(t) for every covariate combination and whole year."""
    years = F.explode(F.array(*[F.lit(t) for t in times])).alias("year")
    grid = level_grid(spark, model).select("*", years)
    return grid.withColumn("survival", survival(model, F.col("year").cast("double")))


def survival_wide(
    grid: DataFrame, columns: Sequence[str] = ("age_band", "sex", "baseline_any"), by: Sequence[str] = ("year",)
) -> DataFrame:
    """One row per year (or value of ``by``), one column per covariate combination."""
    labels = [r[0] for r in grid.select(F.concat_ws("_", *columns).alias("c")).distinct().sort("c").collect()]
    labelled = grid.withColumn("_c", F.concat_ws("_", *columns))
    return labelled.groupBy(*by).pivot("_c", labels).agg(F.first("survival"))


def predict_quantiles(
    spark: SparkSession, model: SurvivalModel, probabilities: Sequence[float] = tuple(i / 100 for i in range(1, 100))
) -> DataFrame:
    """(levels, p, time): the time by which a share p has failed."""
    p = F.col("p")
    eta = model.design.linear(model.beta)
    if model.dist == "gompertz":
        a = model.shape
        load = -F.log1p(-p) / F.exp(eta)
        time = load if abs(a) < 1e-12 else F.log1p(F.lit(a) * load) / F.lit(a)
    else:
        if model.dist == "lognormal":
            q = normal_quantile(p)
        elif model.dist == "loglogistic":
            q = F.log(p / (F.lit(1.0) - p))
        else:
            q = F.log(-F.log1p(-p))
        time = F.exp(eta + F.lit(model.scale) * q)
    points = F.explode(F.array(*[F.lit(float(v)) for v in probabilities])).alias("p")
    return level_grid(spark, model).select("*", points).withColumn("time", time)


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), key, value)


def km_vs_model(km: DataFrame, model: SurvivalModel, by: Sequence[str], time: str = "days", per: float = 1.0) -> DataFrame:
    """Largest and mean distance between the product-limit curve and the model, per stratum.

    ``per`` turns the time column of the curve into the time unit of the model.
    """
    gap = F.abs(F.col("survival") - survival(model, F.col(time) / F.lit(per)))
    return km.where(F.col(time) > 0).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_times"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap")
    )

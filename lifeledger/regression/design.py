"""Treatment-coded design cells shared by the survival and cost regressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: normal quantile of a two-sided 95 % interval.
Z_95 = 1.959963984540054


@dataclass(frozen=True)
class Design:
    """Main effects of categorical covariates; the first level of each is the base."""

    levels: Mapping[str, Sequence]

    @property
    def columns(self) -> list[str]:
        return list(self.levels)

    @property
    def terms(self) -> list[str]:
        effects = [f"{c}={v}" for c, levels in self.levels.items() for v in list(levels)[1:]]
        return ["intercept", *effects]

    def row(self, values: Mapping[str, object]) -> np.ndarray:
        """Design vector of one covariate combination."""
        effects = [float(values[c] == v) for c, levels in self.levels.items() for v in list(levels)[1:]]
        return np.array([1.0, *effects])

    def linear(self, beta: Sequence[float]) -> Column:
        """Linear predictor as an expression on the covariate columns."""
        out = F.lit(float(beta[0]))
        place = 1
        for c, levels in self.levels.items():
            effect = None
            for v in list(levels)[1:]:
                test, value = F.col(c) == F.lit(v), F.lit(float(beta[place]))
                effect = F.when(test, value) if effect is None else effect.when(test, value)
                place += 1
            if effect is not None:
                out = out + effect.otherwise(F.lit(0.0))
        return out

    def indicators(self) -> list[Column]:
        """The design vector as 0/1 expressions, in the order of ``terms``."""
        return [F.lit(1.0)] + [
            (F.col(c) == F.lit(v)).cast("double") for c, levels in self.levels.items() for v in list(levels)[1:]
        ]

    def linear_of(self, beta: Column) -> Column:
        """Linear predictor with the coefficients in an array column."""
        out, place = beta[0], 1
        for c, levels in self.levels.items():
            effect = None
            for v in list(levels)[1:]:
                test = F.col(c) == F.lit(v)
                effect = F.when(test, beta[place]) if effect is None else effect.when(test, beta[place])
                place += 1
            if effect is not None:
                out = out + effect.otherwise(F.lit(0.0))
        return out

    def quadratic(self, matrix: np.ndarray) -> Column:
        """x' M x as an expression, x being the design vector of the row."""
        x = self.indicators()
        out = F.lit(0.0)
        for i in range(len(x)):
            for j in range(len(x)):
                out = out + x[i] * x[j] * F.lit(float(matrix[i, j]))
        return out

    def is_known(self) -> Column:
        """Whether every covariate has a declared level; never null."""
        out = F.lit(True)
        for c, levels in self.levels.items():
            out = out & F.coalesce(F.col(c).isin(list(levels)), F.lit(False))
        return out

    def known(self, df: DataFrame) -> DataFrame:
        """Rows whose covariates all have a declared level; :meth:`is_known` counts the others."""
        return df.where(self.is_known())


def solve_step(information: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Newton step; a term without any data keeps its value."""
    return np.linalg.pinv(information, rcond=1e-12) @ gradient


def covariance(information: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(information, rcond=1e-12)

"""Parametric survival regression from distributed sufficient statistics.

Samples of any number of transitions are compressed to counts per (transition, covariate cell, time, event).
Each Newton round is one Spark aggregation of that table to one row per transition and cell, in which all
transitions and all requested distributions advance together; only those rows reach the driver, where
small linear systems are solved. Parameters enter a round as a small joined table and not as
literals, so every round runs the code that the first one compiled.

No row is lost without a trace: rows without a positive time and rows with an unknown level are
counted per transition (:func:`account`), and a transition that cannot be fitted is reported with the reason.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifeledger.functions import log_normal_sf, normal_hazard
from lifeledger.functions.special import LOG_SQRT_2PI, tail_ratio
from lifeledger.regression.design import Z_95, Design, covariance, solve_step
from lifeledger.session import cut_lineage

#: Name of the column that tells the transitions of a stacked sample apart.
KEY = "transition"

DISTRIBUTIONS = ("weibull", "exponential", "loglogistic", "lognormal")
DEFAULT_LEVELS = {
    "age_band": ["10-24", "25-40", "41-65", "65+"],
    "sex": ["F", "M"],
    "baseline_any": [0, 1],
}


@dataclass(frozen=True)
class SurvivalModel:
    """Fitted model: coefficients on the linear predictor plus ``shape`` (ln scale, or Gompertz a)."""

    dist: str
    design: Design
    beta: np.ndarray
    shape: float
    cov: np.ndarray
    loglik: float
    n: int
    n_events: int
    gradient: float
    rounds: int
    n_refused: int = 0

    @property
    def scale(self) -> float:
        return math.exp(self.shape)

    @property
    def n_parameters(self) -> int:
        return len(self.beta) + (self.dist != "exponential")

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_parameters

    def bic(self, n: int | None = None) -> float:
        return -2 * self.loglik + self.n_parameters * math.log(n or self.n)

    def rows(self) -> list[tuple[str, float, float]]:
        terms = self.design.terms
        out = [(t, float(b), float(math.sqrt(max(v, 0.0)))) for t, b, v in zip(terms, self.beta, np.diag(self.cov))]
        if self.dist != "exponential":
            name = "shape" if self.dist == "gompertz" else "log_scale"
            out.append((name, float(self.shape), float(math.sqrt(max(self.cov[-1, -1], 0.0)))))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(dist, term, estimate, se, lower, upper)."""
        rows = [(self.dist, t, b, s, b - Z_95 * s, b + Z_95 * s) for t, b, s in self.rows()]
        return spark.createDataFrame(
            rows, "dist string, term string, estimate double, se double, lower double, upper double"
        )


def account(sample: DataFrame, design: Design, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, n_no_time, n_unknown, n_fit, n_events): what becomes of the rows of a sample.

    A row is refused if its time is null or not positive, else if a covariate has no declared level; all
    others are fitted.
    """
    timed, known = F.coalesce(F.col("time") > 0, F.lit(False)), design.is_known()
    return sample.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~timed).alias("n_no_time"), F.count_if(timed & ~known).alias("n_unknown"),
        F.count_if(timed & known).alias("n_fit"), F.count_if(timed & known & (F.col("event") == 1)).alias("n_events"),
    )


def compress(sample: DataFrame, design: Design, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (by, cell, time, event) of the rows that :func:`account` calls fitted.

    Nothing else of them enters a likelihood, and the table is bounded by cells x distinct days x 2.
    """
    usable = sample.where((F.col("time") > 0) & design.is_known())
    return usable.groupBy(*by, *design.columns, "time", "event").agg(F.count(F.lit(1)).alias("n"))


def _standardised(dist: str, z: Column, d: Column, ratio: Column | None) -> tuple[Column, Column, Column]:
    """Log density (or log survival if censored) of the standardised error, and two derivatives in z.

    ``ratio`` is the normal tail over the density at abs(z), which only the lognormal needs.
    """
    if dist in ("weibull", "exponential"):
        e = F.exp(z)
        return d * z - e, d - e, -e
    if dist == "loglogistic":
        # ln(1 + e^z) without overflow.
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        k = F.lit(1.0) + d
        return d * z - k * soft, d - k * p, -k * p * (F.lit(1.0) - p)
    hazard = normal_hazard(z, ratio)
    return (
        F.when(d == 1, -z * z / 2 - F.lit(LOG_SQRT_2PI)).otherwise(log_normal_sf(z, ratio)),
        F.when(d == 1, -z).otherwise(-hazard),
        F.when(d == 1, F.lit(-1.0)).otherwise(-hazard * (hazard - z)),
    )


def _location_scale_sums(tau: Column, u: Column, u1: Column, u2: Column, z: Column) -> list[Column]:
    """Per-row log-likelihood and its derivatives in (eta, tau), with tau = ln scale."""
    t, d = F.col("time"), F.col("event").cast("double")
    scale = F.exp(tau)
    return [
        u - d * (tau + F.log(t)),
        -u1 / scale,
        u2 / (scale * scale),
        (u1 + z * u2) / scale,
        -z * u1 - d,
        z * u1 + z * z * u2,
    ]


def _gompertz_sums(eta: Column, a: Column) -> list[Column]:
    """As above for hazard exp(eta + a t); the second parameter is ``a``."""
    t, d = F.col("time"), F.col("event").cast("double")
    x, b = a * t, F.exp(eta)
    # Cumulative base hazard G = (e^{at} - 1) / a and its derivatives in a; series where a t is small.
    small = F.abs(x) < 0.05

    def series(first: int, order: int) -> Column:
        # d^order/da^order of sum_k a^k t^(k+1) / (k+1)!
        out = F.lit(0.0)
        for k in range(order, order + 9):
            c = math.perm(k, order) / math.factorial(k + 1)
            out = out + F.lit(c) * F.pow(x, F.lit(k - order))
        return out * F.pow(t, F.lit(first))

    safe = F.when(F.abs(a) > 1e-12, a).otherwise(F.lit(1.0))
    g = F.when(small, series(1, 0)).otherwise(F.expm1(x) / safe)
    g1 = F.when(small, series(2, 1)).otherwise((t * F.exp(x) - F.expm1(x) / safe) / safe)
    g2 = F.when(small, series(3, 2)).otherwise(
        (t * t * F.exp(x) - F.lit(2.0) * (t * F.exp(x) - F.expm1(x) / safe) / safe) / safe
    )
    return [d * (eta + x) - b * g, d - b * g, -b * g, -b * g1, d * t - b * g1, -b * g2]


_SUMS = ("l", "ge", "hee", "het", "gt", "htt")


def _with_parameters(rows: DataFrame, theta: Mapping[str, Mapping[str, np.ndarray]], dists: Sequence[str]) -> DataFrame:
    """Join an array ``theta_<dist>`` per transition; null where a distribution has no parameters (any more)."""
    keys = sorted(theta)
    table = [(k, *([float(v) for v in theta[k][d]] if d in theta[k] else None for d in dists)) for k in keys]
    schema = ", ".join([f"`{KEY}` string", *(f"theta_{d} array<double>" for d in dists)])
    # One row per transition.
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), on=KEY)


def _with_errors(rows: DataFrame, design: Design, dists: Sequence[str]) -> DataFrame:
    """Linear predictors and, stage by stage, what several sums share, so that each is computed once per row."""
    last = len(design.terms)
    standard = [d for d in dists if d != "gompertz"]
    rows = rows.withColumns({f"eta_{d}": design.linear_of(F.col(f"theta_{d}")) for d in dists})
    rows = rows.withColumns({f"shape_{d}": F.col(f"theta_{d}")[last] for d in dists})
    rows = rows.withColumns({f"z_{d}": (F.log("time") - F.col(f"eta_{d}")) / F.exp(f"shape_{d}") for d in standard})
    ratio = None
    if "lognormal" in dists:
        rows = rows.withColumn("tail_at", F.abs("z_lognormal")).withColumn("ratio", tail_ratio(F.col("tail_at")))
        ratio = F.col("ratio")
    for d in standard:
        parts = _standardised(d, F.col(f"z_{d}"), F.col("event").cast("double"), ratio)
        rows = rows.withColumns({f"u{i}_{d}": u for i, u in enumerate(parts)})
    return rows


def _round_sums(counts: DataFrame, design: Design, theta: Mapping[str, Mapping[str, np.ndarray]], dists: Sequence[str]) -> list:
    """One row per transition and covariate cell with the sums of every distribution at its parameters."""
    rows = _with_errors(_with_parameters(counts, theta, dists), design, dists)
    sums = []
    for d in dists:
        if d == "gompertz":
            parts = _gompertz_sums(F.col("eta_gompertz"), F.col("shape_gompertz"))
        else:
            u, u1, u2 = (F.col(f"u{i}_{d}") for i in range(3))
            parts = _location_scale_sums(F.col(f"shape_{d}"), u, u1, u2, F.col(f"z_{d}"))
        sums += [F.sum(F.col("n") * v).alias(f"{d}_{name}") for name, v in zip(_SUMS, parts)]
    return rows.groupBy(KEY, *design.columns).agg(*sums).collect()


class _State:
    """Newton state of one distribution, with step halving."""

    def __init__(self, dist: str, p: int, start: float):
        self.dist = dist
        # The Gompertz predictor is a log rate, that of the others a log time.
        self.theta = np.zeros(p + 1)
        self.theta[0] = -start if dist == "gompertz" else start
        self.best = None
        self.step = np.zeros(p + 1)
        self.loglik = -math.inf
        self.done = False
        self.rounds = 0

    def free(self) -> slice:
        return slice(0, len(self.theta) - (self.dist == "exponential"))

    def update(self, loglik: float, gradient: np.ndarray, information: np.ndarray, tol: float) -> None:
        self.rounds += 1
        slack = 1e-10 * (1 + abs(self.loglik)) if math.isfinite(self.loglik) else 0.0
        if not math.isfinite(loglik) or loglik < self.loglik - slack:
            self.step = self.step / 2
            self.theta = self.best[0] + self.step
            if np.abs(self.step).max() < 1e-12:
                self._finish()
            return
        gained = loglik - self.loglik
        self.loglik, self.best = loglik, (self.theta.copy(), gradient, information)
        free = self.free()
        info = information[free, free]
        # Where the log-likelihood is not concave a small multiple of the diagonal makes the step an ascent.
        lowest, size = np.linalg.eigvalsh(info)[0], np.abs(np.diag(info)).max()
        if lowest < -1e-10 * size:
            info = info + np.eye(len(info)) * (1e-3 * size - lowest)
        self.step = np.zeros_like(self.theta)
        self.step[free] = solve_step(info, gradient[free])
        largest = np.abs(self.step).max()
        if largest > 2:
            self.step *= 2 / largest
        if largest < tol or (gained < 1e-11 * (1 + abs(loglik)) and largest < 1e-5):
            self._finish()
        else:
            self.theta = self.theta + self.step

    def _finish(self) -> None:
        self.theta, self.done = self.best[0], True


@dataclass(frozen=True)
class Fits:
    """All models of a stacked sample, with the account of its rows and the reason where there is no model."""

    models: Mapping[tuple[str, str], SurvivalModel]
    status: Mapping[tuple[str, str], str]
    accounts: Mapping[str, Mapping[str, int]]


def _too_thin(cells: Sequence, design: Design) -> str | None:
    """Why a transition cannot be fitted: no row, no event at all, or none in a level that has rows."""
    if not cells:
        return "no rows"
    if not sum(r["d"] for r in cells):
        return "no events"
    for c, levels in design.levels.items():
        for v in levels:
            own = [r for r in cells if r[c] == v]
            if own and not sum(r["d"] for r in own):
                return f"no events in {c}={v}"
    return None


def fit_all(
    samples: DataFrame, dists: Sequence[str] = DISTRIBUTIONS, levels: Mapping[str, Sequence] | None = None,
    max_rounds: int = 60, tol: float = 1e-8, expected: Sequence[str] = (),
) -> Fits:
    """Fit several distributions to every transition of a stacked sample (transition, time, event, covariates).

    ``expected`` names transitions that are reported even if they have no row.
    """
    design = Design(dict(DEFAULT_LEVELS if levels is None else levels))
    p = len(design.terms)
    accounts = {r[KEY]: r.asDict() for r in account(samples, design, [KEY]).collect()}
    none = dict.fromkeys(("n_rows", "n_no_time", "n_unknown", "n_fit", "n_events"), 0)
    accounts |= {k: {KEY: k, **none} for k in expected if k not in accounts}
    counts = cut_lineage(compress(samples, design, [KEY]))
    sizes: dict[str, list] = {k: [] for k in accounts}
    for r in counts.groupBy(KEY, *design.columns).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("event")).alias("d"), F.sum(F.col("n") * F.col("time")).alias("t")
    ).collect():
        sizes[r[KEY]].append(r)
    states: dict[tuple[str, str], _State] = {}
    status: dict[tuple[str, str], str] = {}
    for k, cells in sizes.items():
        reason = _too_thin(cells, design)
        for d in dists:
            status[k, d] = reason or "fitted"
            if not reason:
                states[k, d] = _State(d, p, math.log(sum(r["t"] for r in cells) / sum(r["d"] for r in cells)))
    while True:
        active = {kd: s for kd, s in states.items() if not s.done}
        for kd, s in list(active.items()):
            if s.rounds >= max_rounds:
                status[kd] = f"no convergence after {max_rounds} rounds"
                s.done = True
                del active[kd], states[kd]
        if not active:
            break
        theta: dict[str, dict[str, np.ndarray]] = {}
        for (k, d), s in active.items():
            theta.setdefault(k, {})[d] = s.theta
        cells = _round_sums(counts, design, theta, dists)
        for (k, d), s in active.items():
            own = [(design.row(r.asDict()), [r[f"{d}_{name}"] for name in _SUMS]) for r in cells if r[KEY] == k]
            gradient, hessian, value = np.zeros(p + 1), np.zeros((p + 1, p + 1)), []
            for x, sums in own:
                l, ge, hee, het, gt, htt = (math.nan if v is None else v for v in sums)
                value.append(l)
                gradient[:p] += ge * x
                gradient[p] += gt
                hessian[:p, :p] += hee * np.outer(x, x)
                hessian[:p, p] += het * x
                hessian[p, p] += htt
            hessian[p, :p] = hessian[:p, p]
            s.update(math.fsum(value), gradient, -hessian, tol)
    models = {}
    for (k, d), s in states.items():
        free = s.free()
        _, gradient, information = s.best
        own = accounts[k]
        models[k, d] = SurvivalModel(
            dist=d, design=design, beta=s.theta[:-1], shape=float(s.theta[-1]),
            cov=covariance(information[free, free]), loglik=s.loglik, n=own["n_fit"], n_events=own["n_events"],
            gradient=float(np.abs(gradient[free]).max()), rounds=s.rounds, n_refused=own["n_no_time"] + own["n_unknown"],
        )
    return Fits(models, status, accounts)


def fit_models(
    sample: DataFrame, dists: Sequence[str] = DISTRIBUTIONS, levels: Mapping[str, Sequence] | None = None,
    max_rounds: int = 60, tol: float = 1e-8,
) -> dict[str, SurvivalModel]:
    """Fit several distributions to one sample (time, event, covariates)."""
    fits = fit_all(sample.withColumn(KEY, F.lit("all")), dists, levels, max_rounds, tol)
    bad = {d: fits.status.get(("all", d), "no rows") for d in dists if ("all", d) not in fits.models}
    if bad:
        kind = ArithmeticError if any(v.startswith("no convergence") for v in bad.values()) else ValueError
        raise kind(f"no model of the sample: {bad}")
    return {d: fits.models["all", d] for d in dists}


def fit_aft(sample: DataFrame, dist: str, levels: Mapping[str, Sequence] | None = None) -> SurvivalModel:
    """Accelerated failure time model: log T = x beta + scale * error."""
    return fit_models(sample, [dist], levels)[dist]


def fit_gompertz(sample: DataFrame, levels: Mapping[str, Sequence] | None = None) -> SurvivalModel:
    """Hazard exp(x beta + a t)."""
    return fit_models(sample, ["gompertz"], levels)["gompertz"]


COMPARISON = "dist string, n long, n_events long, n_refused long, k int, loglik double, aic double, bic double, status string"


def compare_models(
    sample: DataFrame, dists: Sequence[str] = (*DISTRIBUTIONS, "gompertz"), levels=None, n: int | None = None
) -> DataFrame:
    """(dist, n, n_events, k, loglik, aic, bic), lowest AIC first."""
    models = fit_models(sample, dists, levels)
    rows = [
        (d, m.n, m.n_events, m.n_parameters, m.loglik, m.aic, m.bic(n)) for d, m in models.items()
    ]
    return sample.sparkSession.createDataFrame(
        rows, "dist string, n long, n_events long, k int, loglik double, aic double, bic double"
    ).orderBy("aic", "dist")


def compare_all(fits: Fits, spark: SparkSession) -> DataFrame:
    """(transition, dist, n, n_events, n_refused, k, loglik, aic, bic, status): a row for every pair, fitted or not."""
    rows = []
    for (k, d), status in fits.status.items():
        own, m = fits.accounts[k], fits.models.get((k, d))
        score = (m.n_parameters, m.loglik, m.aic, m.bic()) if m else (None,) * 4
        rows.append((k, d, own["n_fit"], own["n_events"], own["n_no_time"] + own["n_unknown"], *score, status))
    return spark.createDataFrame(rows, f"{KEY} string, {COMPARISON}")


def coefficients(fits: Fits, spark: SparkSession) -> DataFrame:
    """(transition, dist, term, estimate, se, lower, upper) of every fitted model."""
    rows = [(k, d, t, b, s, b - Z_95 * s, b + Z_95 * s) for (k, d), m in fits.models.items() for t, b, s in m.rows()]
    return spark.createDataFrame(
        rows, f"{KEY} string, dist string, term string, estimate double, se double, lower double, upper double"
    )


def score_equations(samples: DataFrame, fits: Fits) -> DataFrame:
    """(transition, dist, term, fitted): the model side of each likelihood equation, summed over the sample.

    At the optimum it equals an observed sum, which needs no model: the events in a term (exponential, Weibull,
    loglogistic, Gompertz), their log times (lognormal), all events (scale), and the times of events
    (Gompertz shape). So a query without any fitting can certify the fits.
    """
    spark = samples.sparkSession
    out = None
    for dist in dict.fromkeys(d for _, d in fits.models):
        models = {k: m for (k, d), m in fits.models.items() if d == dist}
        design = next(iter(models.values())).design
        theta = {k: {dist: np.append(m.beta, m.shape)} for k, m in models.items()}
        counts = compress(samples, design, [KEY])
        rows = _with_errors(_with_parameters(counts, theta, [dist]), design, [dist])
        d, t = F.col("event").cast("double"), F.col("time")
        if dist == "gompertz":
            _, slope, _, _, shape, _ = _gompertz_sums(F.col("eta_gompertz"), F.col("shape_gompertz"))
            own, last, name = d - slope, d * t - shape, "shape"
        else:
            u1, z = F.col(f"u1_{dist}"), F.col(f"z_{dist}")
            own = d - u1 if dist != "lognormal" else d * F.col("eta_lognormal") + F.exp("shape_lognormal") * u1 * (1 - d)
            last, name = -z * u1, "log_scale"
        sums = {term: F.sum(F.col("n") * own * x) for term, x in zip(design.terms, design.indicators())}
        if dist != "exponential":
            sums[name] = F.sum(F.col("n") * last)
        wide = rows.groupBy(KEY).agg(*[v.alias(k) for k, v in sums.items()])
        part = wide.unpivot([KEY], [f"`{k}`" for k in sums], "term", "fitted").withColumn("dist", F.lit(dist))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{KEY} string, dist string, term string, fitted double")
    return out.select(KEY, "dist", "term", "fitted")


def weibull_report(model: SurvivalModel, spark: SparkSession) -> DataFrame:
    """Proportional-hazards reading of a Weibull fit: lambda, gamma, hazard and event-time ratios.

    Rows (quantity, term, estimate, lower, upper), intervals by the delta method.
    """
    if model.dist != "weibull":
        raise ValueError("needs a Weibull model")
    sigma, beta, cov, last = model.scale, model.beta, model.cov, len(model.beta)
    rows = []

    def add(quantity: str, term: str, log_value: float, gradient: np.ndarray) -> None:
        half = Z_95 * math.sqrt(max(float(gradient @ cov @ gradient), 0.0))
        rows.append((quantity, term, math.exp(log_value), math.exp(log_value - half), math.exp(log_value + half)))

    def unit(i: int, value: float) -> np.ndarray:
        g = np.zeros(last + 1)
        g[i] = value
        return g

    mu = float(beta[0])
    g = unit(0, -1 / sigma)
    g[last] = mu / sigma
    add("lambda", "intercept", -mu / sigma, g)
    add("gamma", "log_scale", -model.shape, unit(last, -1.0))
    for i, term in enumerate(model.design.terms[1:], start=1):
        b = float(beta[i])
        g = unit(i, -1 / sigma)
        g[last] = b / sigma
        add("hazard_ratio", term, -b / sigma, g)
        add("event_time_ratio", term, b, unit(i, 1.0))
    return spark.createDataFrame(rows, "quantity string, term string, estimate double, lower double, upper double")

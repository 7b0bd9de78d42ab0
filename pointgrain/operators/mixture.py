"""Density estimators: fit, score, sample, save and load on DataFrames; parameters are small arrays."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgrain.functions import expressions as X
from pointgrain.functions import targets as T
from pointgrain.functions.expressions import finite

#: Distinct rows that starting means are picked from, at most.
START_ROWS = 4096
#: Points whose responsibilities a task holds at a time.
TILE = 8192


@dataclass(frozen=True)
class FitResult:
    """What a fit tells: its seed, steps and end, mean negative log densities, and warnings."""

    seed: int
    steps: int
    converged: bool
    train_nll: float
    validation_nll: float | None
    parameter_count: int
    warnings: tuple[str, ...] = field(default=())


def with_logsumexp(df: DataFrame, terms: Sequence[Column], out: str) -> DataFrame:
    """df with ln of the sum of exp(terms) as column out. Terms and their maximum are columns of projections on top of
    each other, so each is worked out once a row."""
    taken = {c.lower() for c in df.columns}
    names = [n for n in (f"_{out}_{i}" for i in range(len(terms) + len(taken) + 1)) if n.lower() not in taken][: len(terms) + 1]
    *cells, top = names
    staged = df.withColumns(dict(zip(cells, terms, strict=True)))
    staged = staged.withColumn(top, F.greatest(*cells) if len(cells) > 1 else F.col(cells[0]))
    spread = X.total([F.exp(F.col(n) - F.col(top)) for n in cells])
    value = F.when(F.col(top) == F.lit(-X.INFINITY), F.lit(-X.INFINITY)).otherwise(F.col(top) + F.log(spread))
    return staged.withColumn(out, value).drop(*names)


def mean_nll(scored: DataFrame, log_prob: str, weight: str | None = None) -> float:
    """Weighted mean of -log density over finite rows; NaN if there is none."""
    ok, w = finite(log_prob), F.col(weight) if weight else F.lit(1.0)
    found = scored.agg(F.try_divide(F.sum(F.when(ok, -w * F.col(log_prob))), F.sum(F.when(ok, w)))).first()[0]
    return float("nan") if found is None else found


def checked(df: DataFrame, columns: Sequence[str], weight: str | None) -> dict[str, float]:
    """Number of rows, total weight, and weighted mean and variance of each column, from two scans. Cells that are no
    finite numbers, negative or non-finite weights and a total weight of 0 are errors: none is left out in silence."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    bad = X.total([F.when(finite(c), 0).otherwise(1) for c in columns])
    row = df.agg(F.count("*").alias("n"), F.count_if(bad > 0).alias("bad"), F.count_if(~finite(w) | (w < 0)).alias("bad_w"), F.sum(w).alias("w"), *(F.sum(w * F.col(c)).alias(c) for c in columns)).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows have cells that are no finite numbers")
    if row["bad_w"] or not row["w"]:
        raise ValueError("weights must be finite, not negative, and not all 0")
    mean = {c: row[c] / row["w"] for c in columns}
    spread = df.agg(*(F.sum(w * (F.col(c) - mean[c]) * (F.col(c) - mean[c])).alias(c) for c in columns)).first()
    return {"n": row["n"], "w": row["w"]} | {f"mean|{c}": mean[c] for c in columns} | {f"var|{c}": spread[c] / row["w"] for c in columns}


class GaussianMixture:
    """Mixture of Gaussians with full covariances, fitted by expectation maximization.

    A step is one aggregate: tasks add up each component's responsibilities, sums and products for all restarts at
    once, and what meets in the driver are these few sums, however many rows there are. Products are taken around
    the component's last mean, so that a narrow component far from 0 loses no digits. A floor on the diagonal keeps
    covariances regular, also where columns hang on each other or a component shrinks to one point."""

    def __init__(self, columns: Sequence[str], n_components: int = 2, floor: float = 1e-6, n_init: int = 1, max_iter: int = 200, tolerance: float = 1e-4):
        if n_components < 1 or n_init < 1:
            raise ValueError("at least one component and one start")
        self.columns, self.n_components, self.floor, self.n_init, self.max_iter, self.tolerance = tuple(columns), n_components, floor, n_init, max_iter, tolerance
        self.weights, self.means, self.covariances = np.zeros(0), np.zeros((0, len(self.columns))), np.zeros((0, len(self.columns), len(self.columns)))
        self.result: FitResult | None = None

    # Fit.

    def fit(self, df: DataFrame, weight: str | None = None, validation: DataFrame | None = None, seed: int = 0) -> GaussianMixture:
        """Fits to the rows of df, with weights if a column of them is named. The best of n_init starts by log-likelihood
        stays; a start ends when its mean log-likelihood moves by no more than the tolerance, or after max_iter steps. Starts
        hang on the seed and the rows' contents, never on their order or partitions."""
        stats = checked(df, self.columns, weight)
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = df.select(F.array(*(F.col(c).cast("double") for c in self.columns)).alias("point"), w.alias("weight")).where("weight > 0").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            starts = [self._start(rows, stats, seed, r) for r in range(self.n_init)]
            best, steps, done = self._climb(rows, starts, stats["w"])
        finally:
            rows.unpersist()
        self.weights, self.means, self.covariances = best
        notes = () if done else (f"no convergence in {self.max_iter} steps",)
        train = mean_nll(self.with_log_prob(df, "_lp"), "_lp", weight)
        held = None if validation is None else mean_nll(self.with_log_prob(validation, "_lp"), "_lp")
        self.result = FitResult(seed, steps, done, train, held, self.parameter_count(), notes)
        return self

    def _start(self, rows: DataFrame, stats: dict[str, float], seed: int, number: int):
        """Means far from each other among at most START_ROWS distinct rows that a hash picks, and the overall covariance."""
        code = F.xxhash64("point", F.lit(seed), F.lit(number))
        share = min(1 << 30, math.ceil(4 * START_ROWS / stats["n"] * (1 << 30)))
        some = rows.where(F.pmod(code, F.lit(1 << 30)) < share).select("point", code.alias("code")).distinct().orderBy("code").limit(START_ROWS).collect()
        var = np.array([stats[f"var|{c}"] for c in self.columns]) + self.floor
        points, rng = np.array([r["point"] for r in some]), np.random.default_rng((seed, number))
        means = [points[0]]
        far = np.full(len(points), np.inf)
        for _ in range(1, self.n_components):
            far = np.minimum(far, (np.square(points - means[-1]) / var).sum(1))
            means.append(points[rng.choice(len(points), p=far / far.sum()) if far.sum() else 0])
        k = self.n_components
        return np.full(k, 1 / k), np.array(means), np.tile(np.diag(var), (k, 1, 1))

    def _climb(self, rows: DataFrame, params: list, total: float):
        last = [-math.inf] * len(params)
        ended = {}
        for step in range(1, self.max_iter + 1):
            open_ = [r for r in range(len(params)) if r not in ended]
            sums = self._sums(rows, [params[r] for r in open_])
            for i, r in enumerate(open_):
                level, n, first, second = sums[i]
                level /= total
                if abs(level - last[r]) <= self.tolerance:
                    ended[r] = step
                last[r] = level
                params[r] = self._moved(params[r], n, first, second)
            if len(ended) == len(params):
                break
        best = max(range(len(params)), key=lambda r: last[r])
        return params[best], ended.get(best, self.max_iter), best in ended

    def _moved(self, params, n: np.ndarray, first: np.ndarray, second: np.ndarray):
        weights, means, covariances = (x.copy() for x in params)
        for k in np.flatnonzero(n > 1e-12 * n.sum()):  # a component that no row belongs to stays where it is
            step = first[k] / n[k]
            means[k] += step
            covariances[k] = second[k] / n[k] - np.outer(step, step)
            covariances[k] = (covariances[k] + covariances[k].T) / 2 + self.floor * np.eye(len(self.columns))
        weights = np.maximum(n, 1e-300) / np.maximum(n, 1e-300).sum()
        return weights, means, covariances

    def _sums(self, rows: DataFrame, params: list) -> list:
        """For each start: log-likelihood, and for each component the sum of responsibilities and of their products with
        the distances to the last mean."""
        d, k = len(self.columns), self.n_components
        inverse = [np.linalg.inv(np.linalg.cholesky(floored(c))) for _, _, c in params]
        const = [np.log(p[0]) - 0.5 * d * X.LOG_2PI + np.log(np.diagonal(v, axis1=1, axis2=2)).sum(1) for p, v in zip(params, inverse, strict=True)]
        held = rows.sparkSession.sparkContext.broadcast(([p[1] for p in params], inverse, const))

        def summed(batches):
            means, inverses, consts = held.value
            out = np.zeros((len(means), k, 2 + d + d * d))
            for batch in batches:
                points, w = batch.column(0).flatten().to_numpy().reshape(-1, d), batch.column(1).to_numpy()
                for lo in range(0, len(w), TILE):
                    x, v = points[lo : lo + TILE], w[lo : lo + TILE]
                    for r in range(len(means)):
                        gap = x[:, None, :] - means[r]
                        white = np.einsum("kij,nkj->nki", inverses[r], gap)
                        terms = consts[r] - 0.5 * np.square(white).sum(2)
                        top = terms.max(1, keepdims=True)
                        level = top[:, 0] + np.log(np.exp(terms - top).sum(1))
                        share = np.exp(terms - level[:, None]) * v[:, None]
                        out[r, 0, 0] += v @ level
                        out[r, :, 1] += share.sum(0)
                        out[r, :, 2 : 2 + d] += np.einsum("nk,nkj->kj", share, gap)
                        out[r, :, 2 + d :] += np.einsum("nk,nki,nkj->kij", share, gap, gap, optimize=True).reshape(k, -1)
            flat = out.reshape(len(means) * k, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(list(flat), pa.list_(pa.float64()))], ["at", "sums"])

        parts = rows.mapInArrow(summed, "at long, sums array<double>")
        cells = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 + d + d * d)]
        found = {r["at"]: np.array(r[1:]) for r in parts.groupBy("at").agg(*cells).collect()}  # starts x components rows
        whole = np.array([found[i] for i in range(len(params) * k)]).reshape(len(params), k, -1)
        return [(x[0, 0], x[:, 1], x[:, 2 : 2 + d], x[:, 2 + d :].reshape(k, d, d)) for x in whole]

    # Use.

    def terms(self) -> list[Column]:
        """ln(weight) + ln N of each component."""
        x = [F.col(c) for c in self.columns]
        return [F.lit(math.log(w)) + X.full_gauss_logpdf(x, m.tolist(), c) for w, m, c in zip(self.weights.tolist(), self.means, self.covariances, strict=True)]

    def with_log_prob(self, df: DataFrame, out: str = "log_prob") -> DataFrame:
        if not len(self.weights):
            raise RuntimeError("the model is not fitted")
        return with_logsumexp(df, self.terms(), out)

    def sample(self, spark: SparkSession, n: int, seed: int) -> DataFrame:
        """n draws with their id and component_id; a draw hangs on the seed and its id alone."""
        if not len(self.weights):
            raise RuntimeError("the model is not fitted")
        d, cuts = len(self.columns), np.cumsum(self.weights)
        low = np.linalg.cholesky(self.covariances)
        u = X.hash_uniform(F.col("id"), F.lit(seed), F.lit("component"))
        chosen = X.total([(u >= float(c)).cast("int") for c in cuts[:-1]]) if len(cuts) > 1 else F.lit(0)
        rows = spark.range(n).select("id", chosen.alias("component_id"), *(X.hash_normal(F.col("id"), seed, j).alias(f"_e{j}") for j in range(d)))
        pick = lambda values: F.get(F.lit([float(v) for v in values]), F.col("component_id"))
        cells = [(pick(self.means[:, i]) + X.total([F.col(f"_e{j}") * pick(low[:, i, j]) for j in range(i + 1)])).alias(c) for i, c in enumerate(self.columns)]
        return rows.select("id", "component_id", *cells)

    def parameter_count(self) -> int:
        d = len(self.columns)
        return self.n_components * (1 + d + d * (d + 1) // 2) - 1

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters as Parquet, a row for each component, and the settings as JSON. Nothing is pickled."""
        rows = [(k, float(w), m.tolist(), c.tolist()) for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True))]
        spark.createDataFrame(rows, "component_id int, weight double, mean array<double>, cov array<array<double>>").coalesce(1).write.parquet(f"{path}/parameters")
        settings = {n: getattr(self, n) for n in ("columns", "n_components", "floor", "n_init", "max_iter", "tolerance")}
        spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GaussianMixture:
        out = cls(**json.loads(spark.read.text(f"{path}/settings").first()[0]))
        rows = spark.read.parquet(f"{path}/parameters").orderBy("component_id").collect()  # a row for each component
        return out._set([r["weight"] for r in rows], [r["mean"] for r in rows], [r["cov"] for r in rows])

    @classmethod
    def of_target(cls, t: T.Target, pdg_id: int) -> GaussianMixture:
        """A catalogue target's mixture, without its transform."""
        parts = t.components[pdg_id]
        return cls(T.COLUMNS, len(parts))._set([c.weight for c in parts], [c.mean for c in parts], [c.cov for c in parts])

    def _set(self, weights, means, covariances) -> GaussianMixture:
        self.weights, self.means, self.covariances = np.array(weights, float), np.array(means, float), np.array(covariances, float)
        return self


def floored(covariances: np.ndarray) -> np.ndarray:
    """Covariances that a Cholesky factor exists of: rounding may leave one just short of it."""
    out, more = covariances, 0.0
    for i in range(len(out)):
        scale = np.trace(out[i]) / len(out[i])
        while np.linalg.eigvalsh(out[i]).min() <= 1e-15 * scale:
            more = max(2 * more, 1e-14 * scale)
            out = out.copy()
            out[i] += more * np.eye(len(out[i]))
    return out

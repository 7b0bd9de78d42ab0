"""Scores under targets, and fits of simple densities."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrain.functions import expressions as X
from pointgrain.functions import targets as T
from pointgrain.operators.mixture import FitResult, GaussianMixture, checked, mean_nll


def with_log_prob(df: DataFrame, t: T.Target, out: str, pdg_id: int | None = None, key: str = "id") -> DataFrame:
    """df with the log density of a target at each row, under the row's id (null for others) or under one id for all.

    Base coordinates, component terms and their maximum are columns of projections on top of each other, so each is
    worked out once a row and the generated code stays small."""
    names = iter(f"_{out}_{i}" for i in range(1000))
    fresh = lambda: next(n for n in names if n.lower() not in {c.lower() for c in df.columns})
    base, jac = t.inverse(T.state())
    at, jacobian = {c: fresh() for c in T.COLUMNS}, fresh()
    staged = df.withColumns({at[c]: base[c] for c in T.COLUMNS} | {jacobian: jac})
    here = {c: F.col(at[c]) for c in T.COLUMNS}
    by = {i: t.component_terms(i, here) for i in (T.IDS if pdg_id is None else (pdg_id,))}
    most = max(map(len, by.values()))
    terms = [fresh() for _ in range(most)]
    padded = {i: [*x, *[F.lit(None).cast("double")] * (most - len(x))] for i, x in by.items()}
    staged = staged.withColumns({n: padded[pdg_id][k] if pdg_id is not None else T.by_id(key, lambda i, k=k: padded[i][k]) for k, n in enumerate(terms)})
    top = fresh()
    staged = staged.withColumn(top, F.greatest(*terms) if most > 1 else F.col(terms[0]))
    spread = X.total([F.coalesce(F.exp(F.col(n) - F.col(top)), F.lit(0.0)) for n in terms])
    value = F.when(F.col(top) == F.lit(-X.INFINITY), F.lit(-X.INFINITY)).otherwise(F.col(top) + F.log(spread)) + F.col(jacobian)
    return staged.withColumn(out, value).drop(*at.values(), jacobian, *terms, top)


def component_log_probs(t: T.Target, pdg_id: int) -> Column:
    base, _ = t.inverse(T.state())
    return F.array(*t.component_terms(pdg_id, base))


def posterior(log_probs: Column) -> Column:
    """Component probabilities from an array of weighted log densities; they sum to 1."""
    top = F.array_max(log_probs)
    lse = top + F.log(F.aggregate(log_probs, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return F.transform(log_probs, lambda v: F.exp(v - lse))


def mean_posterior(df: DataFrame, log_probs: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean posterior of each component, by group if columns are named: (component_id, mass)."""
    terms = df.select(*by, log_probs.alias("_terms"))  # a column of its own, so that it is written once
    spread = terms.select(*by, F.posexplode(posterior(F.col("_terms"))).alias("component_id", "p"))
    return spread.groupBy(*by, "component_id").agg(F.avg("p").alias("mass"))


def component_counts(df: DataFrame, log_probs: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows by most probable component, the first on ties."""
    best = F.array_position("_terms", F.array_max("_terms")) - 1
    return df.select(*by, log_probs.alias("_terms")).select(*by, best.cast("int").alias("component_id")).groupBy(*by, "component_id").agg(F.count("*").alias("n"))


def weighted_moments(df: DataFrame, columns: Sequence[str], weight: str, floor: float = 1e-6) -> DataFrame:
    """Weighted mean and variance, the variance around the mean of a first pass and not below floor; one row a column."""
    means = df.agg(*(F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(c) for c in columns)).first()
    spread = df.agg(*(F.try_divide(F.sum(F.col(weight) * (F.col(c) - F.lit(means[c])) * (F.col(c) - F.lit(means[c]))), F.sum(weight)).alias(c) for c in columns))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(means[c]).alias("mean"), F.greatest(F.col(c), F.lit(floor)).alias("var")) for c in columns]
    return spread.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def weighted_cov(df: DataFrame, columns: Sequence[str], weight: str | None = None, reg: float = 1e-6) -> DataFrame:
    """Upper triangle of the (weighted) population covariance with reg on the diagonal: rows (a, b, cov)."""
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.agg(F.sum(w).alias("w"), *(F.sum(F.col(c) * w).alias(c) for c in columns)).first()
    mean = {c: means[c] / means["w"] for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = df.agg(*((F.sum(w * (F.col(a) - mean[a]) * (F.col(b) - mean[b])) / F.lit(means["w"])).alias(f"{a}|{b}") for a, b in pairs))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"`{a}|{b}`") + (reg if a == b else 0.0)).alias("cov")) for a, b in pairs]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


class DiagonalGaussian:
    """Density estimator: fit, log_prob and sample work on DataFrames; parameters are plain tables."""

    def __init__(self, columns: Sequence[str], floor: float = 1e-6):
        self.columns, self.floor, self.mean, self.var = tuple(columns), floor, [], []
        self.result: FitResult | None = None

    def fit(self, df: DataFrame, weight: str | None = None, validation: DataFrame | None = None, seed: int = 0) -> DiagonalGaussian:
        """Fits to df with its weights, if a column of them is named; bad cells and weights are errors. The fit is in closed
        form: the seed is only noted."""
        self._fit(df, weight)
        train = mean_nll(self.with_log_prob(df, "_lp"), "_lp", weight)
        held = None if validation is None else mean_nll(self.with_log_prob(validation, "_lp"), "_lp")
        self.result = FitResult(seed, 1, True, train, held, self.parameter_count())
        return self

    def _fit(self, df: DataFrame, weight: str | None) -> None:
        found = checked(df, self.columns, weight)
        self.mean, self.var = [found[f"mean|{c}"] for c in self.columns], [max(found[f"var|{c}"], self.floor) for c in self.columns]

    def parameter_count(self) -> int:
        return 2 * len(self.columns)

    def with_log_prob(self, df: DataFrame, out: str = "log_prob") -> DataFrame:
        return df.withColumn(out, self.log_prob())

    def log_prob(self) -> Column:
        return X.diag_gauss_logpdf([F.col(c) for c in self.columns], self.mean, self.var)

    def sample(self, spark, n: int, seed: int) -> DataFrame:
        cells = [(F.lit(m) + X.hash_normal(F.col("id"), seed, k) * float(np.sqrt(v))).alias(c) for k, (c, m, v) in enumerate(zip(self.columns, self.mean, self.var, strict=True))]
        return spark.range(n).select("id", *cells)

    def save(self, spark, path: str) -> None:
        rows = [(i, c, float(m), json.dumps(np.asarray(v).tolist())) for i, (c, m, v) in enumerate(zip(self.columns, self.mean, self.var, strict=True))]
        spark.createDataFrame(rows, "no int, column string, mean double, var string").write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> DiagonalGaussian:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["no"])  # a row for each column
        out = cls([r["column"] for r in rows])
        out.mean, out.var = [r["mean"] for r in rows], [json.loads(r["var"]) for r in rows]
        return out


class FullGaussian(DiagonalGaussian):
    """The same with a full covariance."""

    def _fit(self, df: DataFrame, weight: str | None) -> None:
        found = checked(df, self.columns, weight)
        self.mean = [found[f"mean|{c}"] for c in self.columns]
        at = {c: i for i, c in enumerate(self.columns)}
        cov = np.zeros((len(at), len(at)))
        for r in weighted_cov(df, self.columns, weight, self.floor).collect():
            cov[at[r["a"]], at[r["b"]]] = cov[at[r["b"]], at[r["a"]]] = r["cov"]
        self.var = cov.tolist()

    def parameter_count(self) -> int:
        d = len(self.columns)
        return d + d * (d + 1) // 2

    def log_prob(self) -> Column:
        return X.full_gauss_logpdf([F.col(c) for c in self.columns], self.mean, self.var)

    def sample(self, spark, n: int, seed: int) -> DataFrame:
        low = np.linalg.cholesky(np.asarray(self.var))
        normals = spark.range(n).select("id", *(X.hash_normal(F.col("id"), seed, k).alias(f"e{k}") for k in range(len(self.columns))))
        return normals.select("id", *((F.lit(m) + X.total([F.col(f"e{j}") * float(low[i, j]) for j in range(i + 1)])).alias(c) for i, (c, m) in enumerate(zip(self.columns, self.mean, strict=True))))


def mixture_fit(df: DataFrame, columns: Sequence[str], k: int, seed: int = 1, n_init: int = 2, max_iter: int = 200) -> GaussianMixture:
    """A mixture of k Gaussians, the best of n_init starts."""
    return GaussianMixture(columns, k, n_init=n_init, max_iter=max_iter).fit(df, seed=seed)

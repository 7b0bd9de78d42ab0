"""A scorer of candidates: logistic regression on standardized columns, calibrated by isotonic pooling."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgrain.functions.expressions import finite, hash_uniform, place, total
from pointgrain.operators import profile

#: Bins of the raw score whose counts calibration pools, and the share of rows kept for it.
BINS, HELD = 512, 0.25


def pooled(weight: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling neighbours that stand in the wrong order: the rising values closest to the rates."""
    blocks: list[list[float]] = []
    for w, r in zip(weight.tolist(), rate.tolist(), strict=True):
        blocks.append([w, w * r, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), s / w) for w, s, n in blocks]) if blocks else np.zeros(0)


class Scorer:
    """fit, score, save and load. Scores lie in [0, 1] and are estimates of the label's rate; is_physical is false: they are
    no results about physics."""

    is_physical = False

    def __init__(self, columns: Sequence[str], regularization: float = 1e-3, seed: int = 1):
        self.columns, self.regularization, self.seed = tuple(columns), regularization, seed
        self.mean: list[float] = []
        self.std: list[float] = []
        self.slopes: list[float] = []
        self.offset = 0.0
        self.edges: list[float] = []
        self.values: list[float] = []

    def fit(self, df: DataFrame, label: str, weight: str | None = None) -> Scorer:
        """Fits to rows with labels 0 and 1. Null labels, cells that are no finite numbers, and negative or non-finite weights
        are errors. A hash of the row's cells keeps a share of the rows for calibration: counts of BINS bins of the raw
        score, pooled until they rise, so what comes to the driver does not grow with the rows."""
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        bad = total([F.when(finite(c), 0).otherwise(1) for c in self.columns]) > 0
        row = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("cells"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("labels"), F.count_if(~finite(w) | (w < 0)).alias("weights"), F.sum(w * F.col(label)).alias("ones"), F.sum(w).alias("w")).first()
        for what in ("cells", "labels", "weights"):
            if row[what]:
                raise ValueError(f"{row[what]} rows with bad {what}")
        if not row["n"] or not 0 < row["ones"] < row["w"]:
            raise ValueError("both labels are needed, with weight")
        stats = profile.parameters(profile.fit_normalization(df, self.columns))
        self.mean, self.std = [stats[c][0] for c in self.columns], [stats[c][1] for c in self.columns]
        rows = df.select(*(F.col(c).cast("double").alias(c) for c in self.columns), F.col(label).cast("double").alias("label"), w.alias("weight"))
        rows = rows.withColumn("held", hash_uniform(F.xxhash64(*self.columns), F.lit(self.seed)) < HELD)
        train = rows.where("NOT held").select("label", "weight", array_to_vector(F.array(*self._units())).alias("features"))
        model = LogisticRegression(weightCol="weight", regParam=self.regularization, standardization=False).fit(train)
        self.slopes, self.offset = model.coefficients.toArray().tolist(), float(model.intercept)
        self._calibrate(rows.where("held"))
        return self

    def _calibrate(self, held: DataFrame) -> None:
        at = F.least(F.floor(self.raw() * BINS), F.lit(BINS - 1)).cast("int")
        counts = held.groupBy(at.alias("bin")).agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("ones")).where("w > 0").orderBy("bin").collect()
        w = np.array([r["w"] for r in counts])
        # A bin's rate leans on its middle with the weight of one row, so that no rate rests on nothing.
        middle = np.array([(r["bin"] + 0.5) / BINS for r in counts])
        unit = w.sum() / max(1, 50 * len(counts))
        rate = (np.array([r["ones"] for r in counts]) + unit * middle) / (w + unit)
        levels = pooled(w + unit, rate)
        keep = np.flatnonzero(np.diff(levels, prepend=-1.0) > 0)
        self.edges = [counts[i]["bin"] / BINS for i in keep[1:]]
        self.values = np.clip(levels[keep], 0, 1).tolist() or [self._constant()]

    def _constant(self) -> float:
        return 1 / (1 + float(np.exp(-self.offset)))

    def _units(self) -> list[Column]:
        return [(F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.std, strict=True)]

    def raw(self) -> Column:
        """The logistic score before calibration."""
        return 1 / (1 + F.exp(-(F.lit(self.offset) + total([u * b for u, b in zip(self._units(), self.slopes, strict=True)]))))

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """df with a score in [0, 1]; null where a cell is no finite number."""
        if not self.slopes:
            raise RuntimeError("the scorer is not fitted")
        ok = total([F.when(finite(c), 0).otherwise(1) for c in self.columns]) == 0
        at = place(F.lit(self.edges), F.col("_raw")) if self.edges else F.lit(0)
        return df.withColumn("_raw", self.raw()).withColumn(out, F.when(ok, F.get(F.lit(self.values), at))).drop("_raw")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(vars(self)),)], "scorer string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        out = cls(())
        vars(out).update(json.loads(spark.read.text(path).first()[0]))
        out.columns = tuple(out.columns)
        return out

"""Feature views of the state on DataFrames: checked ways there and back, scores, and a fitted pipeline."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgrain.functions import expressions as X
from pointgrain.functions.expressions import VIEWS, finite, total
from pointgrain.operators import profile

#: Fixed value: rest mass of a muon in GeV, as the energy query takes it.
MUON_MASS = 0.1134289259
PHYSICAL = ("px", "py", "pz", "x", "y")


def or_error(ok: Column, value: Column, text: str) -> Column:
    """value where ok holds; a row where it doesn't fails when it is read."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(text)).cast("double"))


def to_features(df: DataFrame, view: str, unit: float = 1.0, prefix: str = "") -> DataFrame:
    """df with the feature columns of a view. A row fails when it is read if a coordinate or a feature is no finite
    number, or if the view needs ln(pz) and pz is not positive; nothing is clipped or left out."""
    whole = total([F.when(finite(c), 0).otherwise(1) for c in PHYSICAL]) == 0
    ok = whole if view == "identity" else whole & (F.col("pz") > 0)
    cells = X.view_forward(view, unit)
    return df.withColumns({prefix + n: or_error(ok & finite(c), c, f"the {view} view is not defined here") for n, c in cells.items()})


def from_features(df: DataFrame, view: str, unit: float = 1.0, prefix: str = "") -> DataFrame:
    """df with the physical columns of feature columns. A row fails when it is read if a result is no finite number, as
    where exp(ln pz) overflows, or if pz is not positive in a view with ln(pz)."""
    back = X.view_inverse(view, {n: F.col(prefix + n) for n in VIEWS[view]}, unit)
    staged = df.withColumns({f"_{n}": c for n, c in back.items()})
    ok = total([F.when(finite(f"_{n}"), 0).otherwise(1) for n in back]) == 0
    ok = ok if view == "identity" else ok & (F.col("_pz") > 0)
    kept = staged.withColumns({n: or_error(ok, F.col(f"_{n}"), f"the inverse of the {view} view leaves its domain") for n in back})
    return kept.drop(*(f"_{n}" for n in back))


def physical_log_prob(log_prob: Column, view: str, pz: Column | None = None) -> Column:
    """Log density in physical coordinates from one in a view's features."""
    return log_prob + X.view_log_jacobian(view, F.col("pz") if pz is None else pz)


def angles() -> dict[str, Column]:
    """Polar and azimuth angle of the momentum; theta is null where the direction is not defined."""
    px, py, pz = (F.col(c) for c in PHYSICAL[:3])
    pt = F.hypot(px, py)
    return {"theta": F.when((pt != 0) | (pz != 0), F.atan2(pt, pz)), "phi": F.when(pt == 0, F.lit(0.0)).otherwise(F.atan2(py, px))}


def energy(mass: float = MUON_MASS) -> Column:
    return F.sqrt(total([F.col(c) * F.col(c) for c in PHYSICAL[:3]]) + mass**2)


def momentum_score(scale: float = 50.0) -> Column:
    """Placeholder score p / (p + scale) of the momentum's norm, of no physical meaning."""
    if not 0 < scale < math.inf:
        raise ValueError("the scale must be positive and finite")
    p = F.sqrt(total([F.col(c) * F.col(c) for c in PHYSICAL[:3]]))
    return p / (p + scale)


class FeaturePipeline:
    """A view with its standardization, fitted on training rows and saved as plain numbers."""

    def __init__(self, view: str, unit: float = 1.0, fitted: Mapping[str, tuple[float, float]] | None = None):
        self.view, self.unit, self.fitted = view, unit, {n: (float(m), float(s)) for n, (m, s) in (fitted or {}).items()}

    def fit(self, train: DataFrame) -> FeaturePipeline:
        """A feature without variance is an error."""
        stats = profile.fit_normalization(to_features(train, self.view, self.unit, "_f_").select(*(F.col(f"_f_{n}").alias(n) for n in VIEWS[self.view])), VIEWS[self.view], "error")
        self.fitted = profile.parameters(stats)
        return self

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        features = to_features(df, self.view, self.unit, "_f_")
        cells = profile.standardized({n: F.col(f"_f_{n}") for n in VIEWS[self.view]}, self.fitted)
        return features.withColumns({prefix + n: c for n, c in cells.items()}).drop(*(f"_f_{n}" for n in cells))

    def inverse(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        cells = profile.standardized({n: F.col(prefix + n) for n in VIEWS[self.view]}, self.fitted, inverse=True)
        return from_features(df.withColumns({f"_f_{n}": c for n, c in cells.items()}), self.view, self.unit, "_f_").drop(*(f"_f_{n}" for n in cells))

    def physical_log_prob(self, log_prob: Column, pz: Column | None = None) -> Column:
        """Log density in physical coordinates from one in standardized features."""
        return physical_log_prob(log_prob - sum(math.log(s) for _, s in self.fitted.values()), self.view, pz)

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"view": self.view, "unit": self.unit, "fitted": self.fitted}, sort_keys=True)
        spark.createDataFrame([(text,)], "pipeline string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePipeline:
        return cls(**json.loads(spark.read.text(path).first()[0]))

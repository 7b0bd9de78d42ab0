"""Catalogue of controlled targets D0 to D5: Gaussian mixtures in physical coordinates, some seen through a transform."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgrain.functions import expressions as X

IDS = (13, -13)
COLUMNS = ("px", "py", "pz", "x", "y")

# Fixed values of the catalogue: means, standard deviations, correlations and weights by id, and transforms.
D0 = {"mean": (0.0, 0.0, 50.0, 0.0, 0.0), "std": (3.0, 3.0, 4.0, 0.5, 0.5)}
D1_MEAN = (0.0, 0.0, 50.0, 0.0, 0.0)
D1_COVARIANCE = (
    (9.00, 1.80, 1.20, 0.75, 0.00),
    (1.80, 9.00, 1.20, 0.00, 0.75),
    (1.20, 1.20, 16.00, 0.10, 0.10),
    (0.75, 0.00, 0.10, 0.25, 0.05),
    (0.00, 0.75, 0.10, 0.05, 0.25),
)
D2 = {
    13: [
        {"mean": (2.0, 1.0, 45.0, 0.3, 0.2), "std": (3.0, 3.0, 4.0, 0.5, 0.5), "weight": 0.6},
        {"mean": (-2.0, -1.0, 60.0, -0.3, -0.2), "std": (4.0, 4.0, 5.0, 0.6, 0.6), "weight": 0.4},
    ],
    -13: [
        {"mean": (-1.5, 2.5, 55.0, 0.1, -0.4), "std": (3.5, 3.0, 4.5, 0.5, 0.5), "weight": 0.55},
        {"mean": (3.0, -2.0, 48.0, -0.2, 0.3), "std": (4.0, 3.5, 4.0, 0.6, 0.6), "weight": 0.45},
    ],
}
D3_BANANA = {"scale_px": 3.0, "scale_py": 3.0, "scale_x": 0.5, "curvature": 0.9, "shear": 0.6}
D3 = {
    13: [
        {"mean": (1.5, 0.5, 48.0, 0.1, -0.1), "std": (3.0, 3.0, 4.0, 0.5, 0.5), "corr": {(0, 1): 0.3}, "weight": 0.6},
        {"mean": (-2.0, -1.0, 55.0, -0.2, 0.2), "std": (3.5, 3.0, 4.5, 0.5, 0.5), "corr": {(0, 1): -0.2}, "weight": 0.4},
    ],
    -13: [
        {"mean": (-1.0, 1.5, 52.0, -0.1, 0.1), "std": (3.0, 3.2, 4.2, 0.5, 0.5), "corr": {(0, 1): 0.25}, "weight": 0.55},
        {"mean": (2.5, -1.5, 47.0, 0.2, -0.2), "std": (3.5, 3.0, 4.0, 0.5, 0.5), "corr": {(0, 1): -0.15}, "weight": 0.45},
    ],
}
D4_SCALES, D4_SKEWS = (4.0, 4.0, 5.0, 0.6, 0.6), (0.6, -0.4, 0.0, 0.3, -0.3)
D4_BANANA = {"scale_px": 4.0, "scale_py": 4.0, "scale_x": 0.6, "curvature": 0.7, "shear": 0.5}
D4 = {
    13: [
        {"mean": (3.0, 1.0, 45.0, 0.3, 0.1), "std": (2.5, 2.5, 4.0, 0.4, 0.4), "corr": {(0, 1): 0.4, (0, 3): 0.3}, "weight": 0.5},
        {"mean": (-4.0, -2.0, 58.0, -0.4, 0.3), "std": (5.0, 3.0, 5.0, 0.7, 0.5), "corr": {(0, 1): -0.3, (1, 4): 0.35}, "weight": 0.35},
        {"mean": (0.0, 5.0, 52.0, 0.0, -0.5), "std": (3.0, 4.5, 4.5, 0.5, 0.7), "corr": {(1, 4): -0.4}, "weight": 0.15},
    ],
    -13: [
        {"mean": (-2.5, 2.0, 50.0, -0.2, 0.2), "std": (2.8, 3.5, 4.5, 0.45, 0.55), "corr": {(0, 1): -0.35, (1, 4): 0.3}, "weight": 0.55},
        {"mean": (4.0, -3.0, 46.0, 0.4, -0.3), "std": (4.5, 2.8, 4.0, 0.65, 0.45), "corr": {(0, 3): 0.4}, "weight": 0.3},
        {"mean": (0.5, -1.0, 60.0, 0.1, 0.4), "std": (3.2, 3.2, 5.0, 0.5, 0.6), "corr": {(0, 1): 0.2}, "weight": 0.15},
    ],
}
D5_VARIANTS = {"rare_1e-2": 1e-2, "rare_1e-3": 1e-3}
D5_RARE_MEAN = {13: (18.0, 16.0, 50.0, 3.0, -3.0), -13: (-18.0, -16.0, 50.0, -3.0, 3.0)}
D5_RARE_STD = (2.0, 2.0, 4.0, 0.4, 0.4)
D5_RADIUS_SQ = 16.0
#: Region probability and its standard error, from a million draws.
D5_CALIBRATION = {"rare_1e-2": (0.009812, 9.856837553698447e-05), "rare_1e-3": (0.000979, 3.1273655990305963e-05)}


@dataclass(frozen=True)
class Component:
    mean: tuple[float, ...]
    cov: tuple[tuple[float, ...], ...]
    weight: float


@dataclass(frozen=True)
class Target:
    name: str
    components: dict[int, list[Component]]
    banana: dict[str, float] | None = None
    scales: Sequence[float] = ()
    skews: Sequence[float] = ()
    rare: dict[int, int] = field(default_factory=dict)
    rare_mass: float | None = None

    def forward(self, s: X.State) -> dict[str, Column]:
        s = X.skew(self.scales, self.skews, s) if self.scales else dict(s)
        return X.banana(self.banana, s) if self.banana else s

    def inverse(self, s: X.State) -> tuple[dict[str, Column], Column]:
        """Base coordinates and the inverse log-Jacobian at a physical point."""
        s = X.banana(self.banana, s, inverse=True) if self.banana else dict(s)
        if not self.scales:
            return s, F.lit(0.0)
        return X.skew(self.scales, self.skews, s, inverse=True), X.skew_log_jacobian(self.scales, self.skews, s, inverse=True)

    def component_terms(self, pdg_id: int, s: X.State) -> list[Column]:
        """ln(weight) + ln N for each component, in base coordinates."""
        x = [s[c] for c in COLUMNS]
        return [F.lit(math.log(c.weight)) + X.full_gauss_logpdf(x, c.mean, c.cov) for c in self.components[pdg_id]]

    def region(self, pdg_id: int, s: X.State) -> Column:
        """Whether a point in base coordinates lies in the rare region."""
        return X.mahalanobis_sq([s[c] for c in COLUMNS], D5_RARE_MEAN[pdg_id], np.diag(np.square(D5_RARE_STD))) <= D5_RADIUS_SQ


def _component(spec: dict, weight: float | None = None) -> Component:
    std = np.asarray(spec["std"])
    cov = np.diag(std**2)
    for (i, j), rho in spec.get("corr", {}).items():
        cov[i, j] = cov[j, i] = rho * std[i] * std[j]
    return Component(tuple(spec["mean"]), tuple(map(tuple, cov.tolist())), spec.get("weight", 1.0) if weight is None else weight)


def target(name: str, variant: str = "rare_1e-2", base: bool = False) -> Target:
    """A target by name; base leaves its transform away."""
    if name == "D0":
        found = Target(name, {i: [_component(D0)] for i in IDS})
    elif name == "D1":
        found = Target(name, {i: [Component(D1_MEAN, D1_COVARIANCE, 1.0)] for i in IDS})
    elif name == "D2":
        found = Target(name, {i: [_component(s) for s in D2[i]] for i in IDS})
    elif name == "D3":
        found = Target(name, {i: [_component(s) for s in D3[i]] for i in IDS}, D3_BANANA)
    elif name == "D4":
        found = Target(name, {i: [_component(s) for s in D4[i]] for i in IDS}, D4_BANANA, D4_SCALES, D4_SKEWS)
    elif name == "D5":
        m = D5_VARIANTS[variant]
        parts = {i: [*(_component(s, s["weight"] * (1 - m)) for s in D4[i]), _component({"mean": D5_RARE_MEAN[i], "std": D5_RARE_STD}, m)] for i in IDS}
        found = Target(name, parts, D4_BANANA, D4_SCALES, D4_SKEWS, {i: len(parts[i]) - 1 for i in IDS}, m)
    else:
        raise ValueError(f"unknown target {name!r}")
    return Target(found.name, found.components, rare=found.rare, rare_mass=found.rare_mass) if base else found


def by_id(column: str, make) -> Column:
    """make(id) for each supported id, chosen by the row's id."""
    return F.when(F.col(column) == IDS[0], make(IDS[0])).when(F.col(column) == IDS[1], make(IDS[1]))


def state() -> dict[str, Column]:
    return {c: F.col(c) for c in COLUMNS}


def parameter_table(spark: SparkSession, t: Target) -> DataFrame:
    """The target's components as a table, one row each."""
    rows = [(i, k, c.weight, list(c.mean), [list(r) for r in c.cov]) for i in IDS for k, c in enumerate(t.components[i])]
    return spark.createDataFrame(rows, "id int, component_id int, weight double, mean array<double>, cov array<array<double>>")

"""Monte Carlo inference over aggregated strata: the data are counts, never rows."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _seed(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def bootstrap_difference(strata: DataFrame, key: str, replicates: int = 999, seed: int = 1) -> DataFrame:
    """key, effect, lower, upper: parametric bootstrap of the standardised difference, 2.5 and 97.5 percentiles.

    ``strata``: key, a, a_total, c, c_total, one row a stratum. Seeded by key, so a run repeats itself.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[key].iloc[0]
        s = pdf[(pdf["a_total"] > 0) & (pdf["c_total"] > 0)].sort_values(["a_total", "a", "c_total", "c"])
        if s.empty:
            return pd.DataFrame({key: [name], "effect": [np.nan], "lower": [np.nan], "upper": [np.nan]})
        w = (s["a_total"] / s["a_total"].sum()).to_numpy()
        na, nc = s["a_total"].to_numpy(np.int64), s["c_total"].to_numpy(np.int64)
        pa, pc = s["a"].to_numpy() / na, s["c"].to_numpy() / nc
        rng = np.random.default_rng(_seed(seed, name))
        draws = (rng.binomial(na, pa, (replicates, len(s))) / na - rng.binomial(nc, pc, (replicates, len(s))) / nc) @ w
        low, high = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame({key: [name], "effect": [float((pa - pc) @ w)], "lower": [low], "upper": [high]})

    return strata.groupBy(key).applyInPandas(run, f"{key} string, effect double, lower double, upper double")


def permutation_test(strata: DataFrame, key: str, replicates: int = 499, seed: int = 1) -> DataFrame:
    """key, observed, expected, p: exact stratified permutation of a cell by hypergeometric draws, p = (extreme + 1) / (replicates + 1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[key].iloc[0]
        s = pdf.sort_values(["a_total", "a", "c_total", "c"])
        n1, n0 = s["a_total"].to_numpy(np.int64), s["c_total"].to_numpy(np.int64)
        m = (s["a"] + s["c"]).to_numpy(np.int64)
        observed, expected = float(s["a"].sum()), float((m * n1 / np.maximum(n1 + n0, 1)).sum())
        rng = np.random.default_rng(_seed(seed, name))
        draws = rng.hypergeometric(m, n1 + n0 - m, n1, (replicates, len(s))).sum(axis=1)
        extreme = int((np.abs(draws - expected) + 1e-12 >= abs(observed - expected)).sum())
        return pd.DataFrame({key: [name], "observed": [observed], "expected": [expected], "p": [(extreme + 1) / (replicates + 1)]})

    return strata.groupBy(key).applyInPandas(run, f"{key} string, observed double, expected double, p double")

"""Resampling tests over histories of one row per cycle, not raw rows; larger groups are refused."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

#: Rows of a group at most, and random numbers that are held at once.
MOST, HELD = 1_000_000, 8_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def _permute(pdf: pd.DataFrame, group: str, high: str, value: str, ident: str, rounds: int) -> pd.DataFrame:
    if len(pdf) > MOST:
        raise ValueError(f"a group of {len(pdf)} rows: permutation tests are for at most {MOST}")
    pdf = pdf.sort_values(ident, kind="stable")
    side, v = pdf[high].to_numpy(bool), pdf[value].to_numpy(float)
    n, k = len(v), int(side.sum())
    out = {group: pdf[group].iloc[0], "n_high": k, "n_low": n - k}
    if n < 4 or k in (0, n):
        return pd.DataFrame([out | {"diff": None, "p_value": 1.0}])
    diff = v[side].mean() - v[~side].mean()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, pdf[ident].astype(str)), np.uint64, n)
    total, extreme, block = v.sum(), 0, max(1, HELD // n)
    for first in range(0, rounds, block):
        with np.errstate(over="ignore"):
            turn = np.arange(first, min(rounds, first + block), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            keys = _mixed(own[None, :] + _mixed(turn)[:, None])
        sums = v[np.argpartition(keys, k - 1, axis=1)[:, :k]].sum(1)
        extreme += int((np.abs(sums / k - (total - sums) / (n - k)) >= abs(diff) - 1e-12).sum())
    return pd.DataFrame([out | {"diff": float(diff), "p_value": (extreme + 1) / (rounds + 1)}])


def permutation_p(rows: DataFrame, group: str, high: str, value: str, ident: str, rounds: int = 1000) -> DataFrame:
    """group, n_high, n_low, diff, p_value: two-sided, add-one smoothed, over shuffles ordered by hashes of the ids, so the same everywhere.

    Fewer than four rows, or one side empty, give the p-value 1. Nulls in value or side do not count.
    """
    r = rows.select(group, high, value, ident).dropna(subset=[high, value, ident])
    kind = dict(rows.dtypes)[group]
    return r.groupBy(group).applyInPandas(partial(_permute, group=group, high=high, value=value, ident=ident, rounds=rounds), f"{group} {kind}, n_high long, n_low long, diff double, p_value double")


def beta_draws(seed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.random.default_rng(seed).beta(a, b)


def _draw(pdf: pd.DataFrame, arm: str, seed: int) -> pd.DataFrame:
    pdf = pdf.sort_values(arm, kind="stable")
    draw = beta_draws(seed, 1.0 + pdf["wins"].to_numpy(float), 1.0 + (pdf["n"] - pdf["wins"]).to_numpy(float))
    return pd.DataFrame({arm: pdf[arm], "n": pdf["n"], "wins": pdf["wins"], "draw": draw, "picked": draw == draw.max()})


def thompson(counts: DataFrame, arm: str, seed: int) -> DataFrame:
    """arm, n, wins, draw, picked: one draw per arm from its posterior; counts has one row per arm (arm, n, wins)."""
    kind = dict(counts.dtypes)[arm]
    return counts.groupBy().applyInPandas(partial(_draw, arm=arm, seed=seed), f"{arm} {kind}, n long, wins long, draw double, picked boolean")

"""Draws that depend on a unit and on counters alone, for whole arrays of units."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(units: np.ndarray, *counters: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each unit (64-bit integers) and the counters, which broadcast against it."""
    with np.errstate(over="ignore"):
        x = _mixed(np.asarray(units).astype(np.int64).view(np.uint64) + _STEP)
        for c in counters:
            x = _mixed(x + _STEP * (np.asarray(c).astype(np.uint64) + np.uint64(1)))
    return (x >> np.uint64(11)) / 2.0**53


#: Distribution function of the Poisson law of mean one, up to where a double ends.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))


def poisson(units: np.ndarray, *counters: int | np.ndarray) -> np.ndarray:
    """How often each unit is drawn: Poisson of mean one."""
    return np.searchsorted(_POISSON, uniform(units, *counters), side="right")

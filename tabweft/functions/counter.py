"""Random numbers of NumPy arrays that depend on (seed, stream, row id, place) only, so they survive any repartitioning and any repeated task."""

from __future__ import annotations

import numpy as np

_STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose outputs look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(seed: int, stream: int, ids: np.ndarray, width: int) -> np.ndarray:
    """(rows x width) numbers in (0, 1), of 53 bits."""
    start = np.array([seed & 0xFFFFFFFF, stream & 0xFFFFFFFFFFFF], np.uint64)
    key = _mixed(_mixed(start[:1] * _STEP + np.uint64(1)) + start[1:] * _PLACE)
    rows = _mixed(ids.astype(np.int64).view(np.uint64) * _STEP + key)
    places = np.arange(1, width + 1, dtype=np.uint64) * _PLACE
    return ((_mixed(rows[:, None] + places) >> np.uint64(11)) + 0.5) * 2.0**-53


def normals(seed: int, stream: int, ids: np.ndarray, width: int) -> np.ndarray:
    """(rows x width) standard normal numbers, by pairs of uniform ones."""
    u = uniforms(seed, stream, ids, 2 * ((width + 1) // 2))
    half = u.shape[1] // 2
    radius, angle = np.sqrt(-2 * np.log(u[:, :half])), 2 * np.pi * u[:, half:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], axis=1)[:, :width]

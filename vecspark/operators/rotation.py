"""Seeded orthogonal rotations, built once per seed and dimension."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=8)
def rotation(seed: int, dimension: int) -> np.ndarray:
    """QR of a seeded normal matrix, columns turned so that R's diagonal is positive."""
    normal = np.random.default_rng(seed).standard_normal((dimension, dimension))
    q, r = np.linalg.qr(normal)
    turned = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    turned.setflags(write=False)
    return turned


def is_orthogonal(matrix: np.ndarray, tolerance: float = 1e-9) -> bool:
    """Whether matrix times its transpose is the identity within `tolerance`."""
    return bool(np.abs(matrix @ matrix.T - np.eye(len(matrix))).max() <= tolerance)

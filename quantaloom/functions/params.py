"""Seeded parameters of a quantizer: centroids, signed permutation, Gaussian projection.

They depend on (dim, bit_width, seed) alone and are made on the driver, so that every executor and engine, and the SQL
twins, use the same numbers. Caches are bounded.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

#: Salts that part the rotation's stream from the projection's.
ROTATION_SALT = 0xA5A517C3913D20FF
PROJECTION_SALT = 0xCEFAEDFE19870011
#: The optimal four-level quantizer of a unit normal, positive half.
FOUR_LEVELS = (0.453, 1.51)
#: Lloyd iterations and samples for other level counts.
LLOYD_ROUNDS, LLOYD_SAMPLES = 32, 20_000
MAX_BIT_WIDTH = 9
_MASK = (1 << 64) - 1


@functools.lru_cache(maxsize=128)
def centroids(bits: int, dim: int) -> np.ndarray:
    """2^bits ascending levels for coordinates of unit vectors: normal with deviation 1 / sqrt(dim)."""
    sigma, levels = dim**-0.5, 1 << bits
    if bits == 2:
        return np.array([-FOUR_LEVELS[1], -FOUR_LEVELS[0], *FOUR_LEVELS]) * sigma
    samples = np.random.default_rng((dim << 16) ^ bits).standard_normal(LLOYD_SAMPLES) * sigma
    found = ((np.arange(levels) + 0.5) / levels * 6 - 3) * sigma
    for _ in range(LLOYD_ROUNDS):
        cell = np.searchsorted((found[1:] + found[:-1]) / 2, samples, "left")
        count, total = np.bincount(cell, minlength=levels), np.bincount(cell, samples, levels)
        found = np.sort(np.where(count > 0, total / np.maximum(count, 1), found))
    return found


@functools.lru_cache(maxsize=64)
def signed_permutation(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(source of each coordinate, sign of each): a cheap stand-in for a random rotation."""
    g = np.random.default_rng((seed ^ ROTATION_SALT) & _MASK)
    return g.permutation(dim), np.where(g.random(dim) < 0.5, 1.0, -1.0)


@functools.lru_cache(maxsize=8)
def projection(dim: int, seed: int) -> np.ndarray:
    """dim x dim standard normals, row-major."""
    return np.random.default_rng((seed ^ PROJECTION_SALT) & _MASK).standard_normal((dim, dim))


@dataclass(frozen=True)
class QuantParams:
    """What a quantizer of ``bit_width`` bits a coordinate uses: one bit is the sign sketch's, the others index centroids."""

    dim: int
    bit_width: int = 4
    seed: int = 0

    def __post_init__(self) -> None:
        if self.dim < 1:
            raise ValueError("dim must be at least 1")
        if not 1 <= self.bit_width <= MAX_BIT_WIDTH:
            raise ValueError(f"bit_width must be 1 to {MAX_BIT_WIDTH}")

    @property
    def mse_bits(self) -> int:
        return max(self.bit_width - 1, 1)

    @property
    def centroids(self) -> np.ndarray:
        return centroids(self.mse_bits, self.dim)

    @property
    def midpoints(self) -> np.ndarray:
        return (self.centroids[1:] + self.centroids[:-1]) / 2

    @property
    def perm(self) -> np.ndarray:
        return signed_permutation(self.dim, self.seed)[0]

    @property
    def signs(self) -> np.ndarray:
        return signed_permutation(self.dim, self.seed)[1]

    @property
    def inverse(self) -> np.ndarray:
        out = np.empty(self.dim, np.int64)
        out[self.perm] = np.arange(self.dim)
        return out

    @property
    def projection(self) -> np.ndarray:
        return projection(self.dim, self.seed)

    @property
    def rotated_projection(self) -> np.ndarray:
        """The projection for residuals in rotated coordinates: no rotation back is needed."""
        return self.projection[:, self.perm] * self.signs

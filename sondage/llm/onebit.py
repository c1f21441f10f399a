"""Randomly rotated one-bit codes of vectors (the RaBitQ scheme) in numpy.

A vector's residual from its cell's centre is normalised and rotated at random; its signs, packed eight to a byte, are the
code. With the scalar <code vector, residual> kept beside it, the inner product with any query is estimated from the
packed bits by table look-up, and an angle bound says how far off the estimate can be.
"""

from __future__ import annotations

import numpy as np

_BYTE_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1).T  # 8 x 256


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix of the next multiple of eight dimensions."""
    size = -(-dims // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _rotated_units(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest = x - centre
    norm = np.sqrt((rest * rest).sum(axis=1))
    unit = np.divide(rest, norm[:, None], out=np.zeros_like(rest), where=norm[:, None] > 0)
    return unit @ turn[: x.shape[1]], norm


class Codes:
    """The codes of one cell's vectors and the distances estimated from them."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.centre, self.turn = centre, turn
        units, self.norm = _rotated_units(x, centre, turn)
        self.packed = np.packbits(units > 0, axis=1)
        self.scalar = np.clip(np.abs(units).sum(axis=1) / np.sqrt(turn.shape[0]), 1e-9, 1.0)

    def estimate(self, queries: np.ndarray, epsilon: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of queries (rows) to the cell's vectors (columns): the estimate, and a lower bound.

        With epsilon None the bound is certain: the angle between query and vector is at least the difference of their angles to
        the code. Otherwise it is the probabilistic one, estimate - epsilon * sqrt((1 - s^2) / s^2 / (D - 1)).
        """
        units, norm = _rotated_units(queries, self.centre, self.turn)
        scale = 1 / np.sqrt(self.turn.shape[0])
        dots = np.zeros((len(queries), len(self.norm)))
        for j in range(self.packed.shape[1]):
            dots += (units[:, 8 * j : 8 * j + 8] @ _BYTE_SIGNS)[:, self.packed[:, j]]
        dots *= scale
        s = self.scalar
        cosine = np.clip(dots / s, -1, 1)
        if epsilon is None:
            at_most = dots * s + np.sqrt(1 - s * s) * np.sqrt(np.clip(1 - dots * dots, 0, None))
            at_most[dots >= s] = 1.0
        else:
            at_most = np.minimum(1, cosine + epsilon * np.sqrt((1 - s * s) / (s * s) / (self.turn.shape[0] - 1)))
        square, cross = norm[:, None] ** 2 + self.norm**2, 2 * norm[:, None] * self.norm
        return square - cross * cosine, square - cross * at_most


def nearest_in_cell(codes: Codes, x: np.ndarray, keys: np.ndarray, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, epsilon: float | None = None):
    """Of each query the k nearest vectors of the cell with a squared distance up to its limit, but not the vector of its own key.

    Yields (query row, vector row, squared distance) arrays for blocks of queries, k or fewer for each query. The k best
    estimates are measured exactly and give a radius; every vector whose lower bound is within it is measured too.
    """
    block = max(1, 2_000_000 // max(1, len(x)))
    few = min(len(x), 2 * k + 1)
    for at in range(0, len(queries), block):
        q, o, most = queries[at : at + block], own[at : at + block], limit[at : at + block].copy()
        guess, least = codes.estimate(q, epsilon)
        self_at = o[:, None] == keys
        guess[self_at] = np.inf
        if len(x) > k:
            near = np.argpartition(guess, few - 1, axis=1)[:, :few]
            exact = ((x[near] - q[:, None, :]) ** 2).sum(axis=2)
            exact[np.take_along_axis(self_at, near, axis=1)] = np.inf
            most = np.minimum(most, np.partition(exact, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero((least <= (most * (1 + 1e-9) + 1e-12)[:, None]) & ~self_at)
        exact = ((x[cols] - q[rows]) ** 2).sum(axis=1)
        kept = exact <= most[rows]
        rows, cols, exact = rows[kept], cols[kept], exact[kept]
        order = np.lexsort((keys[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        start = np.searchsorted(rows, np.arange(len(q)))
        best = np.arange(len(rows)) - start[rows] < k
        yield rows[best] + at, cols[best], exact[best]

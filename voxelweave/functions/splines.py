"""Cubic B-spline interpolation of volumes: a recursive prefilter along each axis, and four taps an axis at each point."""

from __future__ import annotations

import numpy as np

#: The pole of the cubic B-spline's inverse filter.
POLE = np.sqrt(3.0) - 2.0


def mirrored(index: np.ndarray, n: int) -> np.ndarray:
    """Places of a signal that is mirrored about its first and its last sample."""
    if n == 1:
        return np.zeros_like(index)
    index = np.abs(index) % (2 * n - 2)
    return np.minimum(index, 2 * n - 2 - index)


def coefficients(volume: np.ndarray) -> np.ndarray:
    """Weights of B-splines at the samples whose sum passes through all of them; edges are mirrored."""
    out = np.array(volume, float)
    for axis, n in enumerate(out.shape):
        if n == 1:
            continue
        c = np.moveaxis(out, axis, 0) * 6.0
        # the first sum runs over the mirrored signal, which has a period of 2 n - 2
        turn = np.concatenate([c, c[-2:0:-1]])
        powers = POLE ** np.arange(len(turn))
        first = np.tensordot(powers, turn, 1) / (1 - POLE ** len(turn))
        c[0] = first
        for k in range(1, n):
            c[k] += POLE * c[k - 1]
        c[-1] = POLE / (POLE * POLE - 1) * (c[-1] + POLE * c[-2])
        for k in range(n - 2, -1, -1):
            c[k] = POLE * (c[k + 1] - c[k])
        out = np.moveaxis(c, 0, axis)
    return out


def kernel(d: np.ndarray) -> np.ndarray:
    """The cubic B-spline at a distance."""
    d = np.abs(d)
    return np.where(d < 1, 2 / 3 - d * d + d * d * d / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0.0))


def sample(weights: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Values at fractional indices (n, 3) of a volume with these coefficients; one tap of the 64 at a time."""
    low = np.floor(index).astype(int) - 1
    taps = [[(mirrored(low[:, a] + k, weights.shape[a]), kernel(index[:, a] - low[:, a] - k)) for k in range(4)] for a in range(3)]
    out = np.zeros(len(index))
    for i, wi in taps[0]:
        for j, wj in taps[1]:
            both = wi * wj
            for k, wk in taps[2]:
                out += both * wk * weights[i, j, k]
    return out

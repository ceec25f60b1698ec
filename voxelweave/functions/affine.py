"""4x4 affines in numpy."""

from __future__ import annotations

import numpy as np


def compose(t: np.ndarray, r: np.ndarray, z: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
    """Translation, rotation, zooms and shears (xy, xz, yz) as one matrix."""
    shear = np.eye(3)
    if s is not None:
        shear[np.triu_indices(3, 1)] = s
    out = np.eye(4)
    out[:3, :3] = np.asarray(r) @ np.diag(z) @ shear
    out[:3, 3] = t
    return out


def decompose(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The way back, by a QR factorisation with positive zooms; the determinant must be positive."""
    a = np.asarray(a, float)
    if np.linalg.det(a[:3, :3]) <= 0:
        raise ValueError("the determinant must be positive")
    q, r = np.linalg.qr(a[:3, :3])
    sign = np.sign(np.diag(r))
    q, r = q * sign, r * sign[:, None]
    z = np.diag(r)
    return a[:3, 3].copy(), q, z.copy(), (r / z[:, None])[np.triu_indices(3, 1)]


def motion_parameters(a: np.ndarray) -> np.ndarray:
    """Angles about the three axes (radians) and translations of a rigid affine; in gimbal lock the last angle is 0."""
    r, t = np.asarray(a, float)[:3, :3], np.asarray(a, float)[:3, 3]
    sy = np.hypot(r[0, 0], r[1, 0])
    if sy > 1e-6:
        angles = [np.arctan2(r[2, 1], r[2, 2]), np.arctan2(-r[2, 0], sy), np.arctan2(r[1, 0], r[0, 0])]
    else:
        angles = [np.arctan2(-r[1, 2], r[1, 1]), np.arctan2(-r[2, 0], sy), 0.0]
    return np.array([*angles, *t])


def rotation(ax: float, ay: float, az: float) -> np.ndarray:
    c, s = np.cos, np.sin
    x = np.array([[1, 0, 0], [0, c(ax), -s(ax)], [0, s(ax), c(ax)]])
    y = np.array([[c(ay), 0, s(ay)], [0, 1, 0], [-s(ay), 0, c(ay)]])
    z = np.array([[c(az), -s(az), 0], [s(az), c(az), 0], [0, 0, 1]])
    return z @ y @ x


def relative(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """From one recording's space to another's through a common one: inverse of the other's times one's own."""
    return np.linalg.inv(other) @ own

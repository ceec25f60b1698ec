"""Butterworth design as second-order sections, and zero-phase filtering of many series at once, in numpy."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, rate: float, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Sections (b0 b1 b2 1 a1 a2): high-pass above `low`, low-pass below `high`, band-pass for both.

    The analogue prototype's poles are moved to the pre-warped cutoffs and taken to the z plane by the bilinear
    transform; conjugate poles share a section, and gain is put into the first one.
    """
    if low is None and high is None:
        raise ValueError("a cutoff is needed")
    for cutoff in (low, high):
        if cutoff is not None and not 0 < cutoff < rate / 2:
            raise ValueError(f"cutoff {cutoff} isn't between 0 and half of the rate {rate}")
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if low is not None and high is not None:
        if low >= high:
            raise ValueError("the low cutoff must be below the high one")
        w1, w2 = warp(low), warp(high)
        centre, band = np.sqrt(w1 * w2), w2 - w1
        half = poles * band / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), band**order
    elif high is not None:
        w = warp(high)
        poles, zeros, gain = poles * w, np.zeros(0), w**order
    else:
        w = warp(low)
        poles, zeros, gain = w / poles, np.zeros(order), 1.0
    k = 2 * rate
    zp, zz = (k + poles) / (k - poles), (k + zeros) / (k - zeros)
    gain = float(np.real(gain * np.prod(k - zeros) / np.prod(k - poles)))
    zz = np.concatenate([zz, -np.ones(len(zp) - len(zz))])
    upper = sorted(zp[zp.imag > 1e-10], key=lambda p: abs(p))
    real = sorted(zp[np.abs(zp.imag) <= 1e-10].real)
    pairs = [(p, np.conj(p)) for p in upper] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    at_one, at_minus = int((zz.real > 0).sum()), int((zz.real < 0).sum())
    sections = []
    for pair in sorted(pairs, key=len):  # a section with a single pole comes first
        zs = []
        for _ in pair:
            take_one = at_one > at_minus or (at_one == at_minus and len(zs) == 0 and at_one > 0)
            zs.append(1.0 if take_one else -1.0)
            at_one, at_minus = (at_one - 1, at_minus) if take_one else (at_one, at_minus - 1)
        b, a = np.poly(zs), np.real(np.poly(pair))
        sections.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))]))
    out = np.array(sections)
    out[0, :3] *= gain
    return out


def steady_state(section: np.ndarray) -> np.ndarray:
    """State of a section that has seen the constant 1 for ever."""
    b, a = section[:3], section[3:]
    dc = b.sum() / a.sum()
    return np.array([dc - b[0], b[2] - a[2] * dc])


def run(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Filter rows of x through all sections from a state (sections, 2, rows)."""
    x = np.array(x, float)
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        z1, z2 = state[s]
        for t in range(x.shape[1]):
            v = x[:, t]
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            x[:, t] = y
    return x


def forward_backward(sections: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Filter forwards and backwards, so that nothing is shifted; ends are continued by odd reflection."""
    x = np.asarray(x, float)
    single = x.ndim == 1
    x = np.atleast_2d(x)
    if pad is None:
        taps = 2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum())
        pad = 3 * taps
    if x.shape[1] <= pad:
        raise ValueError(f"{x.shape[1]} samples are too few; more than {pad} are needed")
    if pad:
        x = np.hstack([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]])
    rest, gain = [], 1.0
    for s in sections:
        rest.append(steady_state(s) * gain)
        gain *= s[:3].sum() / s[3:].sum()
    rest = np.array(rest)
    for _ in range(2):
        x = run(sections, x, rest[:, :, None] * x[:, 0])[:, ::-1]
    x = x[:, pad : x.shape[1] - pad] if pad else x
    return x[0] if single else x

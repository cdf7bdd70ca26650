"""Stokes and receptor polarizations, and the Mueller matrices between them."""

from __future__ import annotations

import numpy as np

#: Each polarization in terms of I, Q, U, V.
IN_STOKES = {
    "I": [1, 0, 0, 0], "Q": [0, 1, 0, 0], "U": [0, 0, 1, 0], "V": [0, 0, 0, 1],
    "XX": [1, 1, 0, 0], "YY": [1, -1, 0, 0], "XY": [0, 0, 1, 1j], "YX": [0, 0, 1, -1j],
    "RR": [1, 0, 0, 1], "LL": [1, 0, 0, -1], "RL": [0, 1, 1j, 0], "LR": [0, 1, -1j, 0],
}


def mueller(outputs: list[str], inputs: list[str]) -> np.ndarray:
    """The least-norm matrix that makes ``outputs`` of ``inputs``; ValueError if none does."""
    a, b = (np.array([IN_STOKES[p] for p in x], complex) for x in (inputs, outputs))
    m = np.linalg.lstsq(a.T, b.T, rcond=None)[0].T
    even = np.round(m * 4) / 4
    m = np.where(np.abs(m - even) < 1e-9, even, m)
    if not np.allclose(m @ a, b):
        raise ValueError(f"{outputs} can't be made of {inputs}")
    return m


def parse_stokes(text: str) -> list[str]:
    if not text or len(set(text)) < len(text) or set(text) - set("IQUV"):
        raise ValueError(f"{text!r}: one or more of I, Q, U, V, each once")
    return sorted(text, key="IQUV".index)


def unparse_stokes(pols: list[str]) -> str:
    return "".join(sorted(pols, key="IQUV".index))


def feed_phases(a1: np.ndarray, a2: np.ndarray) -> np.ndarray:
    """Diagonal phases of RR, RL, LR, LL for feed angles of both antennas."""
    return np.exp(1j * np.stack([a1 - a2, a1 + a2, -(a1 + a2), a2 - a1], -1))

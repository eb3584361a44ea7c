"""Minimising several smooth functions beside each other by limited-memory BFGS, for fits whose gradients are summed in Spark."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np

#: Pairs of steps and gradient changes that stand for the curvature.
MEMORY = 10
#: A step is halved until the function falls by this share of what its slope promises, so often at most.
ARMIJO, HALVINGS = 1e-4, 25


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _direction(gradient: np.ndarray, pairs) -> np.ndarray:
    """The quasi-Newton direction of every row; a pair counts only for the rows in which its curvature is positive (`rho` is 0 elsewhere)."""
    q, kept = -gradient, []
    for s, y, rho in reversed(pairs):
        a = rho * _dot(s, q)
        q = q - a[:, None] * y
        kept.append(a)
    if pairs:
        s, y, rho = pairs[-1]
        yy = _dot(y, y)
        q = q * np.where(rho > 0, _dot(s, y) / np.where(yy > 0, yy, 1), 1.0)[:, None]
    for (s, y, rho), a in zip(pairs, reversed(kept), strict=True):
        q = q + (a - rho * _dot(y, q))[:, None] * s
    return q


def minimise(f: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, iterations: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """The rows of `start`, each moved to a minimum of its own function.

    f takes all rows at once and gives each row's value and gradient, so that one
    pass over the data serves all functions. It ends when no gradient has an entry
    over the tolerance, or no row gets on any more.
    """
    at = start.astype("f8")
    value, gradient = f(at)
    pairs: deque = deque(maxlen=MEMORY)
    for _ in range(iterations):
        live = np.abs(gradient).max(1) > tolerance
        if not live.any():
            break
        way = _direction(gradient, pairs)
        slope = _dot(way, gradient)
        steepest = slope >= 0
        way[steepest], slope[steepest] = -gradient[steepest], -_dot(gradient, gradient)[steepest]
        step = np.where(live, 1.0, 0.0) if pairs else np.where(live, 1 / np.maximum(1.0, np.sqrt(_dot(gradient, gradient))), 0.0)
        for _ in range(HALVINGS):
            there = at + step[:, None] * way
            new, slopes = f(there)
            short = (new > value + ARMIJO * step * slope) & (step > 0)
            if not short.any():
                break
            step = np.where(short, step / 2, step)
        else:
            there, new, slopes = np.where(short[:, None], at, there), np.where(short, value, new), np.where(short[:, None], gradient, slopes)
        s, y = there - at, slopes - gradient
        sy = _dot(s, y)
        rho = np.where(sy > 1e-12 * _dot(y, y), 1 / np.where(sy > 0, sy, 1), 0.0)
        at, value, gradient = there, new, slopes
        if not (np.abs(s).max(1) > 0).any():
            break
        pairs.append((s, y, rho))
    return at

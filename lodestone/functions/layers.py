"""Numeric primitives of a sequence encoder in numpy, for use inside an encoder's Arrow batches; weights are the caller's.

Arrays end in (steps, channels) or, with heads, (heads, steps, channels); what stands before is carried along.
"""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[np.float64])


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


def silu(x: np.ndarray) -> np.ndarray:
    return x * sigmoid(x)


def gelu(x: np.ndarray) -> np.ndarray:
    """The exact form, by the error function."""
    return x * (1 + _erf(x / math.sqrt(2))) / 2


def elu_plus_one(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x + 1, np.exp(np.minimum(x, 0)))


def sum_norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def l2_norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def rms_norm(x: np.ndarray, weight: np.ndarray | float = 1.0, gate: np.ndarray | None = None, eps: float = 1e-5) -> np.ndarray:
    """Over the root mean square, scaled by ``weight`` and, if given, by the sigmoid of ``gate``."""
    out = x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * weight
    return out if gate is None else out * sigmoid(gate)


def layer_norm(x: np.ndarray, weight: np.ndarray | float = 1.0, bias: np.ndarray | float = 0.0, eps: float = 1e-12) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * weight + bias


def short_convolution(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | float = 0.0, activate: bool = True) -> np.ndarray:
    """Each channel by its own kernel, ``weight`` (channels, width): a step sees width // 2 steps before it, itself, and those after it up to the width."""
    steps, width = x.shape[-2], weight.shape[-1]
    room = [(0, 0)] * (x.ndim - 2) + [(width // 2, width)] + [(0, 0)]
    wide = np.pad(x, room)
    out = sum(wide[..., j : j + steps, :] * weight[:, j] for j in range(width)) + bias
    return silu(out) if activate else out


def delta_rule(q: np.ndarray, k: np.ndarray, v: np.ndarray, beta: np.ndarray, fast_gate: np.ndarray, slow_gate: np.ndarray, fast: float = 0.1) -> np.ndarray:
    """Two readings of a memory written by the delta rule, for (.., steps, channels) and (.., steps) of ``beta`` and gates.

    The fast reading attends to the values as they are, the slow one to values from which what earlier like keys hold is
    taken off, to the second order of that correction. A step sees itself and earlier ones only.
    """
    q, k = l2_norm(q), l2_norm(k)
    v, weighed = v * beta[..., None], k * beta[..., None]
    earlier = -np.tril(weighed @ np.swapaxes(k, -1, -2), -1)
    corrected = (np.eye(k.shape[-2]) + earlier + np.tril(earlier @ np.swapaxes(earlier, -1, -2), -1)) @ v
    seen = np.tril(q @ np.swapaxes(k, -1, -2))
    return fast * fast_gate[..., None] * (seen @ v) + (1 - fast) * slow_gate[..., None] * (seen @ corrected)

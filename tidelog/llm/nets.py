"""Recurrent layer with gates, both directions at once, forward and backward in numpy.

Inputs are indices into a table of input projections, one row for each symbol (a byte, or a
distinct word of the batch); symbol 0 is padding and leaves the state as it is.
"""

from __future__ import annotations

import numpy as np

#: Pre-activation of the update gate for padding: the state is kept.
KEEP = np.float32(12.0)


def gru_forward(table: np.ndarray, u: np.ndarray, idx: np.ndarray, keep: bool = False):
    """table (2, S, 3H), u (2, H, 3H), idx (N, T); direction 1 runs from the end.

    Returns states (2, T, N, H), both in text order, and with keep=True what backward needs.
    """
    n, t = idx.shape
    h3 = table.shape[2]
    h = h3 // 3
    state = np.zeros((2, n, h), np.float32)
    out = np.empty((2, t, n, h), np.float32)
    cols = np.ascontiguousarray(idx.T)
    a = np.empty((2, n, h3), np.float32)
    saved = []
    for k in range(t):
        np.take(table[0], cols[k], axis=0, out=a[0], mode="clip")
        np.take(table[1], cols[t - 1 - k], axis=0, out=a[1], mode="clip")
        g = np.matmul(state, u)
        gates = a[:, :, : 2 * h] + g[:, :, : 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :, :h], gates[:, :, h:]
        cand = r * g[:, :, 2 * h :]
        cand += a[:, :, 2 * h :]
        np.tanh(cand, out=cand)
        before = state
        state = state - cand
        state *= z
        state += cand
        out[0, k], out[1, t - 1 - k] = state[0], state[1]
        if keep:
            saved.append((before, z, r, cand, g[:, :, 2 * h :]))
    return (out, saved) if keep else out


def gru_backward(table: np.ndarray, u: np.ndarray, idx: np.ndarray, saved: list, dout: np.ndarray):
    """Gradients of table and u by backpropagation through time."""
    n, t = idx.shape
    h = u.shape[1]
    du = np.zeros_like(u)
    da = np.empty((2, t, n, 3 * h), np.float32)
    dstate = np.zeros((2, n, h), np.float32)
    for k in range(t - 1, -1, -1):
        before, z, r, cand, gn = saved[k]
        dstate = dstate + np.stack([dout[0, k], dout[1, t - 1 - k]])
        dcand = dstate * (1 - z) * (1 - cand * cand)
        dz = dstate * (before - cand) * z * (1 - z)
        dr = dcand * gn * r * (1 - r)
        dg = np.concatenate([dz, dr, dcand * r], 2)
        da[0, k] = np.concatenate([dz[0], dr[0], dcand[0]], 1)
        da[1, t - 1 - k] = np.concatenate([dz[1], dr[1], dcand[1]], 1)
        du += np.matmul(before.transpose(0, 2, 1), dg)
        dstate = dstate * z + np.matmul(dg, u.transpose(0, 2, 1))
    flat = np.ascontiguousarray(idx.T).ravel()
    dtable = np.stack([scatter_sum(flat, da[d].reshape(t * n, 3 * h), table.shape[1]) for d in (0, 1)])
    dtable[:, 0] = 0
    return dtable, du


def scatter_sum(idx: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of rows by index."""
    order = np.argsort(idx, kind="stable")
    at = idx[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    out = np.zeros((size, rows.shape[1]), np.float32)
    if len(at):
        out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Adam:
    """Adam over a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.params[k] -= (self.rate * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)

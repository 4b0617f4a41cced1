"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam, and batched decoding.

Parameters are a dict of float32 arrays: `embed` (characters x D), `wx` (2 x D x 4H), `wh` (2 x H x 4H),
`b` (2 x 4H), `out` (2H x labels), `bias`, `trans` (labels x labels), `first`, `last`. Both directions are
computed in one pass, stacked along the first axis; the second reads the window backwards.
"""

from __future__ import annotations

import numpy as np

BARRED = -1e4


def init(chars: int, labels: int, width: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    bias = np.zeros((2, 4 * hidden), np.float32)
    bias[:, hidden : 2 * hidden] = 1  # the forget gate starts open
    return {
        "embed": draw(chars, width) * np.float32(np.sqrt(chars)) * np.float32(0.5), "wx": draw(2, width, 4 * hidden), "wh": draw(2, hidden, 4 * hidden), "b": bias,
        "out": draw(2 * hidden, labels), "bias": np.zeros(labels, np.float32), "trans": np.zeros((labels, labels), np.float32), "first": np.zeros(labels, np.float32), "last": np.zeros(labels, np.float32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def run_lstm(model: dict, ids: np.ndarray, keep: bool = False):
    """Hidden states (time, batch, 2H) of windows (batch, time); with keep also what the gradient needs."""
    n, steps = ids.shape
    hidden = model["wh"].shape[1]
    x = np.stack([ids.T, ids.T[::-1]])  # direction, time, batch
    table = np.einsum("cd,kdg->kcg", model["embed"], model["wx"]) + model["b"][:, None]  # what each character adds to the gates
    h, c = np.zeros((2, n, hidden), table.dtype), np.zeros((2, n, hidden), table.dtype)
    states = np.empty((steps, 2, n, hidden), table.dtype)
    kept = []
    both = np.arange(2)[:, None]
    for t in range(steps):
        gates = table[both, x[:, t]] + h @ model["wh"]
        act = sigmoid(gates[..., : 3 * hidden])
        i, f, o = act[..., :hidden], act[..., hidden : 2 * hidden], act[..., 2 * hidden :]
        g = np.tanh(gates[..., 3 * hidden :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((i, f, o, g, before, tc, h))
        h = o * tc
        states[t] = h
    joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    return (joined, (x, kept)) if keep else joined


def emissions(model: dict, ids: np.ndarray) -> np.ndarray:
    """(time, batch, labels)"""
    return run_lstm(model, ids) @ model["out"] + model["bias"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradient(model: dict, ids: np.ndarray, labels: np.ndarray, barred: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean negative log likelihood of the labels (batch, time), its gradient); barred: transitions that cannot be."""
    n, steps = ids.shape
    hidden = model["wh"].shape[1]
    states, (x, kept) = run_lstm(model, ids, keep=True)
    e = states @ model["out"] + model["bias"]
    trans = np.where(barred, np.float32(BARRED), model["trans"])
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0] = e[0] + model["first"]
    for t in range(1, steps):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    beta[-1] = model["last"]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _logsum(alpha[-1] + model["last"], 1)
    y, rows = labels.T, np.arange(n)
    score = model["first"][y[0]] + model["last"][y[-1]] + e[np.arange(steps)[:, None], rows, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
    d_e = np.exp(alpha + beta - log_z[None, :, None])
    grad = {"first": d_e[0].sum(0), "last": d_e[-1].sum(0)}
    pair = np.zeros_like(trans)
    for t in range(1, steps):
        pair += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t] - log_z[:, None])[:, None, :]).sum(0)
    np.subtract.at(pair, (y[:-1], y[1:]), 1)
    np.subtract.at(grad["first"], y[0], 1)
    np.subtract.at(grad["last"], y[-1], 1)
    d_e[np.arange(steps)[:, None], rows, y] -= 1
    grad["trans"] = np.where(barred, 0, pair)
    grad["out"] = np.einsum("tbh,tbl->hl", states, d_e)
    grad["bias"] = d_e.sum((0, 1))
    d_states = d_e @ model["out"].T
    d_h_out = np.stack([d_states[..., :hidden], d_states[::-1, :, hidden:]], axis=1)  # time, direction, batch, H
    d_gates = np.empty((steps, 2, n, 4 * hidden), e.dtype)
    d_wh = np.zeros_like(model["wh"])
    d_h, d_c = np.zeros((2, n, hidden), e.dtype), np.zeros((2, n, hidden), e.dtype)
    back = model["wh"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h_before = kept[t]
        d_h = d_h + d_h_out[t]
        d_c = d_c + d_h * o * (1 - tc * tc)
        dg = d_gates[t]
        dg[..., :hidden] = d_c * g * i * (1 - i)
        dg[..., hidden : 2 * hidden] = d_c * before * f * (1 - f)
        dg[..., 2 * hidden : 3 * hidden] = d_h * tc * o * (1 - o)
        dg[..., 3 * hidden :] = d_c * i * (1 - g * g)
        d_wh += h_before.transpose(0, 2, 1) @ dg
        d_h = dg @ back
        d_c = d_c * f
    grad["wh"], grad["b"] = d_wh, d_gates.sum((0, 2))
    seen = (x.reshape(2, -1, 1) == np.arange(len(model["embed"]))).astype(e.dtype)
    table = seen.transpose(0, 2, 1) @ d_gates.transpose(1, 0, 2, 3).reshape(2, -1, 4 * hidden)
    grad["wx"] = np.einsum("cd,kcg->kdg", model["embed"], table)
    grad["embed"] = np.einsum("kcg,kdg->cd", table, model["wx"])
    return float((log_z - score).mean()), {k: (v / n).astype(model[k].dtype) for k, v in grad.items()}


def train(model: dict, batches, barred: np.ndarray, rate: float = 0.02, clip: float = 5.0) -> dict[str, np.ndarray]:
    """Adam over an iterable of (ids, labels) batches; the rate falls to a tenth over the last half."""
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    batches = list(batches)
    for t, (ids, labels) in enumerate(batches, 1):
        _, grad = gradient(model, ids, labels, barred)
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        step = rate * min(1.0, 2.1 - 2 * t / len(batches))
        for k, g in grad.items():
            g = g * np.float32(scale)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            move = step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
            model[k] = (model[k] - move).astype(np.float32)
    return model


def viterbi(model: dict, e: np.ndarray, barred: np.ndarray) -> np.ndarray:
    """The best labels (batch, time) of emissions (time, batch, labels)."""
    steps, n, _ = e.shape
    trans = np.where(barred, np.float32(BARRED), model["trans"])
    best, came = e[0] + model["first"], np.zeros(e.shape, np.int8)
    for t in range(1, steps):
        paths = best[:, :, None] + trans
        came[t] = paths.argmax(1)
        best = paths.max(1) + e[t]
    labels = np.zeros((n, steps), np.int8)
    labels[:, -1] = (best + model["last"]).argmax(1)
    for t in range(steps - 1, 0, -1):
        labels[:, t - 1] = came[t][np.arange(n), labels[:, t]]
    return labels

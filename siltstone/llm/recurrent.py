"""Recurrent layers with their gradients, in numpy.

Arrays are (steps, lanes, features); ``live`` (steps, lanes) marks the steps a lane has. A dead step passes the state on.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-x))


def tanh(x: np.ndarray) -> np.ndarray:
    return 2.0 * sigmoid(2.0 * x) - 1.0


def weights(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)


class Adam:
    """Adam steps on named arrays, gradients clipped at norm ``clip``."""

    def __init__(self, params: Params, rate: float, clip: float = 5.0):
        self.params, self.rate, self.clip, self.step = params, rate, clip, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: Params) -> None:
        self.step += 1
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        scale = min(1.0, self.clip / (norm + 1e-9))
        for name, grad in grads.items():
            grad = grad * scale
            self.first[name] += 0.1 * (grad - self.first[name])
            self.second[name] += 0.01 * (grad * grad - self.second[name])
            first = self.first[name] / (1.0 - 0.9**self.step)
            second = self.second[name] / (1.0 - 0.99**self.step)
            self.params[name] -= self.rate * first / (np.sqrt(second) + 1e-7)


# Gated recurrent unit: gates z (keep), r (reset) and candidate n, side by side in ``W``, ``U``, ``b``.


def gru_params(rng: np.random.Generator, name: str, inputs: int, hidden: int) -> Params:
    return {
        f"{name}.W": weights(rng, inputs, 3 * hidden),
        f"{name}.U": weights(rng, hidden, 3 * hidden),
        f"{name}.b": np.zeros(3 * hidden, np.float32),
    }


def gru_states(gates: np.ndarray, recurrent: np.ndarray, live: np.ndarray, rows: np.ndarray | None = None):
    """States of all steps from the inputs' share of the gates, which ``rows`` (steps, lanes) may look up.

    Also returns what the gradient needs, unless inputs are looked up.
    """
    steps, lanes = live.shape
    hidden = recurrent.shape[0]
    h = np.zeros((lanes, hidden), np.float32)
    states = np.empty((steps, lanes, hidden), np.float32)
    kept = []
    for t in range(steps):
        x = gates[t] if rows is None else gates[rows[t]]
        u = h @ recurrent
        zr = sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = tanh(x[:, 2 * hidden :] + r * u[:, 2 * hidden :])
        new = n + z * (h - n)
        new = np.where(live[t][:, None], new, h)
        if rows is None:
            kept.append((h, z, r, n, u[:, 2 * hidden :]))
        states[t] = h = new
    return states, kept


def gru_gradient(grad_states: np.ndarray, kept: list, recurrent: np.ndarray, live: np.ndarray):
    """Gradients of the gates' input share, and of the recurrent weights."""
    steps, lanes, hidden = grad_states.shape
    grad_gates = np.zeros((steps, lanes, 3 * hidden), np.float32)
    grad_recurrent = np.zeros_like(recurrent)
    carried = np.zeros((lanes, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, un = kept[t]
        total = grad_states[t] + carried
        on = live[t][:, None]
        d = np.where(on, total, 0.0)
        dn = d * (1.0 - z) * (1.0 - n * n)
        dz = d * (h - n) * z * (1.0 - z)
        dr = dn * un * r * (1.0 - r)
        grad_gates[t] = np.concatenate([dz, dr, dn], axis=1)
        du = np.concatenate([dz, dr, dn * r], axis=1)
        grad_recurrent += h.T @ du
        carried = np.where(on, d * z, total) + du @ recurrent.T
    return grad_gates, grad_recurrent


# Long short-term memory: gates i, f, o and candidate g, side by side.


def lstm_params(rng: np.random.Generator, name: str, inputs: int, hidden: int) -> Params:
    bias = np.zeros(4 * hidden, np.float32)
    bias[hidden : 2 * hidden] = 1.0
    return {
        f"{name}.W": weights(rng, inputs, 4 * hidden),
        f"{name}.U": weights(rng, hidden, 4 * hidden),
        f"{name}.b": bias,
    }


def lstm_states(gates: np.ndarray, recurrent: np.ndarray, live: np.ndarray, rows: np.ndarray | None = None):
    steps, lanes = live.shape
    hidden = recurrent.shape[0]
    h = np.zeros((lanes, hidden), np.float32)
    c = np.zeros((lanes, hidden), np.float32)
    states = np.empty((steps, lanes, hidden), np.float32)
    kept = []
    for t in range(steps):
        x = (gates[t] if rows is None else gates[rows[t]]) + h @ recurrent
        gate = sigmoid(x[:, : 3 * hidden])
        i, f, o = gate[:, :hidden], gate[:, hidden : 2 * hidden], gate[:, 2 * hidden :]
        g = tanh(x[:, 3 * hidden :])
        new_c = f * c + i * g
        squashed = tanh(new_c)
        if rows is None:
            kept.append((h, c, i, f, o, g, squashed))
        on = live[t][:, None]
        h, c = np.where(on, o * squashed, h), np.where(on, new_c, c)
        states[t] = h
    return states, kept


def lstm_gradient(grad_states: np.ndarray, kept: list, recurrent: np.ndarray, live: np.ndarray):
    steps, lanes, hidden = grad_states.shape
    grad_gates = np.zeros((steps, lanes, 4 * hidden), np.float32)
    grad_recurrent = np.zeros_like(recurrent)
    dh_next = np.zeros((lanes, hidden), np.float32)
    dc_next = np.zeros((lanes, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, squashed = kept[t]
        total = grad_states[t] + dh_next
        on = live[t][:, None]
        dh = np.where(on, total, 0.0)
        dc = np.where(on, dc_next, 0.0) + dh * o * (1.0 - squashed * squashed)
        dx = np.concatenate(
            [dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1
        )
        grad_gates[t] = dx
        grad_recurrent += h.T @ dx
        dh_next = np.where(on, 0.0, total) + dx @ recurrent.T
        dc_next = np.where(on, dc * f, dc_next)
    return grad_gates, grad_recurrent


def both_ways(params: Params, name: str, inputs: np.ndarray, live: np.ndarray, states):
    """Forward and backward states side by side, and what their gradient needs."""
    outputs, kept = [], []
    for way, turn in (("f", slice(None)), ("b", slice(None, None, -1))):
        gates = inputs[turn] @ params[f"{name}.{way}.W"] + params[f"{name}.{way}.b"]
        run, own = states(gates, params[f"{name}.{way}.U"], live[turn])
        outputs.append(run[turn])
        kept.append(own)
    return np.concatenate(outputs, axis=2), kept


def both_ways_gradient(params: Params, name: str, inputs: np.ndarray, live: np.ndarray, grad, kept, gradient) -> tuple:
    """Gradients of parameters and of the inputs."""
    hidden = grad.shape[2] // 2
    grads: Params = {}
    grad_inputs = np.zeros_like(inputs)
    for at, (way, turn) in enumerate((("f", slice(None)), ("b", slice(None, None, -1)))):
        part = grad[turn, :, at * hidden : (at + 1) * hidden]
        gates, recurrent = gradient(part, kept[at], params[f"{name}.{way}.U"], live[turn])
        flat = gates.reshape(-1, gates.shape[2])
        grads[f"{name}.{way}.W"] = inputs[turn].reshape(-1, inputs.shape[2]).T @ flat
        grads[f"{name}.{way}.U"] = recurrent
        grads[f"{name}.{way}.b"] = flat.sum(axis=0)
        grad_inputs += (gates @ params[f"{name}.{way}.W"].T)[turn]
    return grads, grad_inputs


def looked_up_states(params: Params, name: str, table: np.ndarray, rows: np.ndarray, live: np.ndarray, states):
    """States both ways where inputs are rows of ``table``: its share of the gates is computed once per row."""
    outputs = []
    for way, turn in (("f", slice(None)), ("b", slice(None, None, -1))):
        gates = table @ params[f"{name}.{way}.W"] + params[f"{name}.{way}.b"]
        outputs.append(states(gates, params[f"{name}.{way}.U"], live[turn], rows[turn])[0][turn])
    return np.concatenate(outputs, axis=2)


# Attention pooling: a softmax over the steps of v . tanh(h A + a) weighs the states.


def attention_params(rng: np.random.Generator, name: str, inputs: int, hidden: int) -> Params:
    return {
        f"{name}.A": weights(rng, inputs, hidden),
        f"{name}.a": np.zeros(hidden, np.float32),
        f"{name}.v": weights(rng, hidden),
    }


def attend(params: Params, name: str, states: np.ndarray, live: np.ndarray):
    hidden = tanh(states @ params[f"{name}.A"] + params[f"{name}.a"])
    scores = np.where(live, hidden @ params[f"{name}.v"], -1e9)
    share = np.exp(scores - scores.max(axis=0))
    share = np.where(live, share, 0.0)
    share = (share / np.maximum(share.sum(axis=0), 1e-9)).astype(np.float32)
    return (share[:, :, None] * states).sum(axis=0), (hidden, share)


def attend_gradient(params: Params, name: str, states: np.ndarray, kept: tuple, grad: np.ndarray):
    hidden, share = kept
    pooled = (share[:, :, None] * states).sum(axis=0)
    d_score = share * ((states - pooled) * grad).sum(axis=2)
    d_hidden = d_score[:, :, None] * params[f"{name}.v"] * (1.0 - hidden * hidden)
    flat, flat_states = d_hidden.reshape(-1, d_hidden.shape[2]), states.reshape(-1, states.shape[2])
    grads = {
        f"{name}.A": flat_states.T @ flat,
        f"{name}.a": flat.sum(axis=0),
        f"{name}.v": (d_score[:, :, None] * hidden).sum(axis=(0, 1)),
    }
    return grads, share[:, :, None] * grad + d_hidden @ params[f"{name}.A"].T

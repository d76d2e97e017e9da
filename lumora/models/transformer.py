"""A causal transformer over left-padded sequences in numpy, with its gradients.

Blocks normalise before they attend and before their GELU layer, and add what each gives to their input; a last norm closes them.
Weights are a dict: E (a row for each item, row 0 for padding), P (positions, aligned right), V (verticals), and those of `shapes`.
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]
WIDER = 4  # the inner layer's width in d


def shapes(d: int, blocks: int) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the blocks' weights: norms have a gain and a bias, the inner layer biases."""
    found: dict[str, tuple[int, ...]] = {"gain": (d,), "bias": (d,)}
    for b in range(blocks):
        found |= {f"{w}{b}": (d, d) for w in ("query", "key", "value", "out")}
        found |= {f"{w}{b}": (d,) for w in ("gain_attend", "bias_attend", "gain_inner", "bias_inner", "down_bias")}
        found |= {f"up{b}": (d, WIDER * d), f"up_bias{b}": (WIDER * d,), f"down{b}": (WIDER * d, d)}
    return found


def initial(d: int, blocks: int, rng: np.random.Generator) -> Weights:
    """Gains 1, biases 0, matrices with the deviation that keeps variances."""
    found = {}
    for name, shape in shapes(d, blocks).items():
        found[name] = rng.normal(0, np.sqrt(2 / sum(shape)), shape) if len(shape) > 1 else np.full(shape, float(name.startswith("gain")))
    return found


def _normed(x: np.ndarray, gain: np.ndarray, bias: np.ndarray):
    """(layer norm of x, what its gradient needs)."""
    z = x - x.mean(axis=-1, keepdims=True)
    scale = 1 / np.sqrt((z * z).mean(axis=-1, keepdims=True) + 1e-5)
    z *= scale
    return z * gain + bias, (z, scale)


def _through_norm(dy: np.ndarray, gain: np.ndarray, kept):
    """(gradient of x, of the gain, of the bias)."""
    z, scale = kept
    dz = dy * gain
    dx = scale * (dz - dz.mean(axis=-1, keepdims=True) - z * (dz * z).mean(axis=-1, keepdims=True))
    axes = tuple(range(dy.ndim - 1))
    return dx, (dy * z).sum(axis=axes), dy.sum(axis=axes)


def _gelu(u: np.ndarray):
    """(GELU by tanh, its slope)."""
    c, square = float(np.sqrt(2 / np.pi)), u * u
    t = np.tanh(c * u * (1 + 0.044715 * square))
    half = 0.5 + 0.5 * t
    return u * half, half + 0.5 * c * u * (1 - t * t) * (1 + 3 * 0.044715 * square)


def _outer(x: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Gradient of w for y = x @ w over all positions."""
    return x.reshape(-1, x.shape[-1]).T @ dy.reshape(-1, dy.shape[-1])


def encode(p: Weights, items: np.ndarray, kinds: np.ndarray, heads: int, dropout: float = 0.0, rng: np.random.Generator | None = None):
    """(representations [n, length, d], what their gradients need) of histories [n, length]; item 0 is padding.

    A position attends to itself and the ones before it that aren't padding, by head; what padding holds itself is of no meaning.
    With rng, units are dropped as in training.
    """

    def kept(shape: tuple[int, ...]):
        if rng is None or not dropout:
            return None
        return (rng.random(shape, dtype=np.float32) >= dropout).astype(p["E"].dtype) / (1 - dropout)

    def drop(x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        return x if mask is None else x * mask

    (n, length), d = items.shape, p["E"].shape[1]
    split = lambda x: x.reshape(n, length, heads, -1).transpose(0, 2, 1, 3)
    joined = lambda x: x.transpose(0, 2, 1, 3).reshape(n, length, d)
    at = np.arange(length)
    seen = ((at[:, None] > at) & (items > 0)[:, None, :]) | (at[:, None] == at)
    x = p["E"][items] * np.sqrt(d).astype(p["E"].dtype) + p["P"][len(p["P"]) - length :] + p["V"][kinds]
    first = kept(x.shape)
    x, tape = drop(x, first), []
    for b in range(sum(name.startswith("query") for name in p)):
        y, norm = _normed(x, p[f"gain_attend{b}"], p[f"bias_attend{b}"])
        q, k, v = (split(y @ p[f"{w}{b}"]) for w in ("query", "key", "value"))
        a = q @ k.swapaxes(2, 3) / np.sqrt(d // heads).astype(x.dtype)
        a = np.where(seen[:, None], a, -np.inf)
        a = np.exp(a - a.max(axis=3, keepdims=True))
        a /= a.sum(axis=3, keepdims=True)
        of_a, of_o = kept(a.shape), kept(x.shape)
        o = joined(drop(a, of_a) @ v)
        x = x + drop(o @ p[f"out{b}"], of_o)
        z, inner_norm = _normed(x, p[f"gain_inner{b}"], p[f"bias_inner{b}"])
        u, slope = _gelu(z @ p[f"up{b}"] + p[f"up_bias{b}"])
        of_u, of_w = kept(u.shape), kept(x.shape)
        u = drop(u, of_u)
        x = x + drop(u @ p[f"down{b}"] + p[f"down_bias{b}"], of_w)
        if rng is not None:
            tape.append((y, norm, q, k, v, a, of_a, o, of_o, z, inner_norm, slope, u, of_u, of_w))
    h, last = _normed(x, p["gain"], p["bias"])
    return h, (first, tape, last)


def _summed(shape: tuple[int, ...], at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of values added up by their place."""
    at, values, total = at.ravel(), values.reshape(at.size, -1), np.zeros(shape, values.dtype)
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    total[at[starts]] = np.add.reduceat(values[order], starts)
    return total


def gradients(p: Weights, items: np.ndarray, kinds: np.ndarray, right: np.ndarray, wrong: np.ndarray, heads: int, dropout: float, rng: np.random.Generator):
    """(mean loss, gradients) of the log-sigmoid scores of each position's next item (right, 0 where there is none) and of one that isn't."""
    h, (first, tape, last) = encode(p, items, kinds, heads, dropout, rng)
    (n, length), d = items.shape, h.shape[2]
    split = lambda x: x.reshape(n, length, heads, -1).transpose(0, 2, 1, 3)
    joined = lambda x: x.transpose(0, 2, 1, 3).reshape(n, length, d)
    through = lambda dx, mask: dx if mask is None else dx * mask
    asked = (right > 0) / np.maximum((right > 0).sum(), 1).astype(h.dtype)
    to_right, to_wrong = p["E"][right], p["E"][wrong]
    good, bad = (h * to_right).sum(axis=2), (h * to_wrong).sum(axis=2)
    loss = ((np.logaddexp(0, -good) + np.logaddexp(0, bad)) * asked).sum()
    dgood, dbad = (-asked / (1 + np.exp(np.minimum(good, 80))))[..., None], (asked / (1 + np.exp(np.minimum(-bad, 80))))[..., None]
    g = {}
    dx, g["gain"], g["bias"] = _through_norm(dgood * to_right + dbad * to_wrong, p["gain"], last)
    for b in reversed(range(len(tape))):
        y, norm, q, k, v, a, of_a, o, of_o, z, inner_norm, slope, u, of_u, of_w = tape[b]
        dw = through(dx, of_w)
        g[f"down{b}"], g[f"down_bias{b}"] = _outer(u, dw), dw.sum(axis=(0, 1))
        du = through(dw @ p[f"down{b}"].T, of_u) * slope
        g[f"up{b}"], g[f"up_bias{b}"] = _outer(z, du), du.sum(axis=(0, 1))
        dz, g[f"gain_inner{b}"], g[f"bias_inner{b}"] = _through_norm(du @ p[f"up{b}"].T, p[f"gain_inner{b}"], inner_norm)
        dx = dx + dz
        do = through(dx, of_o)
        g[f"out{b}"] = _outer(o, do)
        do = split(do @ p[f"out{b}"].T)
        da, dv = through(do @ v.swapaxes(2, 3), of_a), through(a, of_a).swapaxes(2, 3) @ do
        ds = a * (da - (a * da).sum(axis=3, keepdims=True)) / np.sqrt(d // heads).astype(h.dtype)
        parts = {"query": joined(ds @ k), "key": joined(ds.swapaxes(2, 3) @ q), "value": joined(dv)}
        g |= {f"{w}{b}": _outer(y, part) for w, part in parts.items()}
        dy, g[f"gain_attend{b}"], g[f"bias_attend{b}"] = _through_norm(sum(part @ p[f"{w}{b}"].T for w, part in parts.items()), p[f"gain_attend{b}"], norm)
        dx = dx + dy
    dx = through(dx, first)
    g["E"] = _summed(p["E"].shape, np.stack([items, right, wrong]), np.stack([dx * np.sqrt(d).astype(h.dtype), dgood * h, dbad * h]))
    g["E"][0] = 0
    g["P"], g["V"] = np.zeros_like(p["P"]), _summed(p["V"].shape, kinds, dx)
    g["P"][len(p["P"]) - length :] = dx.sum(axis=0)
    return loss, g


class AdamW:
    """Adam with decoupled weight decay; gradients are scaled to a norm of `most` at most."""

    def __init__(self, lr: float, decay: float, most: float = 5.0):
        self.lr, self.decay, self.most, self.n, self.m, self.s = lr, decay, most, 0, {}, {}

    def step(self, p: Weights, g: Weights) -> None:
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale, self.n = float(min(1.0, self.most / (norm + 1e-6))), self.n + 1
        for k, x in g.items():
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * scale * x
            self.s[k] = 0.98 * self.s.get(k, 0.0) + 0.02 * scale * scale * x * x
            p[k] -= self.lr * (self.m[k] / (1 - 0.9**self.n) / (np.sqrt(self.s[k] / (1 - 0.98**self.n)) + 1e-8) + self.decay * p[k])

"""A gated recurrent language model in numpy with a class-factored output.

P(token | before) = P(class | h) * P(word | class, h). Classes are bins of WIDTH head words by frequency, then the tail classes and the
end of the text, which have no words of their own here (what follows inside a tail class is up to the caller).
Training is truncated backpropagation through windows of a number of parallel streams of texts, with Adam; scoring carries the state
from window to window, so a text's log-likelihood is that of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 64
SHORT = 6  # rows in a run that is short to _sums
SCORED = 4608  # tokens of a window in scoring, about: what is made of them stays near the core
SAFE = 60.0  # exp of this and its inverse are far from the bounds of single precision


def _exp_sums(x: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows of x, in place, each less its highest value unless bound, which no |x| exceeds, is SAFE; (their sums, the logs of
    the sums of what they were)."""
    high = 0 if bound <= SAFE else x.max(axis=1)
    if bound > SAFE:
        x -= high[:, None]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return total, np.log(total) + high


def _with_one(x: np.ndarray) -> np.ndarray:
    """x with a last column of ones, so that a product with weights over their bias is a whole layer."""
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1], out[:, -1] = x, 1
    return out


def _sums(x: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sums of rows order[begin[i]:begin[i + 1]] of x [k, rows, n], for each i; short runs, which most are, of one length at once."""
    sizes = np.diff(begin, append=len(order))
    out = np.empty((len(x), len(begin), x.shape[2]), x.dtype)
    for size in range(1, SHORT + 1):
        at = np.flatnonzero(sizes == size)
        total = x.take(order[begin[at]], axis=1)
        for j in range(1, size):
            total += x.take(order[begin[at] + j], axis=1)
        out[:, at] = total
    at = np.flatnonzero(sizes > SHORT)
    if len(at):
        rows = order[np.repeat(sizes > SHORT, sizes)]
        out[:, at] = np.add.reduceat(x.take(rows, axis=1), np.cumsum(sizes[at]) - sizes[at], axis=1)
    return out


@dataclass
class Streams:
    """Token columns of parallel streams, [steps, streams]: the token before, whether a text begins, the token, its text (-1: none)."""

    before: np.ndarray
    begins: np.ndarray
    token: np.ndarray
    text: np.ndarray


def streams(ids: np.ndarray, bounds: np.ndarray, width: int, end: int, follows: np.ndarray | None = None) -> Streams:
    """Texts ids[bounds[i]:bounds[i + 1]], none empty, laid one after another on `width` streams, the longest first. Where follows[i],
    text i goes on from i - 1: the token before its first is that one's last, but the state starts anew."""
    lengths = np.diff(bounds)
    width = max(1, min(width, len(lengths)))
    rows, load = [[] for _ in range(width)], np.zeros(width, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        k = int(load.argmin())
        rows[k].append(i)
        load[k] += lengths[i]
    steps = int(load.max()) if len(lengths) else 0
    out = Streams(*(np.full((steps, width), x, k) for x, k in ((end, np.int32), (True, bool), (end, np.int32), (-1, np.int32))))
    for k, texts in enumerate(rows):
        at = 0
        for i in texts:
            n, part = lengths[i], ids[bounds[i] : bounds[i + 1]]
            out.token[at : at + n, k], out.text[at : at + n, k] = part, i
            out.before[at + 1 : at + n, k], out.begins[at + 1 : at + n, k] = part[:-1], False
            if follows is not None and follows[i]:
                out.before[at, k] = ids[bounds[i] - 1]
            at += n
    return out


class Gru:
    """Tokens are 0 to n_head - 1 (head words), then n_tail tail classes, then the end."""

    def __init__(self, n_head: int, n_tail: int, size: int = 24, embedding: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.n_head, self.bins = n_head, -(-n_head // WIDTH)
        self.end = n_head + n_tail
        self.size, classes = size, self.bins + n_tail + 1
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {
            "E": draw(self.end + 1, embedding), "W": draw(embedding, 3 * size), "b": np.zeros(3 * size, np.float32), "U": draw(size, 3 * size),
            "C": draw(size, classes) * np.float32(0.1), "c": np.zeros(classes, np.float32), "O": draw(max(1, self.bins), size, WIDTH) * np.float32(0.1), "o": np.zeros((max(1, self.bins), WIDTH), np.float32),
        }
        self.p["o"].reshape(-1)[n_head:] = -1e9

    def start_at(self, head: np.ndarray, tail: np.ndarray, end: int) -> None:
        """Sets the biases to the log shares of the counts (plus one) of head words, tail classes and the end."""
        inside = np.zeros((len(self.p["o"]), WIDTH))
        inside.reshape(-1)[: len(head)] = head
        classes = np.concatenate([inside.sum(axis=1)[: self.bins], tail, [end]]) + 1
        self.p["c"] = np.log(classes / classes.sum()).astype(np.float32)
        self.p["o"] = np.log((inside + 1) / (inside + 1).sum(axis=1, keepdims=True)).astype(np.float32)
        self.p["o"].reshape(-1)[self.n_head :] = -1e9

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def set_flat(self, weights: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = weights[at : at + v.size].astype(np.float32).reshape(v.shape)
            at += v.size

    def class_of(self, token: np.ndarray) -> np.ndarray:
        return np.where(token < self.n_head, token // WIDTH, token - self.n_head + self.bins)

    def _by_gate(self, x: np.ndarray) -> np.ndarray:
        """Columns of r, z and the candidate as [3, rows, size]: each one's rows lie together, so that a step's work is in whole runs."""
        return np.ascontiguousarray(x.reshape(len(x), 3, self.size).transpose(1, 0, 2))

    def _prepare(self) -> None:
        """What the weights make of every token and state before the gates, and the output's weights over their biases."""
        p, n = self.p, self.size
        half = np.array([0.5, 0.5, 1], p["U"].dtype)[:, None, None]  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.table, self.recurrent = p["E"] @ (self._by_gate(p["W"]) * half) + self._by_gate(p["b"][None]) * half, self._by_gate(p["U"]) * half
        self.classes, self.inside = np.concatenate([p["C"], p["c"][None]]), np.concatenate([p["O"], p["o"][:, None]], axis=1)
        self.bounds = [float(np.abs(x).sum(axis=-2).max()) for x in (self.classes, self.inside)]

    def run(self, s: Streams, lo: int, hi: int, h: np.ndarray, keep: bool):
        """The states of steps lo to hi after state h, the last one, and what backward needs: previous states, their candidate parts,
        gates r and z, candidates, and 0 where a text begins."""
        n, steps, kind = self.size, hi - lo, h.dtype
        inputs, u, alive = self.table.take(s.before[lo:hi], axis=1), self.recurrent, (~s.begins[lo:hi, :, None]).astype(kind)
        begins, kept = s.begins[lo:hi].any(axis=1).tolist(), steps if keep else 1
        out = np.empty((steps, *h.shape), kind)
        before, new = (np.empty((kept, *h.shape), kind) for _ in range(2))
        g, gates = np.empty((kept, 3, *h.shape), kind), np.empty((kept, 2, *h.shape), kind)
        for t in range(steps):
            i = t if keep else 0
            if begins[t]:
                np.multiply(h, alive[t], out=before[i])
            else:
                before[i] = h
            np.matmul(before[i], u, out=g[i])
            np.add(inputs[:2, t], g[i, :2], out=gates[i])
            np.tanh(gates[i], out=gates[i])
            gates[i] *= 0.5
            gates[i] += 0.5
            np.multiply(gates[i, 0], g[i, 2], out=new[i])
            new[i] += inputs[2, t]
            np.tanh(new[i], out=new[i])
            h = out[t]
            np.subtract(before[i], new[i], out=h)
            h *= gates[i, 1]
            h += new[i]
        return out, h, (before, g[:, 2], gates[:, 0], gates[:, 1], new, alive)

    def _by_class(self, kind: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(the head words among the tokens in order of class, each class with its bounds among them)."""
        head = np.flatnonzero(token < self.n_head)
        order = head[np.argsort(kind[head].astype(np.uint16), kind="stable")]
        cuts = np.flatnonzero(np.diff(kind[order], prepend=-1, append=-1)) if len(order) else []
        return order, [(int(kind[order[a]]), int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _inside(self, x: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        """The logits of the words of their class at states x (with a one), in order of class."""
        out = np.empty((len(x), WIDTH), x.dtype)
        for k, a, b in classes:
            np.matmul(x[a:b], self.inside[k], out=out[a:b])
        return out

    def log_probs(self, states: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the tokens at states [n, size]."""
        kind, x = self.class_of(token), _with_one(states)
        reach = max(1.0, float(np.abs(states).max(initial=0)))
        logits = x @ self.classes
        out = logits.take(np.arange(len(token)) * logits.shape[1] + kind)
        out -= _exp_sums(logits, reach * self.bounds[0])[1]
        order, classes = self._by_class(kind, token)
        if classes:
            logits = self._inside(x.take(order, axis=0), classes)
            own = logits.take(np.arange(len(order)) * WIDTH + token[order] % WIDTH)
            out[order] += own - _exp_sums(logits, reach * self.bounds[1])[1]
        return out

    def loss_and_gradients(self, s: Streams, lo: int, hi: int, h: np.ndarray):
        """(nats, tokens, state after, gradients of the mean loss) of a window."""
        p, n = self.p, self.size
        self._prepare()
        states, last, (before, part, r, z, new, alive) = self.run(s, lo, hi, h, keep=True)
        flat, token = states.reshape(-1, n), s.token[lo:hi].reshape(-1)
        live = np.flatnonzero(s.text[lo:hi].reshape(-1) >= 0)
        x, token = _with_one(flat if len(live) == len(flat) else flat[live]), token[live]
        kind, scale, reach = self.class_of(token), np.float32(1.0 / max(1, len(live))), max(1.0, float(np.abs(flat).max(initial=0)))
        grads = {"E": np.zeros_like(p["E"])}
        d = x @ self.classes
        at = np.arange(len(live)) * d.shape[1] + kind
        own = d.take(at)
        total, logs = _exp_sums(d, reach * self.bounds[0])
        nats = float((logs - own).sum(dtype=np.float64))
        d *= (scale / total)[:, None]
        d.reshape(-1)[at] -= scale
        of_classes = x.T @ d
        grads["C"], grads["c"] = of_classes[:-1], of_classes[-1]
        dx = d @ p["C"].T
        order, classes = self._by_class(kind, token)
        of_words = np.zeros_like(self.inside)
        if classes:
            words, at = x.take(order, axis=0), np.arange(len(order)) * WIDTH + token[order] % WIDTH
            d = self._inside(words, classes)
            own = d.take(at)
            total, logs = _exp_sums(d, reach * self.bounds[1])
            nats += float((logs - own).sum(dtype=np.float64))
            d *= (scale / total)[:, None]
            d.reshape(-1)[at] -= scale
            back = np.empty((len(words), n), words.dtype)
            for k, a, b in classes:
                np.matmul(words[a:b].T, d[a:b], out=of_words[k])
                np.matmul(d[a:b], p["O"][k].T, out=back[a:b])
            dx[order] += back
        grads["O"], grads["o"] = (np.ascontiguousarray(x) for x in (of_words[:, :-1], of_words[:, -1]))
        dstates = dx
        if len(live) < len(flat):
            dstates = np.zeros_like(flat)
            dstates[live] = dx
        dstates = dstates.reshape(states.shape)
        rest = 1 - z
        to_new, to_z, to_r = new * new, before - new, part * r
        np.subtract(1, to_new, out=to_new)
        to_new *= rest
        rest *= z
        to_z *= rest
        to_r *= 1 - r
        dh, u = np.zeros_like(h), np.ascontiguousarray(self._by_gate(p["U"]).transpose(0, 2, 1)[[2, 0, 1]])
        d, back = np.empty((4, *states.shape), h.dtype), np.empty((3, *h.shape), h.dtype)  # of the candidate's recurrent part, r, z and the candidate
        dpart, dr, dz, dnew = d
        begins = s.begins[lo:hi].any(axis=1).tolist()
        for t in range(hi - lo - 1, -1, -1):
            dh += dstates[t]
            np.multiply(dh, to_new[t], out=dnew[t])
            np.multiply(dh, to_z[t], out=dz[t])
            np.multiply(dnew[t], to_r[t], out=dr[t])
            np.multiply(dnew[t], r[t], out=dpart[t])
            dh *= z[t]
            np.matmul(d[:3, t], u, out=back)
            dh += back[0]
            dh += back[1]
            dh += back[2]
            if begins[t]:
                dh *= alive[t]
        d = d.reshape(4, -1, n)
        grads["U"] = (before.reshape(-1, n).T @ d[:3])[[1, 2, 0]].transpose(1, 0, 2).reshape(n, 3 * n)
        tokens = s.before[lo:hi].reshape(-1)
        order = np.argsort(tokens.astype(np.uint16) if self.end < 1 << 16 else tokens, kind="stable")
        begin = np.flatnonzero(np.diff(tokens[order], prepend=-1))
        own = tokens[order[begin]]
        of_tokens = _sums(d[1:], order, begin).transpose(1, 0, 2).reshape(len(own), 3 * n)  # of each distinct token's rows of the table
        grads["W"], grads["b"] = p["E"].take(own, axis=0).T @ of_tokens, of_tokens.sum(axis=0)
        grads["E"][own] = of_tokens @ p["W"].T
        return nats, len(live), last, grads

    def train(self, ids: np.ndarray, bounds: np.ndarray, epochs: int = 3, width: int = 32, window: int = 24, rate: float = 0.01, span: tuple[float, float] = (0.0, 1.0), follows: np.ndarray | None = None) -> list[float]:
        """Trains on texts; the nats a token of each epoch. The seed fixes everything. span: where this call begins and ends in the
        course of the whole training, over which the rate falls to a tenth."""
        first, second, step, history = {}, {}, 0, []
        s = streams(ids, bounds, width, self.end, follows)
        total = epochs * -(-len(s.token) // window)
        for _ in range(epochs):
            h, nats, tokens = np.zeros((s.token.shape[1], self.size), np.float32), 0.0, 0
            for lo in range(0, len(s.token), window):
                loss, n, h, grads = self.loss_and_gradients(s, lo, min(lo + window, len(s.token)), h)
                nats, tokens, step = nats + loss, tokens + n, step + 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                pace = rate * (1 - 0.9 * (span[0] + (span[1] - span[0]) * step / total))
                shrink, fix, root = np.float32(0.1 * min(1.0, 1.0 / (norm + 1e-12))), np.float32(pace / (1 - 0.9**step)), np.float32(1 / np.sqrt(1 - 0.99**step))
                for k, g in grads.items():
                    if step == 1:
                        first[k], second[k] = np.zeros_like(g), np.zeros_like(g)
                    g *= shrink
                    first[k] *= np.float32(0.9)
                    first[k] += g
                    np.multiply(g, g, out=g)  # a hundredth of the gradient's square
                    second[k] *= np.float32(0.99)
                    second[k] += g
                    np.sqrt(second[k], out=g)
                    g *= root
                    g += np.float32(1e-8)
                    np.divide(first[k], g, out=g)
                    g *= fix
                    self.p[k] -= g
            history.append(nats / max(1, tokens))
        return history

    def score(self, ids: np.ndarray, bounds: np.ndarray, width: int = 384, window: int | None = None) -> np.ndarray:
        """The natural log probability of each text, in double precision sums. window: its steps, else as many as the streams leave."""
        self._prepare()
        s = streams(ids, bounds, width, self.end)
        out = np.zeros(len(bounds) - 1)
        h = np.zeros((s.token.shape[1] if len(s.token) else 1, self.size), np.float32)
        hi = 0
        while hi < len(s.token):
            lo, hi = hi, min(hi + (window or int(np.clip(SCORED // len(h), 8, 96))), len(s.token))
            states, h, _ = self.run(s, lo, hi, h, keep=False)
            text = s.text[lo:hi].reshape(-1)
            live = np.flatnonzero(text >= 0)
            logp = self.log_probs(states.reshape(-1, self.size)[live], s.token[lo:hi].reshape(-1)[live])
            out += np.bincount(text[live], weights=logp, minlength=len(out))
            if not (s.text[hi - 1] >= 0).any():
                break
            if (s.text[hi - 1] < 0).sum() * 2 > s.text.shape[1]:  # streams that have ended leave
                stay = s.text[hi - 1] >= 0
                s = Streams(*(x[:, stay] for x in (s.before, s.begins, s.token, s.text)))
                h = h[stay]
        return out

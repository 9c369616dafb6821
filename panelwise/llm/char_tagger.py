"""A character-level bidirectional LSTM with a CRF on top, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from panelwise.llm.pii_rules import KINDS, Span

TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
CHARS, EMBEDDING, HIDDEN = 131, 12, 24
NEVER = -1e4


def char_ids(text: str) -> np.ndarray:
    """ASCII as it is, then letters and other characters beyond it; 130 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where(code < 128, code, np.where(code >= 0xC0, 128, 129))


def tags_of(spans: list[Span], size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[max(a, 0):b] = k + 1
        if 0 <= a < size:
            out[a] = k
    return out


def spans_of(tags: np.ndarray) -> list[Span]:
    out, at, n = [], 0, len(tags)
    hot = np.flatnonzero(tags % 2 == 1).tolist()
    for a in hot:
        at = a + 1
        while at < n and tags[at] == tags[a] + 1:
            at += 1
        out.append((a, at, KINDS[(tags[a] - 1) // 2]))
    return out


def allowed() -> np.ndarray:
    """0 where a tag may follow another, ``NEVER`` elsewhere: inside only after begin or inside of its kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(2, TAGS, 2):
        out[:, k] = NEVER
        out[k - 1, k] = out[k, k] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 1) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"emb": rng.normal(0, 0.3, (CHARS, EMBEDDING)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.25, (EMBEDDING, 4 * HIDDEN))
            p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p[f"b{d}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gate open at first
        return cls(p)

    def lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: batch x length x embedding, in the direction's own order."""
        p, n, h4 = self.p, HIDDEN, x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((len(x), n), x.dtype), np.zeros((len(x), n), x.dtype)
        out = np.empty((x.shape[1], len(x), n), x.dtype)
        for t in range(x.shape[1]):
            z = h4[:, t] + h @ p[f"h{d}"]
            gates, g = sigmoid(z[:, :3 * n]), np.tanh(z[:, 3 * n:])
            before, c = c, gates[:, :n] * c + gates[:, n:2 * n] * g
            tanh_c = np.tanh(c)
            if keep is not None:
                keep.append((h, before, gates, g, tanh_c))
            h = gates[:, 2 * n:] * tanh_c
            out[t] = h
        return out.transpose(1, 0, 2)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["emb"][ids]
        return np.concatenate([self.lstm(x, "f"), self.lstm(x[:, ::-1], "b")[:, ::-1]], axis=2) @ self.p["out"] + self.p["bias"]

    def lstm_gradient(self, x: np.ndarray, d: str, keep: list, grad: np.ndarray, into: dict[str, np.ndarray]) -> np.ndarray:
        p, n = self.p, HIDDEN
        dx, dh, dc = np.empty_like(x), np.zeros((len(x), n)), np.zeros((len(x), n))
        for t in range(x.shape[1] - 1, -1, -1):
            h, before, gates, g, tanh_c = keep[t]
            f, i, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - tanh_c**2)
            dz = np.concatenate([dc * before * f * (1 - f), dc * g * i * (1 - i), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            into[f"h{d}"] += h.T @ dz
            into[f"x{d}"] += x[:, t].T @ dz
            into[f"b{d}"] += dz.sum(axis=0)
            dx[:, t], dh, dc = dz @ p[f"x{d}"].T, dz @ p[f"h{d}"].T, dc * f
        return dx

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradient."""
        p, (size, length) = self.p, ids.shape
        x, kept = p["emb"][ids], {"f": [], "b": []}
        both = np.concatenate([self.lstm(x, "f", kept["f"]), self.lstm(x[:, ::-1], "b", kept["b"])[:, ::-1]], axis=2)
        e, trans = both @ p["out"] + p["bias"], p["trans"] + allowed()
        ahead, back = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + allowed()[0]
        for t in range(1, length):
            ahead[:, t] = log_sum(ahead[:, t - 1][:, :, None] + trans, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            back[:, t] = log_sum(trans[None] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = log_sum(ahead[:, -1], 1)
        rows, steps = np.arange(size)[:, None], np.arange(length)[None, :]
        gold = e[rows, steps, tags].sum(axis=1) + trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        de = np.exp(ahead + back - total[:, None, None])
        de[rows, steps, tags] -= 1
        de /= size
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        pair = ahead[:, :-1, :, None] + trans + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        grad["trans"] = np.exp(pair).sum(axis=(0, 1))
        np.add.at(grad["trans"], (tags[:, :-1], tags[:, 1:]), -1)
        grad["trans"] /= size
        grad["out"], grad["bias"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1))
        dboth = de @ p["out"].T
        dx = self.lstm_gradient(x, "f", kept["f"], dboth[:, :, :HIDDEN], grad)
        dx += self.lstm_gradient(np.ascontiguousarray(x[:, ::-1]), "b", kept["b"], dboth[:, ::-1, HIDDEN:], grad)[:, ::-1]
        np.add.at(grad["emb"], ids, dx)
        return float((total - gold).mean()), grad

    def train(self, ids: np.ndarray, tags: np.ndarray, passes: int, size: int = 48, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam over shuffled batches; the mean loss of each pass."""
        rng, first, second, step, out = np.random.default_rng(seed), {}, {}, 0, []
        for k in range(passes):
            order, losses = rng.permutation(len(ids)), []
            for a in range(0, len(ids), size):
                some = order[a:a + size]
                value, grad = self.loss(ids[some], tags[some])
                losses.append(value)
                step += 1
                norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
                for name, g in grad.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * g**2
                    scale = rate * (0.5 ** (3 * k / passes))
                    self.p[name] -= scale * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
            out.append(float(np.mean(losses)))
        return out

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of a batch of emissions, batch x length x tags."""
        trans, n = self.p["trans"] + allowed(), e.shape[1]
        score, back = e[:, 0] + allowed()[0], np.zeros(e.shape, dtype=np.int8)
        for t in range(1, n):
            step = score[:, :, None] + trans
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + e[:, t]
        out = np.empty(e.shape[:2], dtype=np.int64)
        out[:, -1] = score.argmax(axis=1)
        for t in range(n - 1, 0, -1):
            out[:, t - 1] = back[np.arange(len(e)), t, out[:, t]]
        return out

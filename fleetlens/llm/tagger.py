"""A bidirectional LSTM over characters with a conditional random field (CRF) on top, in numpy.

Sequences all have one length; a padding character is a character like any other. Both directions run as
one batched product. Tags are ``O`` and, for every kind, ``B`` (first character of a span) and ``I``
(a further one); a sequence may begin within a span, since windows cut texts anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Characters: ASCII, all others as one, and the padding.
OTHER, PAD, ALPHABET = 128, 129, 130
EMBED, HIDDEN = 12, 20
NEVER = -1e4


def ids_of(windows: Sequence[str], width: int) -> np.ndarray:
    """``(windows, width)`` character numbers; shorter windows are padded at their end."""
    raw = "".join(w.ljust(width, "￿") for w in windows).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, "<u4").reshape(len(windows), width)
    lengths = np.array([len(w) for w in windows])
    return np.where(np.arange(width) < lengths[:, None], np.minimum(code, OTHER), PAD).astype(np.int64)


def tags_of(kinds: Sequence[tuple[int, int, int]], width: int) -> np.ndarray:
    """Tags of a window whose spans are ``(kind, start, end)``; starts before the window go on from outside."""
    tags = np.zeros(width, dtype=np.int64)
    for kind, start, end in kinds:
        tags[max(start, 0):max(min(end, width), 0)] = 2 + 2 * kind
        if 0 <= start < width:
            tags[start] = 1 + 2 * kind
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the spans of one window's tags."""
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(tags):
        if tags[at] == 0:
            at += 1
            continue
        kind, end = (int(tags[at]) - 1) // 2, at + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((kind, at, end))
        at = end
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, kinds: int, seed: int = 11) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        k = 1 + 2 * kinds

        def some(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.weights = {
            "embed": some(ALPHABET, EMBED, scale=0.3), "into": some(2, EMBED, 4 * HIDDEN, scale=EMBED ** -0.5),
            "over": some(2, HIDDEN, 4 * HIDDEN, scale=HIDDEN ** -0.5), "bias": np.zeros((2, 1, 4 * HIDDEN), np.float32),
            "out": some(2 * HIDDEN, k, scale=(2 * HIDDEN) ** -0.5), "last": np.zeros(k, np.float32),
            "move": np.zeros((k, k), np.float32)}
        self.weights["bias"][:, :, HIDDEN:2 * HIDDEN] = 1.0  # remember, to begin with
        # A further character follows a character of its own span only.
        self.barred = np.zeros((k, k))
        for inside in range(2, k, 2):
            self.barred[:, inside] = NEVER
            self.barred[[inside - 1, inside], inside] = 0.0

    def to_bytes(self) -> bytes:
        return b"".join(w.astype("<f4").tobytes() for w in self.weights.values())

    @classmethod
    def from_bytes(cls, raw: bytes, kinds: int) -> Tagger:
        made, flat, at = cls(kinds), np.frombuffer(raw, "<f4"), 0
        for name, w in made.weights.items():
            made.weights[name] = flat[at:at + w.size].reshape(w.shape).copy()
            at += w.size
        return made

    def _states(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        """``(windows, width, 2 * HIDDEN)`` and what the way back needs, step by step."""
        w = self.weights
        n, width = ids.shape
        both = np.stack([ids, ids[:, ::-1]])
        x = w["embed"][both]
        drive = np.matmul(x.reshape(2, n * width, EMBED), w["into"]).reshape(2, n, width, 4 * HIDDEN) + w["bias"][:, :, None]
        drive = np.ascontiguousarray(drive.transpose(2, 0, 1, 3))
        h = np.zeros((2, n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.empty((width, 2, n, HIDDEN), np.float32)
        trace = []
        for t in range(width):
            gates = drive[t] + np.matmul(h, w["over"])
            gates[..., :3 * HIDDEN] = _sigmoid(gates[..., :3 * HIDDEN])
            gates[..., 3 * HIDDEN:] = np.tanh(gates[..., 3 * HIDDEN:])
            put, keep, show, new = (gates[..., i * HIDDEN:(i + 1) * HIDDEN] for i in range(4))
            before, h_before = c, h
            c = keep * c + put * new
            bent = np.tanh(c)
            h = show * bent
            out[t] = h
            trace.append((gates, before, bent, h_before))
        states = np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2)
        return states, [x, trace]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        states, _ = self._states(ids)
        return states @ self.weights["out"] + self.weights["last"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of every window, and for each character how far its tag is above ``O``."""
        emit = self.emissions(ids).astype(np.float64)
        move = self.weights["move"] + self.barred
        n, width, k = emit.shape
        back = np.empty((width, n, k), np.int64)
        score = emit[:, 0]
        for t in range(1, width):
            way = score[:, :, None] + move
            back[t] = way.argmax(axis=1)
            score = np.take_along_axis(way, back[t][:, None], axis=1)[:, 0] + emit[:, t]
        tags = np.empty((n, width), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags, np.take_along_axis(emit, tags[:, :, None], axis=2)[:, :, 0] - emit[:, :, 0]

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        w = self.weights
        states, (x, trace) = self._states(ids)
        emit = (states @ w["out"] + w["last"]).astype(np.float64)
        move = w["move"] + self.barred
        n, width, k = emit.shape
        ahead, after = np.empty((width, n, k)), np.zeros((width, n, k))
        ahead[0] = emit[:, 0]
        for t in range(1, width):
            ahead[t] = _logsum(ahead[t - 1][:, :, None] + move, 1) + emit[:, t]
        for t in range(width - 2, -1, -1):
            after[t] = _logsum(move + (emit[:, t + 1] + after[t + 1])[:, None], 2)
        total = _logsum(ahead[-1], 1)
        rows = np.arange(n)
        told = np.take_along_axis(emit, tags[:, :, None], axis=2).sum(axis=(1, 2)) + move[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        # Gradients of the CRF: what it expects less what is there.
        d_emit = np.exp(ahead + after - total[None, :, None]).transpose(1, 0, 2)
        d_move = np.zeros((k, k))
        for t in range(1, width):
            pair = ahead[t - 1][:, :, None] + move + (emit[:, t] + after[t])[:, None] - total[:, None, None]
            d_move += np.exp(pair).sum(axis=0)
            np.add.at(d_move, (tags[:, t - 1], tags[:, t]), -1.0)
            d_emit[rows, t, tags[:, t]] -= 1.0
        d_emit[rows, 0, tags[:, 0]] -= 1.0
        d_emit = (d_emit / n).astype(np.float32)
        grads = {"move": (d_move / n).astype(np.float32), "last": d_emit.sum(axis=(0, 1)),
                 "out": states.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, k)}
        d_states = (d_emit @ w["out"].T).transpose(1, 0, 2)
        d_out = np.stack([d_states[:, :, :HIDDEN], d_states[::-1, :, HIDDEN:]], axis=1)
        return float((total - told).mean()), grads | self._through_time(d_out, x, trace, ids)

    def _through_time(self, d_out: np.ndarray, x: np.ndarray, trace: list, ids: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        width, _, n, _ = d_out.shape
        d_gates = np.empty((width, 2, n, 4 * HIDDEN), np.float32)
        over = w["over"].transpose(0, 2, 1)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        d_over = np.zeros_like(w["over"])
        for t in range(width - 1, -1, -1):
            gates, before, bent, h_before = trace[t]
            put, keep, show, new = (gates[..., i * HIDDEN:(i + 1) * HIDDEN] for i in range(4))
            dh = dh + d_out[t]
            dc = dc + dh * show * (1 - bent * bent)
            g = d_gates[t]
            g[..., :HIDDEN] = dc * new * put * (1 - put)
            g[..., HIDDEN:2 * HIDDEN] = dc * before * keep * (1 - keep)
            g[..., 2 * HIDDEN:3 * HIDDEN] = dh * bent * show * (1 - show)
            g[..., 3 * HIDDEN:] = dc * put * (1 - new * new)
            dc = dc * keep
            dh = np.matmul(g, over)
            d_over += np.matmul(h_before.transpose(0, 2, 1), g)
        flat = d_gates.transpose(1, 2, 0, 3).reshape(2, n * width, 4 * HIDDEN)
        d_x = np.matmul(flat, w["into"].transpose(0, 2, 1)).reshape(2 * n * width, EMBED)
        d_embed = np.zeros_like(w["embed"])
        np.add.at(d_embed, np.stack([ids, ids[:, ::-1]]).ravel(), d_x)
        return {"over": d_over, "into": np.matmul(x.reshape(2, n * width, EMBED).transpose(0, 2, 1), flat),
                "bias": flat.sum(axis=1, keepdims=True), "embed": d_embed}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.015, seed: int = 5) -> list[float]:
        """Adam with a falling rate and clipped gradients; the mean loss of every step."""
        rng = np.random.Generator(np.random.PCG64(seed))
        mean = {name: np.zeros_like(w) for name, w in self.weights.items()}
        square = {name: np.zeros_like(w) for name, w in self.weights.items()}
        losses, order = [], np.empty(0, dtype=np.int64)
        for step in range(1, steps + 1):
            while len(order) < min(batch, len(ids)):
                order = np.concatenate([order, rng.permutation(len(ids))])
            now, order = order[:batch], order[batch:]
            loss, grads = self.loss(ids[now], tags[now])
            losses.append(loss)
            length = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pace = rate * (1 - 0.9 * step / steps)
            for name, g in grads.items():
                g = g * min(1.0, 5.0 / max(length, 1e-9))
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                self.weights[name] = (self.weights[name] - pace * (mean[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return losses

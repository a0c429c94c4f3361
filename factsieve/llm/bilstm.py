"""A character tagger in numpy: bidirectional LSTM, CRF transitions, Viterbi decoding.

Characters are folded to few classes (all digits are one, case is dropped), so that a shape is learned
from few examples. Both directions run side by side as one stacked product. Tags are O and, for each
kind of span, B (its first character) and I (the rest); transitions that no span allows are barred.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

PAD = 0
_OTHER = 1
_BARRED = -1e4


def _classes() -> np.ndarray:
    """Class of every code point below 128; the last entry stands for all others."""
    table = np.full(129, _OTHER, np.int64)
    for code in range(128):
        letter = chr(code)
        if letter.isdigit():
            table[code] = 2
        elif letter.isspace() or code < 32:
            table[code] = 3
        elif letter.isalpha():
            table[code] = 4 + ord(letter.lower()) - ord("a")
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[signs] = 30 + np.arange(len(signs))
    return table


CLASSES = _classes()
SIZE = int(CLASSES.max()) + 1


def encoded(texts: list[str], width: int) -> np.ndarray:
    """Character classes of texts of at most ``width`` characters, filled up with PAD."""
    out = np.full((len(texts), width), PAD, np.int64)
    for row, text in zip(out, texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        row[: len(codes)] = CLASSES[np.minimum(codes, 128)]
    return out


def span_tags(spans: list[tuple[int, int, int]], width: int) -> np.ndarray:
    """Tags of a window with spans (kind, start, stop); parts outside the window are cut off."""
    tags = np.zeros(width, np.int64)
    for kind, start, stop in spans:
        if stop > 0 and start < width:
            tags[max(start, 0) : min(stop, width)] = 2 + 2 * kind
            if start >= 0:
                tags[start] = 1 + 2 * kind
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _through(ahead: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """log(sum over tags of exp(ahead + log(moves))), as a matrix product."""
    top = ahead.max(-1, keepdims=True)
    return top + np.log(np.exp(ahead - top) @ moves + 1e-30)


def allowed(kinds: int, dtype: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Constants added to transitions and to a window's first tag; I may only follow B or I of its kind.

    A window may begin inside a span, so every first tag is allowed.
    """
    tags = 1 + 2 * kinds
    bars = np.zeros((tags, tags), dtype)
    for kind in range(kinds):
        bars[:, 2 + 2 * kind] = _BARRED
        bars[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = 0
    return bars, np.zeros(tags, dtype)


@dataclass
class Tagger:
    """Weights by name; ``kinds`` kinds of spans."""

    weights: dict[str, np.ndarray]
    kinds: int

    @classmethod
    def new(cls, kinds: int, embedding: int, hidden: int, seed: int, dtype: type = np.float32) -> Tagger:
        r, tags = np.random.default_rng(seed), 1 + 2 * kinds
        shapes = {
            "embed": (SIZE, embedding),
            "inputs": (2, embedding, 4 * hidden),
            "carry": (2, hidden, 4 * hidden),
            "bias": (2, 1, 4 * hidden),
            "out": (2 * hidden, tags),
            "out_bias": (tags,),
            "trans": (tags, tags),
        }
        weights = {n: (r.standard_normal(s) * (0.5 if n == "embed" else s[-2] ** -0.5 if len(s) > 1 else 0)).astype(dtype)
                   for n, s in shapes.items()}
        weights["bias"][:] = 0
        weights["bias"][:, :, hidden : 2 * hidden] = 1  # remember at first
        weights["trans"] *= 0
        return cls(weights, kinds)

    def packed(self) -> bytes:
        """The weights as bytes."""
        out = io.BytesIO()
        np.savez(out, **self.weights)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tagger:
        with np.load(io.BytesIO(data)) as found:
            weights = dict(found)
        return cls(weights, (weights["trans"].shape[0] - 1) // 2)

    # Scores ---------------------------------------------------------------------------

    def emissions(self, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Scores (place, window, tag); ``keep`` collects what the gradient needs."""
        w = self.weights
        hidden = w["carry"].shape[1]
        table = np.matmul(w["embed"], w["inputs"]) + w["bias"]  # gates of every class, per direction
        places = ids.T
        both = np.stack([places, places[::-1]])
        h = np.zeros((2, ids.shape[0], hidden), table.dtype)
        c = h
        states = np.empty((2, ids.shape[1], ids.shape[0], hidden), table.dtype)
        for t in range(ids.shape[1]):
            gates = np.matmul(h, w["carry"])
            gates += np.stack([table[0][both[0, t]], table[1][both[1, t]]])
            s = _sigmoid(gates[..., : 3 * hidden])
            i, f, o = s[..., :hidden], s[..., hidden : 2 * hidden], s[..., 2 * hidden :]
            u = np.tanh(gates[..., 3 * hidden :])
            before, c = c, f * c + i * u
            squashed = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, u, squashed))
            h = o * squashed
            states[:, t] = h
        joined = np.concatenate([states[0], states[1][::-1]], -1)
        if keep is not None:
            keep.append(joined)
        return joined @ w["out"] + w["out_bias"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best tags (window, place), emissions (place, window, tag) and transitions; padding is O."""
        scores = self.emissions(ids)
        scores[..., 1:][ids.T == PAD] += _BARRED
        bars, first = allowed(self.kinds, scores.dtype)
        trans = self.weights["trans"] + bars
        by_tag = np.ascontiguousarray(scores.transpose(0, 2, 1))
        best, back = by_tag[0] + first[:, None], np.zeros(by_tag.shape, np.int8)
        for t in range(1, len(by_tag)):
            way = best[0] + trans[0][:, None]
            for tag in range(1, len(trans)):
                other = best[tag] + trans[tag][:, None]
                back[t][other > way] = tag
                np.maximum(way, other, out=way)
            best = way + by_tag[t]
        tags = np.empty(ids.shape, np.int64)
        tags[:, -1] = best.argmax(0)
        rows = np.arange(len(ids))
        for t in range(len(by_tag) - 1, 0, -1):
            tags[:, t - 1] = back[t][tags[:, t], rows]
        return tags, scores, trans

    def spans(self, ids: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Per window (kind, start, stop, margin): how much better the span scores than O in its place."""
        tags, scores, trans = self.decode(ids)
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in ids]
        for row in np.flatnonzero(tags.any(1)):
            own, width = tags[row], ids.shape[1]
            emitted = scores[np.arange(width), row, own] - scores[:, row, 0]
            moved = np.zeros(width + 1)
            moved[1:-1] = trans[own[:-1], own[1:]] - trans[0, 0]
            start = 0
            while start < width:
                if own[start] == 0:
                    start += 1
                    continue
                kind, stop = (own[start] - 1) // 2, start + 1
                while stop < width and own[stop] == 2 + 2 * kind:
                    stop += 1
                margin = float(emitted[start:stop].sum() + moved[start : stop + 1].sum())
                found[row].append((int(kind), start, stop, margin))
                start = stop
        return found

    # Training -------------------------------------------------------------------------

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags of a window, and its gradients."""
        w, keep = self.weights, []
        scores = self.emissions(ids, keep)
        joined = keep.pop()
        places, windows = scores.shape[:2]
        bars, first = allowed(self.kinds, scores.dtype)
        trans = w["trans"] + bars
        moves = np.exp(trans)
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + first
        for t in range(1, places):
            ahead[t] = _through(ahead[t - 1], moves) + scores[t]
        top = ahead[-1].max(1)
        total = top + np.log(np.exp(ahead[-1] - top[:, None]).sum(1))
        for t in range(places - 2, -1, -1):
            behind[t] = _through(scores[t + 1] + behind[t + 1], moves.T)
        d_scores = np.exp(ahead + behind - total[:, None])
        top = ahead[:-1].max(-1, keepdims=True)
        before = np.exp(ahead[:-1] - top).reshape(-1, len(trans))
        after = np.exp(scores[1:] + behind[1:] - total[:, None] + top).reshape(-1, len(trans))
        d_trans = moves * (before.T @ after)
        gold, row = tags.T, np.arange(windows)
        path = scores[np.arange(places)[:, None], row, gold].sum(0) + first[gold[0]]
        path += trans[gold[:-1], gold[1:]].sum(0)
        d_scores[np.arange(places)[:, None], row, gold] -= 1
        np.subtract.at(d_trans, (gold[:-1], gold[1:]), 1)
        d_scores /= windows
        grads = {"trans": d_trans / windows, **self._backward(ids, d_scores, joined, keep)}
        return float((total - path).mean()), grads

    def _backward(self, ids: np.ndarray, d_scores: np.ndarray, joined: np.ndarray, keep: list) -> dict[str, np.ndarray]:
        w = self.weights
        hidden = w["carry"].shape[1]
        grads = {
            "out": np.einsum("twh,twk->hk", joined, d_scores),
            "out_bias": d_scores.sum((0, 1)),
            "carry": np.zeros_like(w["carry"]),
        }
        d_joined = d_scores @ w["out"].T
        d_states = np.stack([d_joined[..., :hidden], d_joined[::-1][..., hidden:]])
        d_gates = np.empty((2, len(keep), len(ids), 4 * hidden), joined.dtype)
        both = np.stack([ids.T, ids.T[::-1]])
        d_h = np.zeros_like(keep[0][0])
        d_c = np.zeros_like(d_h)
        back = np.swapaxes(w["carry"], 1, 2)
        for t in range(len(keep) - 1, -1, -1):
            h, before, i, f, o, u, squashed = keep[t]
            d_h = d_h + d_states[:, t]
            d_c = d_c + d_h * o * (1 - squashed * squashed)
            gates = np.concatenate(
                [d_c * u * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - u * u)], -1
            )
            grads["carry"] += np.matmul(np.swapaxes(h, 1, 2), gates)
            d_gates[:, t] = gates
            d_h, d_c = np.matmul(gates, back), d_c * f
        # sums by class of character, as a product with a matrix of ones and zeros
        marks = (np.arange(SIZE)[:, None] == both.reshape(2, 1, -1)).astype(joined.dtype)
        d_table = np.matmul(marks, d_gates.reshape(2, -1, 4 * hidden))
        grads["bias"] = d_table.sum(1, keepdims=True)
        grads["embed"] = sum(d_table[way] @ w["inputs"][way].T for way in (0, 1))
        grads["inputs"] = np.stack([w["embed"].T @ d_table[way] for way in (0, 1)])
        return grads

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> float:
        """Adam over batches drawn in a seeded order; the mean loss of the last tenth of the steps."""
        r = np.random.default_rng(seed)
        first = {n: np.zeros_like(v) for n, v in self.weights.items()}
        second = {n: np.zeros_like(v) for n, v in self.weights.items()}
        losses, order = [], np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, r.permutation(len(ids))])
            rows, order = order[:batch], order[batch:]
            value, grads = self.loss(ids[rows], tags[rows])
            losses.append(value)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
            slow = min(1.0, 5.0 / (norm + 1e-9))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for n, g in grads.items():
                g = g * slow
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                mean, spread = first[n] / (1 - 0.9**step), second[n] / (1 - 0.999**step)
                self.weights[n] = (self.weights[n] - pace * mean / (np.sqrt(spread) + 1e-8)).astype(self.weights[n].dtype)
        return float(np.mean(losses[-max(1, steps // 10) :]))

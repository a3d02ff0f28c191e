"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, tags and their probabilities.

All functions work on batches (rows, length) of character classes. Rows shorter than the batch end in
``PAD``, which counts as outside of every span and takes no part in training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Character classes: a letter each regardless of case, one for all digits, a class each for other ASCII characters, then letters elsewhere and the rest.
PAD, LETTER, DIGIT, SPACE, SIGN, FAR_LETTER, FAR = 0, 1, 27, 28, 30, 126, 127
CLASSES = 128
#: Widths of a character's vector and of each direction's state; neighbours on each side whose vectors a place sees beside its own.
CHARACTER, STATE, NEAR = 10, 20, 1
_NEVER = -1e4


def _ascii_classes() -> np.ndarray:
    out = np.empty(128, np.int16)
    for c in range(128):
        s = chr(c)
        out[c] = LETTER + ord(s.lower()) - 97 if s.isalpha() else DIGIT if s.isdigit() else SPACE + (s in "\n\r") if s.isspace() else SIGN + c % 96
    return out


_ASCII = _ascii_classes()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(points, 127)]
    for i in np.flatnonzero(points > 127).tolist():
        out[i] = FAR_LETTER if text[i].isalpha() else FAR
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exponents."""
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """Weights by name. Tags are 0 (outside), then for each kind its first and its further characters."""

    kinds: int
    weights: dict[str, np.ndarray]

    @property
    def tags(self) -> int:
        return 1 + 2 * self.kinds

    @classmethod
    def fresh(cls, kinds: int, seed: int) -> Tagger:
        r, k, wide = np.random.default_rng(seed), 1 + 2 * kinds, (1 + 2 * NEAR) * CHARACTER
        w = {
            "letters": r.normal(0, 0.5, (CLASSES, CHARACTER)), "out": r.normal(0, 0.3, (2 * STATE, k)), "out_bias": np.zeros(k), "follow": np.zeros((k, k)),
            "in": r.normal(0, wide**-0.5, (2, wide, 4 * STATE)), "state": r.normal(0, STATE**-0.5, (2, STATE, 4 * STATE)), "bias": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], STATE), (2, 1)),
        }
        return cls(kinds, {name: x.astype(np.float32) for name, x in w.items()})

    def transitions(self) -> np.ndarray:
        """Scores of one tag after another; further characters follow only the first or further ones of their kind."""
        out = self.weights["follow"].copy()
        for kind in range(self.kinds):
            inner = 2 + 2 * kind
            barred = np.ones(self.tags, bool)
            barred[[inner - 1, inner]] = False
            out[barred, inner] = _NEVER
        return out

    def _run(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """States and gates of both directions side by side, over (rows, length) vectors; the second walks from the end, through what lies beyond a row."""
        w, (rows, length, _) = self.weights, x.shape
        both = np.stack([x, x[:, ::-1]]).transpose(0, 2, 1, 3).reshape(2, length * rows, -1)
        into = (both @ w["in"] + w["bias"][:, None]).reshape(2, length, rows, 4 * STATE)
        h, c = np.zeros((2, rows, STATE), x.dtype), np.zeros((2, rows, STATE), x.dtype)
        gates, cells, states = np.empty_like(into), np.empty((2, length, rows, STATE), x.dtype), np.empty((2, length, rows, STATE), x.dtype)
        for t in range(length):
            z = into[:, t] + h @ w["state"]
            z[..., : 3 * STATE] = sigmoid(z[..., : 3 * STATE])
            z[..., 3 * STATE :] = np.tanh(z[..., 3 * STATE :])
            c = z[..., STATE : 2 * STATE] * c + z[..., :STATE] * z[..., 3 * STATE :]
            h = z[..., 2 * STATE : 3 * STATE] * np.tanh(c)
            gates[:, t], cells[:, t], states[:, t] = z, c, h
        return {"both": both, "gates": gates, "cells": cells, "states": states}

    def _around(self, ids: np.ndarray) -> np.ndarray:
        """Classes (rows, length, places) of each place and its neighbours."""
        padded = np.pad(ids, ((0, 0), (NEAR, NEAR)))
        return np.stack([padded[:, i : i + ids.shape[1]] for i in range(1 + 2 * NEAR)], 2)

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores (rows, length, tags) of each place, and what training needs of the way there."""
        x = self.weights["letters"][self._around(ids)].reshape(*ids.shape, -1)
        way = self._run(x)
        way["joined"] = np.concatenate([way["states"][0], way["states"][1, ::-1]], 2).transpose(1, 0, 2)
        scores = way["joined"] @ self.weights["out"] + self.weights["out_bias"]
        scores[ids == PAD] = _NEVER
        scores[ids == PAD, 0] = 0.0
        return scores, way

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log of all paths' weight, alpha, beta), in logs, of the chain of tags; no row begins inside a span."""
        rows, length, k = scores.shape
        follow = self.transitions()
        first = np.where(np.arange(k) % 2 * 1 + (np.arange(k) == 0), 0.0, _NEVER).astype(np.float32)
        a, b = np.empty_like(scores), np.zeros_like(scores)
        a[:, 0] = scores[:, 0] + first
        for t in range(1, length):
            a[:, t] = _total(a[:, t - 1, :, None] + follow, 1) + scores[:, t]
        for t in range(length - 2, -1, -1):
            b[:, t] = _total(follow + (scores[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        return _total(a[:, -1], 1), a, b

    def best(self, scores: np.ndarray) -> np.ndarray:
        """The most likely tags of each row."""
        rows, length, k = scores.shape
        follow = self.transitions()
        now = scores[:, 0] + np.where(np.arange(k) % 2 * 1 + (np.arange(k) == 0), 0.0, _NEVER)
        back = np.zeros((rows, length, k), np.int8)
        for t in range(1, length):
            reach = now[:, :, None] + follow
            back[:, t] = reach.argmax(1)
            now = reach.max(1) + scores[:, t]
        out = np.empty((rows, length), np.int8)
        out[:, -1] = now.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = np.take_along_axis(back[:, t], out[:, t, None].astype(int), 1)[:, 0]
        return out

    def gradients(self, ids: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the true tags, and its slope in every weight."""
        w, (rows, length) = self.weights, ids.shape
        scores, way = self.emissions(ids)
        z, a, b = self.marginals(scores)
        k, follow = self.tags, self.transitions()
        slope = np.exp(np.minimum(a + b - z[:, None, None], 0.0)).astype(scores.dtype)
        np.add.at(slope, (np.arange(rows)[:, None], np.arange(length)[None], truth), -1.0)
        pairs = np.zeros((k, k), np.float32)
        for t in range(1, length):
            pairs += np.exp(np.minimum(a[:, t - 1, :, None] + follow + (scores[:, t] + b[:, t])[:, None, :] - z[:, None, None], 0.0)).sum(0)
        np.add.at(pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), -1.0)
        path = np.take_along_axis(scores, truth[..., None], 2).sum((1, 2)) + follow[truth[:, :-1], truth[:, 1:]].sum(1)
        slope[ids == PAD] = 0.0
        g = {"follow": np.where(follow <= _NEVER / 2, 0.0, pairs), "out": np.tensordot(way["joined"], slope, ((0, 1), (0, 1))), "out_bias": slope.sum((0, 1))}
        down = slope @ w["out"].T
        down = np.stack([down[..., :STATE], down[:, ::-1, STATE:]]).transpose(0, 2, 1, 3)
        into = self._back(way, down, g)
        x = (into @ w["in"].transpose(0, 2, 1)).reshape(2, length, rows, -1).transpose(0, 2, 1, 3)
        letters, around = (x[0] + x[1, :, ::-1]).reshape(-1, CHARACTER), self._around(ids).reshape(-1)
        g["letters"] = np.stack([np.bincount(around, letters[:, j], CLASSES) for j in range(CHARACTER)], 1)
        return float((z - path).mean()), {name: (x / rows).astype(x.dtype) for name, x in g.items()}

    def _back(self, way: dict, down: np.ndarray, g: dict) -> np.ndarray:
        """Slopes of what enters the gates, by walking the steps back; adds those of the weights to ``g``."""
        gates, cells, states = way["gates"], way["cells"], way["states"]
        _, length, rows, _ = cells.shape
        turned = self.weights["state"].transpose(0, 2, 1)
        out = np.empty_like(gates)
        dh, dc = np.zeros_like(cells[:, 0]), np.zeros_like(cells[:, 0])
        i, f, o, u = (gates[..., j * STATE : (j + 1) * STATE] for j in range(4))
        tanh = np.tanh(cells)
        old = np.concatenate([np.zeros_like(cells[:, :1]), cells[:, :-1]], 1)
        to_i, to_f, to_u, to_o, to_c = u * i * (1 - i), old * f * (1 - f), i * (1 - u**2), tanh * o * (1 - o), o * (1 - tanh**2)
        for t in range(length - 1, -1, -1):
            dh = dh + down[:, t]
            dc = dc + dh * to_c[:, t]
            z = out[:, t]
            z[..., :STATE], z[..., STATE : 2 * STATE], z[..., 2 * STATE : 3 * STATE], z[..., 3 * STATE :] = dc * to_i[:, t], dc * to_f[:, t], dh * to_o[:, t], dc * to_u[:, t]
            dh, dc = z @ turned, dc * f[:, t]
        before = np.concatenate([np.zeros_like(states[:, :1]), states[:, :-1]], 1).reshape(2, length * rows, STATE)
        flat = out.reshape(2, length * rows, -1)
        g["state"], g["in"], g["bias"] = before.transpose(0, 2, 1) @ flat, way["both"].transpose(0, 2, 1) @ flat, flat.sum(1)
        return flat


def trained(ids: np.ndarray, truth: np.ndarray, kinds: int, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Tagger:
    """A tagger after so many steps of Adam, at a falling rate, over batches of rows of one length."""
    model, r = Tagger.fresh(kinds, seed), np.random.default_rng(seed)
    first = {name: np.zeros_like(x) for name, x in model.weights.items()}
    second = {name: np.zeros_like(x) for name, x in model.weights.items()}
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        while len(order) < batch:
            order = np.append(order, r.permutation(len(ids)))
        some, order = order[:batch], order[batch:]
        _, slopes = model.gradients(ids[some], truth[some])
        norm = np.sqrt(sum(float((x**2).sum()) for x in slopes.values()))
        now, small = rate * min(1.0, 1.5 * (1 - step / (steps + 1))), min(1.0, 5.0 / max(norm, 1e-9))
        for name, x in slopes.items():
            first[name] = 0.9 * first[name] + 0.1 * small * x
            second[name] = 0.99 * second[name] + 0.01 * (small * x) ** 2
            model.weights[name] = (model.weights[name] - now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model

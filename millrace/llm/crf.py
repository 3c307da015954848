"""A linear-chain conditional random field over few tags with sparse binary features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = range(3)
_NEVER = -1e9
#: What may follow what: a span begins before it goes on.
_ALLOWED = np.array([[0, 0, _NEVER], [0, 0, 0], [0, 0, 0]])
_START = np.array([0, 0, _NEVER])


@dataclass(frozen=True)
class Chain:
    """Weights of (feature, tag), and of (glue, tag before, tag): glue says how two tokens are joined."""

    names: dict[str, int]
    tags: np.ndarray
    moves: np.ndarray

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        """Scores (token, tag) of the tokens' features; unknown ones count nothing."""
        out = np.zeros((len(features), 3))
        for i, f in enumerate(features):
            own = [n for x in f if (n := self.names.get(x)) is not None]
            if own:
                out[i] = self.tags[own].sum(axis=0)
        return out

    def decode(self, scores: np.ndarray, glue: list[int]) -> tuple[list[int], np.ndarray]:
        """The best tags by Viterbi, and each token's chance of not being outside by the forward-backward sums."""
        n = len(scores)
        steps = self.moves + _ALLOWED
        best, back, ahead = np.empty((n, 3)), np.zeros((n, 3), int), np.empty((n, 3))
        best[0] = ahead[0] = scores[0] + _START
        for t in range(1, n):
            m = steps[glue[t]]
            ways = best[t - 1][:, None] + m
            back[t] = ways.argmax(axis=0)
            best[t] = ways[back[t], range(3)] + scores[t]
            ahead[t] = _log_sum(ahead[t - 1][:, None] + m, 0) + scores[t]
        behind = np.zeros((n, 3))
        for t in range(n - 2, -1, -1):
            behind[t] = _log_sum(steps[glue[t + 1]] + (scores[t + 1] + behind[t + 1])[None], 1)
        tags = [int(best[-1].argmax())]
        for t in range(n - 1, 0, -1):
            tags.append(int(back[t][tags[-1]]))
        both = ahead + behind
        inside = 1 - np.exp(both[:, OUTSIDE] - _log_sum(both, 1))
        return tags[::-1], inside


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(sequences: list[tuple[list[list[str]], list[int], list[int]]], rounds: int = 80, rate: float = 0.3, keep: float = 1e-3, least: int = 3) -> Chain:
    """Fit to sequences (features by token, glue by token, tags) by the gradient of the penalised likelihood.

    Features that fewer than `least` tokens have are left out. All sequences are padded to the longest and go through
    the forward and backward sums at once; steps are AdaGrad's. The same sequences always give the same weights.
    """
    count: dict[str, int] = {}
    for features, _, _ in sequences:
        for f in features:
            for x in f:
                count[x] = count.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in count.items() if n >= least))}
    glues = 1 + max((g for _, gs, _ in sequences for g in gs), default=0)
    tags, moves = np.zeros((len(names), 3)), np.zeros((max(2, glues), 3, 3))
    if not sequences:
        return Chain(names, tags, moves)
    size, length = len(sequences), max(len(t) for _, _, t in sequences)
    at, own, glue = [], [], np.zeros((size, length), int)
    gold, live = np.zeros((size, length, 3)), np.zeros((size, length), bool)
    for s, (features, gs, ts) in enumerate(sequences):
        live[s, : len(ts)] = True
        glue[s, : len(ts)] = gs
        gold[s, range(len(ts)), ts] = 1
        for t, f in enumerate(features):
            ids = [names[x] for x in f if x in names]
            own += ids
            at += [s * length + t] * len(ids)
    at, own = np.array(at, int), np.array(own, int)
    hold, hold_moves = np.full_like(tags, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(rounds):
        e = np.zeros((size * length, 3))
        np.add.at(e, at, tags[own])
        e = e.reshape(size, length, 3)
        steps = moves + _ALLOWED
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + _START
        for t in range(1, length):
            new = _log_sum(ahead[:, t - 1][:, :, None] + steps[glue[:, t]], 1) + e[:, t]
            ahead[:, t] = np.where(live[:, t][:, None], new, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _log_sum(steps[glue[:, t + 1]] + (e[:, t + 1] + behind[:, t + 1])[:, None], 2)
            behind[:, t] = np.where(live[:, t + 1][:, None], new, 0)
        whole = _log_sum(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - whole[:, None, None]) * live[:, :, None]
        slope = (gold - chance).reshape(-1, 3)
        g = np.zeros_like(tags)
        np.add.at(g, own, slope[at])
        g -= keep * size * tags / 100
        gm = np.zeros_like(moves)
        for t in range(1, length):
            on = live[:, t]
            if on.any():
                pair = ahead[on, t - 1][:, :, None] + steps[glue[on, t]] + (e[on, t] + behind[on, t])[:, None] - whole[on][:, None, None]
                np.add.at(gm, glue[on, t], gold[on, t - 1][:, :, None] * gold[on, t][:, None] - np.exp(pair))
        gm -= keep * size * moves / 100
        hold += g * g
        hold_moves += gm * gm
        tags += rate * g / np.sqrt(hold)
        moves += rate * gm / np.sqrt(hold_moves)
    return Chain(names, tags, moves)

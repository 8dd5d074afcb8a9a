"""A linear-chain conditional random field with two labels and set-valued features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

Features = list[list[str]]


@dataclass
class Chain:
    """Log weights: of each feature for label 1 against 0, of each label following another, and of
    each label at the beginning and at the end."""

    weights: dict[str, float]
    follows: list[list[float]]
    first: list[float]
    last: list[float]

    def decode(self, features: Features) -> list[int]:
        """The most probable labels of a sequence, by Viterbi. Of equal paths label 0 comes first."""
        if not features:
            return []
        get, (to0, to1) = self.weights.get, zip(*self.follows)
        a, b = self.first
        back: list[tuple[int, int]] = []
        for i, names in enumerate(features):
            if i:
                x0, x1, y0, y1 = a + to0[0], b + to0[1], a + to1[0], b + to1[1]
                back.append((int(x1 > x0), int(y1 > y0)))
                a, b = max(x0, x1), max(y0, y1)
            b += sum(get(n, 0.0) for n in names)
        label = int(b + self.last[1] > a + self.last[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(sequences: Sequence[tuple[Features, list[int]]], *, epochs: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Chain:
    """Maximise the likelihood of labelled sequences: forward and backward sums give the expected
    counts, AdaGrad steps follow the difference from the labels. The order is fixed, so training
    twice gives the same chain."""
    names = sorted({n for features, _ in sequences for block in features for n in block})
    number = {n: i for i, n in enumerate(names)}
    # Feature weights, then the four transitions, two firsts and two lasts.
    k = len(names)
    theta, squares = np.zeros(k + 8), np.full(k + 8, 1e-6)
    prepared = []
    for features, labels in sequences:
        if features:
            index = np.concatenate([[number[n] for n in block] for block in features]).astype(np.int64)
            of = np.repeat(np.arange(len(features)), [len(block) for block in features])
            prepared.append((index, of, np.array(labels)))
    for _ in range(epochs):
        for index, of, labels in prepared:
            n = len(labels)
            scores = np.zeros((n, 2))
            scores[:, 1] = np.bincount(of, theta[index], n)
            scores[0] += theta[k + 4 : k + 6]
            scores[-1] += theta[k + 6 :]
            follows = theta[k : k + 4].reshape(2, 2)
            forward, backward = scores.copy(), np.zeros((n, 2))
            for i in range(1, n):
                forward[i] += np.logaddexp(forward[i - 1, 0] + follows[0], forward[i - 1, 1] + follows[1])
            for i in range(n - 2, -1, -1):
                ahead = backward[i + 1] + scores[i + 1]
                backward[i] = np.logaddexp(follows[:, 0] + ahead[0], follows[:, 1] + ahead[1])
            total = np.logaddexp(*forward[-1])
            belief = np.exp(forward + backward - total)
            truth = np.eye(2)[labels]
            step = np.zeros(k + 8)
            step[:k] = np.bincount(index, (truth - belief)[of, 1], k)
            pairs = np.exp(forward[:-1, :, None] + follows + (scores + backward)[1:, None] - total).sum(axis=0)
            step[k : k + 4] = (np.einsum("ia,ib->ab", truth[:-1], truth[1:]) - pairs).ravel()
            step[k + 4 : k + 6] = (truth - belief)[0]
            step[k + 6 :] = (truth - belief)[-1]
            step -= decay * theta
            squares += step**2
            theta += rate * step / np.sqrt(squares)
    follows = theta[k : k + 4].reshape(2, 2).tolist()
    return Chain(dict(zip(names, theta[:k].tolist())), follows, theta[k + 4 : k + 6].tolist(), theta[k + 6 :].tolist())

"""Linear-chain conditional random fields over batches of sequences, in numpy.

All tokens of a batch lie one after the other. Recursions run place by place over all sequences
that are long enough, so that one numpy call serves thousands of sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Size of the table of hashed features.
BUCKETS = 1 << 18


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


#: Weights of paths that differ by less are equal but for the order of additions.
TIE = 1e-9


def _first_best(values: np.ndarray) -> np.ndarray:
    """Along the second axis the first index whose value is the greatest, or less by a tie."""
    return (values >= values.max(1, keepdims=True) - TIE).argmax(1)


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[int]]:
    """Sequences by falling length, where each starts, and how many reach each place."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    falling = lengths[order]
    longest = int(falling[0]) if len(falling) else 0
    alive = (int(n) for n in np.searchsorted(-falling, -np.arange(longest), side="left"))
    return order, starts, alive


@dataclass(frozen=True)
class Chain:
    """Transition scores from state to state, and scores of the first and the last state."""

    move: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def messages(self, emit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log messages per token, and the log partition per sequence."""
        k = emit.shape[1]
        ahead, back = np.empty_like(emit), np.empty_like(emit)
        total = np.zeros(len(lengths))
        order, starts, alive = _places(lengths)
        counts = list(alive)
        for t, n in enumerate(counts):
            at = starts[:n] + t
            if t == 0:
                ahead[at] = emit[at] + self.first
            else:
                before = ahead[at - 1]
                ahead[at] = emit[at] + np.column_stack([_lse(before + self.move[:, j], 1) for j in range(k)])
        ends = starts[: counts[0]] + lengths[order][: counts[0]] - 1 if counts else np.empty(0, int)
        for t in range(len(counts) - 1, -1, -1):
            n, longer = counts[t], counts[t + 1] if t + 1 < len(counts) else 0
            if n > longer:
                back[starts[longer:n] + t] = self.last
            if longer:
                at = starts[:longer] + t
                after = emit[at + 1] + back[at + 1]
                back[at] = np.column_stack([_lse(after + self.move[i], 1) for i in range(k)])
        if counts:
            total[order[: counts[0]]] = _lse(ahead[ends] + self.last, 1)
        return ahead, back, total

    def marginals(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ahead, back, total = self.messages(emit, lengths)
        return np.exp(np.minimum(ahead + back - np.repeat(total, lengths)[:, None], 0))

    def second_state(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The marginals of the second of two states, from each token's emission odds between them.

        With two states a message is one number, the odds of the second state, and both recursions are fractions of
        it: no logarithm and no exponential per token.
        """
        w = np.exp(self.move - self.move.max())
        order, starts, alive = _places(lengths)
        counts = list(alive)
        ahead, out = np.empty_like(odds), np.empty_like(odds)
        for t, n in enumerate(counts):
            at = starts[:n] + t
            if t == 0:
                now = odds[at] * np.exp(self.first[1] - self.first[0])
            else:
                now = now[:n]
                now = odds[at] * (w[0, 1] + w[1, 1] * now) / (w[0, 0] + w[1, 0] * now)
            ahead[at] = now
        back = np.empty(0)
        for t in range(len(counts) - 1, -1, -1):
            at = starts[: counts[t]] + t
            after = odds[at[: len(back)] + 1] * back
            after = (w[1, 0] + w[1, 1] * after) / (w[0, 0] + w[0, 1] * after)
            back = np.concatenate([after, np.full(counts[t] - len(after), np.exp(self.last[1] - self.last[0]))])
            both = ahead[at] * back
            out[at] = both / (1 + both)
        return out

    def viterbi(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best state of every token; ties (within ``TIE``) go to the smaller state."""
        best, came = np.empty_like(emit), np.zeros(emit.shape, np.int64)
        order, starts, alive = _places(lengths)
        counts = list(alive)
        for t, n in enumerate(counts):
            at = starts[:n] + t
            if t == 0:
                best[at] = emit[at] + self.first
            else:
                ways = best[at - 1][:, :, None] + self.move[None]
                came[at] = _first_best(ways)
                best[at] = emit[at] + ways.max(1)
        state = np.zeros(len(emit), np.int64)
        for t in range(len(counts) - 1, -1, -1):
            n, longer = counts[t], counts[t + 1] if t + 1 < len(counts) else 0
            ends = starts[longer:n] + t
            state[ends] = _first_best(best[ends] + self.last)
            at = starts[:longer] + t
            state[at] = came[at + 1, state[at + 1]]
        return state


def train(
    features: list[list[int]], kinds: np.ndarray, states: np.ndarray, lengths: np.ndarray, k: int, rounds: int, penalty: float
) -> tuple[np.ndarray, Chain]:
    """Emission weights (``BUCKETS`` by ``k``) and chain of greatest penalised likelihood.

    ``features`` lists the buckets of each kind of token, ``kinds`` and ``states`` give the kind and the true
    state of every token. Full-batch gradient steps with momentum and scaling per weight.
    """
    width = np.array([len(f) for f in features])
    flat = np.concatenate([np.array(f, np.int64) for f in features])
    used, local = np.unique(flat, return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(width)[:-1]])
    owner = np.repeat(np.arange(len(features)), width)
    size = len(used) * k
    theta = np.zeros(size + k * k + 2 * k)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    starts = np.cumsum(lengths) - lengths
    ends = starts + lengths - 1
    inner = np.ones(len(kinds), bool)
    inner[starts] = False
    here = np.flatnonzero(inner)
    truth = np.eye(k)[states]
    moves = np.zeros((k, k))
    np.add.at(moves, (states[here - 1], states[here]), 1)
    for step in range(1, rounds + 1):
        w = theta[:size].reshape(-1, k)
        chain = Chain(theta[size : size + k * k].reshape(k, k), theta[size + k * k : size + k * k + k], theta[size + k * k + k :])
        emit = np.add.reduceat(w[local], edge, axis=0)[kinds]
        ahead, back, total = chain.messages(emit, lengths)
        each = np.repeat(total, lengths)
        p = np.exp(np.minimum(ahead + back - each[:, None], 0))
        by_kind = np.column_stack([np.bincount(kinds, (truth - p)[:, s], len(features)) for s in range(k)])
        g_w = np.column_stack([np.bincount(local, by_kind[owner, s], len(used)) for s in range(k)])
        pair = ahead[here - 1][:, :, None] + chain.move[None] + (emit[here] + back[here])[:, None, :] - each[here][:, None, None]
        g_move = moves - np.exp(np.minimum(pair, 0)).sum(0)
        gradient = np.concatenate([g_w.ravel(), g_move.ravel(), (truth - p)[starts].sum(0), (truth - p)[ends].sum(0)]) - penalty * theta
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        theta = theta + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * min(1.0, 20 / step)
    out = np.zeros((BUCKETS, k))
    out[used] = theta[:size].reshape(-1, k)
    tail = theta[size:]
    return out, Chain(tail[: k * k].reshape(k, k), tail[k * k : k * k + k], tail[k * k + k :])

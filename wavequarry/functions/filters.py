"""Butterworth filters run forward and backward, with Gustafsson's end conditions (1996), over many signals at once.

A pass is a linear recurrence, which runs in blocks of samples: a block's output is one matrix product of its input and another of the state that
the block before hands on, and so is the state it hands on itself. Signals of different lengths go together, each row padded behind its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Samples of a block; cells of a padded batch; how much longer than the shortest signal of a batch its longest may be.
BLOCK, CELLS, RATIO = 64, 1 << 21, 1.25


def butterworth_coefficients(order: int, low: float, high: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital filter by the bilinear transform; edges as shares of the Nyquist frequency."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    first, last = 4 * np.tan(np.pi * low / 2), 4 * np.tan(np.pi * high / 2)
    width, middle = last - first, np.sqrt(first * last)

    def both(p: np.ndarray) -> np.ndarray:
        root = np.sqrt(p * p - middle * middle)
        return np.r_[p + root, p - root]

    if kind == "low":
        zeros, poles, gain = np.empty(0), last * poles, last**order
    elif kind == "high":
        zeros, poles, gain = np.zeros(order), first / poles, 1.0
    elif kind == "stop":
        zeros, poles, gain = np.r_[np.full(order, 1j * middle), np.full(order, -1j * middle)], both(width / 2 / poles), 1.0
    else:
        zeros, poles, gain = np.zeros(order), both(poles * width / 2), width**order
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    digital = np.r_[(4 + zeros) / (4 - zeros), np.full(len(poles) - len(zeros), -1.0)]
    return gain * np.real(np.poly(digital)), np.real(np.poly((4 + poles) / (4 - poles)))


def stepped(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over the rows of x from the given states, sample by sample (transposed direct form), and the states behind it."""
    y, state = np.empty_like(x), state.copy()
    for i in range(x.shape[1]):
        y[:, i] = b[0] * x[:, i] + state[:, 0]
        state[:, :-1] = state[:, 1:] + np.outer(x[:, i], b[1:-1]) - np.outer(y[:, i], a[1:-1])
        state[:, -1] = b[-1] * x[:, i] - a[-1] * y[:, i]
    return y, state


@lru_cache(maxsize=256)
def block_matrices(b: tuple, a: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: input to output, state to output, input to next state, state to next state."""
    m, b, a = len(a) - 1, np.array(b), np.array(a)
    of_state, next_state = stepped(b, a, np.zeros((m, size)), np.eye(m))
    impulse, _ = stepped(b, a, np.eye(1, size), np.zeros((1, m)))
    into = np.array([np.r_[np.zeros(i), impulse[0, : size - i]] for i in range(size)])
    _, reached = stepped(b, a, np.eye(size), np.zeros((size, m)))
    return into, of_state, reached, next_state


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One pass over the rows of x from the given states."""
    y, n = np.empty_like(x), x.shape[1]
    for i in range(0, n, BLOCK):
        into, of_state, reached, next_state = block_matrices(tuple(b), tuple(a), BLOCK if n - i >= BLOCK else n - i)
        part = x[:, i : i + BLOCK]
        y[:, i : i + BLOCK] = part @ into + state @ of_state
        state = part @ reached + state @ next_state
    return y


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different lengths as one matrix with zeros behind them, and their lengths."""
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = np.concatenate(rows) if rows else 0
    return out, n


def reversed_rows(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each row's first n samples backwards, zeros behind them."""
    at = n[:, None] - 1 - np.arange(x.shape[1])
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), 1), 0.0)


@lru_cache(maxsize=4096)
def end_states(b: tuple, a: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of signals of n samples: from the difference of both orders of passes to the two end states, and from these to what they add."""
    m, b, a = len(a) - 1, np.array(b), np.array(a)
    answer = filtered(b, a, np.zeros((m, n)), np.eye(m))  # to each unit state, without input
    answered = filtered(b, a, answer[:, ::-1], np.zeros((m, m)))
    both = np.vstack([answered[:, ::-1] - answer, answer[:, ::-1] - answered])  # what the states change in the difference of the orders
    return np.linalg.pinv(both.T, rcond=np.finfo(float).eps * n).T, np.vstack([answered[:, ::-1], answer[:, ::-1]])


def together(signals: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of signals that fit into one padded matrix, of similar lengths."""
    held: list[int] = []
    for i in sorted(range(len(signals)), key=lambda i: len(signals[i])):
        if held and (len(signals[i]) > RATIO * len(signals[held[0]]) + BLOCK or len(signals[i]) * (len(held) + 1) > CELLS):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def forward_backward(b: np.ndarray, a: np.ndarray, signals: list[np.ndarray]) -> list[np.ndarray]:
    """Both passes over each signal. The states at the two ends are those for which the order of the passes matters least."""
    out: list[np.ndarray] = [np.empty(0)] * len(signals)
    for some in together(signals):
        x, n = padded([signals[i] for i in some])
        rest = np.zeros((len(x), len(a) - 1))
        fb = reversed_rows(filtered(b, a, reversed_rows(filtered(b, a, x, rest), n), rest), n)
        bf = filtered(b, a, reversed_rows(filtered(b, a, reversed_rows(x, n), rest), n), rest)
        for length in np.unique(n):
            rows = np.flatnonzero(n == length)
            fit, add = end_states(tuple(b), tuple(a), int(length))
            y = fb[rows, :length] + (bf[rows, :length] - fb[rows, :length]) @ fit @ add
            for r, v in zip(rows, y):
                out[some[r]] = v
    return out


def steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which a constant input of 1 gives a constant output."""
    rest = b[1:] - a[1:] * (b.sum() / a.sum())
    return np.cumsum(rest[::-1])[::-1]


def padded_forward_backward(b: np.ndarray, a: np.ndarray, signals: list[np.ndarray]) -> list[np.ndarray]:
    """Both passes over signals that are extended oddly by three times the coefficients, from steady states."""
    pad, zi = 3 * len(a), steady(b, a)
    out: list[np.ndarray] = [np.empty(0)] * len(signals)
    for some in together(signals):
        if len(signals[some[0]]) <= pad:
            raise ValueError(f"signals need more than {pad} samples")
        y, n = padded([np.pad(signals[i], pad, mode="reflect", reflect_type="odd") for i in some])
        for _ in range(2):
            y = reversed_rows(filtered(b, a, y, y[:, :1] * zi), n)
        for i, row, length in zip(some, y, n):
            out[i] = row[pad : length - pad]
    return out

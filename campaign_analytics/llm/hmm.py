"""Scaled forward and backward recursions of a hidden Markov model, for many sequences at once.

Sequences are cut into chunks of bounded length, so that the steps of a recursion stay few and
wide however long a text is.  The state distribution at a chunk's start, and what follows its
end, come from the product of the transfer matrices of the chunks before and after it, which is
exact: the recursions inside a chunk then run as if the sequence were never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Tokens of a chunk at most, and tokens worked on at once.
CHUNK = 4096
BLOCK = 1 << 18


@dataclass
class Chain:
    """``start``: distribution of the state before the first token; ``moves[a, b]``: probability of b after a."""

    start: np.ndarray
    moves: np.ndarray

    @classmethod
    def sticky(cls, states: int, stay: float) -> Chain:
        moves = np.full((states, states), (1 - stay) / states) + stay * np.eye(states)
        return cls(np.full(states, 1 / states), moves)

    @classmethod
    def from_counts(cls, start: np.ndarray, moves: np.ndarray, firmness: float = 1.0) -> Chain:
        """Expected counts to probabilities; ``firmness`` counts are spread evenly over each row."""
        even = firmness / len(start)
        start, moves = start + even, moves + even
        return cls(start / start.sum(), moves / moves.sum(axis=1, keepdims=True))


@dataclass
class Counts:
    """Expected counts: of each state per word, of moves between states, and of states before the first token."""

    words: np.ndarray
    moves: np.ndarray
    start: np.ndarray


class _Layout:
    """Sequences by position: all first tokens, then all second ones, and so on, longest sequences first."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths  # descending
        n = int(lengths.sum())
        owner = np.repeat(np.arange(len(lengths)), lengths)
        position = np.arange(n) - (np.cumsum(lengths) - lengths)[owner]
        alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths.max(initial=0))), "right")
        self.edges = np.concatenate(([0], np.cumsum(alive)))
        place = self.edges[position] + owner
        self.source = np.empty(n, np.int64)  # where each token stands in the text
        self.source[place] = starts[owner] + position
        self.owner = np.empty(n, np.int64)
        self.owner[place] = owner
        self.last = self.edges[lengths - 1] + np.arange(len(lengths))

    def steps(self) -> Iterator[tuple[int, int, int]]:
        edges = self.edges.tolist()
        return zip(edges[:-1], edges[1:], [b - a for a, b in zip(edges[1:-1], edges[2:])] + [0])


def _forward(emitted: np.ndarray, layout: _Layout, entry: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and the scales, whose product is a sequence's likelihood."""
    ahead, scale = np.empty_like(emitted), np.empty(len(emitted))
    now = entry
    for a, b, _ in layout.steps():
        now = (now[: b - a] @ moves) * emitted[a:b]
        total = now.sum(axis=1)
        now /= total[:, None]
        ahead[a:b], scale[a:b] = now, total
    return ahead, scale


def _transfers(emitted: np.ndarray, layout: _Layout, moves: np.ndarray) -> np.ndarray:
    """For each sequence the matrix of its probability from each state before it to each state at its end, scaled."""
    states = len(moves)
    out = np.empty((len(layout.lengths), states, states))
    now = np.broadcast_to(np.eye(states), out.shape)
    for a, b, following in layout.steps():
        now = (now[: b - a] @ moves) * emitted[a:b, None, :]
        now /= now.sum(axis=(1, 2), keepdims=True)
        out[following : b - a] = now[following:]
    return out


def _add_counts(
    counts: Counts,
    words: np.ndarray,
    emitted: np.ndarray,
    layout: _Layout,
    chain: Chain,
    entry: np.ndarray,
    leave: np.ndarray,
    first: np.ndarray,
) -> np.ndarray:
    """Add a block's expected counts; returns the scales."""
    ahead, scale = _forward(emitted, layout, entry, chain.moves)
    leave = leave / (ahead[layout.last] * leave).sum(axis=1, keepdims=True)
    shares = np.empty_like(emitted)
    onward = np.empty((0, len(chain.start)))  # emission and future of the next position, scaled
    pairs = np.zeros_like(chain.moves)
    for a, b, following in reversed(list(layout.steps())):
        future = leave[: b - a].copy()
        future[:following] = onward @ chain.moves.T
        shares[a:b] = ahead[a:b] * future
        pairs += ahead[a : a + following].T @ onward
        onward = emitted[a:b] * future / scale[a:b, None]
    pairs += entry.T @ onward
    counts.moves += pairs * chain.moves
    counts.start += (entry * (onward @ chain.moves.T))[first].sum(axis=0)
    for s in range(shares.shape[1]):
        counts.words[:, s] += np.bincount(words, weights=shares[:, s], minlength=len(counts.words))
    return scale


def _chunks(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and owner of the chunks of sequences that follow each other, and their number in their owner."""
    pieces = -(-lengths // most)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
    size = np.minimum(lengths[owner] - number * most, most)
    return (np.cumsum(lengths) - lengths)[owner] + number * most, size, owner, number


def _blocks(lengths: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Chunk numbers, longest first, in blocks of about ``block`` tokens."""
    order = np.argsort(-lengths, kind="stable")
    which = np.cumsum(lengths[order]) // block
    return iter(np.split(order, np.flatnonzero(np.diff(which)) + 1)) if len(order) else iter(())


def _bridge(
    tokens: np.ndarray, emissions: np.ndarray, chain: Chain, chunks: tuple, block: int
) -> tuple[np.ndarray, np.ndarray]:
    """The state distribution before each chunk, and what weighs the states at its end."""
    starts, sizes, owner, number = chunks
    entry = np.broadcast_to(chain.start, (len(starts), len(chain.start))).copy()
    leave = np.ones_like(entry)
    last = np.ones(len(starts), bool)
    last[:-1] = owner[1:] != owner[:-1]
    parted = np.flatnonzero((number > 0) | ~last)
    if not len(parted):
        return entry, leave
    transfer = np.empty((len(parted), len(chain.start), len(chain.start)))
    for some in _blocks(sizes[parted], max(block // 4, 1)):
        layout = _Layout(starts[parted[some]], sizes[parted[some]])
        transfer[some] = _transfers(emissions[tokens[layout.source]], layout, chain.moves)
    at = np.full(len(starts), -1)
    at[parted] = np.arange(len(parted))
    order = np.argsort(number[parted], kind="stable")
    levels = np.split(parted[order], np.flatnonzero(np.diff(number[parted][order])) + 1)
    for level in levels:  # the first chunks of all texts, then the second ones
        go = level[~last[level]]
        entry[go + 1] = (entry[go, None, :] @ transfer[at[go]])[:, 0]
        entry[go + 1] /= entry[go + 1].sum(axis=1, keepdims=True)
    for level in reversed(levels):
        back = level[number[level] > 0]
        leave[back - 1] = (transfer[at[back]] @ leave[back, :, None])[:, :, 0]
        leave[back - 1] /= leave[back - 1].sum(axis=1, keepdims=True)
    return entry, leave


def log_likelihoods(
    tokens: np.ndarray,
    lengths: np.ndarray,
    emissions: np.ndarray,
    chain: Chain,
    counts: Counts | None = None,
    chunk: int = CHUNK,
    block: int = BLOCK,
) -> np.ndarray:
    """Natural logarithm of each sequence's probability; its expected counts are added to ``counts``.

    ``tokens`` are the word numbers of all sequences one after the other, ``emissions[w, s]`` is
    the probability of word w in state s.  No sequence is empty.
    """
    chunks = starts, sizes, owner, number = _chunks(lengths, chunk)
    entry, leave = _bridge(tokens, emissions, chain, chunks, block)
    out = np.zeros(len(lengths))
    for some in _blocks(sizes, block):
        layout = _Layout(starts[some], sizes[some])
        words = tokens[layout.source]
        emitted = emissions[words]
        if counts is None:
            _, scale = _forward(emitted, layout, entry[some], chain.moves)
        else:
            first = number[some] == 0
            scale = _add_counts(counts, words, emitted, layout, chain, entry[some], leave[some], first)
        out += np.bincount(owner[some][layout.owner], weights=np.log(scale), minlength=len(out))
    return out


def expected_counts(
    tokens: np.ndarray, lengths: np.ndarray, emissions: np.ndarray, chain: Chain, **sizes: int
) -> tuple[Counts, float]:
    """The expectation step of Baum-Welch, and the log-likelihood of all sequences."""
    counts = Counts(np.zeros_like(emissions), np.zeros_like(chain.moves), np.zeros_like(chain.start))
    return counts, float(log_likelihoods(tokens, lengths, emissions, chain, counts, **sizes).sum())

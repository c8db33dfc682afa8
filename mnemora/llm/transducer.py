"""Finite transducers over symbol arrays, run as compositions of state-transition functions."""

from __future__ import annotations

import numpy as np

#: Symbols of a chunk.
CHUNK = 256


def states_before(table: np.ndarray, symbols: np.ndarray, start: int = 0) -> np.ndarray:
    """The state before each symbol; ``table[symbol, state]`` is the state after it.

    Each chunk becomes the function from its first state to its last, all chunks at once; a parallel prefix scan composes
    these functions in logarithmic rounds, which gives every chunk's first state; then all chunks run from theirs.
    A document's length hence costs no more steps in a row than a chunk has symbols, plus the rounds.
    """
    n, k = len(symbols), table.shape[1]
    if not n:
        return np.zeros(0, np.uint8)
    table = np.vstack([table, np.arange(k)]).astype(np.uint8)  # a last symbol that changes nothing fills up
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, len(table) - 1, np.intp)
    grid[:n] = symbols
    grid = grid.reshape(chunks, CHUNK)
    ends = np.tile(np.arange(k, dtype=np.uint8), (chunks, 1))
    for i in range(CHUNK):
        ends = table[grid[:, i, None], ends]
    hop = 1
    while hop < chunks:  # ends[c] becomes the function of all chunks up to c
        ends[hop:] = np.take_along_axis(ends[hop:], ends[:-hop].copy(), axis=1)
        hop *= 2
    state = np.empty(chunks, np.uint8)
    state[0], state[1:] = start, ends[:-1, start]
    out = np.empty((chunks, CHUNK), np.uint8)
    for i in range(CHUNK):
        out[:, i] = state
        state = table[grid[:, i], state]
    return out.ravel()[:n]

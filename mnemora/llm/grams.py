"""Character n-grams of many texts at once, as hashed keys in arrays, and naive Bayes on them."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
LONGEST = 4


def letters(text: str) -> str:
    """Letters and marks without case, words apart by single spaces, with one at each end; nothing of a text without any."""
    bare = re.sub(r"[\W\d_]+", " ", unicodedata.normalize("NFC", text).lower()).strip()
    return f" {bare} " if bare else ""


def chained(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The key of a string that goes on with a character."""
    with np.errstate(over="ignore"):
        h = (h * _P + code + np.uint64(1)) * _Q
        return h ^ (h >> np.uint64(29))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together, and the length of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), np.array([len(t) for t in texts], np.int64)


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams up to LONGEST letters, and the text of each; ascending by text."""
    c, n = codes([letters(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(c))
    found, of = [], []
    h = np.zeros(len(c), np.uint64)
    for k in range(1, LONGEST + 1):
        h = chained(h[: len(h) - (k > 1)], c[k - 1 :]) if k > 1 else chained(h, c)
        valid = left[: len(h)] >= k
        if k == 1:
            valid &= c != 32
        found.append(h[valid])
        of.append(owner[: len(h)][valid])
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return found[order], of[order]


class Bayes:
    """Naive Bayes with additive smoothing over n-grams."""

    def __init__(self, alpha: float = 0.02):
        self.alpha, self.parts = alpha, {}

    def add(self, label: str, found: np.ndarray) -> None:
        self.parts.setdefault(label, []).append(found)

    def freeze(self) -> Bayes:
        """Turns n-grams into one matrix of logs, a row each and a column a label; the last row is of unknown ones."""
        return self.counted({x: np.unique(np.concatenate(found), return_counts=True) for x, found in self.parts.items()})

    def counted(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], sizes: dict[str, int] | None = None, different: int | None = None) -> Bayes:
        """From the keys of each label and how often it has them; where these are a part, ``sizes`` and ``different`` are of all."""
        self.labels = sorted(counts)
        counted = [counts[x] for x in self.labels]
        self.known = np.unique(np.concatenate([k for k, _ in counted])) if counted else np.zeros(0, np.uint64)
        logs = np.full((len(self.known) + 1, len(self.labels)), self.alpha)
        for j, (k, n) in enumerate(counted):
            logs[np.searchsorted(self.known, k), j] += n
        size = np.array([(sizes[x] if sizes else n.sum()) + self.alpha * (len(self.known) if different is None else different) + self.alpha for x, (_, n) in zip(self.labels, counted)])
        self.logs = np.log(logs / size).astype(np.float32)
        self.parts = {}
        return self

    def logliks(self, found: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
        """Of each text, a row each, in each language, a column each."""
        out = np.zeros((texts, len(self.labels)))
        if not len(found) or not len(self.labels):
            return out
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        at[self.known[at] != found] = len(self.known)
        for j in range(len(self.labels)):
            out[:, j] = np.bincount(of, self.logs[at, j], texts)
        return out

"""Byte-level BPE of whole corpora, merged with segment trees over adjacent pair ranks.

Texts are cut into pieces by the tokenizer's pattern. A piece's merges are found by a segment tree whose leaves are its
positions, each with the rank of the pair that starts there, and whose root is hence the leftmost pair of lowest rank;
a merge changes three leaves, so that a piece of n bytes costs O(n log n) however long it is. The trees of all new
pieces of a batch advance together, one merge each a step, as numpy arrays; pieces that were seen before are looked up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that cuts texts into pieces, part of the tokenizer's definition.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Seen pieces that a worker keeps at most; beyond it starts anew, which costs time only.
SEEN_MOST = 400_000
#: Leaves of the trees that advance together.
LEAVES = 1 << 19
_NONE = np.iinfo(np.int64).max


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class Encoder:
    """Pieces to ids by the vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[x] for x in _byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pieces = regex.compile(PATTERN).findall
        self.seen: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1 where it doesn't merge."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        rank = self._rank(a, b)
        return np.where(rank < 0, _NONE, rank * n + at)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. All pieces share one tree size, the power of two that holds the longest."""
        count, longest = len(pieces), max(map(len, pieces))
        n = 1 << max(1, (longest - 1).bit_length())
        size = np.fromiter(map(len, pieces), np.int64, count)
        ids = np.full((count, n + 1), -1, np.int64)  # the last column is the end of every piece
        inside = np.arange(n + 1) < size[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        spot = np.arange(n + 1)
        after = np.where(inside, spot + 1, n)
        after[np.arange(count), np.maximum(size - 1, 0)] = n
        before = np.broadcast_to(spot - 1, (count, n + 1)).copy()
        tree = np.full((count, 2 * n), _NONE, np.int64)
        has = inside[:, :-1] & inside[:, 1:]
        row, col = np.nonzero(has)
        tree[row, n + col] = self._leaf(ids[row, col], ids[row, col + 1], col, n)
        level = n
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.nonzero(tree[:, 1] != _NONE)[0]
        while len(live):
            rank, at = np.divmod(tree[live, 1], n)
            gone = after[live, at]
            then = after[live, gone]
            prior = before[live, at]
            new = self.merged[rank]
            ids[live, at], ids[live, gone], after[live, at], before[live, then] = new, -1, then, at
            tree[live, n + gone] = _NONE
            ok = then < n
            tree[live, n + at] = np.where(ok, self._leaf(new, ids[live, then], at, n), _NONE)
            held = prior >= 0
            p = prior[held]
            tree[live[held], n + p] = self._leaf(ids[live[held], p], new[held], p, n)
            node = np.stack([at, gone, np.where(held, prior, at)], 1) + n
            rows = live[:, None]
            while node[0, 0] > 1:
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] != _NONE]
        return [x[x >= 0] for x in ids[:, :-1]]

    def learn(self, new: list[str]) -> None:
        """Encodes pieces that weren't seen before, those of like lengths together."""
        raw = sorted(((x.encode("utf-8", "replace"), x) for x in new), key=lambda p: len(p[0]))
        i = 0
        while i < len(raw):
            n = 1 << max(1, (len(raw[i][0]) - 1).bit_length())
            j = i
            while j < len(raw) and len(raw[j][0]) <= n and (j - i) * n < LEAVES:
                j += 1
            j = max(j, i + 1)
            for (_, x), ids in zip(raw[i:j], self.merge([b for b, _ in raw[i:j]])):
                self.seen[x] = ids.astype(np.int32).tobytes()
            i = j

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes; a null or empty text has none."""
        if len(self.seen) > SEEN_MOST:
            self.seen.clear()
        cut = [self.pieces(t) if t else [] for t in texts]
        if new := set(chain.from_iterable(cut)).difference(self.seen):
            self.learn(list(new))
        get = self.seen.__getitem__
        return [b"".join(map(get, x)) for x in cut]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches(batches: Iterator[pa.RecordBatch], path: str, most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most most_chars of text, unless one text alone has more, and their ids."""
    enc = encoder(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= most_chars):
                chars += len(texts[j] or "")
                j += 1
            yield batch.slice(i, j - i), enc.encode(texts[i:j])
            i = j


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id, ids array<int>)`` of every row: the ids of its text without special tokens.

    A null or empty text has an empty list; what looks like a special token is ordinary text; repeated rows stay
    repeated. Reads two columns, without a shuffle. The tokenizer's file must be at ``path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _batches(batches, path):
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    narrow = docs.select(F.col(id_col), F.col(text_col))
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, ids array<int>")


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(id, tokens)`` of every row: how many ids its text has; none if it is null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _batches(batches, path):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())], [id_col, "tokens"])

    narrow = docs.select(F.col(id_col), F.col(text_col))
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, tokens bigint")

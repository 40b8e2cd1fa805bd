"""Huffman trees of index symbols, as parallel arrays, and their codes.

A tree is made from add-one counts, so every symbol has a code and the tree of one vector can encode any other of its
width. Of parentless nodes the two least by (weight, node) are joined, the first as left; leaves are nodes 0 to levels - 1.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np

#: Fixed value: no link.
NONE = 0xFFFFFFFF


@dataclass(frozen=True)
class Tree:
    parent: tuple[int, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    root: int

    @property
    def levels(self) -> int:
        return len(self.parent) // 2


def build_tree(counts) -> Tree:
    levels = len(counts)
    parent, left, right = ([NONE] * (2 * levels) for _ in range(3))
    heap = [(int(n) + 1, node) for node, n in enumerate(counts)]
    heapq.heapify(heap)
    for node in range(levels, 2 * levels - 1):
        (a, left[node]), (b, right[node]) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left[node]] = parent[right[node]] = node
        heapq.heappush(heap, (a + b, node))
    return Tree(tuple(parent), tuple(left), tuple(right), 2 * levels - 2)


def symbol_counts(idx: np.ndarray, levels: int) -> np.ndarray:
    """How often each symbol below ``levels`` occurs; without any, symbol 0 counts once."""
    counts = np.bincount(idx[idx < levels], minlength=levels)
    return counts if counts.sum() else np.eye(1, levels, dtype=np.int64)[0]


def codes(tree: Tree) -> list[tuple[int, ...]]:
    """The bits of each symbol from the root down, right being 1."""
    out = []
    for node in range(tree.levels):
        path = []
        while (up := tree.parent[node]) != NONE:
            path.append(int(tree.right[up] == node))
            node = up
        out.append(tuple(reversed(path)))
    return out


def fingerprint(tree: Tree, bit_width: int, generation: int, policy_id: int) -> str:
    """A collision-resistant tag of a tree in use; hex of SHA-256 over its little-endian links and identifiers."""
    links = np.array([*tree.parent, *tree.left, *tree.right, tree.root], "<u4").tobytes()
    rest = bit_width.to_bytes(1, "little") + len(tree.parent).to_bytes(8, "little") + generation.to_bytes(8, "little", signed=True) + policy_id.to_bytes(8, "little", signed=True)
    return hashlib.sha256(links + rest).hexdigest()


def encode(idx: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(words, written bits) of rows of symbols; a row's capacity is ``levels`` bits for each symbol."""
    rows, dim = idx.shape
    found = codes(tree)
    size = np.array([len(c) for c in found])
    bits = np.zeros((tree.levels, max(1, size.max())), np.uint8)
    for symbol, code in enumerate(found):
        bits[symbol, : len(code)] = code
    lengths = size[idx]
    starts = np.cumsum(lengths, 1) - lengths
    words = -(-dim * tree.levels // 32)
    out = np.zeros((rows, words * 32), np.uint8)
    row = np.arange(rows)[:, None]
    for at in range(bits.shape[1]):
        live = lengths > at
        out[np.broadcast_to(row, idx.shape)[live], (starts + at)[live]] = bits[idx[live], at]
    return np.packbits(out, axis=1, bitorder="little").view("<u4").astype(np.int64), lengths.sum(1)


def decode(words: np.ndarray, written: np.ndarray, dim: int, tree: Tree) -> np.ndarray:
    """Rows of symbols; -1 from where a row's bits end too early. All rows walk the tree together."""
    bits = np.unpackbits(words.astype("<u4").view(np.uint8), axis=1, bitorder="little")
    left, right = np.array(tree.left), np.array(tree.right)
    at, out = np.zeros(len(words), np.int64), np.full((len(words), dim), -1, np.int32)
    for symbol in range(dim):
        node = np.full(len(words), tree.root)
        while (live := np.flatnonzero((left[node] != NONE) & (at < written))).size:
            bit = bits[live, at[live]]
            node[live] = np.where(bit, right[node[live]], left[node[live]])
            at[live] += 1
        out[:, symbol] = np.where(left[node] == NONE, node, -1)
    return out

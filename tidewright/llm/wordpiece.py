"""Counts of word pieces by a linear longest-match automaton, without building the pieces.

The vocabulary is a trie over two roots, one for pieces that begin a word and one for pieces
that continue it. Each node has a failure link, to the node for what is left once the longest
pieces known so far are taken off, and the number of pieces taken. Reading a word follows edges
and failure links and adds these numbers: each character is looked at once.
"""

from __future__ import annotations

import unicodedata
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, map_batches, slices
from .pieces import PIECE_BPE, SPACE, piece_model
from .tokens import Recent, vocabulary


class Automaton:
    """begin: pieces that begin a word; follow: pieces that continue one."""

    def __init__(self, begin: set[str], follow: set[str], most: int = 200_000):
        self.edges: list[dict[str, int]] = [{}, {}]
        last = [False, False]
        for root, words in ((0, begin), (1, follow)):
            for w in sorted(x for x in words if x):
                at = root
                for c in w:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        last.append(False)
                    at = self.edges[at][c]
                last[at] = True
        self.link, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        todo = deque((0, 1))
        while todo:
            u = todo.popleft()
            for c, v in self.edges[u].items():
                todo.append(v)
                if last[v]:
                    self.link[v], self.popped[v] = 1, 1
                    continue
                z, n = self.link[u], self.popped[u]
                while z >= 0 and c not in self.edges[z]:
                    n += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.edges[z][c], n
        self.chunks = Recent(self._chunk, most)

    def word(self, w: str) -> int:
        """How many pieces greedy longest match gives; 1, the unknown piece, if it gives none."""
        edges, link, popped = self.edges, self.link, self.popped
        at = n = 0
        for c in w:
            while (to := edges[at].get(c)) is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:
            n += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return n

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.word, words(chunk)))

    def text(self, s: str) -> int:
        return sum(map(self.chunks.__getitem__, s.replace("\n", " ").split(" ")))


def words(s: str) -> list[str]:
    """Words between white space; each punctuation mark is a word of its own."""
    out: list[str] = []
    for part in s.split():
        start = 0
        for i, c in enumerate(part):
            if not c.isalnum() and (c in "$+<=>^`|~" or unicodedata.category(c)[0] == "P"):
                out += [x for x in (part[start:i], c) if x]
                start = i + 1
        if start < len(part):
            out.append(part[start:])
    return out


_held: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """From a piece file: pieces with a space mark begin words, the others continue them."""
    if path not in _held:
        ids = piece_model(path).id
        _held[path] = Automaton({p[1:] for p in ids if p.startswith(SPACE)}, {p for p in ids if not p.startswith(SPACE)})
    return _held[path]


def count_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each row of `docs` (doc_id, text).

    Null and empty texts have 0 tokens; words that the vocabulary can't spell count 1 token.
    Words may have any length. Repeated rows come back each; other columns are not looked at.
    """
    path = path or vocabulary(PIECE_BPE)

    def run(batches: Batches) -> Batches:
        a = automaton(path)
        for b in slices(batches):
            n = [a.text(x) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long")

"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary piece at each place of a word.
The vocabulary is a trie.  Where the trie has no next edge, the failure link of the node says
how many pieces the automaton has certainly passed (the popped count, computed when the
links are built) and in which node the rest of them continues.  Each byte is read once and
the number of pieces is the sum of popped counts; no piece is ever built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, with_keys

_UNKNOWN = 1 << 40


class LongestMatch:
    """``first``: pieces that may start a word; ``rest``: pieces that may continue one
    (None: the same ones)."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes] | None = None):
        self.child: list[dict[int, int]] = [{}]
        self.more = 0                                   # the node in which a word goes on
        ends: set[int] = set()
        if rest is not None:
            self.more = self._node()
            for p in rest:
                self._add(self.more, p, ends)
        for p in first:
            self._add(0, p, ends)
        self._link(ends)

    def _node(self) -> int:
        self.child.append({})
        return len(self.child) - 1

    def _add(self, node: int, piece: bytes, ends: set[int]) -> None:
        if not piece:
            return
        for c in piece:
            nxt = self.child[node].get(c)
            if nxt is None:
                nxt = self.child[node][c] = self._node()
            node = nxt
        ends.add(node)

    def _link(self, ends: set[int]) -> None:
        n = len(self.child)
        self.fail, self.pops = [-1] * n, [0] * n
        level = [0] if self.more == 0 else [0, self.more]
        while level:                                    # by depth: links point to shallower nodes
            below = []
            for v in level:
                for c, u in self.child[v].items():
                    below.append(u)
                    if u in ends:
                        self.fail[u], self.pops[u] = self.more, 1
                        continue
                    z, pops = self.fail[v], self.pops[v]
                    while z >= 0 and c not in self.child[z]:
                        pops += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[u], self.pops[u] = self.child[z][c], pops
            level = below

    @property
    def tables(self) -> tuple:
        return self.child, self.fail, self.pops, self.more

    def length(self, word: bytes) -> int:
        return match_length(self.tables, word)


def match_length(tables: tuple, word: bytes) -> int:
    """Number of pieces, or -1 if the word can't be split greedily."""
    child, fail, pops, more = tables
    u = n = 0
    for c in word:
        nxt = child[u].get(c)
        while nxt is None:
            n += pops[u]
            u = fail[u]
            if u < 0:
                return -1
            nxt = child[u].get(c)
        u = nxt
    while u != more and u != 0:
        n += pops[u]
        u = fail[u]
        if u < 0:
            return -1
    return n


class _Lengths(dict):
    """Lengths of words met so far; holds at most ``limit`` words, others are matched
    again.  An unknown word is one token."""

    def __init__(self, tables: tuple, prefix: bytes, limit: int):
        self.tables, self.prefix, self.limit = tables, prefix, limit

    def __missing__(self, word: bytes) -> int:
        n = match_length(self.tables, self.prefix + word)
        n = n if n >= 0 else _UNKNOWN + 1
        if len(self) < self.limit and len(word) <= 64:
            self[word] = n
        return n


def rank_file(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks, one per line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def token_counts(docs: DataFrame, automaton: LongestMatch, prefix: bytes = b"", id_col: str = "doc_id",
                 text_col: str = "text", cache_words: int = 200_000) -> DataFrame:
    """(id, th, n_words, n_tokens, n_unknown) per input row.

    Words are runs of other bytes than space and 9 to 13; ``prefix`` is put before each, as in
    vocabularies whose word-initial pieces begin with a space.  A word that can't be split is
    one unknown token.  Null and empty texts have no words; texts and words of any length are
    read whole; repeated rows are counted each; an empty table gives an empty result; other
    columns are not read.  The automaton is broadcast: its size is the vocabulary's, not the data's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton.tables)
    held: list[_Lengths] = []

    def run(c):
        if not held:
            held.append(_Lengths(shared.value, prefix, cache_words))
        lengths = held[0]
        words, tokens = [], []
        for t in c["text"].to_pylist():
            w = t.split()
            words.append(len(w))
            tokens.append(sum(map(lengths.__getitem__, w)))
        got = np.array(tokens, dtype=np.int64)
        return {"id": c["id"], "th": c["th"], "n_words": np.array(words, dtype=np.int64),
                "n_tokens": got % _UNKNOWN, "n_unknown": got // _UNKNOWN}
    return map_batches(with_keys(docs, id_col, text_col), run,
                       "id long, th long, n_words long, n_tokens long, n_unknown long")

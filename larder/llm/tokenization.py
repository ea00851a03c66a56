"""Encoding of a corpus with a public byte-level BPE vocabulary, by prefix-sharing trie traversal.

A text is split by the vocabulary's pattern into pieces; merges never cross a piece, and a corpus has few
distinct pieces. Distinct pieces are inserted into a trie of bytes. For a prefix p the encoding of p ends
in exactly one token t such that the encoding of p without t ends in a token that is compatible with t
(encoding the two together gives the two back). So a node of the trie needs one state, the last token of
the encoding of its prefix, computed from its ancestors' states in depth-first order: prefixes shared by
many pieces are encoded once, and a piece's ids are read off by following last tokens back to the root.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Nodes of a task's trie beyond which it is begun anew; bounds memory, changes no result.
MAX_NODES = 400_000
#: Bytes beyond which a piece is encoded by the same recurrence along its own path, outside the trie.
MAX_DEPTH = 512


class TrieEncoder:
    """Encodes pieces of text; keeps the trie of all prefixes seen and the ids of all pieces seen."""

    def __init__(self, ranks: dict[bytes, int], max_nodes: int = MAX_NODES):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.max_nodes = max_nodes
        self.split = regex.compile(PATTERN).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits = lru_cache(maxsize=1_000_000)(self._fits)
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]
        self.known: dict[str, list[int]] = {}

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: replay of the merges of lower rank; None for a byte."""
        if token not in self.halves:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]])
                    if r is not None and r < token and (best is None or r < best):
                        best, at = r, i
                parts[at : at + 2] = [best]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` stays as it is when both are encoded together.

        Only merges across the border can change it. Going back through the merges of the two, at
        each step the later merge is undone on its side; a merge across the border that would have
        come before it (or, at equal rank, further left) breaks the pair.
        """
        limit = 1 << 62
        ranks, text = self.ranks, self.bytes_of
        while True:
            across = ranks.get(text[left] + text[right])
            if across is not None and across < limit:
                return False
            if left > right:
                halves = self._parts(left)
                limit = left
                if halves is None:
                    return True
                left = halves[1]
            else:
                halves = self._parts(right)
                limit = right + 1
                if halves is None:
                    return True
                right = halves[0]

    def _state(self, piece: bytes, depth: int, before: list[int]) -> int:
        """The last token of the encoding of ``piece[:depth]``; ``before`` has that of every shorter prefix."""
        for length in range(min(depth, self.longest), 0, -1):
            token = self.ranks.get(piece[depth - length : depth])
            if token is not None and (length == depth or self.fits(before[depth - length], token)) and self._whole(token):
                return token
        raise AssertionError("every byte is a token")

    def _insert(self, piece: bytes) -> list[int]:
        """The ids of ``piece``; states are computed for new nodes only, deeper ones from their ancestors."""
        states = [-1]
        if len(piece) > MAX_DEPTH:
            for depth in range(1, len(piece) + 1):
                states.append(self._state(piece, depth, states))
        else:
            node = 0
            children, last = self.children, self.last
            for depth, byte in enumerate(piece, 1):
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = len(last)
                    children[node][byte] = nxt
                    children.append({})
                    last.append(self._state(piece, depth, states))
                node = nxt
                states.append(last[node])
        ids, depth = [], len(piece)
        while depth:
            token = states[depth]
            ids.append(token)
            depth -= len(self.bytes_of[token])
        ids.reverse()
        return ids

    @lru_cache(maxsize=100_000)  # noqa: B019
    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it (a vocabulary may hold tokens no merge reaches)."""
        halves = self._parts(token)
        return halves is None or self.ranks.get(self.bytes_of[halves[0]] + self.bytes_of[halves[1]]) == token

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text. New distinct pieces enter the trie in sorted order, so shared prefixes meet."""
        if len(self.last) > self.max_nodes:
            self._clear()
        pieces = [self.split(t) if t else [] for t in texts]
        known = self.known
        for piece in sorted({p for ps in pieces for p in ps} - known.keys()):
            known[piece] = self._insert(piece.encode("utf-8", "replace"))
        return [[i for p in ps for i in known[p]] for ps in pieces]


def load_ranks(name: str, root: str = TOKENIZERS) -> dict[bytes, int]:
    """The vocabulary ``name`` (a .tiktoken file of ranks) of the tokenizer folder."""
    with open(f"{root}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(name: str, root: str) -> TrieEncoder:
    """One encoder per worker process; it lives across batches."""
    return TrieEncoder(load_ranks(name, root))


def encode(documents: DataFrame, text: str, tokenizer: str = "byte_bpe_50k", root: str = TOKENIZERS, ids: str = "ids") -> DataFrame:
    """``documents`` with ``ids``: the token ids of ``text`` without special tokens; a column of that name is replaced.

    Null and empty texts give an empty list. No shuffle: each task builds the trie of its own pieces.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer, root)
        for batch in batches:
            yield pd.Series(enc.encode_batch([t if isinstance(t, str) else None for t in batch]))

    return documents.withColumn(ids, F.pandas_udf(run, "array<int>")(F.col(text)))


def token_counts(documents: DataFrame, text: str, tokenizer: str = "byte_bpe_50k", root: str = TOKENIZERS, count: str = "n_tokens") -> DataFrame:
    """``documents`` with the number of tokens of ``text``; 0 for null and empty texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer, root)
        for batch in batches:
            yield pd.Series([len(x) for x in enc.encode_batch([t if isinstance(t, str) else None for t in batch])], dtype="int32")

    return documents.withColumn(count, F.pandas_udf(run, "int")(F.col(text)))

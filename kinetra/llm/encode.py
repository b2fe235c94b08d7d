"""Encoding with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function that needs it.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokenizer's pattern (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a Python worker remembers, and the longest of them in bytes.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
#: Characters of text that are encoded at a time.
CHUNK = 2_000_000
_NEVER = np.int64(1) << 40


class Vocabulary:
    """Token bytes by rank, the merge that makes each token, and the longest-match index."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        n = max(self.rank.values()) + 1
        self.longest = max(map(len, self.rank))
        self.prefixes = {token[:k] for token in self.rank for k in range(1, len(token))}
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1 and len(parts := self._merged(token, rank)) == 2:
                self.left[rank], self.right[rank] = parts
        made = np.flatnonzero(self.left >= 0)
        self.n = n
        keys = self.left[made] * n + self.right[made]
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]

    def _merged(self, word: bytes, below: int | None = None) -> list[int]:
        """The word's ids by exact merging: always the lowest rank first, the leftmost of equals. below: only merges of lower ranks."""
        n = len(word)
        start, end = list(range(n)), list(range(1, n + 1))  # the piece that begins at i ends at end[i]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        limit = len(self.rank) + 1 if below is None else below

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.rank.get(word[i : end[j]])) is not None and r < limit:
                heapq.heappush(queue, (r, i, end[i], end[j]))

        queue: list[tuple[int, int, int, int]] = []
        for i in start:
            offer(i)
        while queue:
            _, i, mid, stop = heapq.heappop(queue)
            j = after[i]
            if end[i] != mid or j != mid or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while 0 <= i < n:
            ids.append(self.rank[word[i : end[i]]])
            i = after[i]
        return ids

    def _greedy(self, word: bytes) -> list[int]:
        """Speculation: the longest token at each place."""
        if (whole := self.rank.get(word)) is not None:
            return [whole]
        ids, i, n = [], 0, len(word)
        rank, prefixes = self.rank, self.prefixes
        while i < n:
            best, at, stop = rank[word[i : i + 1]], i + 1, i + 1
            while stop < n and word[i:stop] in prefixes:
                stop += 1
                if (r := rank.get(word[i:stop])) is not None:
                    best, at = r, stop
            ids.append(best)
            i = at
        return ids

    def _product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that merges a and b, or _NEVER."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when the bytes of both are merged together.

        Both tokens are taken apart step by step, always the one that was made last, along the border. At every step
        the two pieces at the border must not merge before they are used up in their own tokens.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        todo = np.arange(len(a))
        limit = np.full(len(a), _NEVER)
        while len(todo):
            clash = self._product(a, b) < limit
            good[todo[clash]] = False
            keep = ~clash
            a, b, limit, todo = a[keep], b[keep], limit[keep], todo[keep]
            la, rb = self.right[a], self.left[b]
            # a piece of one byte can't be taken apart
            take_a = (la >= 0) & ((a >= b) | (rb < 0))
            take_b = (rb >= 0) & ~take_a
            # at equal ranks the left one of two equal merges comes first
            limit = np.where(take_a, a, np.where(take_b, b + 1, limit))
            a, b = np.where(take_a, la, a), np.where(take_b, rb, b)
            going = take_a | take_b
            a, b, limit, todo = a[going], b[going], limit[going], todo[going]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: speculation, one vectorised check of all adjacent pairs, exact merging of what fails."""
        proposed = [self._greedy(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        if not sizes.sum():
            return proposed
        flat = np.fromiter((i for ids in proposed for i in ids), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposed)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.n, pairs % self.n)
        for k in np.unique(owner[inner[~good[which]]]):
            proposed[k] = self._merged(words[k])
        return proposed


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Loaded once a Python worker."""
    return Vocabulary(path)


@functools.cache
def _pattern():
    import regex

    return regex.compile(PATTERN)


class Encoder:
    def __init__(self, path: str):
        self.vocabulary, self.known = vocabulary(path), {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [[w.encode("utf-8", "replace") for w in _pattern().findall(t)] for t in texts]
        fresh = list({w for ws in pieces for w in ws if w not in self.known})
        ids = dict(zip(fresh, self.vocabulary.encode_words(fresh)))
        known = self.known
        out = [[i for w in ws for i in (known[w] if w in known else ids[w])] for ws in pieces]
        if len(known) + len(ids) > REMEMBERED:
            known.clear()
        known.update((w, x) for w, x in ids.items() if len(w) <= REMEMBERED_BYTES)
        return out


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(texts: pd.Series, path: str) -> Iterator[tuple[int, list[int]]]:
    """(position, ids) of each text, a bounded amount of text at a time."""
    encoder, at, some, size = _encoder(path), 0, [], 0
    for k, t in enumerate(texts):
        some.append(t or "")
        size += len(some[-1])
        if size > CHUNK or k == len(texts) - 1:
            yield from enumerate(encoder.encode(some), at)
            at, some, size = k + 1, [], 0


def token_ids(text: Column, folder: str = VOCABULARIES, name: str = VOCABULARY) -> Column:
    """array<int>: the ids of each text, without special tokens; their strings are ordinary text.

    The text is cut into words by the vocabulary's pattern; distinct words are encoded by greedy longest match, every
    adjacent pair of tokens is checked for compatibility, and only words with a failing pair are merged exactly. Empty
    and null texts give the empty list. Whole texts are encoded, however long.
    """
    path = os.path.join(folder, name)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(x, np.int32) for _, x in _encoded(texts, path)], dtype=object)

    return ids(text)


def token_count(text: Column, folder: str = VOCABULARIES, name: str = VOCABULARY) -> Column:
    """bigint: the number of token_ids, which stay in the worker."""
    path = os.path.join(folder, name)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for _, x in _encoded(texts, path)], dtype="int64")

    return count(text)

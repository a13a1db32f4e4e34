"""Encoding of texts with a public byte-level BPE vocabulary by speculation and verification.

A text is cut into words by the vocabulary's fixed pattern. For each distinct word of a batch a
greedy longest match proposes tokens. The proposal is the BPE result exactly if no adjacent pair
of its tokens would have merged differently; that test runs on all pairs of all words at once
over the table of merges. Only words with a failing pair are merged exactly, rank by rank.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public tokenizer files on every executor.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the word pattern that belongs to the vocabulary. Its white space is the Unicode
#: property, which leaves out the separators U+001C to U+001F.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct words whose tokens a Python worker keeps.
CACHE_WORDS = 200_000


class Encoder:
    """The tables of one vocabulary and the encoding of words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        n = max(self.rank.values()) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for token, r in self.rank.items():
            if len(token) > 1:
                self.left[r], self.right[r] = (self.rank[x] for x in self._merge(token, r))
        made = np.flatnonzero(self.left >= 0)
        key = self.left[made] << 32 | self.right[made]
        order = np.argsort(key)
        self.keys, self.made = key[order], made[order]
        self.longest = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.longest.add_word(token.decode("latin-1"), (len(token), r))
        self.longest.make_automaton()
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, list[int]] = {}

    def _merge(self, word: bytes, below: int = 1 << 60) -> list[bytes]:
        """Exact merging of ``word`` by all merges of a rank under ``below``: the lowest rank first, of
        equal ranks the leftmost. Parts are a linked list and pairs wait in a heap, so a word of n
        bytes takes n log n steps."""
        n, rank = len(word), self.rank
        right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # of the part that begins at a place
        pairs = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2], below)) < below]
        heapq.heapify(pairs)
        while pairs:
            _, i, stop = heapq.heappop(pairs)
            j = end[i]
            if j <= i or j >= n or end[j] != stop:  # a part of this pair has been merged since
                continue
            end[i], end[j], right[i] = stop, 0, right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := rank.get(word[a : end[b]], below)) < below:
                    heapq.heappush(pairs, (r, a, end[b]))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or a huge number."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], 1 << 60)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the neighbours ``a`` and ``b`` as they are, for arrays of pairs.

        Merging the bytes of both tokens again, the seam between them stays unless at some time
        the part left of it and the part right of it form a merge that comes before the merge
        that builds either of them up further. The parts at the seam are the right spine of
        ``a`` and the left spine of ``b``; undoing the later merge first walks back in time.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(a), 1 << 60, np.int64)  # the merge that ends the present state
        while len(live):
            # A seam merge of the rank that builds the right part comes first: it lies to the left.
            bad = self._merged(x, y) < until
            ok[live[bad]] = False
            lx, ly = self.left[x], self.left[y]
            go = ~bad & ((lx >= 0) | (ly >= 0))
            x, y, live, until = x[go], y[go], live[go], until[go]
            # Equal ranks build up in order of place, so the right part is undone first.
            undo_x = np.where(self.left[x] >= 0, x, -1) > np.where(self.left[y] >= 0, y, -1)
            until = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def encode_words(self, words: list[str]) -> None:
        """Put the tokens of new words into the cache."""
        raw = [w.encode() for w in words]
        proposals = [[r for _, (_, r) in self.longest.iter_long(b.decode("latin-1"))] for b in raw]
        lens = np.array([len(p) for p in proposals])
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lens.sum()))
        owner = np.repeat(np.arange(len(words)), lens)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair = flat[inner] << 32 | flat[inner + 1]
        pair, back = np.unique(pair, return_inverse=True)
        ok = self.compatible(pair >> 32, pair & 0xFFFFFFFF)[back]
        failed = set(owner[inner[~ok]].tolist())
        for i, (w, b) in enumerate(zip(words, raw)):
            self.cache[w] = [self.rank[x] for x in self._merge(b)] if i in failed else proposals[i]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list({w for ws in cut for w in ws if w not in self.cache})
        if new:
            self.encode_words(new)
        get = self.cache.__getitem__
        return [[t for ids in map(get, ws) for t in ids] for ws in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once per Python worker."""
    return Encoder(path)


def _path(tokenizer_dir: str, name: str) -> str:
    return f"{tokenizer_dir}/{name}.tiktoken"


def encode_documents(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the tokens of ``text``, without special tokens, one row per input row.

    Null and empty texts give an empty list; text that looks like a special token is plain text.
    Texts are never cut. Rows are encoded where they lie, without a shuffle.
    """
    path = _path(tokenizer_dir, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids = e.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], tokenizer_dir: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_tokens``, the length of the encoding of ``text``."""
    path = _path(tokenizer_dir, name)
    schema = docs.select(*keep).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n = [len(x) for x in e.encode_batch(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.select("text", *keep).mapInArrow(run, schema)

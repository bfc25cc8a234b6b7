"""Encoding with a public byte-level BPE vocabulary: speculate, verify, repair.

Greedy longest match proposes the tokens of every distinct word; one vectorised
test per adjacent pair finds the proposals that BPE itself would make (an
encoding is the right one exactly if each of its adjacent pairs encodes to
itself), and only failing words are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters tokenised at a time; bounds the memory of a batch, not the texts.
CHUNK = 2_000_000
#: Distinct words whose ids a worker remembers.
MEMO = 300_000


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file, from NIGHTLOOM_TOKENIZERS or the installed package."""
    folder = os.environ.get("NIGHTLOOM_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def default_pattern() -> str:
    """The vocabulary's word pattern, as its package publishes it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class BytePairVocabulary:
    """Ranks of a byte-level BPE vocabulary, with the merge that makes each token."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        # ids of single bytes need not precede the merges, so merges are compared by their own order
        self.order = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        pairs = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.order[rank] = rank
            if len(token) == 1:
                continue
            halves = self._merge(token, below=rank)
            if len(halves) == 2:
                a, b = halves
                self.left[rank], self.right[rank] = a, b
                pairs[(a, b)] = rank
        self.pairs = pairs
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        sort = np.argsort(keys)
        self.size, self.keys, self.made = size, keys[sort], np.array(list(pairs.values()), np.int64)[sort]
        # prefixes[n]: whether some token of n bytes or more starts so; longest match goes down from there
        self.longest: dict[bytes, int] = {}
        for token in self.ranks:
            head = token[:2]
            self.longest[head] = max(self.longest.get(head, 0), len(token))

    def _merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact BPE of a word: always the lowest-ranked merge, leftmost first; heap and linked list."""
        ranks = self.ranks
        n = len(word)
        ends = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n:
                r = ranks.get(word[i : ends[j]])
                if r is not None and (below is None or r < below):
                    heapq.heappush(heap, (r, i, j, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not (alive[i] and alive[j] and ends[i] == j and ends[j] == k):
                continue
            alive[j] = False
            ends[i] = k
            if k < n:
                prev[k] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ranks, out, i, n = self.ranks, [], 0, len(word)
        while i < n:
            k = min(n - i, self.longest.get(word[i : i + 2], 1))
            while k > 1 and word[i : i + k] not in ranks:
                k -= 1
            out.append(ranks[word[i : i + k]])
            i += k
        return out

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, a huge one where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], 1 << 60)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, side by side, is what BPE makes of their bytes.

        Both tokens are undone merge by merge from the latest on; the pair fails if
        at some point a merge across their border would have come first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        # the first merge across that would not have been beaten: of a's merge it must be no later, of b's earlier
        limit = np.full(len(a), 1 << 59, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            bad = self._made(x, y) < lim
            good[live[bad]] = False
            when_x = np.where(self.left[x] >= 0, x, -1)
            when_y = np.where(self.left[y] >= 0, y, -1)
            on = ~bad & ((when_x >= 0) | (when_y >= 0))
            live, x, y, when_x, when_y = live[on], x[on], y[on], when_x[on], when_y[on]
            undo_x = when_x > when_y
            # undoing x's merge: a merge across wins at this moment only if it comes before it;
            # the border lies right of x, so of equal ranks x's own, being further left, goes first
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x, y, self.left[y])
        return good

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of each word, and how many words had to be merged exactly."""
        got = [self.propose(w) for w in words]
        counts = np.array([len(g) for g in got], np.int64)
        flat = np.array([t for g in got for t in g], np.int64)
        if len(flat) < 2:
            return got, 0
        of = np.repeat(np.arange(len(got)), counts)
        inner = np.flatnonzero(of[1:] == of[:-1])
        pair, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pair // self.size, pair % self.size)[back]
        failing = np.unique(of[inner[~fine]])
        for k in failing:
            got[k] = self._merge(words[k])
        return got, len(failing)


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> BytePairVocabulary:
    """The vocabulary, loaded once a worker."""
    return BytePairVocabulary(path, pattern)


class Encoder:
    """Encodes texts, remembering the words met."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocab = vocabulary(path, pattern)
        self.memo: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.vocab.words.findall(t) for t in texts]
        fresh = list({w for ws in split for w in ws if w not in self.memo})
        ids, _ = self.vocab.encode_words([w.encode("utf-8", "replace") for w in fresh])
        if len(self.memo) + len(fresh) > MEMO:
            known = {w: self.memo[w] for ws in split for w in ws if w in self.memo}
            self.memo = known
        self.memo.update(zip(fresh, ids, strict=True))
        memo = self.memo
        return [np.array([i for w in ws for i in memo[w]], np.int32) for ws in split]


def encode_corpus(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of every text, without special tokens.

    ``docs``: doc_id, text. Null and empty texts give an empty list; special-token
    strings are ordinary text; blank texts, any script and any length are encoded
    whole. Repeated rows come out repeated, an empty table empty, further columns
    are ignored. A map over partitions: nothing is shuffled.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, pattern)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            start = chars = 0
            for k, t in enumerate(texts):
                chars += len(t)
                if chars >= CHUNK or k == len(texts) - 1:
                    part = b["doc_id"].iloc[start : k + 1]
                    yield pd.DataFrame({"doc_id": part.to_numpy(), "ids": encoder.encode(texts[start : k + 1])})
                    start, chars = k + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ids array<int>")

"""Evaluation texts leaking into training text.

Test items form a small BM25 inverted index whose postings are cut into blocks
with their best impact. Every passage of every document is a query; block-max
WAND returns all items whose score reaches the item's own threshold, and the
consecutive words decide. An item's threshold is the least score that a passage
holding enough of its consecutive words can have, so retrieval loses nothing;
impacts are divided by it, which makes it 1 for all items and lets one bound skip
whole blocks.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm.markup import plain

#: Items of an index, which goes to every worker; more items make more indexes.
ITEMS = 20_000
#: Consecutive words that make a leak.
RUN = 13
#: Words of a passage; passages overlap by RUN - 1 words.
PASSAGE = 64
#: Postings of a block.
BLOCK = 16
K1, B = 1.2, 0.75
#: What a sum of scaled impacts may lack of 1 by rounding.
SLACK = 1e-9

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Words of a text: runs of letters and digits, free of markup, hidden characters, case and Unicode form."""
    text = plain(text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


class ItemIndex:
    """Inverted index of test items; ``skipped`` and ``scored`` count what searches did not and did look at."""

    def __init__(self, items: list[tuple[str, str]], run: int = RUN, block: int = BLOCK) -> None:
        self.run = run
        self.ids: list[str] = []
        docs: list[list[str]] = []
        for name, passage in sorted(items):
            w = words(passage)
            if len(w) >= run:
                self.ids.append(name)
                docs.append(w)
        n = len(docs)
        mean = sum(map(len, docs)) / n if n else 1.0
        df = Counter(t for w in docs for t in set(w))
        self.number = {t: i for i, t in enumerate(sorted(df))}
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.number]
        self.grams: list[set[bytes]] = []
        for k, w in enumerate(docs):
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in Counter(w).items()}
            least = min(sum(impact[t] for t in set(w[i : i + run])) for i in range(len(w) - run + 1))
            for t, v in impact.items():
                ids, vs = self.postings[self.number[t]]
                ids.append(k)
                vs.append(v / least)
            self.grams.append(self._grams(np.array([self.number[t] for t in w], np.int32)))
        self.best = np.array([max(vs) for _, vs in self.postings])
        #: last item and best impact of every block
        self.blocks = [([ids[min(i + block, len(ids)) - 1] for i in range(0, len(ids), block)], [max(vs[i : i + block]) for i in range(0, len(ids), block)]) for ids, vs in self.postings]
        self.skipped = self.scored = 0

    def _grams(self, numbers: np.ndarray) -> set[bytes]:
        return {numbers[i : i + self.run].tobytes() for i in range(len(numbers) - self.run + 1)}

    def search(self, query: list[int]) -> list[int]:
        """All items whose scaled score reaches 1 for a passage's distinct words, by block-max WAND."""
        lists = [(self.postings[t], self.blocks[t], float(self.best[t])) for t in query]
        at = [0] * len(lists)
        least, out = 1 - SLACK, []
        live = sorted((x[0][0][0], k) for k, x in enumerate(lists))
        while True:
            bound, pivot = 0.0, None
            for j, (_, k) in enumerate(live):
                bound += lists[k][2]
                if bound >= least:
                    pivot = j
                    break
            if pivot is None:
                return out
            doc = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == doc:
                pivot += 1
            # what the blocks that may hold the pivot allow, and where the first of them ends
            reach, after = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else len(self.ids)
            for _, k in live[: pivot + 1]:
                lasts, tops = lists[k][1]
                b = bisect_left(lasts, doc)
                if b < len(lasts):
                    reach += tops[b]
                    after = min(after, lasts[b] + 1)
            if reach < least:
                # no item before the end of these blocks can reach it
                goal = max(after, doc + 1)
                self.skipped += goal - doc
            else:
                score, goal = 0.0, doc + 1
                for _, k in live[: pivot + 1]:
                    ids, vs = lists[k][0]
                    p = bisect_left(ids, doc, at[k])
                    if p < len(ids) and ids[p] == doc:
                        score += vs[p]
                self.scored += 1
                if score >= least:
                    out.append(doc)
            moved = []
            for _, k in live[: pivot + 1]:
                ids = lists[k][0][0]
                at[k] = bisect_left(ids, goal, at[k])
                if at[k] < len(ids):
                    moved.append((ids[at[k]], k))
            live = sorted(moved + live[pivot + 1 :])

    def passages(self, text: str) -> Iterator[np.ndarray]:
        """Words, as numbers, of the passages of a text: parts of its runs of words that occur in items; a word of no item is in no leak and ends a run."""
        get = self.number.get
        numbers = np.array([get(w, -1) for w in words(text)], np.int32)
        if len(numbers) < self.run:
            return
        edges = np.flatnonzero(np.diff(np.concatenate([[False], numbers >= 0, [False]]).astype(np.int8)))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start >= self.run:
                for a in range(start, end - self.run + 1, PASSAGE - self.run + 1):
                    yield numbers[a : min(a + PASSAGE, end)]

    def leaked(self, text: str) -> list[str]:
        """Ids of the items of which the text holds enough consecutive words."""
        found: set[int] = set()
        for part in self.passages(text):
            query = np.unique(part)
            if self.best[query].sum() < 1 - SLACK:
                continue
            hits = [k for k in self.search(query.tolist()) if k not in found]
            if hits:
                grams = self._grams(part)
                found.update(k for k in hits if not grams.isdisjoint(self.grams[k]))
        return [self.ids[k] for k in sorted(found)]


def find_leaks(docs: DataFrame, items: DataFrame, run: int = RUN, most: int = ITEMS) -> DataFrame:
    """doc_id, item_id: distinct pairs where the text holds ``run`` consecutive words of the item's passage.

    ``docs``: doc_id, text; ``items``: item_id, passage. Null, empty and short
    texts, null items and items of fewer words give no pair; whole texts are
    searched, however long; equal documents each give their own pairs, repeated
    rows one. A map over partitions, then a distinct. Items are dealt to as many
    indexes of about ``most`` as they need, and every index sees all documents.
    """
    listed = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("string").alias("item_id"), "passage").distinct()
    shards = max(1, math.ceil(listed.count() / most))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = []
    for k in range(shards):
        own = listed.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(shards)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in own], run))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                hits = [(i, item) for i, t in enumerate(b.column("text").to_pylist()) for item in index.leaked(t)]
                ids = b.column("doc_id").take(pa.array([i for i, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for _, x in hits], pa.string())], names=["doc_id", "item_id"])

        found.append(texts.mapInArrow(search, f"doc_id {kind}, item_id string"))
    return reduce(DataFrame.union, found).distinct()

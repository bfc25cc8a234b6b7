"""Near-duplicate texts by tiled exact comparison of bit sketches.

Every distinct bag of words becomes a parity sketch, the wider the longer the
text: the exclusive-or of two sketches never has more bits than the two bags have
unlike words, so a pair beyond the radius of its lengths is ruled out for certain,
and so is a whole tile pair whose population counts differ beyond it. Tiles are
formed within buckets of equal min-hash bands, so that only texts that may be
alike meet, or, where no chance of a miss is wanted, within buckets of like
lengths, which all pairs that can reach the threshold share. The words themselves
decide in the end.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.session import cut, small

_WORD = re.compile("[a-z0-9]+")

#: Words of a text up to which its sketch has 256 bits; twice the words have twice the bits, up to WIDEST times.
PLAIN_WORDS, WIDEST = 300, 64
#: Rows of a tile.
TILE = 512
#: Rows from which a bucket is split: its tiles of so many rows are compared pair by pair in tasks of their own.
HOT = 8192
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-3
#: Rows of a band that are tried for one whose buckets hold no more than BUCKET rows for the SMALL share of all texts; where no one does, BACKGROUND, the likeness of unrelated texts, tells how many rows to take.
TRIED, BUCKET, SMALL, BACKGROUND = (3, 4, 5, 6), 600, 0.6, 0.2
#: Word numbers a worker keeps hashes of.
VOCABULARY = 40_000


def bands_for(rows: int, threshold: float, miss: float) -> int:
    """Bands of so many rows that leave a pair at the threshold a chance of at most ``miss`` to share none."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def rows_for(texts: int) -> int:
    """Rows of a band for which unrelated texts fall into buckets of BUCKET rows, but more than were tried."""
    return max(TRIED[-1] + 1, math.ceil(math.log(max(texts, 2) / BUCKET) / math.log(1 / BACKGROUND)))


def width_of(words: np.ndarray) -> np.ndarray:
    """64-bit words of the sketch of a text of so many words."""
    steps = np.ceil(np.log2(np.maximum(words, 1) / PLAIN_WORDS) - 1e-12)
    return 4 << np.clip(steps, 0, WIDEST.bit_length() - 1).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Signer:
    """Band keys and parity sketches of bags of words; the k-th occurrence of a word is a word of its own."""

    def __init__(self, rows: int, bands: int) -> None:
        self.rows, self.bands = rows, bands
        self.seeds = _mix(np.arange(1, rows * bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple[str, int], int] = {}
        self.table = np.empty((1024, self.rows * self.bands), np.uint32)
        self.bit = np.empty(1024, np.int64)

    def _numbers(self, words: list[str]) -> list[int]:
        import xxhash

        seen: dict[str, int] = {}
        out = []
        for w in words:
            k = seen.get(w, 0)
            seen[w] = k + 1
            i = self.ids.get((w, k))
            if i is None:
                i = self.ids[(w, k)] = len(self.ids)
                if i == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                    self.bit = np.concatenate([self.bit, np.empty_like(self.bit)])
                h = np.uint64(xxhash.xxh64_intdigest(w, k))
                self.table[i] = (_mix(self.seeds ^ h) >> np.uint64(32)).astype(np.uint32)
                self.bit[i] = int(h) % (256 * WIDEST)
            out.append(i)
        return out

    def sign(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys (n, bands) int64, word counts (n) and the words' bits of all texts one after the other."""
        if len(self.ids) > VOCABULARY:
            self.clear()
        numbers = [self._numbers(t) for t in texts]
        count = np.array([len(x) for x in numbers], np.int64)
        flat = np.fromiter((i for x in numbers for i in x), np.int64, int(count.sum()))
        first = np.r_[0, np.cumsum(count)[:-1]]
        least = np.empty((len(texts), self.rows * self.bands), np.uint32)
        a = 0
        while a < len(texts):  # a bounded number of words at a time, at least one text
            b = max(a + 1, int(np.searchsorted(first, first[a] + 60_000)))
            end = len(flat) if b >= len(texts) else first[b]
            if b == a + 1:  # one text, in pieces if it is a long one
                pieces = [self.table[flat[k : min(k + 60_000, end)]].min(axis=0) for k in range(first[a], end, 60_000)]
                least[a] = np.minimum.reduce(pieces)
            else:
                least[a:b] = np.minimum.reduceat(self.table[flat[first[a] : end]], first[a:b] - first[a], axis=0)
            a = b
        return self.keys(least), count, self.bit[flat]

    def tries(self, texts: list[list[str]]) -> np.ndarray:
        """Keys (n, len(TRIED)) of one band by the first few of its rows, as many as are tried."""
        rows, self.rows = self.rows, 1
        bands, self.bands = self.bands, rows * self.bands
        try:
            single, _, _ = self.sign(texts)
        finally:
            self.rows, self.bands = rows, bands
        key = np.zeros(len(texts), np.uint64)
        out = []
        for r in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + single[:, r].view(np.uint64))
            out.append(key.view(np.int64))
        return np.stack([out[r - 1] for r in TRIED], axis=1)

    def keys(self, least: np.ndarray) -> np.ndarray:
        """Band keys of the least hashes."""
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64) + np.uint64(1), (len(least), self.bands)).copy()
        for r in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r :: self.rows])
        return key.view(np.int64)


def sketches(count: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Parity sketches (n, width) of texts of ``count`` words, whose bits come one after the other."""
    out = np.empty((len(count), width), np.uint64)
    first, wide = np.r_[0, np.cumsum(count)], 64 * width
    for a in range(0, len(count), step := max(1, 2_000_000 // wide)):
        n = count[a : a + step]
        at = bits[first[a] : first[a] + n.sum()] % wide
        odd = np.bincount(np.repeat(np.arange(len(n)), n) * wide + at, minlength=len(n) * wide).reshape(-1, wide) & 1
        out[a : a + step] = np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)
    return out


def packed_type(width: int) -> np.dtype:
    """A record of the shuffle: population count (first, so that rows sort by it), word count, text number, sketch."""
    return np.dtype([("count", ">u2"), ("words", "<i4"), ("id", "<i8"), ("sketch", "<u8", width)])


def _binary(packed: np.ndarray) -> pa.Array:
    size = packed.dtype.itemsize
    offsets = np.arange(len(packed) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    """The rows of a binary column, all of one width."""
    if not len(column):
        return np.empty(0, packed_type(4))
    start, end = np.frombuffer(column.buffers()[1], np.int32, 2, offset=4 * column.offset)
    kind = packed_type((end - start - packed_type(0).itemsize) // 8)
    return np.frombuffer(column.buffers()[2], kind, len(column), offset=start).copy()


class Comparer:
    """Pairs of a bucket that may reach the threshold, by exclusive-or and bit counts."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        #: unlike words a pair may have for each word that both have together
        self.share = (1 - threshold) / (1 + threshold)
        self.compared = self.skipped = 0

    def _near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows, broadcast against each other, may be alike; b is a field-wise view."""
        la, lb = a["words"].astype(np.int64), b["words"].astype(np.int64)
        far = np.zeros(np.broadcast_shapes(la.shape, lb.shape), np.int16)
        for w in range(a["sketch"].shape[-1]):
            far += np.bitwise_count(a["sketch"][..., w] ^ b["sketch"][..., w])
        return far <= self.share * (la + lb) + 1e-9

    def by_offset(self, key: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """All pairs of small buckets at once: rows against the rows k places on, while keys agree."""
        out = []
        at = np.arange(len(key))
        k = 1
        while len(at):
            at = at[at + k < len(key)]
            at = at[key[at] == key[at + k]]
            if len(at):
                hit = at[self._near(rows[at], rows[at + k])]
                out.append(np.stack([rows["id"][hit], rows["id"][hit + k]], axis=1))
                self.compared += len(at)
            k += 1
        return out

    def by_tile(self, rows: np.ndarray) -> list[np.ndarray]:
        """All pairs of one large bucket, tile against tile, in order of population count."""
        count = np.bitwise_count(rows["sketch"]).sum(axis=1).astype(np.int64)
        order = np.argsort(count, kind="stable")
        rows, count = rows[order], count[order]
        starts = range(0, len(rows), TILE)
        longest = [int(rows["words"][i : i + TILE].max()) for i in starts]
        out = []
        for x, i in enumerate(starts):
            a = rows[i : i + TILE]
            for y in range(x, len(longest)):
                j = y * TILE
                if count[j] - count[min(i + TILE, len(rows)) - 1] > self.share * (longest[x] + longest[y]):
                    self.skipped += 1
                    continue
                b = rows[j : j + TILE]
                near = self._near(a[:, None], b[None, :])
                if x == y:
                    near &= np.tri(len(a), len(b), -1, dtype=bool).T
                p, q = np.nonzero(near)
                out.append(np.stack([a["id"][p], b["id"][q]], axis=1))
                self.compared += len(a) * len(b)
        return out

    def between(self, a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
        """Distinct pairs across two tiles of a split bucket, or within one."""
        if same:
            out = self.by_tile(a)
        else:
            out = [np.empty((0, 2), np.int64)]
            for i in range(0, len(a), TILE):
                for j in range(0, len(b), TILE):
                    p, q = np.nonzero(self._near(a[i : i + TILE, None], b[None, j : j + TILE]))
                    out.append(np.stack([a["id"][i + p], b["id"][j + q]], axis=1))
        both = np.sort(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=1)
        return np.unique(both[both[:, 0] != both[:, 1]], axis=0)

    def pairs(self, key: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct pairs (lesser, greater text number) of whole buckets; rows sorted by key."""
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(edges)
        out = [np.empty((0, 2), np.int64)]
        large = sizes > 48
        fit = np.repeat(~large & (sizes > 1), sizes)
        out += self.by_offset(key[fit], rows[fit])
        for g in np.flatnonzero(large):
            out += self.by_tile(rows[edges[g] : edges[g + 1]])
        both = np.concatenate(out)
        both.sort(axis=1)
        both = both[both[:, 0] != both[:, 1]]
        return np.unique(both, axis=0)


def shared_words(a: str, b: str) -> float:
    """Words of two texts in common, counted with repetition, by all words of both less those."""
    x, y = Counter(_WORD.findall(a.lower())), Counter(_WORD.findall(b.lower()))
    common = sum((x & y).values())
    return common / (sum(x.values()) + sum(y.values()) - common)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, keys, rows) of the parts of batches, which come in order of width."""
    for b in batches:
        width = b.column("width").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, width[1:] != width[:-1], True]) if len(width) else []
        for start, end in pairwise(edges):
            part = b.slice(start, end - start)
            yield int(width[start]), part.column("key").to_numpy(zero_copy_only=False), _unpacked(part.column("row"))


def candidate_pairs(reps: DataFrame, threshold: float, least_words: int, shape: tuple[int, int] | None, hot_rows: int = HOT) -> DataFrame:
    """a, b: numbers of texts (``reps``: number, text) whose sketches allow the threshold.

    ``shape``: rows of a band and bands; None takes buckets of like lengths instead,
    which lose nothing and grow with the square of the texts.
    """
    rows, bands = shape or (1, 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(rows, bands)
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                b = batch.slice(part, 2000)
                lists = [_WORD.findall(t.lower()) for t in b.column("text").to_pylist()]
                fit = np.array([len(x) >= least_words for x in lists], bool)
                if not fit.any():
                    continue
                keys, count, bits = signer.sign([x for x, y in zip(lists, fit, strict=True) if y])
                number = b.column("number").to_numpy(zero_copy_only=False)[fit]
                if shape is None:
                    # a text meets those down to its own part of the scale, and those up to the next
                    scale = np.floor(np.log(count) / -math.log(threshold)).astype(np.int64)
                    keys = np.stack([scale, scale + 1], axis=1)
                own, most = width_of(count), width_of(np.floor(count / threshold))
                text_of = np.repeat(np.arange(len(count)), count)
                for width in np.unique(np.concatenate([own, most])):
                    # texts that may have a partner of this width, their own or a wider one
                    at = np.flatnonzero((own <= width) & (width <= most))
                    packed = np.empty(len(at), packed_type(width))
                    packed["id"], packed["words"] = number[at], count[at]
                    packed["sketch"] = sketches(count[at], bits[np.isin(text_of, at)] if len(at) < len(count) else bits, width)
                    packed["count"] = np.bitwise_count(packed["sketch"]).sum(axis=1)
                    own_keys = _mix(keys[at].view(np.uint64) + np.uint64(width)).view(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own_keys), width, np.int16)), pa.array(own_keys), _binary(np.repeat(packed, keys.shape[1]))], names=["width", "key", "row"])

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, parts in groupby(_segments(batches), key=lambda x: x[0]):
            yield from compare(packed_type(width), parts)

    def compare(kind: np.dtype, parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(threshold)
        held_keys, held_rows, size = [np.empty(0, np.int64)], [np.empty(0, kind)], 0
        hot: tuple[int, int] | None = None  # the open bucket's key and rows so far, once it is a hot one

        def out(pairs: np.ndarray, keys: np.ndarray, rows: np.ndarray, first: int = 0) -> pa.RecordBatch:
            none, n = len(pairs), len(rows)
            tile = (first + np.arange(n)) // hot_rows
            columns = [
                pa.concat_arrays([pa.array(pairs[:, 0]), pa.nulls(n, pa.int64())]), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(n, pa.int64())]),
                pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(keys)]), pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(tile)]),
                pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(rows["count"].astype(np.int32))]), pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(rows["words"].astype(np.int32))]),
                pa.concat_arrays([pa.nulls(none, pa.binary()), _binary(rows)]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "tile", "count", "words", "row"])

        nothing = np.empty((0, 2), np.int64)

        def settle(key: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs of complete buckets, large ones passed on whole."""
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
            sizes = np.diff(edges)
            for g in np.flatnonzero(sizes >= hot_rows):
                yield out(nothing, key[edges[g] : edges[g + 1]], row[edges[g] : edges[g + 1]])
            rest = np.repeat(sizes < hot_rows, sizes)
            yield out(comparer.pairs(key[rest], row[rest]), key[:0], row[:0])

        for _, keys, rows in parts:
            if hot is not None:
                end = int(np.searchsorted(keys, hot[0], side="right"))
                yield out(nothing, keys[:end], rows[:end], hot[1])
                hot = (hot[0], hot[1] + end) if end == len(keys) else None
                keys, rows = keys[end:], rows[end:]
            held_keys.append(keys)
            held_rows.append(rows)
            size += len(keys)
            if size >= 12 * hot_rows:
                key, row = np.concatenate(held_keys), np.concatenate(held_rows)
                start = int(np.searchsorted(key, key[-1]))
                if len(key) - start >= hot_rows:
                    hot = (int(key[-1]), len(key) - start)
                    yield out(nothing, key[start:], row[start:])
                    held_keys, held_rows = [key[:0]], [row[:0]]
                else:
                    held_keys, held_rows = [key[start:]], [row[start:]]
                size = len(held_keys[0])
                yield from settle(key[:start], row[:start])
        yield from settle(np.concatenate(held_keys), np.concatenate(held_rows))

    def tiles(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (np.concatenate([_unpacked(c) for c in t.column("row").chunks if len(c)]) if t.num_rows else np.empty(0, packed_type(4)) for t in (left, right))
        got = Comparer(threshold).between(a, b, same=key[1].as_py() == key[2].as_py())
        return pa.table({"a": got[:, 0], "b": got[:, 1]})

    banded = reps.select("number", "text").mapInArrow(sign, "width short, key long, row binary")
    kind = "a long, b long, key long, tile long, count int, words int, row binary"
    compared = cut(banded.repartition("key").sortWithinPartitions("width", "key", "row").mapInArrow(compare_all, kind))
    pairs = compared.where("a is not null").select("a", "b")
    large = compared.where("key is not null").select("key", "tile", "count", "words", "row")
    if not large.isEmpty():
        share = (1 - threshold) / (1 + threshold)
        stats = large.groupBy("key", "tile").agg(F.min("count").alias("low"), F.max("count").alias("high"), F.max("words").alias("longest"))
        one, two = (stats.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("tile", "low", "high", "longest")]) for p in "xy")
        meet = one.join(two, "key").where(f"x_tile <= y_tile and greatest(x_low, y_low) - least(x_high, y_high) <= {share} * (x_longest + y_longest)").select("key", "x_tile", "y_tile")
        sides = []
        for p in "xy":
            names = [f"{p}1", f"{p}2", f"{p}3", "row"]
            side = large.select("key", F.col("tile").alias(f"{p}_tile"), "row").join(meet, ["key", f"{p}_tile"]).select("key", "x_tile", "y_tile", "row").toDF(*names)
            sides.append(side.groupBy(*names[:3]))
        pairs = pairs.union(sides[0].cogroup(sides[1]).applyInArrow(tiles, "a long, b long"))
    return pairs.distinct()


def band_rows(members: DataFrame, texts: int) -> int:
    """The fewest rows of a band whose buckets are small for most of all texts (``members``: copy, tries: a key for each of TRIED).

    Counted over every distinct text. Texts of a crowd of near-duplicates stay in
    large buckets however many rows there are, so not all are asked for.
    """
    for i, rows in enumerate(TRIED):
        sizes = members.groupBy(F.col("tries")[i].alias("key")).agg(F.count_distinct("copy").alias("c"))
        small_ones = sizes.agg(F.sum(F.when(F.col("c") <= BUCKET, F.col("c")))).first()[0] or 0
        if small_ones >= SMALL * texts:
            return rows
    return rows_for(texts)


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.7, least_words: int = 20, hot_rows: int = HOT, miss: float | None = MISS) -> tuple[DataFrame, DataFrame]:
    """(links, members) of texts that share at least ``threshold`` of their words.

    links: a, b, id_a, id_b, pairs of classes of exact copies by their
    representatives; members: head, id, the records of every class of more than one.
    What counts is said at ``near_duplicates``; with ``miss`` None no pair is missed.
    """
    docs = docs.where("id is not null and text is not null").select(F.xxhash64("id", "text").alias("number"), "id", "text")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Signer(TRIED[-1], 1)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                lists = [_WORD.findall(t.lower()) for t in b.column("text").to_pylist()]
                fit = [k for k, x in enumerate(lists) if len(x) >= least_words]
                if not fit:
                    continue
                copies = [hashlib.blake2b(" ".join(sorted(lists[k])).encode(), digest_size=16).digest() for k in fit]
                tries = np.zeros((len(fit), len(TRIED)), np.int64) if miss is None else probe.tries([lists[k] for k in fit])
                own = b.take(pa.array(fit, pa.int64()))
                offsets = pa.array(np.arange(len(fit) + 1, dtype=np.int32) * len(TRIED))
                yield pa.RecordBatch.from_arrays([own.column("number"), own.column("id"), pa.array(copies, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(tries.ravel()))], names=["number", "id", "copy", "tries"])

    told = docs.mapInArrow(bag, "number long, id string, copy binary, tries array<long>")
    members = cut(told.groupBy("number").agg(F.min("id").alias("id"), F.min("copy").alias("copy"), F.min("tries").alias("tries"), F.count("*").alias("times")))
    heads = members.groupBy("copy").agg(F.min(F.struct("id", "number")).alias("head"), F.count("*").alias("copies"))
    texts = heads.count()
    copied = cut(members.join(heads.where("copies > 1"), "copy").select("number", "id", F.col("head.number").alias("head")))
    rows = None if miss is None else band_rows(members.select("copy", "tries"), texts)
    reps = docs.join(small(copied.where("number <> head").select("number")), "number", "left_anti")
    again = cut(members.where("times > 1").select("number"))
    if not again.isEmpty():
        # rows told more than once, brought down to one where they are
        often = small(again)
        reps = reps.join(often, "number", "left_anti").union(reps.join(often, "number", "left_semi").dropDuplicates(["number", "id", "text"]))
    pairs = cut(candidate_pairs(reps, threshold, least_words, None if rows is None else (rows, bands_for(rows, threshold, miss)), hot_rows))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shared_words(x, y) >= threshold - 1e-12 for x, y in zip(a, b, strict=True)], dtype=bool)

    # only the texts that occur in a pair are moved
    needed = reps.join(small(pairs.selectExpr("explode(array(a, b)) as number").distinct()), "number", "left_semi")
    one, two = (needed.select(F.col("number").alias(p), F.col("id").alias(f"id_{p}"), F.col("text").alias(f"text_{p}")) for p in "ab")
    links = pairs.join(one, "a").join(two, "b").where(alike("text_a", "text_b")).select("a", "b", "id_a", "id_b")
    return links, copied.select("head", "id")


def near_duplicates(docs: DataFrame, threshold: float = 0.7, least_words: int = 20, hot_rows: int = HOT, miss: float | None = MISS) -> DataFrame:
    """left_id, right_id: pairs of ids, lesser first, whose texts share at least ``threshold`` of their words.

    ``docs``: id, text; words are runs of a-z and 0-9 after lower-casing, counted
    with repetition. Texts of fewer than ``least_words`` words, null ids and null
    texts pair with nothing; repeated rows count once; an id with several texts
    pairs by each of them, but not with itself; empty tables give an empty result.
    Exact copies are reduced to one text before any comparison and expanded at the
    very end. A pair exactly at the threshold is missed with a chance of ``miss``
    (fewer the more alike it is), none with ``miss`` None.
    """
    links, members = near_duplicate_classes(docs, threshold, least_words, hot_rows, miss)
    group = small(members)
    left = links.join(group.select(F.col("head").alias("a"), F.col("id").alias("x")), "a", "left").select(F.coalesce("x", "id_a").alias("x"), "b", "id_b")
    both = left.join(group.select(F.col("head").alias("b"), F.col("id").alias("y")), "b", "left").select("x", F.coalesce("y", "id_b").alias("y"))
    equal = members.select("head", F.col("id").alias("x")).join(members.select("head", F.col("id").alias("y")), "head").where("x < y").select("x", "y")
    return both.union(equal).where("x <> y").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()

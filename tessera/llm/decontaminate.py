"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index lookup, exact check.

Window sizes follow the items: an item of 8 words or more uses the largest size of a
geometric grid within half its length, so a contiguous edit leaves a whole window
intact; a shorter item uses its own length. Every window of every document gets a
64-bit SimHash of its words. Fingerprints are divided into four 16-bit blocks: two
that differ in at most RADIUS = 3 bits agree in one block at least, so looking up each
block finds all item windows within the radius. Each hit proposes a place for the
whole item, where the weighted (multiset) Jaccard similarity of five-word shingles is
computed exactly; two hits whose places differ, as words were inserted or left out
between them, also propose the span from the one's start to the other's end, if it has
SHORTEST to LONGEST times the item's words. Words are compared with A-Z as a-z.

Documents never shuffle: detection is one expression over their text. The items are
taken in blocks of about BLOCK_WORDS words, one block after another: the driver and the
tasks hold one block's index at a time, and a benchmark of more blocks takes more passes
over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import utf8, write_scratch
from tessera.llm.words import LOWER, U, shingles, word_blocks

RADIUS = 3
THRESHOLD = 0.8
SHINGLE = 5
SHORTEST, LONGEST = 0.8, 1.25
GRID = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96)
#: Most words of benchmark items in one block (about 100 bytes a word in a task).
BLOCK_WORDS = 200_000
#: Spans that are compared together, and the most numbers that takes at a time.
PAIRS, CELLS = 100_000, 1_000_000
#: Words of a document whose windows are formed together.
STRIDE = 16_384
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType())]))
#: Each bit of a byte in a lane of its own.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], U)


def window_size(words: int) -> int:
    return words if words < 8 else max(g for g in GRID if g <= max(words // 2, GRID[0]))


def lane_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the words' bits, 8 x (n+1); each number has eight one-byte lanes.

    A difference of two sums of fewer than 256 words is exact in every lane, as the
    carries cancel.
    """
    out = np.zeros((8, len(hashes) + 1), U)
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for i in range(8):
        np.cumsum(_LANES[octets[:, i]], out=out[i, 1:])
    return out


def fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` words: a bit is set if more than half of the words have it."""
    n = sums.shape[1] - size
    out = np.zeros(max(n, 0), U)
    if n <= 0:
        return out
    lift = U(0x0101010101010101 * (127 - size // 2))
    for i in range(8):
        count = sums[i, size:] - sums[i, :-size]
        count += lift
        count &= U(0x8080808080808080)
        count >>= U(7)
        count *= U(0x0102040810204080)
        count >>= U(56)
        out |= count << U(8 * i)
    return out


@dataclass
class _Size:
    """All windows of one size of a block of items, indexed by each 16-bit block."""

    prints: np.ndarray
    item: np.ndarray
    place: np.ndarray
    starts: list[np.ndarray]
    orders: list[np.ndarray]
    known: list[np.ndarray]


class ItemIndex:
    def __init__(self, texts: list[str]):
        data, offsets = utf8(pa.array(texts, pa.string()))
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        lengths: list[int] = []
        by_size: dict[int, list] = {}
        for i, _, hashes, ends, _ in word_blocks(LOWER[data], offsets):
            for k in range(len(ends) - 1):
                words = hashes[ends[k] : ends[k + 1]]
                lengths.append(len(words))
                self.bags.append(_bag(words))
                if len(words):
                    size = window_size(len(words))
                    prints = fingerprints(lane_sums(words), size)
                    by_size.setdefault(size, []).append((prints, np.full(len(prints), i + k), np.arange(len(prints))))
        self.lengths = np.array(lengths, np.int64)
        self.sizes = {}
        for size, parts in by_size.items():
            prints, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            blocks = prints.view(np.uint16).reshape(-1, 4)
            orders = [np.argsort(blocks[:, b], kind="stable") for b in range(4)]
            starts = [np.append(0, np.cumsum(np.bincount(blocks[:, b], minlength=65536))) for b in range(4)]
            self.sizes[size] = _Size(prints, item, place, starts, orders, [np.diff(s) > 0 for s in starts])

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Rows (start of the item, item) that windows within the radius propose, for words in one run."""
        found = []
        for at in range(0, len(hashes), STRIDE):
            part = hashes[at : at + STRIDE + GRID[-1]]
            sums = lane_sums(part)
            for size, index in self.sizes.items():
                prints = fingerprints(sums, size)[:STRIDE]
                blocks = prints.view(np.uint16).reshape(-1, 4)
                for b in range(4):
                    window = np.flatnonzero(index.known[b][blocks[:, b]])
                    if not len(window):
                        continue
                    value = blocks[window, b].astype(np.int64)
                    many = index.starts[b][value + 1] - index.starts[b][value]
                    window = np.repeat(window, many)
                    inner = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
                    other = index.orders[b][np.repeat(index.starts[b][value], many) + inner]
                    near = np.bitwise_count(prints[window] ^ index.prints[other]) <= RADIUS
                    found.append(np.stack([window[near] + at - index.place[other[near]], index.item[other[near]]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def matches(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[list[tuple[int, float, int]]]:
        out: list[list[tuple[int, float, int]]] = []
        for i, j, hashes, ends, _ in word_blocks(LOWER[data], offsets):
            best: list[dict[int, tuple[float, int]]] = [{} for _ in range(i, j)]
            # windows are formed across the block; the check looks inside one text only
            hits = self.hits(hashes)
            n, last = self.lengths[hits[:, 1]], len(hashes) - 1
            places = (hits[:, 0], hits[:, 0] + n // 2, hits[:, 0] + n - 1)
            owners = [np.searchsorted(ends, np.clip(p, 0, last), "right") - 1 for p in places]
            met = np.unique(np.concatenate([np.stack([o, hits[:, 1], hits[:, 0]], 1) for o in owners]), axis=0)
            cut = np.flatnonzero(np.any(met[1:, :2] != met[:-1, :2], axis=1)) + 1
            for group in np.split(met, cut) if len(met) else []:
                text, item = int(group[0, 0]), int(group[0, 1])
                words = hashes[ends[text] : ends[text + 1]]
                similarity, at = self._best_span(words, item, group[:, 2] - ends[text])
                if similarity >= threshold - 1e-12:
                    best[text][item] = (similarity, at)
            out += [[(item, s, at) for item, (s, at) in sorted(x.items())] for x in best]
        return out

    def _best_span(self, words: np.ndarray, item: int, starts: np.ndarray) -> tuple[float, int]:
        """The greatest similarity of the item with a span that the starts propose, and its first word; of equal ones the first proposed.

        First the spans of the item's length at each start, then those from one start to
        the end another one proposes, if that has SHORTEST to LONGEST times the length.
        """
        n, size = int(self.lengths[item]), len(words)
        inside = lambda lo, hi: (np.clip(lo, 0, size), np.clip(hi, 0, size))
        compare = self._comparer(words, item, max(int(starts[0]), 0), min(int(starts[-1]) + n, size))
        found, at = 0.0, 0

        def take(lo: np.ndarray, hi: np.ndarray) -> None:
            nonlocal found, at
            lo, hi = inside(lo, hi)
            lo, hi = lo[hi > lo], hi[hi > lo]
            if len(lo):
                value = compare(lo, hi)
                k = int(np.argmax(value))
                if value[k] > found:
                    found, at = float(value[k]), int(lo[k])

        for k in range(0, len(starts), PAIRS):
            take(starts[k : k + PAIRS], starts[k : k + PAIRS] + n)
        first = np.searchsorted(starts, starts - (1 - SHORTEST) * n, "left")
        many = np.searchsorted(starts, starts + (LONGEST - 1) * n, "right") - first
        k = 0
        while k < len(starts) and found < 1.0:
            to = max(k + 1, int(np.searchsorted(np.cumsum(many[k:]), PAIRS, "right")) + k)
            own = np.repeat(np.arange(k, to), many[k:to])
            other = np.arange(len(own)) - np.repeat(np.cumsum(many[k:to]) - many[k:to], many[k:to]) + np.repeat(first[k:to], many[k:to])
            take(starts[own], starts[other] + n)
            k = to
        return found, at

    def _comparer(self, words: np.ndarray, item: int, begin: int, end: int):
        """A function of spans' first and end words, within begin to end: the weighted Jaccard similarity of each span's shingles with the item's.

        How often a span has a shingle of the item is a difference of two places in the
        sorted list of their occurrences, so a span costs as much as the item has
        shingles, however long it is and however often the text repeats itself.
        """
        values, counts = self.bags[item]
        total = int(counts.sum())
        if self.lengths[item] < SHINGLE or end - begin < SHINGLE:
            bag = dict(zip(values.tolist(), counts.tolist(), strict=True))
            return lambda lo, hi: np.array([_similarity(_bag(words[a:b]), bag, total) for a, b in zip(lo, hi, strict=True)])
        own = shingles(words[begin:end], np.array([0, end - begin]), SHINGLE)[0]
        rank = np.minimum(np.searchsorted(values, own), len(values) - 1)
        place = np.flatnonzero(values[rank] == own)
        present = np.unique(rank[place])
        step = end - begin + 1
        keys = np.sort(rank[place] * step + place)

        def compare(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            value = np.zeros(len(lo))
            many = hi - lo - (SHINGLE - 1)
            rows = max(1, CELLS // max(1, len(present)))
            for k in range(0, len(lo), rows):
                a, b = lo[k : k + rows] - begin, np.maximum(hi[k : k + rows] - begin - (SHINGLE - 1), lo[k : k + rows] - begin)
                held = np.searchsorted(keys, present * step + b[:, None]) - np.searchsorted(keys, present * step + a[:, None])
                common = np.minimum(held, counts[present]).sum(1)
                value[k : k + rows] = common / np.maximum(np.maximum(many[k : k + rows], 1) + total - common, 1)
            return value

        return compare


def _bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles and how often each occurs."""
    return np.unique(shingles(words, np.array([0, len(words)]), SHINGLE)[0], return_counts=True)


def _similarity(a: tuple[np.ndarray, np.ndarray], b: dict[int, int], total: int) -> float:
    common = sum(min(n, b.get(x, 0)) for x, n in zip(a[0].tolist(), a[1].tolist(), strict=True))
    return common / max(1, int(a[1].sum()) + total - common)


def _matches_udf(index: ItemIndex, ids: list[int | None], threshold: float):
    @F.arrow_udf(MATCHES)
    def detect(text: pa.Array) -> pa.Array:
        found = index.matches(*utf8(text), threshold)
        return pa.array([[{"item_id": ids[i], "similarity": s, "start_word": at} for i, s, at in x] for x in found], pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64())])))

    return detect


_NO_MATCHES = "array<struct<item_id:bigint,similarity:double,start_word:bigint>>"


def item_blocks(benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, item_col: str = "item_id", item_text: str = "text") -> tuple[int, Iterator]:
    """How many blocks the distinct items make, and the blocks' expressions (a text to its matches), each made when it is asked for."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"), (F.size(F.split(F.col(item_text), r"[ \t-\r]+")) + 1).alias("words")).where("text is not null and text != ''").distinct()
    total = items.agg(F.sum("words")).first()[0] or 0
    blocks = -(-total // block_words)

    def made():
        for block in range(blocks):
            rows = sorted((r[0] if r[0] is not None else -1, r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).select("item", "text").collect())
            if rows:
                yield _matches_udf(ItemIndex([r[2] for r in rows]), [r[1] for r in rows], threshold)

    return blocks, made()


def matches_column(benchmark: DataFrame, text: Column | str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, item_col: str = "item_id", item_text: str = "text") -> Column:
    """An array column of (item_id, similarity, start_word) over a document's whole text.

    One entry for each item that some window of the document matches with a similarity
    of ``threshold`` or more, at its best place. A null or empty text matches nothing; an
    item without words matches nothing; an empty benchmark gives empty arrays; equal
    items of different ids each match. All blocks of items stand in one expression, so
    this form is for benchmarks of a few blocks; contaminated() and clean() take any.
    """
    columns = [match(text) for match in item_blocks(benchmark, threshold, block_words, item_col, item_text)[1]]
    return reduce(F.concat, columns) if columns else F.array().cast(_NO_MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, similarity, start_word: one row for each document row and benchmark item it holds.

    Documents without a match have no row. Repeated rows and null ids are reported as
    they come; repeated items count once; other columns are ignored; empty tables give an
    empty result.
    """
    blocks, matches = item_blocks(benchmark, threshold, block_words)
    parts = []
    for match in matches:
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(match("text")).alias("m")).select("doc_id", "m.item_id", "m.similarity", "m.start_word")
        parts.append(found if blocks == 1 else write_scratch(found, "found"))
    nothing = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array().cast(_NO_MATCHES)).alias("m")).select("doc_id", "m.item_id", "m.similarity", "m.start_word")
    return reduce(DataFrame.unionByName, parts) if parts else nothing


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    blocks, matches = item_blocks(benchmark, threshold, block_words)
    for at, match in enumerate(matches):
        docs = docs.where(F.size(match(docs["text"])) == 0)
        if at + 1 < blocks:
            docs = write_scratch(docs, "clean")
    return docs

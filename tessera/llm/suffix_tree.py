"""LM scoring with a probabilistic suffix tree over words.

Symbols are the words of a text (A-Z as a-z) and one end. Contexts are the up to DEPTH
symbols before a symbol. The tree grows level by level: a run of m symbols is counted
only if both its shorter runs occur LEAST_COUNT times or more, so each pass over the
texts counts few runs that cannot be kept. A context is retained if its next-symbol
distribution diverges from its suffix's by DIVERGENCE nats or more for each distinct
next symbol that it holds LEAST_COUNT times or more (the others count as one). Nothing
else bounds the contexts: the tree is a table that grows with the corpus.

Distributions are smoothed by absolute discounting of one: a context of ``whole``
occurrences gives a next symbol seen n times (n - 1) / whole, and what is left over to
its suffix; the root is the unigram base. So for every run x two numbers say what it
adds to a text's log10 probability: how much its own chance exceeds what its suffix
leaves it, and, as a context, which share it leaves to its suffix. The score of the
longest suffix state is then a sum over the runs in a text: the chances of a bounded
head of frequent runs are looked up where the tasks run, and all others are looked up by
a shuffle that deals the runs of the texts and of the tree by the same hash.

Runs travel as sorted arrays of keys, one array for each bucket that a task feeds, and
as single rows only where a task feeds a bucket few of them: keys have 48 bits, of which the
first tell the bucket (56 from WIDE_BYTES of text on). The levels of the tree travel so too: runs are
looked up by suffix and by prefix bucket by bucket. The unigram base is exact up to 64-bit hashes of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BATCH_ROWS, drop_scratch, list_array, setting, shuffles_removed, utf8, write_scratch
from tessera.llm.words import LOWER, U, mix, word_blocks

#: Symbols of the longest contexts.
DEPTH = 3
#: Fewest occurrences of a retained run, whatever the size of the corpus.
LEAST_COUNT = 2
DIVERGENCE = 1.5
#: Most words in the head table, and its slots (a word that finds its slot taken counts as tail).
HEAD_WORDS, HEAD_SLOTS = 1 << 17, 1 << 18
#: The same for runs.
HEAD_RUNS, RUN_SLOTS = 1 << 18, 1 << 19
END_WORD = 0
#: Runs a task holds before it counts them and hands them on, and runs in a bucket.
HELD, BUCKET = 200_000, 1_000_000
#: Texts whose words are hashed from one copy of their bytes.
SLICE = 1 << 10
#: Bytes of text a run is reckoned to take, and from which on keys are wider.
RUN_BYTES, WIDE_BYTES = 6, 1 << 34
#: Bits of a key filter: so many a key, at most so many.
BITS_A_KEY, MOST_BITS = 8, 1 << 27
_PREFIX = U(0x9FB21C651E98DF25)


class Keys:
    """How runs are named and dealt: so many bytes a key, so many buckets."""

    def __init__(self, text_bytes: int):
        self.width = 7 if text_bytes >= WIDE_BYTES else 6
        self.mask = U((1 << (8 * self.width)) - 1)
        self.buckets = max(1, -(-text_bytes // (RUN_BYTES * BUCKET)))

    def join(self, prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Key of the run whose first symbols are ``prefix`` and last ones ``suffix`` (all but one each)."""
        return mix(prefix * _PREFIX + suffix) & self.mask

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return (((key >> U(8 * self.width - 32)) * U(self.buckets)) >> U(32)).astype(np.int32)

    def pack(self, key: np.ndarray) -> bytes:
        """The bytes of the keys, place by place, as sorted keys differ little in the first ones."""
        return self.places(key, self.width)

    @staticmethod
    def places(numbers: np.ndarray, width: int) -> bytes:
        """The bytes of 64-bit numbers, place by place, the lowest ``width`` ones."""
        return np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()

    @staticmethod
    def spread(raw: bytes, width: int) -> np.ndarray:
        """The keys in the bytes of one pack()."""
        out = np.zeros((len(raw) // width, 8), np.uint8)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
        return out.view(U).ravel()

    def unpack(self, parts: list[bytes], width: int | None = None) -> np.ndarray:
        width = width or self.width
        planes = [np.frombuffer(p, np.uint8).reshape(width, -1) for p in parts]
        out = np.zeros((sum(p.shape[1] for p in planes), 8), np.uint8)
        if planes:
            out[:, :width] = np.concatenate(planes, axis=1).T
        return out.view(U).ravel()


def symbols(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts with an end after each text, and the text of each symbol."""
    counts = np.diff(ends)
    text = np.repeat(np.arange(len(counts)), counts + 1)
    out = np.zeros(len(text), U)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = hashes
    return out, text


def runs(keys: Keys, words: np.ndarray, text: np.ndarray, passes: list) -> list[np.ndarray]:
    """Keys of the runs of 1, 2, ... symbols that start at each symbol, with 0 for those that cannot be kept.

    ``passes`` holds a test (or None) for the runs of each length but the longest.
    """
    level = words & keys.mask
    out = [level]
    for test in passes:
        known = np.ones(len(level), bool) if test is None else (level != 0) & test(level)
        both = known[:-1] & known[1:] & (text[: len(level) - 1] == text[len(text) - len(level) + 1 :])
        level = np.where(both, keys.join(level[:-1], level[1:]), U(0))
        out.append(level)
    return out


class KeySet:
    """A bit map that holds every key of a set (and, rarely, others); of bounded size."""

    def __init__(self, keys: Keys, n: int, parts):
        self.bits = max(15, min(MOST_BITS.bit_length() - 1, (BITS_A_KEY * max(n, 1) - 1).bit_length()))
        self.shift = U(8 * keys.width - self.bits)
        self.map = np.zeros(1 << (self.bits - 3), np.uint8)
        for part, raw in parts(self.bits):
            self.map[part << 12 : (part << 12) + len(raw)] |= np.frombuffer(raw, np.uint8)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = key >> self.shift
        return (self.map[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def key_set(keys: Keys, packed: DataFrame) -> KeySet:
    """The set of the keys of ``packed`` (deal, keys): a bucket is a stretch of keys, so it gives a stretch of the map."""

    def parts(bits: int):
        def mapped(table: pa.Table) -> pa.Table:
            at = np.sort(keys.unpack(table.column("keys").to_pylist()) >> U(8 * keys.width - bits)).astype(np.int64)
            held = []
            for part, lo, hi in _stretches(at >> 15):
                bit = np.zeros(1 << 15, np.uint8)
                bit[at[lo:hi] & 32767] = 1
                held.append((part, np.packbits(bit, bitorder="little").tobytes()))
            return pa.table([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.binary())], names=["part", "bits"])

        made = packed.select("deal", "keys").groupBy("deal").applyInArrow(mapped, "part long, bits binary")
        return ((r["part"], bytes(r["bits"])) for r in made.collect())

    return KeySet(keys, (packed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // keys.width, parts)


_FED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("first", T.BinaryType()), T.StructField("second", T.BinaryType()), T.StructField("counts", T.BinaryType())])
#: Bucket numbers below zero are those of words.
_COUNTED = T.StructType([*[T.StructField(c, T.LongType()) for c in ("word", "n", "deal")], *[T.StructField(c, T.BinaryType()) for c in ("suffixes", "prefixes", "counts")]])
#: Runs and what their suffixes say of them, dealt by their prefixes.
_RAISED = T.StructType([T.StructField("deal", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("prefixes", "suffixes", "counts", "above", "chances")]])
#: Runs with their chances (``gain`` is nan where the context is not retained), or retained contexts with the share they keep.
_LEVEL = T.StructType([T.StructField("deal", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "counts", "above", "chances", "gains", "kept")]])


def _stretches(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each stretch of equal numbers; costs nothing for buckets that have no run."""
    found, begin = np.unique(bucket, return_index=True)
    return list(zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True)) if len(bucket) else []


def _fed(bucket: int, first: bytes, second: bytes | None, counts: np.ndarray) -> tuple:
    ones = (counts == 1).all()
    return bucket, first, second, None if ones else counts.astype(np.uint32).tobytes()


def _rows(fed: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*fed, strict=True)) if fed else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], _FED.names)


def _count_runs(keys: Keys, length: int, passes: list, with_words: bool):
    """A task: sorted distinct runs of ``length`` symbols (prefix, suffix) by bucket, and with the first pass the words."""

    def count(batches):
        tests = [p.value if p is not None else None for p in passes]
        held, words, size = [], [], 0

        def hand_on():
            fed = []
            if held:
                prefix, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
                key = keys.join(prefix, suffix)
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                count = np.diff(np.append(first, len(key)))
                at = order[first]
                prefix, suffix, bucket = prefix[at], suffix[at], keys.bucket(key[first])
                for b, lo, hi in _stretches(bucket):
                    for chosen in (count[lo:hi] == 1, count[lo:hi] > 1):
                        if chosen.any():
                            p, s, n = prefix[lo:hi][chosen], suffix[lo:hi][chosen], count[lo:hi][chosen]
                            by = np.argsort(p)
                            fed.append(_fed(b, keys.pack(p[by]), keys.pack(s[by]), n[by]))
            if words:
                word, n = np.unique(np.concatenate(words), return_counts=True)
                for b, lo, hi in _stretches(((word >> U(32)) * U(keys.buckets)) >> U(32)):
                    fed.append(_fed(-1 - b, word[lo:hi].tobytes(), None, n[lo:hi]))
            held.clear(), words.clear()
            return _rows(fed)

        for text_column in (b.column(0).slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            data, offsets = utf8(text_column)
            for _, _, hashes, ends, _ in word_blocks(LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]):
                stream, text = symbols(hashes, ends)
                levels = runs(keys, stream, text, tests)
                if length > 1:
                    live = np.flatnonzero(levels[length - 1])
                    held.append((levels[length - 2][live], levels[length - 2][live + 1]))
                    size += len(live)
                if with_words:
                    words.append(stream)
                    size += len(stream) if length == 1 else 0
                if size > HELD:
                    yield hand_on()
                    size = 0
        yield hand_on()

    return count


def _whole(n: np.ndarray) -> bytes:
    """Whole numbers, place by place like keys, in as few bytes as the greatest needs."""
    width = max(1, (int(n.max()).bit_length() + 7) // 8) if len(n) else 1
    return Keys.places(n.astype(np.int64), width)


def _wholes(parts: list[bytes], sizes: list[int]) -> np.ndarray:
    out = np.zeros((sum(sizes), 8), np.uint8)
    at = 0
    for raw, size in zip(parts, sizes, strict=True):
        if size:
            planes = np.frombuffer(raw, np.uint8).reshape(-1, size)
            out[at : at + size, : len(planes)] = planes.T
        at += size
    return out.view(np.int64).ravel()


def _floats(parts: list[bytes], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(p, kind) for p in parts]])


def _sizes(keys: Keys, parts: list[bytes]) -> list[int]:
    return [len(p) // keys.width for p in parts]


def _packed(schema: T.StructType, rows: list[dict]) -> pa.Table:
    kinds = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    return pa.table([pa.array([r.get(f.name) for r in rows], kinds[f.dataType]) for f in schema.fields], names=schema.names)


def _merge_runs(keys: Keys, least: int):
    """Words with their counts, or the runs of one bucket that occur ``least`` times or more, dealt by their suffixes."""

    def merge(table: pa.Table) -> pa.Table:
        words = table.column("bucket")[0].as_py() < 0
        firsts, counts = table.column("first").to_pylist(), table.column("counts").to_pylist()
        width = 8 if words else keys.width
        n = np.concatenate([np.frombuffer(c, np.uint32).astype(np.int64) if c is not None else np.ones(len(f) // width, np.int64) for f, c in zip(firsts, counts, strict=True)])
        if words:
            key = np.concatenate([np.frombuffer(f, U) for f in firsts])
        else:
            prefix, suffix = keys.unpack(firsts), keys.unpack(table.column("second").to_pylist())
            key = keys.join(prefix, suffix)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(n[order], first)
        if words:
            none = [pa.nulls(len(n), k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
            return pa.table([pa.array(key[first].view(np.int64)), pa.array(n), *none], names=_COUNTED.names)
        kept = n >= least
        prefix, suffix, n = prefix[order[first[kept]]], suffix[order[first[kept]]], n[kept]
        by = np.argsort(suffix)
        prefix, suffix, n = prefix[by], suffix[by], n[by]
        return _packed(_COUNTED, [{"deal": b, "suffixes": keys.pack(suffix[lo:hi]), "prefixes": keys.pack(prefix[lo:hi]), "counts": _whole(n[lo:hi])} for b, lo, hi in _stretches(keys.bucket(suffix))])

    return merge


def _counted(texts: DataFrame, keys: Keys, length: int, passes: list, with_words: bool = False, least: int = LEAST_COUNT) -> DataFrame:
    fed = texts.mapInArrow(_count_runs(keys, length, passes, with_words), _FED)
    return fed.groupBy("bucket").applyInArrow(_merge_runs(keys, least), _COUNTED)


def _pack_words(keys: Keys):
    """A task: the words' keys, counts and chances as the lowest level."""

    def pack(batches):
        for batch in batches:
            key, n, above, chance = (batch.column(i).to_numpy() for i in range(4))
            order = np.argsort(key)
            key, n, above, chance = key[order].view(U), n[order], above[order], chance[order]
            yield from _packed(_LEVEL, [
                {"deal": b, "keys": keys.pack(key[lo:hi]), "counts": _whole(n[lo:hi]), "above": _whole(above[lo:hi]), "chances": chance[lo:hi].tobytes()} for b, lo, hi in _stretches(keys.bucket(key))
            ]).to_batches()

    return pack


def _level_below(keys: Keys, below: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order with counts, counts of their suffixes and chances; one key that no run has stands last."""
    raw = below.column("keys").to_pylist()
    sizes = _sizes(keys, raw)
    key = keys.unpack(raw)
    order = np.argsort(key)
    n, above = (_wholes(below.column(c).to_pylist(), sizes) for c in ("counts", "above"))
    chance = _floats(below.column("chances").to_pylist(), kind)
    return np.append(key[order], ~U(0)), np.append(n[order], 0), np.append(above[order], 0), np.append(chance[order], kind(0))


def _raise_runs(keys: Keys, kind: type):
    """Runs of one bucket of suffixes get their suffix's count and chance, and are dealt by their prefixes."""

    def raised(now: pa.Table, below: pa.Table) -> pa.Table:
        raw = now.column("suffixes").to_pylist()
        suffix, prefix, n = keys.unpack(raw), keys.unpack(now.column("prefixes").to_pylist()), _wholes(now.column("counts").to_pylist(), _sizes(keys, raw))
        known, count, _, chance = _level_below(keys, below, kind)
        at = np.searchsorted(known, suffix)
        hit = np.flatnonzero(known[at] == suffix)
        hit = hit[np.argsort(prefix[hit])]
        suffix, prefix, n, at = suffix[hit], prefix[hit], n[hit], at[hit]
        above, chance = count[at], chance[at]
        return _packed(_RAISED, [
            {"deal": b, "prefixes": keys.pack(prefix[lo:hi]), "suffixes": keys.pack(suffix[lo:hi]), "counts": _whole(n[lo:hi]), "above": _whole(above[lo:hi]), "chances": chance[lo:hi].tobytes()}
            for b, lo, hi in _stretches(keys.bucket(prefix))
        ])

    return raised


def _retain(keys: Keys, divergence: float, kind: type):
    """Runs of one bucket of prefixes: which of these contexts are retained, and all runs' chances, dealt by the runs' keys."""

    def retain(runs_: pa.Table, below: pa.Table) -> pa.Table:
        raw = runs_.column("prefixes").to_pylist()
        sizes = _sizes(keys, raw)
        prefix, suffix = keys.unpack(raw), keys.unpack(runs_.column("suffixes").to_pylist())
        n, above = (_wholes(runs_.column(c).to_pylist(), sizes) for c in ("counts", "above"))
        above_chance = _floats(runs_.column("chances").to_pylist(), kind).astype(float)
        if not len(prefix):
            return _packed(_LEVEL, [])
        order = np.argsort(prefix)
        prefix, suffix, n, above, above_chance = prefix[order], suffix[order], n[order], above[order], above_chance[order]
        first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        kinds = np.diff(np.append(first, len(prefix)))
        of = np.repeat(np.arange(len(first)), kinds)
        known, count, count_above, _ = _level_below(keys, below, kind)
        at = np.searchsorted(known, prefix[first])
        found = known[at] == prefix[first]
        whole, above_whole = np.where(found, count[at], 1).astype(float), np.where(found, count_above[at], 1).astype(float)
        held, above_held = np.add.reduceat(n, first), np.add.reduceat(above, first)
        rest = whole - held
        left_over = np.where(found & (rest > 0), rest, 0.0)
        gain = np.add.reduceat(n * np.log(n / above), first) + held * np.log(above_whole / whole)
        share = np.where(left_over > 0, left_over / whole, 1.0) / np.maximum(1 - above_held / above_whole, 1e-9)
        gain += np.where(left_over > 0, left_over * np.log(share), 0.0)
        keep = 1 - (held - kinds) / whole
        kept = found & (gain >= divergence * (kinds + (left_over > 0))) & (keep > 0)  # two runs of one key, a few in 10^8, could leave nothing
        left = keep[of] * above_chance
        in_kept = kept[of]
        chance = np.where(in_kept, (n - 1) / whole[of] + left, above_chance)
        gain = np.full(len(n), np.nan, np.float32)
        gain[in_kept] = np.log10(chance[in_kept] / left[in_kept])
        key, chance = keys.join(prefix, suffix), chance.astype(np.float32)
        order = np.argsort(key)
        key, n, above, chance, gain = key[order], n[order], above[order], chance[order], gain[order]
        out = [
            {"deal": b, "keys": keys.pack(key[lo:hi]), "counts": _whole(n[lo:hi]), "above": _whole(above[lo:hi]), "chances": chance[lo:hi].tobytes(), "gains": gain[lo:hi].tobytes()}
            for b, lo, hi in _stretches(keys.bucket(key))
        ]
        context, held, keep = prefix[first[kept]], held[kept], keep[kept].astype(np.float32)
        out += [{"deal": b, "keys": keys.pack(context[lo:hi]), "counts": _whole(held[lo:hi]), "kept": keep[lo:hi].tobytes()} for b, lo, hi in _stretches(keys.bucket(context))]
        return _packed(_LEVEL, out)

    return retain


def _level(now: DataFrame, below: DataFrame, keys: Keys, divergence: float, kind: type) -> DataFrame:
    """The runs of one more symbol with their chances and gains (log10 of the chance over what the suffix leaves), and the contexts retained with the share they keep.

    ``below`` is the level of the shorter runs; its keys are unique and its buckets even,
    so runs are looked up in it bucket by bucket, first by their suffixes, then by their
    prefixes.
    """
    raised = now.groupBy("deal").cogroup(below.groupBy("deal")).applyInArrow(_raise_runs(keys, kind), _RAISED)
    return raised.groupBy("deal").cogroup(below.groupBy("deal")).applyInArrow(_retain(keys, divergence, kind), _LEVEL)


def grow_tree(texts: DataFrame, depth: int = DEPTH, least: int = LEAST_COUNT, divergence: float = DIVERGENCE) -> tuple[Keys, DataFrame, list[DataFrame], list]:
    """The tree of a one-column table: how keys are made, the words (word, n, key), the levels of runs of two and more symbols, and their key sets."""
    spark = texts.sparkSession
    name = texts.columns[0]
    keys = Keys(texts.agg(F.sum(F.octet_length(name) + 1)).first()[0] or 0)
    both = write_scratch(_counted(texts, keys, min(2, depth + 1), [None] * min(1, depth), True, least), "counts")
    words = both.where("deal IS NULL").select("word", "n", F.col("word").bitwiseAND(F.lit(int(keys.mask))).alias("key"))
    words = write_scratch(words, "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    below = words.groupBy("key").agg(F.sum("n").alias("n"))
    kinds = words.count()
    below = below.select("key", "n", F.lit(total).cast("long").alias("above"), ((F.col("n") + 0.5) / F.lit(float(total + 0.5 * (kinds + 1)))).alias("chance"))
    below = write_scratch(below.mapInArrow(_pack_words(keys), _LEVEL), "level")
    lowest = below
    levels, sets, passes = [], [], [None]
    for length in range(2, depth + 2):
        if length > 2:
            both = write_scratch(_counted(texts, keys, length, passes, least=least), "counts")
        now = both.where("deal IS NOT NULL").select("deal", "suffixes", "prefixes", "counts")
        level = write_scratch(_level(now, below, keys, divergence, np.float64 if length == 2 else np.float32), "level")
        levels.append(level)
        below = level.where("chances IS NOT NULL")
        drop_scratch(both)
        if length <= depth:
            held = spark.sparkContext.broadcast(key_set(keys, below))
            sets.append(held)
            passes = [*passes, held]
    drop_scratch(lowest)
    return keys, words, levels, sets


_TREE = T.StructType([T.StructField("deal", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "values", "counts")]])


def _add_values(table: pa.Table) -> pa.Table:
    """The runs of one bucket: what each adds to a text's log10 probability, as a context and as a whole, and how often."""
    of, value, n = [], [], []
    for key, count, chance, gain, kept in zip(*[table.column(c).to_pylist() for c in ("keys", "counts", "chances", "gains", "kept")], strict=True):
        worth = np.log10(np.frombuffer(kept, np.float32).astype(float)) if chance is None else np.frombuffer(gain, np.float32).astype(float)
        some, width = ~np.isnan(worth), len(key) // len(worth)
        of.append(Keys.spread(key, width)[some]), value.append(worth[some]), n.append(_wholes([count], [len(worth)])[some])
    key, value, n = (np.concatenate(x) for x in (of, value, n))
    if not len(key):
        return _packed(_TREE, [])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    value, n = (np.add.reduceat(x[order], first) for x in (value, n))
    return _packed(_TREE, [{"deal": table.column("deal")[0].as_py(), "keys": Keys.places(key[first], width), "values": value.astype(np.float32).tobytes(), "counts": _whole(n)}])


def packed_tree(levels: list[DataFrame]) -> DataFrame:
    """A row for each bucket: its runs, what each adds to a text's log10 probability, and how often they occur."""
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.groupBy("deal").applyInArrow(_add_values, _TREE)


def _unpack_tree(choose=None):
    """A task: the rows (key, value, n) of a packed tree, those that ``choose`` picks by n."""

    def unpack(batches):
        for batch in batches:
            for key, value, count in zip(*[batch.column(c).to_pylist() for c in ("keys", "values", "counts")], strict=True):
                value = np.frombuffer(value, np.float32)
                key, n = Keys.spread(key, len(key) // len(value)), _wholes([count], [len(value)])
                some = np.flatnonzero(choose(n)) if choose else np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(value[some]), pa.array(n[some])], ["key", "value", "n"])

    return unpack


_RUN = "key long, value float, n long"


def tree_values(levels: list[DataFrame]) -> DataFrame:
    """key, value, n: what each run adds to a text's log10 probability, as a context and as a whole."""
    return packed_tree(levels).mapInArrow(_unpack_tree(), _RUN)


_SCORED = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("place", T.IntegerType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("added", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.LongType())),
        T.StructField("places", T.BinaryType()),
        T.StructField("runs", T.BinaryType()),
        T.StructField("deal", T.LongType()),
    ]
)
#: The same after the look-up: sums by place take the runs' place.
_FOUND = T.StructType([*_SCORED.fields[:-2], T.StructField("sums", T.BinaryType())])


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - slots.bit_length() + 1)).astype(np.int64)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each owner, their times, and how many each of ``n`` owners has."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first].view(np.int64), np.diff(np.append(first, len(keys))), np.bincount(owner[first], minlength=n)


#: Rows scored side by side; their places fit 16 bits.
CHUNK = 1 << 11


def _score_texts(fields: T.StructType, keys: Keys, depth: int, passes: list, valued, head_runs, head, end_base: float):
    """A task: a row for each text (base and what the heads give), and rows of other runs and their texts' places by bucket.

    ``deal`` is a bucket of runs, or below zero for the texts of a chunk.
    """

    def score(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 40
        tests, known_runs = [p.value if p is not None else None for p in passes], valued.value
        slots, logs = head.value
        run_slots, run_values = head_runs.value
        names = fields.names
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), CHUNK):
                batch = whole.slice(at, CHUNK)
                n = batch.num_rows
                data, offsets = utf8(batch.column(names.index("text")))
                data, offsets = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
                tokens, known, base, added = np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, end_base), np.zeros(n)
                words, times, many, rest_runs, rest_places = [], [], np.zeros(n, np.int64), [], []
                for i, j, hashes, ends, _ in word_blocks(data, offsets):
                    counts = np.diff(ends)
                    owner = np.repeat(np.arange(j - i), counts)
                    slot = (hashes & U(HEAD_SLOTS - 1)).astype(np.int64)
                    found = slots[slot] == hashes
                    tokens[i:j] += counts
                    known[i:j] += np.bincount(owner[found], minlength=j - i)
                    base[i:j] += np.bincount(owner[found], logs[slot[found]], j - i)
                    rest, often, many[i:j] = _distinct(hashes[~found], owner[~found], j - i)
                    words.append(rest)
                    times.append(often)
                    stream, text = symbols(hashes, ends)
                    for level in runs(keys, stream, text, tests):
                        live = np.flatnonzero((level != 0) & known_runs(level))
                        key, of = level[live], text[live]
                        slot = _slot(key, RUN_SLOTS)
                        in_head = run_slots[slot] == key
                        added[i:j] += np.bincount(of[in_head], run_values[slot[in_head]], j - i)
                        rest_runs.append(key[~in_head])
                        rest_places.append((of[~in_head] + i).astype(np.uint16))
                flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
                none = lambda kind: pa.nulls(n, kind)
                own = [batch.column(k) if c != "text" else pa.nulls(n, pa.string()) for k, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays(
                    [*[x for x, c in zip(own, names, strict=True) if c != "text"], pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), pa.array(known), pa.array(tokens), pa.array(base), pa.array(added),
                     list_array(flat(words), many), list_array(flat(times), many), none(pa.binary()), none(pa.binary()), pa.array(np.full(n, -1 - chunk))],
                    [*[c for c in names if c != "text"], *_SCORED.names],
                )
                key, place = flat(rest_runs).astype(U), flat(rest_places).astype(np.uint16)
                order = np.argsort(key)
                key, place = key[order], place[order]
                used = _stretches(keys.bucket(key))
                if used:
                    m = len(used)
                    packed = [keys.pack(key[lo:hi]) for _, lo, hi in used]
                    places = [place[lo:hi].tobytes() for _, lo, hi in used]
                    empty = [pa.nulls(m, batch.schema.field(k).type) for k, c in enumerate(names) if c != "text"]
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [*empty, pa.array(np.full(m, chunk)), *[pa.nulls(m, k) for k in kinds], pa.array(places, pa.binary()), pa.array(packed, pa.binary()), pa.array([b for b, _, _ in used], pa.int64())],
                        [*[c for c in names if c != "text"], *_SCORED.names],
                    )
                chunk += 1

    return score


def _look_up(keys: Keys):
    """The runs of one bucket of texts in the same bucket of the tree: sums by chunk and place. Rows of texts pass."""

    def look_up(texts: pa.Table, tree: pa.Table) -> pa.Table:
        names = [c for c in texts.column_names if c not in ("runs", "deal")]
        if texts.num_rows and texts.column("deal")[0].as_py() < 0:
            return texts.select(names).append_column("sums", pa.nulls(texts.num_rows, pa.binary()))
        known = keys.unpack(tree.column("keys").to_pylist())
        value = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(v, np.float32) for v in tree.column("values").to_pylist()]])
        order = np.argsort(known)
        known, value = np.append(known[order], ~U(0)), np.append(value[order].astype(float), 0.0)
        chunks, places, sums = [], [], []
        for chunk, raw, at in zip(texts.column("chunk").to_pylist(), texts.column("runs").to_pylist(), texts.column("places").to_pylist(), strict=True):
            key, place = keys.unpack([raw]), np.frombuffer(at, np.uint16)
            found = np.searchsorted(known, key)
            hit = known[found] == key
            total = np.bincount(place[hit], value[found[hit]])
            some = np.flatnonzero(total)
            if len(some):
                chunks.append(chunk), places.append(some.astype(np.uint16).tobytes()), sums.append(Keys.places(total[some], 8))
        given = {"chunk": pa.array(chunks, pa.int64()), "places": pa.array(places, pa.binary())}
        columns = [given[c] if c in given else pa.nulls(len(chunks), texts.schema.field(c).type) for c in names]
        return pa.table([*columns, pa.array(sums, pa.binary())], names=[*names, "sums"])

    return look_up


_TOTALS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("more", T.DoubleType())])


def _add_up(table: pa.Table) -> pa.Table:
    place = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("places").to_pylist()])
    total = np.bincount(place, np.concatenate([Keys.spread(x, 8).view(np.float64) for x in table.column("sums").to_pylist()]))
    some = np.unique(place)
    return pa.table([pa.array(np.full(len(some), table.column("chunk")[0].as_py())), pa.array(some.astype(np.int32)), pa.array(total[some])], names=_TOTALS.names)


def _least_step(steps: list, room: int) -> float:
    """The lowest whole step of a logarithmic scale from which on all rows fit the room; ``steps`` holds (step, rows)."""
    least = float("inf")
    for at, n in sorted(steps, reverse=True):
        room -= n
        if room < 0:
            break
        least = at
    return least


def _frequent(rows: DataFrame, room: int) -> DataFrame:
    """The most frequent rows (n), by whole steps of a logarithmic scale, as many as there is room for."""
    step = F.floor(8 * F.log2("n"))
    least = _least_step(rows.groupBy(step.alias("step")).count().collect(), room)
    return rows.where(step >= int(least)) if least != float("inf") else rows.limit(0)


def _frequent_runs(tree: DataFrame, room: int) -> DataFrame:
    """The same of a packed tree, as rows (key, value, n)."""
    step = lambda n: np.floor(8 * np.log2(n)).astype(np.int64)

    def steps(batches):
        for batch in batches:
            for value, count in zip(batch.column("values").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                at, n = np.unique(step(_wholes([count], [len(value) // 4])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["step", "n"])

    least = _least_step(tree.select("values", "counts").mapInArrow(steps, "step long, n long").groupBy("step").agg(F.sum("n")).collect(), room)
    return tree.mapInArrow(_unpack_tree(lambda n: step(n) >= least), _RUN)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def lm_scores(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH, least: int = LEAST_COUNT, divergence: float = DIVERGENCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    A null text is empty (one end). Repeated rows count and are scored as often as they
    come; a null doc_id is not held out. Without training rows every token is unknown. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with shuffles_removed(spark), setting(spark, BATCH_ROWS, str(CHUNK)), setting(spark, "spark.sql.parquet.compression.codec", "zstd"):
        keys, words, levels, sets = grow_tree(source.where(~held_out()).select("text"), depth, least, divergence)
        size, kinds, ends = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END_WORD, F.col("n")))).first()
        size, ends = size or 0, ends or 0
        whole = size + 0.5 * (kinds + 1)
        log = lambda c: float(np.log10((c + 0.5) / whole))
        slots, logs = np.zeros(HEAD_SLOTS, U), np.zeros(HEAD_SLOTS)
        table = _frequent(words, HEAD_WORDS).where(F.col("word") != END_WORD).select("word", "n").toArrow()
        word, n = table.column("word").to_numpy().view(U), table.column("n").to_numpy()
        slot = (word & U(HEAD_SLOTS - 1)).astype(np.int64)
        slots[slot], logs[slot] = word, np.log10((n + 0.5) / whole)
        head = share((slots, logs))

        tree = write_scratch(packed_tree(levels), "tree")
        for level in levels:
            drop_scratch(level)
        run_slots, run_values = np.full(RUN_SLOTS, ~U(0)), np.zeros(RUN_SLOTS, np.float32)  # no key has 64 bits
        table = _frequent_runs(tree, HEAD_RUNS).toArrow()
        order = np.argsort(table.column("n").to_numpy(), kind="stable")  # of two in one slot the more frequent stays
        run, value = table.column("key").to_numpy().view(U)[order], table.column("value").to_numpy()[order]
        slot = _slot(run, RUN_SLOTS)
        run_slots[slot], run_values[slot] = run, value
        valued = share(key_set(keys, tree))

    rows = source.select("doc_id", held_out().alias("held_out"), "text")
    fields = rows.schema
    own = [T.StructField(f.name, f.dataType) for f in fields if f.name != "text"]
    passes = ([None, *sets])[:depth]
    with setting(spark, BATCH_ROWS, str(CHUNK)), setting(spark, "spark.sql.parquet.compression.codec", "zstd"):  # the tail of the runs goes into the shuffle at once and stands nowhere else
        score = _score_texts(fields, keys, depth, passes, valued, share((run_slots, run_values)), head, log(ends))
        met = rows.mapInArrow(score, T.StructType(own + _SCORED.fields)).groupBy("deal")
        scored = write_scratch(met.cogroup(tree.select("deal", "keys", "values").groupBy("deal")).applyInArrow(_look_up(keys), T.StructType(own + _FOUND.fields)), "scored")
    drop_scratch(tree)
    sums = scored.where("place IS NULL").select("chunk", "places", "sums")
    scored = scored.where("place IS NOT NULL").drop("places", "sums")
    rare = scored.select("chunk", "place", F.explode(F.arrays_zip("words", "times")).alias("w")).select("chunk", "place", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    log_base = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(whole)))
    based = rare.join(words.select("word", "n"), "word", "left").groupBy("chunk", "place").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"), F.sum(log_base).alias("more_base"))
    based = write_scratch(based, "base")
    drop_scratch(words)
    more = write_scratch(sums.groupBy("chunk").applyInArrow(_add_up, _TOTALS), "sums")
    full = scored.drop("words", "times").join(based, ["chunk", "place"], "left").join(more, ["chunk", "place"], "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(size).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("added") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )

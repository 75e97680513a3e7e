"""Pairs of texts that may be alike, found among many: two bounds on what two texts share, each for many pairs at once.

A bound works on classes of characters, of which two texts share no less than of
characters, so a pair it drops is not alike; of the pairs it keeps some are not either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.operators.evaluation import common

#: Classes of characters: the code point modulo this.
CLASSES = 32
#: Groups of at most so many rows are compared pair by pair; in larger ones so many rows meet so many words of 64 others.
FEW, ROWS, STRIP = 256, 128, 16
#: Pairs a pass of the common subsequence, and the words of 64 characters beyond which it goes pair by pair.
PASS, WORDS = 8192, 8
#: Rows whose groups are read in one go, if no group is larger.
READ = 20_000


class Texts:
    """Texts as classes of characters: one row of counts each, and their codes one after the other."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") % CLASSES).astype(np.uint8)
        rows = np.repeat(np.arange(len(texts)) * CLASSES, self.sizes)
        self.counts = np.bincount(rows + self.codes, minlength=len(texts) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def _few(own: Texts, ends: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one small group: ``ends`` has the end of each row's group; sizes ascend in a group."""
    i, step = np.arange(len(ends)), 0
    while len(i):
        step += 1
        i = i[i + step < ends[i]]
        a, b = own.sizes[i], own.sizes[i + step]
        fits = 2 * a >= (least - 1e-12) * (a + b)
        i, a, b = i[fits], a[fits], b[fits]  # later ones of the group are longer still
        shared = np.minimum(own.counts[i], own.counts[i + step]).sum(1)
        kept = i[2 * shared >= (least - 1e-12) * (a + b)]
        yield kept, kept + step


def _needed(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Characters that texts of these sizes must share."""
    return np.ceil((least - 1e-12) * (a + b) / 2 - 1e-9).astype(np.int64)


def _totals(planes: np.ndarray) -> np.ndarray:
    """How many planes have each bit: three planes of a weight become one, and one of twice the weight."""
    total, weights, n = np.zeros(planes.shape[1] * 64, np.int64), [[planes]], 0
    while n < len(weights):
        left, above = np.concatenate(weights[n]), []
        while (third := len(left) // 3) > 0:
            x, y, z = left[:third], left[third : 2 * third], left[2 * third : 3 * third]
            odd = x ^ y
            above.append(x & y | odd & z)
            left = np.concatenate([odd ^ z, left[3 * third :]])
        for plane in left:
            total += np.unpackbits(plane.view(np.uint8), bitorder="little").astype(np.int64) << n
        weights += [above] if above else []
        n += 1
    return total


def _many(own: Texts, low: int, middle: int, high: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows from low to middle with those from middle to high, or, if middle is high, with one another, whose longest common subsequence suffices.

    A text meets 64 others a word: a bit is one of them, and the table of the subsequence
    is filled one diagonal after the other. In it ``down`` and ``right`` say where a step
    of the first or of the second text adds one. Places too far from the main diagonal
    would leave too many characters unmatched before or after them, so they stay empty.
    """
    sizes, begins = own.sizes[low:high], own.starts[low:high]
    codes = np.full((high - low, int(sizes[-1])), CLASSES, np.uint8)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = own.codes[begins[0] : begins[-1] + sizes[-1]]
    mine, first = (high - low, 0) if middle == high else (middle - low, middle - low)
    across = np.ascontiguousarray(np.pad(codes[first:].T, ((0, 0), (0, -(high - low - first) % 64)), constant_values=CLASSES))
    planes = np.stack([np.packbits(across == c, axis=1, bitorder="little").view(np.uint64) if c < CLASSES else np.zeros((len(across), across.shape[1] // 64), np.uint64) for c in range(CLASSES + 1)])
    words, at = planes.shape[2], 0
    while at < mine and (next_ := max(at + 1, first)) < len(sizes):
        stop = max(at + 1, min(at + ROWS, mine, int(np.searchsorted(sizes, sizes[at] * 1.25, side="right"))))  # rows of about one size
        size, reach = int(sizes[stop - 1]), int(np.searchsorted(sizes, sizes[stop - 1] * (2 - least) / least + 1e-6, side="right"))
        for begin in range((next_ - first) // 64, words, STRIP):
            low_b, high_b = first + begin * 64, min(first + (begin + STRIP) * 64, len(sizes))
            if low_b >= reach:
                break
            nearest, longest = int(sizes[max(low_b, next_)]), int(sizes[high_b - 1])
            lag, lead = longest - int(_needed(sizes[at], longest, least)), size - int(_needed(size, min(size, nearest), least))
            some = np.ascontiguousarray(planes[:, :longest, begin : begin + STRIP])
            wide = (stop - at) * some.shape[2]
            down, right, some = np.zeros((size, wide), np.uint64), np.zeros((longest, wide), np.uint64), some.reshape(-1, some.shape[2])
            classes = codes[at:stop, :size].T.astype(np.int64) * longest
            for d in range(size + longest - 1):
                i0 = max(0, d - longest + 1, -(-(d - lag) // 2))
                i1 = min(size - 1, d, (d + lead) // 2)
                if i1 < i0:
                    continue
                met = some.take(classes[i0 : i1 + 1] + np.arange(d - i0, d - i1 - 1, -1)[:, None], 0).reshape(-1, wide)
                v, h = down[i0 : i1 + 1], right[d - i1 : d - i0 + 1][::-1]
                met |= v
                met |= h
                turned = met ^ h
                np.bitwise_xor(met, v, out=h)
                v[...] = turned
            shared = _totals(down).reshape(stop - at, -1)[:, : high_b - low_b]
            i, j = np.arange(at, stop)[:, None], np.arange(low_b, high_b)
            i, j = np.nonzero((shared >= _needed(sizes[i], sizes[j], least)) & (i < j))
            yield i + at + low, j + low_b + low
        at = stop


def _subsequences(own: Texts, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a longest common subsequence that leaves the ratio at ``least`` or more; a row of its table is bits, as in common().

    A pair is left as soon as the rest of its second text cannot make up for what was unmatched.
    """
    need = _needed(own.sizes[i], own.sizes[j], least)
    ends, pair = own.sizes[j], np.arange(len(i))
    (a, i), (b, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    long_a, long_b = own.sizes[a], own.sizes[b]
    words = -(-int(long_a.max()) // 64)
    table = np.zeros((len(a), words, CLASSES + 1), np.uint64)
    for p in range(int(long_a.max())):
        on = np.flatnonzero(long_a > p)
        table[on, p // 64, own.codes[own.starts[a[on]] + p]] |= np.uint64(1 << p % 64)
    codes = np.full((int(long_b.max()), len(b)), CLASSES, np.uint8)  # the last class is in no text
    within = np.arange(len(codes))[:, None] < long_b
    codes[within] = own.codes[(np.arange(len(codes))[:, None] + own.starts[b])[within]]
    table, base = table.ravel(), i * (words * (CLASSES + 1))
    rows = [np.full(len(i), 2**64 - 1, np.uint64) for _ in range(words)]
    for p in range(len(codes)):
        at = base + codes[p].take(j)
        carry = None
        for w, row in enumerate(rows):
            met = table.take(at + w * (CLASSES + 1) if w else at)
            met &= row
            total = row + met
            over = total < met if w + 1 < words else None
            if carry is not None:
                total += carry
                over = over | (total < carry) if over is not None else None
            row ^= met  # without what met
            row |= total
            carry = over.astype(np.uint64) if over is not None else None
        if p % 8 == 7 or p + 1 == len(codes):
            found = sum((np.bitwise_count(~row).astype(np.int64) for row in rows), np.zeros(len(j), np.int64))
            kept = found + np.maximum(ends - p - 1, 0) >= need
            if not kept.all():
                base, j, ends, need, pair, rows = base[kept], j[kept], ends[kept], need[kept], pair[kept], [row[kept] for row in rows]
                if not len(j):
                    break
    return pair


def _kept(own: Texts, i: np.ndarray, j: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that the common subsequence does not rule out; i has the shorter texts."""
    words = -(-own.sizes[i] // 64)
    for w in np.unique(words):
        of = np.flatnonzero(words == w)
        if w > WORDS:
            least_of = lambda x, y: (least - 1e-12) * (len(x) + len(y))
            pairs = [(x, y) for x, y in zip(i[of], j[of], strict=True) if 2 * common(own.texts[x], own.texts[y]) >= least_of(own.texts[x], own.texts[y])]
            yield np.array([x for x, _ in pairs], np.int64), np.array([y for _, y in pairs], np.int64)
            continue
        for at in range(0, len(of), PASS):
            some = of[at : at + PASS]
            pair = _subsequences(own, i[some], j[some], least)
            yield i[some][pair], j[some][pair]


def possible_pairs(texts: list[str], late: np.ndarray, starts: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one group that may have a ratio of ``least`` or more, each once.

    ``starts`` has the first row of each group. Sizes ascend in a group; in one with late
    rows these come last, none shorter than the others, and only pairs of a late with
    another row are looked for.
    """
    own, ends = Texts(texts), np.append(starts[1:], len(texts))
    lates = np.add.reduceat(late.astype(np.int64), starts)
    small = (ends - starts <= FEW) & (lates == 0)
    among = np.where(small, ends, starts).repeat(ends - starts)  # rows of other groups meet nobody here

    gathered: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in _few(own, among, least):
        gathered.append((i, j))
        if sum(len(x) for x, _ in gathered) >= 16 * PASS:
            yield from _kept(own, *map(np.concatenate, zip(*gathered, strict=True)), least)
            gathered = []
    if gathered:
        yield from _kept(own, *map(np.concatenate, zip(*gathered, strict=True)), least)
    for low, high, n in zip(starts[~small].tolist(), ends[~small].tolist(), lates[~small].tolist(), strict=True):
        if n < high - low:
            yield from _many(own, low, high - n, high, least)


def links(batches: Iterator[pa.RecordBatch], least: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For rows (start, late, key, head, last, name, text) the pairs that may be alike, as (source, target, their names, target's text, source's text).

    A group begins where ``start`` is true. ``head`` and ``last`` are the first and the
    last document of a text: it is a source of those that occur in a document after its
    first. Two texts that each come before the other are a pair either way.
    """
    held: list[pa.Table] = []
    rows = 0
    place = lambda document: (document is not None, document)  # noqa: E731  null comes first

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, keys, names, heads, lasts = (table[c].to_pylist() for c in ("text", "key", "name", "head", "last"))
        starts = np.flatnonzero(table["start"].to_numpy(zero_copy_only=False))
        late = table["late"].to_numpy(zero_copy_only=False)
        for i, j in possible_pairs(texts, late, starts, least):
            out = [(x, y) for pair in zip(i.tolist(), j.tolist(), strict=True) for x, y in (pair, pair[::-1]) if place(heads[x]) < place(lasts[y])]
            for at in range(0, len(out), 1024):
                some = out[at : at + 1024]
                columns = [[keys[x] for x, _ in some], [keys[y] for _, y in some], [names[x] for x, _ in some], [names[y] for _, y in some], [texts[y] for _, y in some], [texts[x] for x, _ in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        begins = np.flatnonzero(table["start"].to_numpy(zero_copy_only=False))
        if rows and rows + table.num_rows > READ and len(begins):
            yield from compared(pa.concat_tables([*held, table.slice(0, begins[-1])]))
            table, held, rows = table.slice(begins[-1]), [], 0
        held.append(table)
        rows += table.num_rows
    if rows:
        yield from compared(pa.concat_tables(held))

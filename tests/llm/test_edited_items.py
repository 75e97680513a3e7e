"""Benchmark items that are held with words inserted or left out."""

import numpy as np
import pyarrow as pa

from tessera.llm import decontaminate
from tessera.llm.common import utf8


def test_insertions_and_deletions_are_found():
    rng = np.random.default_rng(9)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    item = words(104)
    index = decontaminate.ItemIndex([" ".join(item)])
    left_out, inserted, more = item[:48] + item[56:], item[:52] + words(8) + item[52:], item[:52] + words(10) + item[52:]
    much = item[:52] + words(24) + item[52:]
    texts = [" ".join(words(70) + held + words(50)) for held in (left_out, inserted, more, much, words(104))]
    found = index.matches(*utf8(pa.array(texts)), decontaminate.THRESHOLD)
    # shingles in common, of all: those over the edit differ
    assert [[(i, round(s, 6), at) for i, s, at in x] for x in found] == [[(0, round(88 / 104, 6), 70)], [(0, round(96 / 112, 6), 70)], [(0, round(96 / 114, 6), 70)], [], []]


def test_a_text_that_repeats_itself_is_checked_in_bounded_time():
    import time

    import pyarrow as pa

    from tessera.llm.common import utf8

    ten = [f"word{i}" for i in range(10)]
    item = ten * 10
    item[50] = "odd"
    index = decontaminate.ItemIndex([" ".join(item)])
    began = time.time()
    ((item_id, similarity, _),) = index.matches(*utf8(pa.array([" ".join(ten * 2000)])), 0.8)[0]
    assert (item_id, similarity) == (0, 0.91) and time.time() - began < 10


def test_spans_equal_bags_compared_one_by_one(monkeypatch):
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from tessera.llm.common import utf8
    from tessera.llm.words import LOWER, shingles, word_blocks

    rng = random.Random(3)
    bag = lambda words: Counter(shingles(words, np.array([0, len(words)]), 5)[0].tolist())
    for n in (3, 5, 20, 60):
        item = [rng.choice("abcdefg") for _ in range(n)]
        text = [rng.choice("abcdefg") for _ in range(30)] + item[: n // 2] + ["new"] + item[n // 2 :] + item
        index = decontaminate.ItemIndex([" ".join(item)])
        data, offsets = utf8(pa.array([" ".join(text)]))
        words = next(word_blocks(LOWER[data], offsets))[2]
        own = next(word_blocks(*utf8(pa.array([" ".join(item)]))))[2]
        starts = np.arange(-2, len(text) - 1, 3)
        want = 0.0
        for lo in starts:
            for hi in [lo + n] + [o + n for o in starts if lo - 0.2 * n <= o <= lo + 0.25 * n]:
                a, b = bag(words[max(lo, 0) : min(hi, len(words))]), bag(own)
                if min(hi, len(words)) > max(lo, 0):
                    want = max(want, (a & b).total() / max(1, (a | b).total()))
        for pairs, cells in ((100_000, 1_000_000), (7, 3)):
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            monkeypatch.setattr(decontaminate, "CELLS", cells)
            assert abs(index._best_span(words, 0, starts)[0] - want) < 1e-12

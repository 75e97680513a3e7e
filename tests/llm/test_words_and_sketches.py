"""Words, shingles, signatures and near-duplicate classes against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessera.llm import bagminhash, words
from tessera.llm.common import key_filter, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(texts, block=words.BLOCK):
    data, offsets = utf8(pa.array(texts, pa.string()))
    out = []
    for _, _, hashes, ends, _ in words.word_blocks(data, offsets, block):
        out += [hashes[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def bag(text, k=5):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def similarity(a, b):
    return (a & b).total() / max(1, (a | b).total())


def test_word_hashes_follow_the_words():
    texts = ["a b a", "", None, "  é\tb\n", "a", "x" * 500 + " b", " "]
    got, seen = hashed(texts), {}
    for text, row in zip(texts, got, strict=True):
        split = WORD.findall(text or "")
        assert len(split) == len(row)
        for w, h in zip(split, row, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_long_text_hashes_alike_in_pieces():
    text = " ".join(f"w{i % 97} {'y' * (i % 13)}" for i in range(3000))
    assert hashed([text], 256) == hashed([text])


def test_signatures_estimate_weighted_jaccard():
    base = [f"x{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(["rep"] * 40 + base[:150]), " ".join(["rep"] * 20 + base[:150]), " ".join(base[:100] + ["new"] + base[101:])]
    data, offsets = utf8(pa.array(texts))
    (_, _, hashes, ends, _), = words.word_blocks(data, offsets)
    times = bagminhash.signatures(*words.multisets(*words.shingles(hashes, ends)), len(texts), 1900)
    assert np.isfinite(times).all()
    for i in range(4):
        for j in range(i):
            assert abs((times[i] == times[j]).mean() - similarity(bag(texts[i]), bag(texts[j]))) < 0.05


def brute_classes(rows):
    nodes = {}
    for i, text in rows:
        if text is not None:
            nodes.setdefault(text, []).append(i)
    texts, parent = list(nodes), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8 - 1e-12:
                parent[root(i)] = root(j)
    classes = {}
    for i, t in enumerate(texts):
        classes.setdefault(root(i), []).extend(nodes[t])
    out = Counter()
    for members in classes.values():
        known = [m for m in members if m is not None]
        out.update((m, min(known) if known else None) for m in members)
    out.update((i, i) for i, t in rows if t is None)
    return out


def family(n, seed, edits):
    rng = np.random.default_rng(seed)
    base = [f"s{seed}w{i}" for i in rng.integers(0, 400, 160)]
    out = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for at in rng.choice(len(w), edits, replace=False):
            w[at] = f"e{k}_{at}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("large", [8192, 8])
def test_classes_equal_brute_force(spark, large):
    texts = [*family(30, 1, 3), *family(40, 2, 5), *family(5, 3, 30), "one two", "one two", "one two three", "", "", None, None, " ", "word " * 3000]
    texts += ["common passage " * 3 + t for t in family(12, 4, 2)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, bucket int")
    got = Counter((r.doc_id, r.class_id) for r in bagminhash.near_duplicate_classes(df, large=large).collect())
    assert got == brute_classes(rows)


def test_deduplicated_keeps_one_of_each(spark):
    rows = [(5, "a b c d e f", "p"), (2, "a b c d e f", "q"), (2, "a b c d e f", "q"), (7, "x y z", None), (8, None, "r"), (9, None, "r"), (None, "x y z", "s"), (None, "p q r", "t"), (None, "p q s", "t"), (None, "p q s", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    kept = bagminhash.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert got == [-1, -1, 2, 7, 8, 9]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bagminhash.near_duplicate_classes(df).count() == 0
    assert bagminhash.deduplicated(df).count() == 0


@pytest.mark.parametrize("most_bits", [1 << 27, 1 << 15, 100])
def test_key_filter_lets_every_key_pass(spark, most_bits):
    keys = spark.createDataFrame([(i * 7 if i else None,) for i in range(300)], "k long")
    rows = spark.createDataFrame([(i, "x") for i in range(2100)] + [(None, "y"), (0, None)], "k long, _part string")
    may, other = key_filter(keys, "k", most_bits)(rows, F.col("k"))
    assert may.columns == other.columns == rows.columns
    passed, kept = ([r.k for r in df.collect()] for df in (may, other))
    assert len(passed) + len(kept) == 2102 and not {*kept} & {None, *range(7, 2100, 7)}
    assert len(passed) < 600 if most_bits > 1 << 20 else True
    assert key_filter(keys.limit(0), "k")(rows, F.col("k"))[1].count() == 2102


def test_classes_do_not_depend_on_what_counts_as_large(spark):
    shared = [" ".join(f"shared{g}_{i}" for i in range(600)) for g in range(5)]
    texts = [f"{t} {passage}" for g, passage in enumerate(shared) for seed in range(3) for t in family(6, 20 + 3 * g + seed, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, many = ({(r.doc_id, r.class_id) for r in bagminhash.near_duplicate_classes(df, bands=1, rows=1, large=n).collect()} for n in (8192, 2))
    assert few == many and len({c for _, c in few}) < len(texts) / 2


def test_similar_weights_meet_in_a_divided_bucket(spark):
    weights = [*range(1, 60), 64, 80, 100, 125, 1000, 1250]
    now = spark.createDataFrame([(5, bytes([i]), bytes([i]), len(weights)) for i in range(len(weights))], "bucket long, key binary, component binary, size long")
    nodes = spark.createDataFrame([(bytes([i]), w, [5, 100 + i]) for i, w in enumerate(weights)], "key binary, weight long, bands array<long>")
    met = {}
    for r in bagminhash._divided(now, nodes, 8, 0.8).collect():
        met.setdefault(r.bucket, set()).add(r.key[0])
    assert all(any({i, j} <= keys for keys in met.values()) for i, a in enumerate(weights) for j, b in enumerate(weights) if min(a, b) >= 0.8 * max(a, b))
    assert max(map(len, met.values())) < len(weights) / 2

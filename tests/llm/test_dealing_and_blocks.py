"""Equal rows spread over groups, special tokens, naive packing, blocks of items, the fingerprint lookup against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, packing, vector_packing


def plain_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def test_special_ids_equal_an_unchanged_tokenizer(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "plain", "", "<|endof text|>", "x<|endoftext|>"]
    for text in texts:
        assert bpe.encoder(special=True)(text) == plain_ids(text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = vector_packing.best_fit_sequences(df, special=True).collect()
    assert {r.doc_id: r.length for r in rows} == {i: len(plain_ids(t)) + 1 for i, t in enumerate(texts)}
    assert sum(r.n_tokens for r in packing.packed_rows(df, special=True).collect()) == sum(len(plain_ids(t)) + 1 for t in texts)


def test_equal_rows_spread_over_the_groups(spark, monkeypatch):
    df = spark.range(60_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    packed = vector_packing.best_fit_sequences(df)
    groups = -(-60_000 // vector_packing.GROUP_PIECES)
    sizes = packed.groupBy(F.expr(f"(sequence_id div 2) % {groups}").alias("g")).count().collect()
    assert len(sizes) == groups and max(r["count"] for r in sizes) < 1.2 * 60_000 / groups
    monkeypatch.setattr(packing, "GROUP_BYTES", 1 << 16)
    groups = -(-60_000 * 8 // (1 << 16))
    rows = packing.packed_rows(df).groupBy(F.expr(f"row_id % {groups}").alias("g")).agg(F.sum("n_tokens").alias("n")).collect()
    assert len(rows) == groups and sum(r.n for r in rows) == 60_000 and max(r.n for r in rows) < 1.2 * 60_000 / groups


def naive(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_packing_equals_naive_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for capacity in (20, 100):
        lengths = rng.integers(1, capacity + 1, 500)
        assert len(packing.best_fit_decreasing(lengths, capacity)) == naive(lengths.tolist(), capacity)


def naive_vector(lengths, caps, weights):
    bins = []
    for n in sorted(lengths.tolist(), reverse=True):
        need = np.array([n, 1, n * n]) / caps
        left = [b - need for b in bins]
        fit = [i for i, x in enumerate(left) if (x >= -1e-12).all()]
        if fit:
            i = min(fit, key=lambda i: (np.round(weights @ (left[i] ** 2), 12), i))
            bins[i] = left[i]
        else:
            bins.append(1 - need)
    return len(bins)


def test_bound_limits_pack_like_a_naive_version():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 300)
    caps = np.array([100.0, 4.0, 6000.0 + 100**2 - 6000.0])
    for caps in (np.array([100.0, 4.0, 10_000.0]), np.array([100.0, 100.0, 10_000.0]), np.array([200.0, 6.0, 10_000.0])):
        bins, _ = vector_packing.vector_best_fit(lengths, tuple(caps))
        n, want = len(set(bins.tolist())), naive_vector(lengths, caps, np.array(vector_packing.WEIGHTS))
        assert abs(n - want) <= max(1, 0.01 * want)


def test_lookup_finds_every_pair_within_the_radius():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [" ".join(rng.choice(vocabulary, n)) for n in (16, 24, 24, 48)]
    index = decontaminate.ItemIndex(items)
    for size, part in index.sizes.items():
        doc = rng.choice(words, 600)
        prints = decontaminate.fingerprints(decontaminate.lane_sums(doc), size)
        # plant item fingerprints that differ from windows of the document by up to five bits
        for k in range(len(part.prints)):
            bits = rng.choice(64, rng.integers(0, 6), replace=False)
            part.prints[k] = prints[rng.integers(len(prints))] ^ np.bitwise_or.reduce(np.append(np.uint64(1) << bits.astype(np.uint64), np.uint64(0)))
        blocks = part.prints.view(np.uint16).reshape(-1, 4)
        part.orders = [np.argsort(blocks[:, b], kind="stable") for b in range(4)]
        part.starts = [np.append(0, np.cumsum(np.bincount(blocks[:, b], minlength=65536))) for b in range(4)]
        part.known = [np.diff(s) > 0 for s in part.starts]
        only = decontaminate.ItemIndex([])
        only.sizes = {size: part}
        want = {(w - int(part.place[k]), int(part.item[k])) for w in range(len(prints)) for k in range(len(part.prints)) if int(prints[w] ^ part.prints[k]).bit_count() <= decontaminate.RADIUS}
        assert {tuple(x) for x in only.hits(doc).tolist()} == want and want


@pytest.mark.parametrize("block_words", [60, 10**6])
def test_blocks_of_items_one_after_another(spark, block_words):
    rng = np.random.default_rng(6)
    item = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    items = [item(n) for n in (16, 24, 40, 30, 20)]
    texts = [f"{item(20)} {items[i % 5]} {item(20)}" for i in range(10)] + [item(60), None, "", f"{items[0]} {items[1]}"] * 2
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (7, None), (None, items[1])], "item_id long, text string")
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id is None, r.item_id or 0) for r in decontaminate.contaminated(docs, bench, block_words=block_words).collect())
    want = []
    for i, t in enumerate(texts):
        for k, x in [*enumerate(items), (None, items[1])]:
            if t and x in t:
                want.append((i == 3, i if i != 3 else 0, k is None, k or 0))
    assert got == sorted(want)
    kept = decontaminate.clean(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and kept.count() == 6

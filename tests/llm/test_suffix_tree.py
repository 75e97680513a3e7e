"""The suffix tree over words against a plain version with dictionaries, and its growth with the corpus."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import suffix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def tokens(text):
    return [*WORD.findall((text or "").lower()), None]


class Plain:
    """Counts, retained contexts and chances, spelt out."""

    def __init__(self, texts, depth, least, divergence):
        self.depth = depth
        self.n = [Counter() for _ in range(depth + 2)]
        for t in texts:
            w = tokens(t)
            for m in range(1, depth + 2):
                self.n[m].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
        self.total, kinds = sum(self.n[1].values()), len(self.n[1])
        self.whole = self.total + 0.5 * (kinds + 1)
        self.held = [{x: c for x, c in n.items() if c >= least} for n in self.n]
        self.keep = {}
        for m in range(2, depth + 2):
            follow = defaultdict(list)
            for x, c in self.held[m].items():
                follow[x[:-1]].append((x, c))
            for context, rows in follow.items():
                whole = self.n[m - 1][context]
                above = lambda x, m=m: self.n[m - 1][x[1:]] / (self.n[m - 2][x[1:-1]] if m > 2 else self.total)
                gain = sum(c * math.log(c / whole / above(x)) for x, c in rows)
                rest = whole - sum(c for _, c in rows)
                if rest:
                    gain += rest * math.log(rest / whole / max(1 - sum(above(x) for x, _ in rows), 1e-9))
                if gain >= divergence * (len(rows) + (rest > 0)):
                    self.keep[context] = 1 - sum(c - 1 for _, c in rows) / whole

    def chance(self, context, word):
        if not context:
            return (self.n[1][word,] + 0.5) / self.whole
        below = self.chance(context[1:], word)
        if context not in self.keep:
            return below
        return self.keep[context] * below + max(self.held[len(context) + 1].get((*context, word), 0) - 1, 0) / self.n[len(context)][context]

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.chance(tuple(w[max(0, i - self.depth) : i]), x)) for i, x in enumerate(w))


def corpus(rng):
    kinds = ["".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(kinds, rng.integers(1, 60))) for _ in range(150)]
    passage = " ".join(rng.choice(kinds, 30))
    return [*texts, *[f"{t} {passage}" for t in texts[:20]], texts[3], texts[3], texts[7], "zz É", "", None, " \n", "one", "A a A a A a A a"]


def test_scores_equal_the_plain_tree(spark, monkeypatch):
    texts = corpus(np.random.default_rng(8))
    want = {}
    for depth in (1, 3):
        plain = Plain([t for i, t in enumerate(texts) if not held(i)], depth, 2, 1.5)
        assert {len(c) for c in plain.keep} == set(range(1, depth + 1))
        want[depth] = [plain.score(t) for t in texts]
    # heads that hold all, little or nothing; tasks that hand on after every block; one bucket or many
    for depth, head, held_runs, bucket in ((3, suffix_tree.HEAD_RUNS, suffix_tree.HELD, suffix_tree.BUCKET), (3, 40, 1, 100), (1, 1, 50, 17)):
        monkeypatch.setattr(suffix_tree, "HEAD_RUNS", head)
        monkeypatch.setattr(suffix_tree, "HEAD_WORDS", max(head, 2))
        monkeypatch.setattr(suffix_tree, "HELD", held_runs)
        monkeypatch.setattr(suffix_tree, "BUCKET", bucket)
        rows = suffix_tree.lm_scores(table(spark, texts), depth=depth).collect()
        assert len(rows) == len(texts)
        assert all(abs(r.score - want[depth][r.doc_id]) < 1e-4 for r in rows)


def test_chances_add_up_to_one(spark):
    texts = corpus(np.random.default_rng(9))
    plain = Plain([t for i, t in enumerate(texts) if not held(i)], 3, 2, 1.5)
    for context in [(), *list(plain.keep)[::25]]:
        seen = sum(plain.chance(context, w) for (w,) in plain.n[1])
        assert abs(seen + plain.chance(context, "never seen") - 1) < 1e-9


def test_the_tree_grows_with_the_corpus_and_tells_repeated_texts_apart(spark):
    rng = np.random.default_rng(3)
    kinds = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(kinds, 80)) for _ in range(300)]
    sizes = []
    for n in (100, 300):
        texts_now = [t for t in texts[:n] for _ in range(2)]
        _, _, levels, _ = suffix_tree.grow_tree(table(spark, texts_now).select("text"))
        sizes.append(suffix_tree.tree_values(levels).count())
    assert sizes[1] > 2 * sizes[0]
    twice = [i for i in range(20) if not held(i) and not held(300 + i)]
    rows = {r.doc_id: r.score / r.n_tokens for r in suffix_tree.lm_scores(table(spark, [*texts, *texts[:20]])).collect()}
    assert min(rows[i] for i in twice) > max(s for i, s in rows.items() if 20 <= i < 300)


def test_wide_keys_and_clashing_columns(spark, monkeypatch):
    texts = corpus(np.random.default_rng(4))
    df = table(spark, texts).selectExpr("doc_id", "text", "1 AS chunk", "'x' AS bucket", "2 AS place", "3 AS n", "4 AS key")
    plain = {r.doc_id: r.score for r in suffix_tree.lm_scores(df).collect()}
    monkeypatch.setattr(suffix_tree, "WIDE_BYTES", 1)
    wide = {r.doc_id: r.score for r in suffix_tree.lm_scores(df).collect()}
    assert plain.keys() == wide.keys() and all(abs(plain[i] - wide[i]) < 1e-6 for i in plain)
    assert suffix_tree.lm_scores(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted((r.n_tokens, r.held_out) for r in suffix_tree.lm_scores(nulls).collect()) == [(1, False), (3, False), (3, False)]


def test_levels_travel_as_buckets_not_as_rows(spark, monkeypatch):
    texts = corpus(np.random.default_rng(5))
    monkeypatch.setattr(suffix_tree, "BUCKET", 1000)
    keys, _, levels, _ = suffix_tree.grow_tree(table(spark, texts).select("text"))
    assert 1 < keys.buckets < 8
    for level in levels:
        assert level.count() <= 2 * keys.buckets**2
    runs = suffix_tree.tree_values(levels)
    assert runs.count() == runs.select("key").distinct().count() > 2 * len(levels) * keys.buckets**2

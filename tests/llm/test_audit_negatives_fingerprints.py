"""Divergence audit and hard negatives against their SQL, fingerprints against a plain version; odd inputs."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import divergence, fingerprints, hard_negatives

DOCS = "doc_id long, text string, lang string, source string, term string, count long, value string"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted(con.execute(sql).fetchall())


# --- op11


def audited(spark, rows):
    df = spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], DOCS)
    got = sorted(map(tuple, divergence.audit(df).collect()))
    frame = pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["doc_id", "text", "lang", "source"]).astype({"text": "string", "lang": "string", "source": "string"})
    assert got == by_sql(divergence.ORACLE_SQL, documents=frame)
    return got


def odd_documents():
    rng = np.random.default_rng(3)
    words = [*"alpha Beta gamma été ÉTÉ straße 日本 x y z".split(), "don't", "a1b2c3"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), ["en", "fr", None, ""][i % 4], [f"s{i % 7}", None, "", "hot", "hot"][i % 5]) for i in range(600)]
    rows += [(None, "en", "silent"), ("", "en", "empty"), ("12 34 !!", "de", "digits"), ("alone", "it", None), ("word", None, None)]
    return rows + rows[:40]


@pytest.mark.parametrize("chunk, block, held", [(1024, 256, 200_000), (3, 2, 20)])
def test_audit_equals_sql(spark, monkeypatch, chunk, block, held):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    got = audited(spark, odd_documents())
    assert {r[2] for r in got} == {"pair", "term"}
    assert ("it", "", "pair") not in {r[:3] for r in got}  # a lone group has no pair
    assert {r[4] for r in got if r[0] == "de"} <= {0}


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_a_long_text_is_counted_in_slices(monkeypatch):
    text = ("Wort für Wort, ohne Ende. " * 50).encode()
    whole = [w for part in divergence._words(text) for w in part]
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert [w for part in divergence._words(text) for w in part] == whole == divergence.TERM.findall(text.lower())


def test_shares_are_exact_for_large_counts(spark):
    rng = np.random.default_rng(0)
    below = rng.integers(1, 9 * 10**15, 200)
    count = (below * rng.random(200)).astype(np.int64)
    want = [1 + 10**9 * (int(c) + 5) // int(b) for c, b in zip(count, below)]
    assert [int(divergence._shares(np.array([c]), np.array([b]))[0]) for c, b in zip(count, below)] == want
    df = spark.createDataFrame([(int(c), int(b) - 50) for c, b in zip(count, below) if b > 50], "count long, total long")
    assert [r[0] for r in df.select(divergence.share("count", "total", F.lit(10))).collect()] == [w for w, b in zip(want, below) if b > 50]


# --- op12

VECTORS = "vec_id long, embedding array<float>, label int, score string, cells int"


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = sorted(map(tuple, hard_negatives.mined(df).collect()))
    frame = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "embedding": [None if r[1] is None else np.array([np.nan if x is None else x for x in r[1]], np.float32) for r in rows], "label": pd.array([r[2] for r in rows], "Int32")})
    assert got == by_sql(hard_negatives.ORACLE_SQL, embeddings=frame)
    return got


def clustered(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    return [(int(i), (centres[i % 4] + spread * rng.normal(size=d)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("anchors, rows, cells", [(512, 4096, 256), (2, 50, 4), (3, 7, 2)])
def test_negatives_equal_sql(spark, monkeypatch, anchors, rows, cells):
    for name, value in (("ANCHORS", anchors), ("ROWS", rows)):
        monkeypatch.setattr(hard_negatives, name, value)
    made = hard_negatives.Cells
    monkeypatch.setattr(hard_negatives, "Cells", lambda a, b, sample: made(a, b, sample, cells))
    assert len(mined(spark, clustered(900, 6, 1))) > 20


def test_negatives_with_copies_ties_and_odd_rows(spark):
    rows = clustered(300, 3, 2)
    same = [(1000 + i, [0.5, 0.25, 0.75], i % 2) for i in range(400)]  # a third of all rows are copies
    rows += same + [(2000, None, 1), (2100, [0.1, None, 0.2], 1), (2200, [float("nan"), 1.0, 1.0], 1), (2300, [1.0, float("inf"), 1.0], 1), (2400, [1.0, 1.0, 1.0], None), (2500, [0.0, 0.0, 0.0], 1), (-100, [0.5, 0.25, 0.7], 0)]
    got = mined(spark, rows)
    assert {r[0] for r in got} >= {1000, 1100}


def test_negatives_do_not_depend_on_repeated_rows(spark):
    rows = clustered(300, 3, 5)
    once = mined(spark, rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:150]], VECTORS)
    assert sorted(map(tuple, hard_negatives.mined(df).collect())) == once


def test_negatives_of_nothing_and_shorter_vectors(spark):
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mined(spark.createDataFrame([(100, None, 1, "", 0)], VECTORS)).count() == 0
    rows = [(100, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [], 2)]
    got = hard_negatives.mined(spark.createDataFrame([(*r, "", 0) for r in rows], VECTORS)).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 2, 65536, 230 * 256)]


def test_bounds_hold_and_most_rows_are_not_scored(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(scale=200, size=(2000, 16)).astype(np.int64)
    vectors[0] *= 1000  # far outside the sample
    cells = hard_negatives.Cells(vectors.min(0), vectors.max(0), vectors[1:300])
    where = cells.of(vectors) + cells.offset
    for anchor in vectors[:20]:
        low, high = (hard_negatives._bounds(where, t) for t in cells.tables(anchor))
        exact = vectors @ anchor
        assert (low <= exact).all() and (exact <= high).all()
    df = spark.createDataFrame([(*r, "", 0) for r in clustered(3000, 12, 9)], VECTORS)
    calls = []
    real = hard_negatives._scored
    try:
        hard_negatives._scored = lambda c, *a: calls.append(c.count()) or real(c, *a)
        hard_negatives.mined(df).count()
    finally:
        hard_negatives._scored = real
    assert sum(calls) < 30 * 3000 / 20  # of 30 anchors x 3,000 rows


def test_components_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError):
        hard_negatives.mined(spark.createDataFrame([(100, [1e12], 1, "", 0), (1, [1.0], 1, "", 0)], VECTORS))


# --- op13

SPACES = re.compile("[ \t-\r]+")


def plain_sketch(text, k=fingerprints.K):
    hashed = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    words = [hashed(w.encode(), 42) for w in SPACES.split(text) if w]
    found = set()
    for i in range(max(len(words) - 4, 1) if words else 0):
        value = 42
        for w in words[i : i + 5]:
            value = hashed(w.to_bytes(8, "little"), value)
        found.add(value - (1 << 64) if value >> 63 else value)
    return sorted(found)[:k]


def plain_likeness(a, b, k=fingerprints.K):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if a == b else len(set(union) & set(a) & set(b)) / len(union)


def text_of(sketch):
    return "".join(f"{x % (1 << 64):016X}" for x in sketch)


ODD = ["Plain words here.", "", None, " \n\t ", "a", "ab", "abc", "é ü 日本 𝒳𝒴𝒵", "Long " * 4000, "one two three four five six seven eight nine ten", " ".join(f"w{i}" for i in range(5000)), "a  b\tc \v d\fe\rf", "Plain words here."]


@pytest.mark.parametrize("ids", [range(13), [5, 900, 3, 77, -4, 12, 1 << 40, 8, 0, 1, 2, 4, 6]])
def test_fingerprints_equal_a_plain_version(spark, ids):
    docs = dict(zip(ids, ODD, strict=True))
    df = spark.createDataFrame([(i, t, "en", "s", "x", 1, "y") for i, t in docs.items()], DOCS)
    rows = {r.doc_id: r for r in fingerprints.fingerprint_digest(df).collect()}
    order = sorted(docs, reverse=True)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, following = docs[i] or "", docs[after] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(following)
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b))
        assert r.near_edited == pytest.approx(plain_likeness(a, b)) and r.near_next == pytest.approx(plain_likeness(a, c))


def test_fingerprints_of_odd_ids(spark):
    one = "one two three four five six"
    df = spark.createDataFrame([(None, one, None, None, "x", 1, "y")] * 3 + [(7, one, None, None, "x", 1, "y")] * 4, DOCS)
    rows = fingerprints.fingerprint_digest(df).collect()
    assert len(rows) == 7
    assert {(r.doc_id, r.near_next, r.edited_sha256) for r in rows} == {(None, None, hashlib.sha256(one[:18].encode()).hexdigest()), (7, 1.0, hashlib.sha256((one[:18] + one[:9]).encode()).hexdigest())}
    assert fingerprints.fingerprint_digest(spark.createDataFrame([], DOCS)).count() == 0


def test_many_partitions_keep_the_order(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text of"), "id").alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        rows = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprint_digest(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i in range(1000):
        text, following = f"text of {i}", f"text of {(i - 1) % 1000}"
        cut = len(text) // 3
        assert rows[i] == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()


def test_sketches_merge_and_estimate(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 10**6, n)) for n in (3000, 3000, 40)]
    both = texts[0] + " " + texts[1]
    part = " ".join(texts[0].split()[:1500])
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, both, part, None])], "i int, text string").withColumn("sketch", fingerprints.sketch(F.col("text")))
    s = {r.i: r.sketch for r in df.collect()}
    assert s[5] == []
    one = {r.g: r.sketch for r in fingerprints.merged_by(df.withColumn("g", F.col("i") < 2), ["g"]).collect()}[True]
    assert one == sorted(set(s[0]) | set(s[1]))[: fingerprints.K] == sorted(set(plain_sketch(texts[0])) | set(plain_sketch(texts[1])))[: fingerprints.K]
    assert {r.i: r.sketch for r in fingerprints.merged_by(df, ["i"]).collect()} == s
    pair = lambda a, b: spark.createDataFrame([(s[a], s[b])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = pair(4, 3).select(fingerprints.containment(a, b), fingerprints.containment(b, a), fingerprints.resemblance(a, b), fingerprints.distinct_shingles(b)).first()
    assert got[0] > 0.7 and abs(got[1] - 0.25) < 0.1 and abs(got[2] - 0.25) < 0.12 and abs(got[3] / 5996 - 1) < 0.3
    assert tuple(pair(2, 5).select(fingerprints.containment(b, a), fingerprints.resemblance(a, b), fingerprints.distinct_shingles(a), fingerprints.distinct_shingles(b)).first()) == (1.0, 0.0, 36.0, 0.0)


def test_the_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", "x", 1, "y")], DOCS)
    plan = fingerprints.fingerprint_digest(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonSQL", ""))

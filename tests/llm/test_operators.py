"""The other training-data operators: brute force, round trips and edge cases on small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, html_wrapper, nn_descent, packing, quality, shards, suffix_tree, vector_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string"


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}" if i != 4 else None, len(t or ""), 7, "k") for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = ["Plain words here.", "", None, " \n\t ", "a", "repeat repeat repeat", "é ü 日本", "Long " * 4000, "a  b   c \n \n d ", "<|endoftext|> x", "Plain words here."]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- quality


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(n)) + "."


def test_quality_separates_and_scores_all(spark):
    rng = np.random.default_rng(0)
    good = [prose(rng, rng.integers(20, 200)) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, rng.integers(20, 200)).split()) for _ in range(60)] + ["spam " * rng.integers(20, 90) for _ in range(60)]
    texts = good + bad + ODD
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(0, 1, 0), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality_scores(df, labels).collect()}
    assert len(rows) == len(texts)
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(i for i in rows if rows[i].held_out and i < 240) == held
    assert np.mean([rows[i].predicted == int(i < 120) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert abs(rows[240].score - rows[250].score) < 1e-9
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_quality_without_a_class(spark):
    df = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(df, none).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), none).count() == 0
    assert quality.accepted(df, none).count() == len(ODD)


# --- tokens and packing


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_file():
    for text in [*ODD, "a\x85 \x85b", "\x1c \x1d", "it's we'll DON'T 12,5", "　x  y", " lead", "trail "]:
        assert bpe.encoder()(text or "") == reference_ids(text)


def test_best_fit_keeps_every_limit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 800)
    for rule in ("norm", "dot"):
        bins, offsets = vector_packing.vector_best_fit(lengths, (100, 5, 4000.0 + 100**2), rule=rule)
        for b in set(bins):
            own = lengths[bins == b]
            assert own.sum() <= 100 and len(own) <= 5 and (own**2).sum() <= 14000
            assert sorted(offsets[bins == b]) == [0, *np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]
    free, _ = vector_packing.vector_best_fit(lengths, (100, 1000, 10000.0))
    assert free.max() + 1 <= 1.02 * math.ceil(lengths.sum() / 100)
    with pytest.raises(ValueError):
        vector_packing.vector_best_fit(np.array([101]), (100, 5, 1e9))


def test_sequences_hold_every_piece(spark):
    rows = vector_packing.best_fit_sequences(docs(spark, ODD), capacity=64, max_documents=8, max_attention=64 * 64, group_pieces=5).collect()
    want = Counter()
    for i, text in enumerate(ODD):
        ids = [*reference_ids(text), 2]
        for piece, (at, n) in enumerate(vector_packing.cut(len(ids), 64)):
            want[i, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert sum(n for _, n in parts) <= 64 and len(parts) <= 8
    assert vector_packing.best_fit_sequences(docs(spark, ODD).limit(0)).count() == 0


def test_segment_tree_finds_the_least_room():
    rng, tree, held = np.random.default_rng(2), packing.RoomTree(50), Counter()
    for _ in range(2000):
        room = int(rng.integers(0, 51))
        if held[room] and rng.random() < 0.5:
            held[room] -= 1
            tree.add(room, -1)
        else:
            held[room] += 1
            tree.add(room, 1)
        need = int(rng.integers(0, 51))
        assert tree.least(need) == min((r for r, n in held.items() if n and r >= need), default=-1)


def test_packed_rows_round_trip(spark):
    rows = packing.packed_rows(docs(spark, ODD, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]), capacity=128).collect()
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 128 and r.cu_seqlens[-1] == r.n_tokens and r.cu_seqlens[0] == 0
        assert (ids[r.n_tokens :] == 0).all() and r.position_resets[: len(r.doc_ids)] == r.cu_seqlens[:-1]
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            parts[doc].append((start, ids[a:b].tolist()))
    for doc, text in zip([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None], ODD, strict=True):
        assert [x for _, p in sorted(parts[doc]) for x in p] == [*reference_ids(text), 2]
    assert len({r.row_id for r in rows}) == len(rows)


# --- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="post-{n}"><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A<li><a>B</a></ul></nav><div class="cookie-notice">We use cookies {n}</div><div id=main><div class="article-body">
<h1>Title {n} &amp; more</h1><p>First   <b>bold {n}</b>text<br>after.<p>Second &lt;{n}&gt; &eacute;&nbsp;x</p>{extra}<form><input name=q><button>Go</button></form></div>
<aside>Related {n}</aside><div class="comments"><p>Nice {n}</p></div></div><script>var a="</p><p>no";</script><footer>&copy; {n}</footer></body></html>"""
LIST = "<ul><li>one<li>two</ul>"


def test_wrapper_extracts_the_article(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n, extra=LIST if n % 2 else "")) for n in range(6)]
    rows += [(90, "http://h.example/x", None), (91, None, ""), (92, "odd", "no <b>markup</b> at all"), (93, "http://solo.example", "<body><div><p>Only text here.</p></div><nav>menu</nav>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_wrapper.extract(df).collect()}
    for n in range(6):
        lines = [f"Title {n} & more", f"First bold {n}text after.", f"Second <{n}> é x", *(["one", "two"] if n % 2 else [])]
        assert got[n].text == "\n".join(lines)
    assert got[90].text == got[91].text == "" and got[92].text == "no markup at all" and got[93].text == "Only text here."
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_wrapper.extract(df.limit(0)).count() == 0


def test_alignment_makes_optional_and_repeated_items():
    one, two, three = (html_wrapper.Page(f"<body><h1>t</h1>{x}</body>") for x in ("<p>a</p><p>b</p>", "<p>a</p><img><hr><em>x</em>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    wrapper = html_wrapper.Wrapper()
    for page in (one, two, three):
        wrapper.add(page)
    assert html_wrapper.expression(wrapper.items) == "body(h1(#) p(#)* em(#)? dl((dt(#) dd(#))+)?)".replace("((dt", "((dt")
    left, right = html_wrapper.Wrapper(), html_wrapper.Wrapper()
    left.add(one), right.add(two), right.add(three)
    left.join(html_wrapper.Wrapper.load(right.dump()))
    assert left.pages == 3 and left.slots == wrapper.slots


# --- sharding


def test_shards_match_the_mixture(spark):
    rows = [(i, f"t{i % 50}", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(700)] + [(7, "t7", None), (7, "t7", None), (None, None, "hot")]
    df = spark.createDataFrame([(*r, 99, 1) for r in rows], "doc_id long, text string, source string, shard int, size long")
    old = shards.BUCKET_ROWS
    shards.BUCKET_ROWS = 60
    try:
        out = shards.shard_digest(df).collect()
        mixed = shards.interleave(df.drop("shard")).collect()
    finally:
        shards.BUCKET_ROWS = old
    assert len(out) == len(rows)
    counts, slots = Counter(r.shard for r in out), defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    share = Counter((r.shard, r.source) for r in mixed)
    for source, n in Counter(r[2] for r in rows).items():
        assert all(abs(share[k, source] - n / 24) < 2 for k in range(24))
    assert shards.shard_digest(df.limit(0)).count() == 0


# --- decontamination


def test_contaminated_documents_are_found(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    items = [" ".join(word() for _ in range(n)) for n in (16, 24, 40, 59, 3, 7, 120)] + ["", None, " "]
    clean = [" ".join(word() for _ in range(60)) for _ in range(20)]
    holding = [f"{clean[i][:100]} {items[i % 7]}\n{clean[i][100:]}" for i in range(14)]
    edited = items[6].split()
    edited[60] = "changed"
    far = items[2].split()
    far[10] = far[20] = far[30] = "changed"
    texts = [*clean, *holding, " ".join(edited), " ".join(far), items[3].upper().replace(" ", "  \n"), "", None, "z " * 30000 + items[1]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, matches int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    want = {(20 + i, i % 7) for i in range(14)} | {(34, 6), (36, 3), (39, 1)}
    assert got == want
    blocks = docs(spark, texts).select("doc_id", F.explode(decontaminate.matches_column(bench, block_words=60)).alias("m"))
    assert {(r.doc_id, r.m.item_id) for r in blocks.collect()} == want
    kept = decontaminate.clean(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, texts).limit(0), bench).count() == 0


def test_lookup_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sums = decontaminate.lane_sums(prints)
    for size in (1, 5, 96):
        bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        want = [sum(1 << b for b in range(64) if 2 * bits[i : i + size, b].sum() > size) for i in range(len(prints) - size + 1)]
        assert decontaminate.fingerprints(sums, size).tolist() == want


# --- language model


def test_base_score_and_tree(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "Dog"], 30)) for _ in range(60)] + ODD
    rows = {r.doc_id: r for r in suffix_tree.lm_scores(docs(spark, texts)).collect()}
    tokens = [[*WORD.findall(lower(t or "")), "\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    count = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total, kinds = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        r = rows[i]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in count for w in t), total)
        assert abs(r.base_score - base) < 1e-6 * len(t) and r.score < 0
    assert rows[60].score == rows[70].score
    assert suffix_tree.lm_scores(docs(spark, texts).limit(0)).count() == 0


# --- chat


def test_snapshots_collapse(spark):
    said = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["a"], 6: ["c", "b"], 7: [None, "b"]}
    rows = [(k, i, "user" if i % 2 == 0 else None, t, 0) for k, v in said.items() for i, t in enumerate(v)] + [(2, 0, "user", "a", 0), (None, 0, "user", "z", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    out = {r.conv_id: r for r in chat.formatted_conversations(df).collect()}
    assert set(out) == {2, 4, 6, 7, None} and out[2].copies == 2 and out[2].n_turns == 3
    assert out[4].rendered == "<|user|>\na\n<|end|>\n<||>\nx\n<|end|>\n"
    assert chat.formatted_conversations(df.limit(0)).count() == 0


# --- neighbours


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)) + 2 * rng.normal(size=(8, 16))[rng.integers(0, 8, 900)]
    x[100:400] = x[100]
    vectors = [v.astype("float32").tolist() for v in x]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [1.0], 0), (5, vectors[5], 0), (None, vectors[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    old, nn_descent.LEAF = nn_descent.LEAF, 64
    try:
        got = defaultdict(list)
        for r in sorted(nn_descent.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
            got[r.query_id].append((r.vec_id, r.score))
    finally:
        nn_descent.LEAF = old
    assert sorted(got) == list(range(0, 900, 20))
    y, hits = np.array(vectors, np.float32).astype(float), []
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(s, 9)))[:20].tolist()
        assert len(found) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in found)
        assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)
        hits.append(len(set(best) & {i for i, _ in found}) / 20)
        if 100 <= q < 400:  # equal vectors: the least ids, in order
            same = [i for i, _ in found if 100 <= i < 400]
            assert same == [i for i in range(100, 400) if i != q][: len(same)]
    assert np.mean(hits) >= 0.9


def test_search_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = [(r.query_id, r.rank, r.vec_id, r.score) for r in nn_descent.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(rows) == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert nn_descent.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0

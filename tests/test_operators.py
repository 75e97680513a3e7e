"""Operators that SQL cannot check: brute force, invariants and hand-made rows."""

import datetime as dt
import json
import random
import zipfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, dedup, evaluation, graph, relational, texts, toxicity
from tessera.sources import files, sinks


@pytest.mark.parametrize("text", ["", "One. Two!\n\nThree; four", "x" * 3000, "a b " * 900, " lead. \n \n  trail ", "No end"])
def test_spans_keep_offsets_and_lose_only_space(text):
    spans = list(texts.spans_of(text))
    at = 0
    for lo, hi in spans:
        assert lo >= at and not text[at:lo].strip() and hi - lo <= 1200
        at = hi
    assert not text[at:].strip()


@pytest.mark.parametrize("text", ["", "p1\n\np2", "word " * 5000, ("para " * 100 + "\n\n") * 30])
def test_chunks_are_the_text(text):
    chunks = texts.chunks_of(text, 2000)
    assert "".join(c for _, _, c in chunks) == text
    assert all(len(c) <= 2000 and text[a : a + len(c)] == c for _, a, c in chunks)
    assert [i for i, _, _ in chunks] == list(range(1, len(chunks) + 1))


def test_bounded_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.randrange(30), i) for i in range(200)]
    got = Counter((r.i_a, r.i_b) for r in relational.bounded_pairs(spark.createDataFrame(rows, "s int, d int, i int"), ["s"], ["d", "i"], "i", 6).collect())
    want = Counter()
    by = defaultdict(list)
    for s, d, i in rows:
        by[s].append((d, i))
    for seq in by.values():
        seq.sort()
        want.update((seq[a][1], seq[b][1]) for a in range(len(seq)) for b in range(max(0, a - 6), a))
    assert got == want


def test_bridges(spark):
    edges = [(1, 1, 2, 0.9), (1, 2, 3, 0.9), (1, 1, 3, 0.9), (1, 3, 4, 0.72), (1, 4, 5, 0.95), (2, 7, 8, 0.9)]
    kept = graph.split_bridges(spark.createDataFrame(edges, "component int, a int, b int, weight double"), least=0.58)
    assert sorted((r.a, r.b) for r in kept.collect()) == [(1, 2), (1, 3), (2, 3), (4, 5), (7, 8)]


def test_degree_cap(spark):
    rows = [(1, a, b, 1.0 / (a + b)) for a in range(8) for b in range(a + 1, 8)]
    kept = graph.degree_capped(spark.createDataFrame(rows, "s int, a int, b int, score double"), "s", "score", 2).collect()
    degree = Counter(x for r in kept for x in (r.a, r.b))
    assert max(degree.values()) <= 2 and (0, 1) in {(r.a, r.b) for r in kept}


def test_components_of_a_path_and_alone(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 50, 51, 60, 70]], "node int")
    got = {r.node: r.component for r in graph.components(edges, nodes).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 51: 50, 60: 60, 70: 70}


def test_near_copies_against_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(i, "b", base.replace("dog", f"dog{i}" * (i % 3 + 1))) for i in range(9)] + [(20, "c", base), (21, "b", "short")]
    got = {(r.source, r.target): r.ratio for r in dedup.near_copies(spark.createDataFrame(rows, "id long, block string, text string").withColumn("doc", F.col("id")), ["block"], ["id"], "id", "doc", "text", 3, 0.78, 0.985).collect()}
    want = {}
    seq = sorted(r for r in rows if r[1] == "b")
    for a in range(len(seq)):
        for b in range(max(0, a - 3), a):
            x = evaluation.ratio(seq[a][2], seq[b][2])
            if 0.78 <= x < 0.985:
                want[seq[b][0], seq[a][0]] = round(x, 4)
    assert got == want


def test_twenty_alike_entries_become_one(spark):
    day = dt.date(2024, 1, 5)
    rows = [(1, day, "symptom", i, f"Patient reports mild headache {i:02d}", 0.5) for i in range(20)] + [(1, day, "lab", 50, "Other", 0.9)]
    out = dedup.timeline_dedupe(spark.createDataFrame(rows, "subject long, day date, category string, entry_id long, description string, confidence double")).collect()
    one = next(r for r in out if r.category == "symptom")
    assert len(out) == 2 and len(one.merged) == 20


def test_greedy_match_is_one_to_one(spark):
    day = dt.date(2024, 1, 1)
    gold = spark.createDataFrame([(1, 1, "a", "fever", day), (1, 2, "a", "fever", day), (1, 3, "b", "cough", day)], "subject long, id long, category string, entity string, day date")
    pred = spark.createDataFrame([(1, 11, "a", "fever", day), (1, 12, "b", "coughs", day), (1, 13, "z", "other", None)], "subject long, id long, category string, entity string, day date")
    got = sorted((r.gold_id, r.predicted_id) for r in evaluation.greedy_match(gold, pred).collect())
    assert got == [(2, 11), (3, 12)]


def test_a_changed_entry_breaks_the_chain(spark):
    rows = spark.createDataFrame([(1, i, f"p{i}") for i in range(5)] + [(2, 9, None)], "subject long, seq_no long, payload string")
    chain = audit.chained(rows, "subject", "seq_no", "payload")
    assert {(r.subject, r.entries, r.first_break) for r in audit.verified(chain, "subject").collect()} == {(1, 5, None), (2, 1, None)}
    bad = chain.withColumn("payload_hash", F.when((F.col("subject") == 1) & (F.col("seq") == 3), F.lit("x")).otherwise(F.col("payload_hash")))
    assert {(r.subject, r.first_break) for r in audit.verified(bad, "subject").collect()} == {(1, 3), (2, None)}


def test_corrections_replay_twice(spark):
    found = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, organ string")
    fixes = spark.createDataFrame([(1, "remove", None, 1), (2, "edit", "x", 1), (2, "edit", "y", 2), (9, "add", "z", 1)], "id long, action string, organ string, seq int")
    once = toxicity.corrected(found, fixes, "id", "organ")
    twice = toxicity.corrected(once, fixes, "id", "organ")
    assert sorted((r.id, r.organ) for r in once.collect()) == sorted((r.id, r.organ) for r in twice.collect()) == [(2, "y"), (3, "c"), (9, "z")]


def test_files_are_read_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caffè\r\npage\x0ctwo".encode("cp1252"))
    (tmp_path / "b.csv").write_text("x;y\n1;2\n;\n")
    (tmp_path / "c.json").write_text(json.dumps({"a": {"b": [1, None, {"c": "d"}]}}))
    (tmp_path / "d.xml").write_text('<r xmlns="u"><k> v </k><e/></r>')
    (tmp_path / "e.bin").write_bytes(b"\x00")
    (tmp_path / "f.json").write_text("{broken")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "g.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p></w:document>")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "caffè\npage\x0ctwo" and rows["b.csv"].text == "x | y\n1 | 2"
    assert rows["c.json"].text == "a.b[0]: 1\na.b[2].c: d" and rows["d.xml"].text == "k: v" and rows["g.docx"].text == "Hello there"
    assert rows["e.bin"].error == "unsupported" and rows["f.json"].text is None and "JSONDecodeError" in rows["f.json"].error
    paged = files.pages(files.read_documents(spark, str(tmp_path)).where("kind = 'txt'")).collect()
    assert [(r.page, r.page_text) for r in sorted(paged, key=lambda r: r.page)] == [(1, "caffè\npage"), (2, "two")]


def test_markdown_round_trip(spark):
    df = spark.range(1).select(sinks.markdown_table(["a", "b"], F.array(F.array(F.lit("1"), F.lit("x y")), F.array(F.lit("2"), F.lit("z")))).alias("t"))
    assert df.select(sinks.markdown_cells(F.col("t")).alias("c")).first().c == [["a", "b"], ["1", "x y"], ["2", "z"]]


def test_swap_in_replaces(spark, tmp_path):
    for n in (3, 5):
        sinks.swap_in(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def plain_related(rows, k, local_days, long_days):
    """Each row of (subject, entity, day, item, terms) with its predecessors, by loops."""
    out = {}

    def meet(group, scale, days, unknown, term):
        group = sorted(group, key=lambda r: (r[2] is not None, r[2] or 0, r[3]))
        for i, r in enumerate(group):
            for p in group[max(0, i - k) : i]:
                gap = None if r[2] is None or p[2] is None else abs((r[2] - p[2]).days)
                if unknown if gap is None else gap <= days:
                    pair = out.setdefault((min(r[3], p[3]), max(r[3], p[3])), {"local": False, "longitudinal": False, "days": gap, "terms": set()})
                    pair[scale] = True
                    pair["terms"] |= {term} - {None}

    for s in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == s]
        meet(mine, "local", local_days, False, None)
        for e in {r[1] for r in mine} - {None}:
            meet([r for r in mine if r[1] == e], "longitudinal", long_days, True, e)
        for t in {t for r in mine for t in r[4] or []}:
            meet([r for r in mine if t in (r[4] or [])], "longitudinal", long_days, True, t)
    return {(*pair, x["local"], x["longitudinal"], x["days"], len(x["terms"])) for pair, x in out.items()}


@pytest.mark.parametrize("terms", [None, "terms"])
def test_related_pairs_and_what_they_carry(spark, terms):
    rng = random.Random(5)
    day = lambda: rng.choice([None, *[dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(40)]])
    rows = [(rng.choice([1, 2, None]), rng.choice(["x", "y", None]), day(), i, rng.sample(["t", "u", "x"], rng.randrange(3))) for i in range(160)]
    df = spark.createDataFrame(rows, "s long, e string, d date, i long, terms array<string>")
    got = graph.related(df, "s", "e", "d", ["d", "i"], "i", 3, 4, 9, terms=terms, carried=["e"])
    flat = {(r.a, r.b, r.local, r.longitudinal, r.days, r.shared_terms) for r in got.collect()}
    assert flat == plain_related(rows if terms else [(*r[:4], []) for r in rows], 3, 4, 9)
    assert all((r.s, r.e_a, r.e_b) == (rows[r.a][0], rows[r.a][1], rows[r.b][1]) for r in got.collect())


@pytest.mark.parametrize("name", ["graph_candidates", "graph_rule_relations"])
def test_related_pairs_are_not_shuffled(spark, name, capsys):
    """The rows are dealt by subject once, the many pairs made of them not at all."""
    from tessera.plans import catalog

    catalog.queries()[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(user_id") == plan.count("Exchange") == 1 and "Join" not in plan

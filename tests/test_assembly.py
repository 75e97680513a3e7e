"""Joined fragments, greedy rounds, carried ids and separated components against plain versions."""

import difflib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, carryover, dedup, evaluation, fragments, matching

# --- fragments

FACTS = "doc long, seq int, category string, entity string, refs array<int>, attributes map<string,string>, other int"


def plain_fragments(facts):
    out = []
    for doc, seq, category, entity, refs, attributes, _ in sorted(facts, key=lambda f: (f[0], f[1])):
        refs = sorted({r for r in refs or [] if r and r > 0})
        said = {k: v for k, v in (attributes or {}).items() if v}
        name = lambda x: " ".join((x or "").split()).lower()
        if out and out[-1][0] == doc and refs and out[-1][4]:
            _, _, c, e, r, a, n = out[-1]
            near = refs[0] <= r[-1] + 1 and len({*r, *refs}) <= 6
            clash = any(k == j and v != w or k.startswith(j + ".") or j.startswith(k + ".") for k, v in said.items() for j, w in a.items())
            if (name(c), name(e)) == (name(category), name(entity)) and near and not clash:
                out[-1] = [doc, out[-1][1], c, e, sorted({*r, *refs}), {**said, **a}, n + 1]
                continue
        out.append([doc, seq, category, entity, refs, said, 1])
    return out


def test_fragments_equal_a_plain_fold(spark):
    rng = random.Random(2)
    value = lambda: rng.choice(["x", "x", "y", "", None])
    facts = []
    for doc in range(12):
        at = 1
        for seq in range(60):
            at = max(1, at + rng.choice([0, 0, 1, 1, 1, 2, -1]))
            refs = rng.choice([[at], [at], [at + 1, at], [at, at], [], None, [0, at], [None, at]])
            attributes = rng.choice([None, {}, {k: value() for k in rng.sample(["a", "b", "b.c", "b.d", "bc"], 2)}])
            facts.append((doc, seq, rng.choice(["lab", "lab", "Lab ", None]), rng.choice(["k", "k", " K", "m"]), refs, attributes, 1))
    facts.append((99, 0, None, None, None, None, 1))
    got = fragments.coalesced(spark.createDataFrame(facts, FACTS), "doc", "seq", "category", "entity", "refs", "attributes").collect()
    mine = [[r.doc, r.seq, r.category, r.entity, list(r.refs), dict(r.attributes), r.fragments] for r in got]
    key = lambda row: row[:2]
    assert sorted(mine, key=key) == sorted(plain_fragments(facts), key=key)
    assert max(m[6] for m in mine) >= 3


def test_fragments_of_nothing_and_a_long_island(spark):
    assert fragments.coalesced(spark.createDataFrame([], FACTS), "doc", "seq", "category", "entity", "refs", "attributes").count() == 0
    facts = [(1, i, "c", "e", [i + 1], {"k": "v"}, 0) for i in range(600)]
    got = fragments.coalesced(spark.createDataFrame(facts, FACTS), "doc", "seq", "category", "entity", "refs", "attributes").collect()
    assert len(got) == 100 and {r.fragments for r in got} == {6}


# --- greedy rounds


def plain_greedy(pairs):
    used, out = set(), []
    for score, a, b in sorted(((s, a, b) for a, b, s in pairs), reverse=True):
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_mutual_bests_are_the_greedy_matching(spark, seed):
    rng = random.Random(seed)
    pairs = list({(a, b): (a, b, rng.choice([0.5, 0.7, rng.random()])) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(160))}.values())
    df = spark.createDataFrame([*pairs, (None, 3, 9.0), (4, None, 9.0)], "a long, b long, score double")
    got = matching.one_to_one(df, "a", "b", F.struct("score", "a", "b"))
    assert got.columns == df.columns
    assert sorted((r.a, r.b) for r in got.collect()) == plain_greedy(pairs)


def test_no_pairs_no_matches(spark):
    empty = spark.createDataFrame([], "a long, b long, score double, s long")
    assert matching.one_to_one(empty, "a", "b", F.struct("score")).count() == 0
    assert matching.degree_capped(empty, "s", "score", 3).count() == 0


def test_degree_cap_equals_a_plain_pass(spark):
    rng = random.Random(4)
    pairs = list({(s, a, b): (s, a, b, round(rng.random(), 1)) for s, a, b in ((rng.randrange(3), *sorted(rng.sample(range(20), 2))) for _ in range(300))}.values())
    used, want = {}, []
    for s, a, b, score in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if used.get((s, a), 0) < 3 and used.get((s, b), 0) < 3:
            used[s, a], used[s, b] = used.get((s, a), 0) + 1, used.get((s, b), 0) + 1
            want.append((s, a, b))
    got = matching.degree_capped(spark.createDataFrame(pairs + pairs[:20], "s long, a long, b long, score double"), "s", "score", 3).collect()
    assert sorted((r.s, r.a, r.b) for r in got) == sorted(want)


EVENTS = "subject long, id long, category string, entity string, day date, extra int"


def test_greedy_match_equals_scoring_all_pairs(spark):
    import datetime as dt

    rng = random.Random(6)
    words = ["atrial fibrillation", "atrial flutter", "fibrillation", "chest pain", "thoracic pain", "", None]
    make = lambda first: [(rng.randrange(3), first + i, rng.choice(["symptom", "diagnosis", None]), rng.choice(words), rng.choice([dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]), 1) for i in range(40)]
    gold, predicted = make(0), make(1000)
    want, used = [], set()
    scored = []
    for g in gold:
        for p in predicted:
            if g[0] == p[0]:
                same, dated = (g[i] is not None and g[i] == p[i] for i in (2, 4))
                ratio = difflib.SequenceMatcher(None, g[3] or "", p[3] or "", autojunk=False).ratio()
                scored.append(((0.35 if same else 0.0) + 0.45 * ratio + (0.20 if dated else 0.0), g[1], p[1], g[0]))
    for score, g, p, s in sorted(scored, reverse=True):
        if score >= 0.62 and not {g, p} & used:
            used |= {g, p}
            want.append((s, g, p, round(score, 4)))
    got = evaluation.greedy_match(spark.createDataFrame(gold, EVENTS), spark.createDataFrame(predicted, EVENTS)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(ValueError):
        evaluation.greedy_match(spark.createDataFrame(gold, EVENTS), spark.createDataFrame(predicted, EVENTS), least=0.4)


def test_similarity_counts_frequent_characters():
    words = [f"clause{i} of the report" for i in range(40)]
    changed = [w if i not in (7, 21) else "another thing entirely" for i, w in enumerate(words)]
    assert evaluation.ratio("; ".join(words), "; ".join(changed)) > 0.9


@pytest.mark.parametrize("k", [2, 8])
def test_near_copies_equal_a_plain_pass(spark, k):
    rng = random.Random(k)
    base = [" ".join(f"clause{rng.randrange(200)} of report" for _ in range(30)) for _ in range(3)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = "changed"
        text = rng.choice([" ", "  ", "\n"]).join(words)
        rows.append((i, rng.randrange(12), rng.choice(["a", None]), text.upper() if i % 7 == 0 else text if i % 11 else None))
    want, seen = [], {}
    for i, document, block, text in rows:
        mine = " ".join((text or "").lower().split())
        for j, other_document, other in seen.setdefault(block, [])[-k:]:
            if mine and other and mine != other and document != other_document:
                ratio = difflib.SequenceMatcher(None, mine, other, autojunk=False).ratio()
                if 0.78 <= ratio < 0.985:
                    want.append((j, i, round(ratio, 4)))
        seen[block].append((i, document, mine))
    df = spark.createDataFrame(rows, "i int, doc int, block string, text string")
    assert sorted(map(tuple, dedup.near_copies(df, ["block"], ["i"], "i", "doc", "text", k).collect())) == sorted(want) and want


@pytest.mark.parametrize("seed", range(2))
def test_timeline_equals_a_fold_over_entries(spark, seed):
    import datetime as dt

    rng = random.Random(seed)
    base = ["mild headache reported by the patient at home", "chest pain on exertion", "chest pain at rest"]
    rows = []
    for i in range(80):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["new", "old"])
        text = " ".join(words)
        rows.append((rng.randrange(2), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(20)) if i % 13 else None, rng.choice(["symptom", None]), i, text.upper() if i % 5 == 0 else text, rng.choice([0.5, 0.9])))
    exact = {}
    for subject, day, category, i, text, sure in rows:
        exact.setdefault((subject, day, category, " ".join(text.lower().split())), []).append((i, text, sure))
    kept = []
    entries = []
    for (subject, day, category, _), copies in exact.items():
        lead = min(copies, key=lambda c: (-len(c[1]), -c[2], c[0]))
        entries.append([subject, day, category, lead[0], min(c[1] for c in copies), max(c[2] for c in copies), [c[0] for c in copies]])
    for e in sorted(entries, key=lambda e: (-len(e[4]), -e[5], e[3])):
        for k in kept:
            if k[0] == e[0] and k[2] is not None and k[2] == e[2] and k[1] and e[1] and abs((k[1] - e[1]).days) <= 7 and evaluation.ratio(e[4], k[4]) >= (0.75 if k[1] == e[1] else 0.95):
                k[6] += e[6]
                break
        else:
            kept.append(e)
    got = dedup.timeline_dedupe(spark.createDataFrame(rows, "subject long, day date, category string, entry_id long, description string, confidence double")).collect()
    assert {r.entry_id: (*r[:3], r.description, r.confidence, list(r.merged)) for r in got} == {k[3]: (*k[:3], k[4], k[5], sorted(k[6])) for k in kept}


# --- separated components


def plain_components(edges, nodes, apart):
    of, members = {n: n for n in nodes}, {n: {n} for n in nodes}
    bad = {frozenset(p) for p in apart}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], min(e[:2]), max(e[:2]))):
        x, y = of[a], of[b]
        if x != y and not any(frozenset((p, q)) in bad for p in members[x] for q in members[y]):
            of.update(dict.fromkeys(members[y], x))
            members[x] |= members.pop(y)
    return {n: min(members[of[n]]) for n in nodes}


@pytest.mark.parametrize("many", [0, 4, 60])
def test_components_keep_pairs_apart(spark, many):
    rng = random.Random(many)
    edges = list({frozenset((a, b)): (a, b, rng.choice([0.6, 0.8, rng.random()])) for a, b in (rng.sample(range(40), 2) for _ in range(90))}.values())
    apart = [tuple(rng.sample(range(40), 2)) for _ in range(many)]
    df = spark.createDataFrame(edges + edges[:5] + [(3, 3, 1.0)], "a long, b long, weight double")
    got = {r.node: r.component for r in matching.separated_components(df, spark.range(42).toDF("node"), spark.createDataFrame(apart + [(5, 5)], "a long, b long")).collect()}
    assert got == plain_components(edges, range(42), apart)
    assert all(got[a] != got[b] for a, b in apart)


def test_a_long_chain_is_cut_at_its_weakest_edge(spark):
    n = 20_000
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.when(F.col("id") == 777, 0.1).otherwise(0.5 + F.col("id") / n / 2).alias("weight"))
    apart = spark.createDataFrame([(0, n - 1)], "a long, b long")
    sizes = matching.separated_components(chain, spark.range(n).toDF("node"), apart).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in sizes} == {(0, 778), (778, n - 778)}


# --- carried ids


def test_ids_are_name_based_uuids(spark):
    got = spark.range(1).select(carryover.stable_id("EVT", F.lit("p1"), F.lit(None).cast("string"), F.lit("città"))).first()[0]
    assert got == "EVT_" + uuid.uuid5(uuid.NAMESPACE_URL, "p1\x1f\x1fcittà").hex


def test_a_reviewed_episode_keeps_its_id_when_an_earlier_one_appears(spark):
    clusters = spark.createDataFrame([("c1", "p", "symptom", "pain", 1), ("c2", "p", "symptom", "pain", 2), ("c3", "p", "diagnosis", "pain", 1), ("c4", "q", "symptom", "pain", 1), ("c5", "p", "symptom", "rash", 1)], "cluster string, subject string, category string, entity string, episode int")
    members = spark.createDataFrame([("c1", "e0", "2023-01-01", "d1"), ("c2", "e1", None, "d1"), ("c2", "e2", "2024-01-01", "d2"), ("c2", "e2", "2024-01-01", "d2"), ("c3", "e3", "2024-01-01", "d2"), ("c5", "e4", "2024-01-01", "d2")], "cluster string, evidence_id string, day string, document_id string")
    events = spark.createDataFrame([("EVT_old", "p", "symptom", "pain", "EPI_old"), ("EVT_less", "p", "symptom", "rash", None), ("EVT_other", "p", "medication", "pain", None)], "event_id string, subject string, category string, entity string, episode_id string")
    cited = spark.createDataFrame([("EVT_old", "e1"), ("EVT_old", "e2"), ("EVT_less", "e2"), ("EVT_less", "e4"), ("EVT_other", "e3")], "event_id string, evidence_id string")
    rows = {r.cluster: r for r in carryover.carried(clusters, members, events, cited).collect()}
    new = lambda kind, *parts: f"{kind}_" + uuid.uuid5(uuid.NAMESPACE_URL, "\x1f".join(parts)).hex
    assert (rows["c2"].event_id, rows["c2"].episode_id, rows["c2"].is_carried) == ("EVT_old", "EPI_old", True)
    assert rows["c1"].event_id == new("EVT", "p", "symptom", "pain", "e0") and rows["c2"].previous_episode_id == rows["c1"].episode_id
    assert rows["c3"].event_id == new("EVT", "p", "diagnosis", "pain", "1")
    assert rows["c4"].event_id == new("EVT", "q", "symptom", "pain", "")
    assert (rows["c5"].event_id, rows["c5"].episode_id) == ("EVT_less", new("EPI", "EVT_less"))


# --- audit


def test_a_chain_of_one_subject_spans_batches(spark):
    df = spark.range(30_000).select(F.lit(7).cast("long").alias("s"), "id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("payload"))
    chain = audit.chained(df, "s", "id", "payload")
    assert tuple(audit.verified(chain, "s").first()) == (7, 30_000, None)
    broken = chain.withColumn("entry_hash", F.when(F.col("id") == 20_500, F.sha2(F.lit("x"), 256)).otherwise(F.col("entry_hash")))
    assert audit.verified(broken, "s").first().first_break == 20_501


def test_few_pairs_are_matched_block_by_block(monkeypatch):
    import pandas as pd

    rng, matched = random.Random(5), []
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40, 90))) for _ in range(40)]
    texts += [t[:30] + "xy" + t[31:] for t in texts[:10]] + ["", "à" * 70]
    pairs = [(a, b) for a in texts for b in texts]
    want = [evaluation.ratio(a, b) for a, b in pairs]
    whole = evaluation.ratio
    monkeypatch.setattr(evaluation, "ratio", lambda a, b: matched.append(1) or whole(a, b))
    got = evaluation.ratio_from.func(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]), pd.Series([0.78] * len(pairs)))
    assert [None if pd.isna(x) else x for x in got] == [x if x >= 0.78 else None for x in want] and len(matched) < len(pairs) / 4


def test_the_ratio_is_that_of_difflib():
    import time

    rng = random.Random(11)
    for letters in ("ab", "abc", "abcdefgh ", "abé\U0001f600"):
        for _ in range(1500):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in "ab")
            b = rng.choice([b, a[:5] + b + a[5:]])
            assert evaluation.ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)
    long, began = "a" * 12_000, time.time()
    assert evaluation.ratio(long, long[:6_000] + "b" + long[:5_999]) == 2 * 11_999 / 24_000
    assert time.time() - began < 5  # in proportion to all pairs of places it takes longer


def test_odd_characters_never_rule_out_a_like_pair(spark):
    rng = random.Random(3)
    texts = ["", "a", "\U0001f600\U0001f600b", "é\u0301e"] + ["".join(rng.choice("ab1 é\U0001f600") for _ in range(rng.randrange(20))) for _ in range(40)]
    rows = [(a, b, evaluation.ratio(a, b) * (len(a) + len(b))) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string, twice double").withColumn("most", evaluation.most_shared(evaluation.odd_characters("a"), evaluation.odd_characters("b"), F.length("a") + F.length("b")))
    assert df.where("most < twice - 1e-9").count() == 0
    assert df.where("most < length(a) + length(b)").count() > len(rows) / 2


def test_timeline_across_weeks_and_without_text(spark):
    import datetime as dt

    sunday = dt.date(2024, 1, 7)
    texts = {1: ("Reading of 37 was recorded at the ward", 0), 2: ("Reading of 32 was recorded at the ward", 7), 3: ("Reading of 73 was recorded at the ward", 8), 4: (None, 0), 5: (None, 0), 6: ("", 0), 7: (" ", 1), 8: ("\U0001f600" * 20, 0), 9: ("\U0001f600" * 20 + "x", 7), 10: ("Reading of 37 was  recorded at the ward", 0)}
    rows = [(1, sunday + dt.timedelta(days=days), "c", i, text, 0.5) for i, (text, days) in texts.items()]
    kept = []
    exact = {}
    for _, day, _, i, text, _ in rows:
        exact.setdefault((day, text and " ".join(text.lower().split())), []).append((i, text))
    heads = []
    for (day, _), copies in exact.items():
        heads.append([day, min(copies, key=lambda c: (-len(c[1] or ""), c[0]))[0], min((c[1] for c in copies if c[1] is not None), default=None), [c[0] for c in copies]])
    for day, i, text, ids in sorted(heads, key=lambda h: (-len(h[2] or ""), h[1])):
        for k in kept:
            if text is not None and k[2] is not None and abs((k[0] - day).days) <= 7 and evaluation.ratio(text, k[2]) >= (0.75 if k[0] == day else 0.95):
                k[3] += ids
                break
        else:
            kept.append([day, i, text, ids])
    got = dedup.timeline_dedupe(spark.createDataFrame(rows, "subject long, day date, category string, entry_id long, description string, confidence double")).collect()
    assert {r.entry_id: (r.day, r.description, list(r.merged)) for r in got} == {k[1]: (k[0], k[2], sorted(k[3])) for k in kept}
    assert sorted(len(r.merged) for r in got)[-1] > 2

"""The corpus pipeline against a plain version of its stages, and the queries that SQL can express."""

import re
from collections import Counter

import duckdb

import corpus_pipeline
from tessera.llm import quality, queries
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text, k=5):
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def near(a, b):
    return (a & b).total() >= 0.8 * max(1, (a | b).total()) - 1e-9


def test_stages_equal_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, table(spark, SF, "labels")).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] >= 0.5}
    one = corpus_pipeline.quality_stage(spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(rows)

    bags, parent = {i: bag(t) for i, t in rows.items()}, {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a in sorted(rows):
        for b in sorted(rows):
            if b < a and (rows[a] == rows[b] or (bags[a] and bags[b] and min(bags[a].total(), bags[b].total()) >= 0.8 * max(bags[a].total(), bags[b].total()) and near(bags[a], bags[b]))):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    unique = {i for i in rows if root(i) == i}
    two = corpus_pipeline.near_dedup_stage(spark, one, SF)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == unique

    items = [" ".join(WORD.findall(r.text)).lower() for r in table(spark, SF, "benchmark").collect()]
    flat = {i: " ".join(WORD.findall(rows[i])).lower() for i in unique}
    three = corpus_pipeline.decontamination_stage(spark, two, SF)
    kept = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns
    assert not kept & {i for i in unique if any(q in flat[i] for q in items)}
    assert len(unique) - len(kept) <= 2 * len({i for i in unique if any(q in flat[i] for q in items)}) + 1

    packed = corpus_pipeline.packing_stage(spark, three, SF).collect()
    assert {r.doc_id for r in packed} == kept
    assert max(Counter({s: sum(r.length for r in packed if r.sequence_id == s) for s in {r.sequence_id for r in packed}}).values()) <= 1024


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_chat_equals_sql(spark):
    df = queries.queries()["op8_chat_formatting"](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    result = con.execute(queries.oracle_sql()["op8_chat_formatting"])
    names = [d[0] for d in result.description]
    want = sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in result.fetchall())
    assert sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect()) == want

import difflib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alike, dedup


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def edited(rng, text, share):
    out = list(text)
    for _ in range(int(len(out) * share)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(["", rng.choice("aeiou "), out[at] + rng.choice("xyzé")])
    return "".join(out)


def expanded(found, place):
    """All pairs of rows that links and copies stand for."""
    links = [r for r in found if r.ratio < 1]
    copies = defaultdict(list)
    for r in found:
        if r.ratio == 1:
            copies[r.source].append(r.target)
    pairs = [(a, b, r.ratio) for r in links for a in [r.source, *copies[r.source]] for b in [r.target, *copies[r.target]] if place(a) < place(b)]
    assert len({p[:2] for p in pairs}) == len(pairs)
    assert set(copies) <= {x for r in links for x in (r.source, r.target)}
    return sorted(pairs)


@pytest.mark.parametrize("chunk", [1 << 20, 900])
def test_links_stand_for_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    rng = random.Random(chunk)
    base = ["".join(rng.choice("etaoin shrdlu ") for _ in range(n)) for n in (20, 40, 90, 150)]
    rows = []
    for i in range(240):
        text = edited(rng, rng.choice(base), rng.choice([0, 0, 0.05, 0.1, 0.2]))
        rows.append((i, rng.randrange(30) if i % 13 else None, rng.choice(["a", "b", None]), text.upper() if i % 7 == 0 else None if i % 31 == 0 else text.replace(" ", " \n") if i % 11 == 0 else text))
    place = {i: (d is not None, d or 0, i) for i, d, _, _ in rows}
    want, seen = [], defaultdict(list)
    for i, document, block, text in sorted(rows, key=lambda r: place[r[0]]):
        mine = " ".join((text or "").lower().split())
        for j, earlier, other in seen[block]:
            if mine and other and mine != other and document != earlier and 0.78 <= (x := ratio(mine, other)) < 0.985:
                want.append((j, i, round(x, 4)))
        seen[block].append((i, document, mine))
    df = spark.createDataFrame(rows, "i int, doc int, block string, text string")
    found = dedup.near_copy_links(df, ["block"], "doc", ["i"], "i", "text").collect()
    assert expanded(found, lambda i: place[i][:2]) == sorted(want) and len(want) > len(found)


def test_query_finds_pairs_with_many_rows_between(spark, tmp_path):
    import __spark_entry__

    said = lambda i: f"Report of the ward {'abcdefghijklmnopqrstuvwxyz'[i]} was long"
    other = ["Report quince jumps vexed zebras oddly daft", "Report 1234 5678 9012 3456 7890 1357"]
    rows = [(i, f"{said(i)}. {other[i % 2]}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["near_copy_candidates"](spark, str(tmp_path)).collect()
    pairs = expanded(found, lambda fact: int(fact.split(":")[0]))
    assert [p[:2] for p in pairs] == sorted((f"{a}:0", f"{b}:0") for b in range(20) for a in range(b))


@pytest.mark.parametrize(("n", "few"), [(16, 256), (16, 2), (72, 8)])
def test_no_alike_pair_is_ruled_out(monkeypatch, n, few):
    monkeypatch.setattr(alike, "FEW", few)
    rng = random.Random(n)
    texts = []
    for size in (25, 60, 130, 600):
        first = "".join(rng.choice("etaoin shrdlué") for _ in range(size))
        texts += [edited(rng, first, rng.choice([0.02, 0.15, 0.3])) for _ in range(n // 4)]
    for late in (0, 7):
        groups = [sorted(rng.sample(texts, k), key=len) for k in (n, 3, 1, n // 2)]
        starts = np.cumsum([0, *map(len, groups)])[:-1]
        flags = np.concatenate([np.arange(len(g)) >= len(g) - late if late else np.zeros(len(g), bool) for g in groups])
        flat = [t for g in groups for t in g]
        got = [p for i, j in alike.possible_pairs(flat, flags, starts, 0.78) for p in zip(i.tolist(), j.tolist(), strict=True)]
        want = set()
        for low, g in zip(starts.tolist(), groups, strict=True):
            for j in range(low, low + len(g)):
                want |= {(i, j) for i in range(low, j) if (not late or flags[j] and not flags[i]) and max(ratio(flat[i], flat[j]), ratio(flat[j], flat[i])) >= 0.78}
        assert want <= set(got) and len(set(got)) == len(got) and want

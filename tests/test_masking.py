"""Masked numbers and their return, canonical analytes, merged names."""

import itertools
import random
import string

import pytest
from pyspark.sql import functions as F

from tessera.functions import masking
from tessera.operators import identity, labs


def names():
    for n in itertools.count(1):
        yield from map("".join, itertools.product(string.ascii_uppercase, repeat=n))


def test_tokens_count_in_letters(spark):
    numbers = [*range(60), 701, 702, 703, 18277, 18278, 18279, 20000]
    df = spark.createDataFrame([(n,) for n in numbers], "n int")
    want = list(itertools.islice(names(), 20001))
    assert [r[0] for r in df.orderBy("n").select(masking._letters(F.col("n"))).collect()] == [want[n] for n in numbers]


TEXTS = ["TC del 12/03/2024: 3,5 mm e 40 %", "[PAGINA 2] 37.5 °C ore 12:30", "nulla", "", None, "-5 +7 1.234,56", "a1b 22c", "12.03.2024-13.03.2024", "[Pagina  3]x", "9" * 40, " ".join(map(str, range(900)))]


def test_masking_hides_all_digits_and_returns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").withColumn("m", masking.masked(F.col("t")))
    rows = df.select("t", "m", masking.restored(F.col("m"), F.col("t")).alias("r")).collect()
    assert not any(ch.isdigit() for r in rows for ch in r.m)
    assert [(r.r.text, r.r.problem) for r in rows] == [(t, None) if (t or "").strip() else (None, "empty") for t in TEXTS]
    assert rows[1].m == "[[PAGINA_A]] [[VALORE_B]] °C ore [[VALORE_C]]"  # a number with one mark reads as a day and month first


@pytest.mark.parametrize(("output", "text", "problem"), [
    ("dose [[VALORE_A]] e [[VALORE_B]]", "dose 5 e 10", None), ("solo [[VALORE_B]]", "solo 10", None), ("[[VALORE_B]] poi [[VALORE_A]]", None, "reordered"), ("[[VALORE_A]] [[VALORE_Z]]", None, "unknown_token"),
    ("[[VALORE_A]], [[VALORE_A]], [[VALORE_B]]", "5, , 10", None), ("[[VALORE_B]] [[VALORE_A]] [[VALORE_B]]", None, "duplicated_token"), ("[[VALORE_A]] 99", None, "new_number"), ("[[VALORE_A]] [VALORE B", None, "damaged_token"),
    (masking.NOTHING, masking.NOTHING, None), ("", None, "empty"), (None, None, "empty"), ("senza numeri", "senza numeri", None),
])
def test_outputs_are_checked(spark, output, text, problem):
    got = spark.range(1).select(masking.restored(F.lit(output).cast("string"), F.lit("dose 5 e 10 mg"))).first()[0]
    assert tuple(got) == (text, problem)


def test_parameters_of_odd_names(spark):
    cases = [(None, None, None, ""), ("", "", "", ""), ("  ", "%", "urine", ""), ("got got", "", "", "aspartato_aminotransferasi_aspartato_aminotransferasi"), ("hbsag", "", "", "hbsag"), ("Colesterolo  HDL", "", "", "colesterolo_colesterolo_hdl"), ("creatinina", "mg/24h", "URINE", "creatinina_urine"), ("creatinina", "mg/dl", "urine", "creatinina")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n string, u string, m string, want string")
    assert [r.got for r in df.select("i", labs.normal_parameter(F.col("n"), F.col("u"), F.col("m")).alias("got")).orderBy("i").collect()] == [c[3] for c in cases]


def test_subset_names_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["anna", "bruno", "carla", "dario", "elena", "fabio"]
    rows = [(i, rng.choice([1, 2, None]), " ".join(rng.choice([str.upper, str.title])(w) for w in rng.choices(words, k=rng.randrange(0, 4))) if i % 9 else None) for i in range(120)]
    bag = lambda r: frozenset((r[2] or "").lower().split())
    group = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in itertools.combinations(rows, 2):
            if a[1] is not None and a[1] == b[1] and bag(a) and bag(b) and (bag(a) <= bag(b) or bag(b) <= bag(a)):
                group[a[0]] = group[b[0]] = min(group[a[0]], group[b[0]])
    df = spark.createDataFrame(rows, "k int, birth int, name string")
    got = {r.k: r.group for r in identity.groups(df, "k", [], identity.subset_names(df, "k", "birth", "name")).collect()}
    assert got == group

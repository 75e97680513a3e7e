"""What a document's sentences signal and no extracted fact covers: a plan of what to look at again.

Signals are typed; a fact covers a signal of its own or of an equivalent type in every
sentence it cites. Signals and citations meet as rows, so the plan is an anti-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.evidence import matches

#: Fixed values, patterns over a sentence: what signals a fact of each type.
IMAGING = r"(?i)(?:^|\W)(?:TC|TAC|RMN?|PET(?:[- /]?FDG|/TC)?|RX|ecografi\w*)(?:\W|$)"
PATHOLOGY = r"(?i)\b(?:istolog\w*|istopatolog\w*|citolog\w*|biops\w*|immunoistochim\w*|pezzo operatorio|campione tissutale|margini? di resezione)\b"
PLANNED = r"(?i)\b(?:da\s+(?:eseguire|effettuare|programmare)|si\s+(?:programma|programmerà|richiede|propone|consiglia)|(?:programmat|pianificat|previst|richiest|consigliat|indicat|propost|prenotat)\w*|in\s+attesa\s+di|eventuale|candidato\s+(?:a|ad))\b"
PERFORMED = r"(?i)\b(?:eseguit|effettuat|praticat|sottopost)\w*\b[^.;]{0,90}?(?:broncoscopia(?:\s+con\s+BAL)?|colonscopia|gastroscopia|EGDS|toracentesi|paracentesi|biopsia\w*|exeresi|resezione|asportazione)\b"
FINDING = r"(?i)\b(?:evidenz\w*|mostra\w*|presenza|comparsa|increment\w*|riduz\w*|captazione|lesion\w*|nodul\w*|metastas\w*|edema|ispessimento|enhancement|ipodensit\w*|iperintensit\w*|pseudonodularit\w*|linfoaden\w*|repert\w*)\b"
OVER = r"(?i)\b(?:risolt|scompars|regredit)[oaie]*\b"
SIGNALS = {
    "diagnosis": r"(?i)\b(?:affett[oa]\s+da|diagnos\w*|melanoma|metastas\w*|progressione|risposta (?:metabolica )?(?:completa|parziale)|tossicit\w*|miocardite|polineuropatia|uveite|allerg\w*|familiarit\w*|compatibile\s+con|sospett\w*|probabil\w*)\b",
    "symptom": r"(?i)\b(?:dolor\w*|tosse|dispnea|affanno|astenia|fatigue|nausea|vomito|diarrea|stipsi|prurito|rash|eritema|cefalea|vertigin\w*|disfagia|disfonia|parestesi\w*|ipoestesia|debolezza|palpitazioni|sincope|brividi|calo ponderale)\b",
    "procedure": r"(?i)\b(?:sottopost[oa]\s+(?:ad?|a)|exeresi|resezione|asportazione|intervento chirurgico|radioterapia|RT\s+(?:su|alla)|biopsia|broncoscopia|colonscopia)\b",
    "vital_sign": r"(?i)\b(?:SpO2|saturazione|FC|frequenza cardiaca|PA|pressione arteriosa|temperatura|peso|BMI|ECOG|performance status)\b",
    "clinical_decision": r"(?i)\b(?:si (?:è )?concorda(?:to)?|si prescrive|in programma|si propone|indicat[oa]|soprassedere|monitoraggio|programmat\w*|rivalutazione|follow[- ]?up)\b",
    "hospitalization": r"(?i)\b(?:ricover\w*|ospedalizz\w*|degenza|accesso\s+(?:in|al)\s+(?:pronto soccorso|PS))\b",
    "discharge": r"(?i)\b(?:dimess\w*|dimission\w*)\b",
    "biomarker": r"(?i)\b(?:BRAF|NRAS|KRAS|EGFR|ALK|ROS1|HER2|ERBB2|PD[- ]?L1|MSI|dMMR|BRCA[12]?|KIT|RET|MET|NTRK|IDH[12]?|MGMT|mutat\w*|wild[- ]?type|amplificat\w*|espressione)\b",
}
#: Types that stand for each other, always and in a sentence that plans.
EQUIVALENT = [("radiology_finding", "instrumental_finding"), ("vital_sign", "clinical_sign")]
EQUIVALENT_IF_PLANNED = ("procedure", "clinical_decision")


def signal_types(sentence: Column, is_medication: Column | None = None) -> Column:
    """The types a sentence signals; ``is_medication`` says whether it names a drug. A null sentence signals none."""
    text = F.coalesce(sentence, F.lit(""))
    tests = {
        "medication": F.coalesce(is_medication, F.lit(False)) if is_medication is not None else F.lit(False),
        "radiology_finding": matches(text, IMAGING) & matches(text, FINDING),
        **{name: matches(text, pattern) for name, pattern in SIGNALS.items()},
    }
    tests["symptom"] = tests["symptom"] & ~matches(text, OVER)
    return F.filter(F.array(*[F.when(test, name) for name, test in tests.items()]), lambda x: x.isNotNull())


def _stand_ins(kind: Column, planned: Column) -> Column:
    """The types that cover a signal: its own and those equivalent to it."""
    out = [F.array(kind)]
    for pair in EQUIVALENT:
        out.append(F.when(kind.isin(*pair), F.array(*[F.lit(x) for x in pair])).otherwise(F.array().cast("array<string>")))
    out.append(F.when(planned & kind.isin(*EQUIVALENT_IF_PLANNED), F.array(*[F.lit(x) for x in EQUIVALENT_IF_PLANNED])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(reduce(F.concat, out))


def missing_signals(sentences: DataFrame, facts: DataFrame, document: str, number: str, sentence: str, is_medication: Column | None = None) -> DataFrame:
    """document, number, fact_type: signals of sentences that no fact covers.

    ``facts``: document, fact_type, refs (the numbers of the sentences it cites). A
    pathology result that has its histopathology fact needs neither diagnosis nor
    procedure, and a procedure that was performed is found by rule. Sentences are unique
    by document and number; repeated facts count once; null types and references cover
    nothing; empty tables give an empty plan or leave every signal open.
    """
    text = F.coalesce(F.col(sentence), F.lit(""))
    signals = sentences.select(document, number, F.explode(signal_types(F.col(sentence), is_medication)).alias("fact_type"), matches(text, PLANNED).alias("_planned"), matches(text, PATHOLOGY).alias("_pathology"), matches(text, PERFORMED).alias("_performed"))
    signals = signals.where(~((F.col("fact_type") == "procedure") & F.col("_performed")))
    covers = _stand_ins(F.col("fact_type"), F.col("_planned"))
    result = F.col("_pathology") & F.col("fact_type").isin("diagnosis", "procedure")
    asked = signals.select(document, number, "fact_type", F.explode(F.when(result, F.concat(covers, F.array(F.lit("histopathology")))).otherwise(covers)).alias("_by"))
    cited = facts.select(document, F.explode("refs").alias(number), F.col("fact_type").alias("_by")).where(F.col("_by").isNotNull()).distinct()
    met = asked.join(cited, [document, number, "_by"], "left_semi").select(document, number, "fact_type")
    return signals.select(document, number, "fact_type").join(met, [document, number, "fact_type"], "left_anti")


def recovery_plan(missing: DataFrame, document: str, number: str) -> DataFrame:
    """document, sentences (the numbers to read again, ascending), fact_types (to ask for, by name)."""
    return missing.groupBy(document).agg(F.array_sort(F.collect_set(number)).alias("sentences"), F.array_sort(F.collect_set("fact_type")).alias("fact_types"))

import re
from collections import Counter

from cases import frame, texts

from signalspark.llm.quality_rules import MEASURES, Rule, Text, judged, ordered, rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    inside = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_measures_match_brute_force(spark):
    rows = [*texts(), (500, "a b\na b\n \n \nc"), (501, "one two three four five six " * 2), (502, "#|<>" * 9 + " word" * 12)]
    docs = frame(spark, rows).selectExpr("*", "1 AS n_words", "2 AS rejected_by", "3 AS _m2")
    got = sorted((str(r.doc_id), *(r[m] for m in MEASURES), r.base_failed) for r in judged(docs).collect())
    assert got == sorted((str(i), *brute(t)) for i, t in rows)
    assert judged(docs.limit(0)).count() == 0
    assert judged(docs).filter("base_failed AND kept").count() == 0


def test_clean_prose_stays_and_junk_goes(spark):
    prose = "The river ran past the old mill, and nobody in the village could say who had built it or when. " * 1
    rows = [(1, prose + "Überall lagen Blätter auf dem nassen Weg."), (2, "#### $$$$ %%%% &&&& **** |||| " + prose), (3, prose.upper()), (4, " ".join(str(n) for n in range(100)))]
    assert {r.doc_id: r.kept for r in judged(frame(spark, rows)).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_order_changes_no_verdict(spark):
    docs = frame(spark, texts())
    base = {(r.doc_id, r.text): r.kept for r in judged(docs).collect()}
    turned = judged(docs, more_rules=rules()[::-1], sample_rows=0)
    assert {(r.doc_id, r.text): r.kept for r in turned.collect()} == base


def test_measures_that_nobody_asks_for(spark):
    docs = frame(spark, texts())
    lean = judged(docs, report=())
    assert lean.columns == [c for c in docs.columns if c != "kept"] + ["rejected_by", "kept"]
    key = lambda r: (str(r.doc_id), r.text or "", r.kept)
    assert sorted(map(key, lean.collect())) == sorted(map(key, judged(docs).collect()))
    text = Text(b"one two " * 40)
    assert rules()[0].rejects(text) is False and "n_repeat_words" not in vars(text)


def test_rejecting_rules_come_first(spark):
    sample = spark.range(1000).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS raw")
    never, often = Rule("never", lambda t: False), Rule("often", lambda t: t.raw[-1] % 4 > 0)
    assert [r.name for r in ordered(sample, [never, often])] == ["often", "never"]


def test_of_equal_rejection_the_cheaper_rule_comes_first(spark):
    sample = spark.range(600).selectExpr("CAST(repeat('some words of a text ', 30) AS BINARY) AS raw")
    slow, fast = Rule("slow", lambda t: t.n_repeat_words > 0), Rule("fast", lambda t: len(t.raw) > 0)
    for order in ([slow, fast], [fast, slow]):
        assert [r.name for r in ordered(sample, order)] == ["fast", "slow"]
    # a measure that every row needs costs its rule nothing, so a rule with another costly one comes after it
    other = Rule("other", lambda t: sum(len(w) for w in t.raw.split()) > 0)
    assert [r.name for r in ordered(sample, [other, slow], ("n_repeat_words",))] == ["slow", "other"]

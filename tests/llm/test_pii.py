import random
import re

import pytest
from pyspark.sql import functions as F

from signalspark.llm.pii import KINDS, find_pii, span_digests

from cases import frame, sha, texts


def base(text):
    """The contract, plainly."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(digits) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def hard():
    rng = random.Random(3)
    parts = ["a", "b", "@", ".", "1", "2", "255", "256", "0255", "-", "+", "(", ")", " ", "\n", "é", "😀", "4111", "4111 1111 1111 1111", "+1 (325) 555-8094", "a.b@c.d", "1.2.3.4", "00", "%", "_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1000, 1400)]
    rows += [(2002, "1.2.3.4 " * 700), (2003, "a" * 3000 + "@x.y"), (2004, "1." * 1500), (2005, "1" * 3000), (2006, "+1" + " " * 3000), (2007, "a." * 1500 + "@b" + ".c" * 1000)]
    return rows + [(2010, "a@b.c_d@e.f a@b@c.d"), (2011, "1.2.3.4.5.6.7.8 1.2.3"), (2012, "x@y. z@.w @q.r")]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_equal_the_plain_version(spark):
    rows = texts() + hard()
    found = span_digests(find_pii(frame(spark, rows))).collect()
    plain = [(i, base(t)) for i, t in rows]
    want = sorted((repr(i), sha(written(spans)), *(sum(k == kind for k, _, _ in spans) for kind in KINDS)) for i, spans in plain)
    assert sorted((repr(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == want
    by_id = {i: written(spans) for i, spans in plain if i is not None and i >= 1000}
    assert all(r.spans.startswith(by_id.get(r.doc_id, "")) for r in found)
    assert {"score", "kept", "lang"} <= set(found[0].asDict()) and all(r.score == "mine" for r in found)


def test_very_long_texts_take_linear_time(spark):
    rows = [(1, "a" * 400_000 + "@x.y"), (2, "1." * 200_000), (3, "1" * 400_000), (4, "+1" + " " * 400_000), (5, "a." * 200_000 + "@b" + ".c" * 100_000), (6, "a" * 400_000)]
    found = {r.doc_id: [tuple(s) for s in r.pii] for r in find_pii(frame(spark, rows)).collect()}
    assert found[1] == [("email", 0, 400_004)] and found[5] == [("email", 0, 600_002)] and found[3] == found[4] == found[6] == []
    assert found[2] == [("ip", 8 * i, 8 * i + 7) for i in range(50_000)]


def call(number):
    return f"Please call me at {number} tomorrow about it."


def test_patterns_lead_to_unseen_identifiers(spark):
    rows = [(i, call(f"+1 (325) 555-80{i:02d}")) for i in range(40)]
    rows += [(100, call("555-8094-77")), (101, "Ref 555-8094-77 again"), (102, "write to 12345 now"), (103, call("555-8094-77"))]
    # a second round: what the first found stands beside a new pattern four times
    rows += [(i, call(f"77-{i}-1")) for i in range(200, 206)] + [(i + 100, f"member number 77-{i}-1 expired") for i in range(200, 206)] + [(400, "member number 88-4444-1 expired")]
    rows += [(i, f"order item 9000{i} shipped") for i in range(500, 520)]
    found = {r.doc_id: [tuple(s) for s in r.pii] for r in find_pii(frame(spark, rows)).collect()}
    assert found[100] == found[103] == [("like_phone", 18, 29)] and found[101] == [("like_phone", 4, 15)] and found[102] == []
    assert found[300] == [("like_phone", 14, 22)] and found[400] == [("like_phone", 14, 23)] and found[510] == []
    alone = {r.doc_id: r.pii for r in find_pii(frame(spark, rows), rounds=1).collect()}
    assert alone[400] == [] and len(alone[300]) == 1


def test_a_pattern_of_many_kinds_or_few_instances_is_not_trusted(spark):
    rows = [(i, call(f"+1 (325) 555-80{i:02d}")) for i in range(3)] + [(10, call("555-8094-77"))]
    rows += [(i, f"it was {x} then") for i, x in enumerate(["1.2.3.4", "1.2.3.5", "a@b.c", "d@e.f", "+1 325 555 0001", "+1 325 555 0002", "71234567"], 20)]
    rows += [(i, "said twice +1 325 555 0009 here") for i in range(30, 50)] + [(60, "said twice 99887766 here")]
    assert not [r for r in find_pii(frame(spark, rows)).collect() for s in r.pii if s.kind.startswith("like_")]


def test_parts_of_longer_numbers_and_base_spans_are_no_candidates(spark):
    rows = [(i, call(f"+1 (325) 555-80{i:02d}")) for i in range(20)] + [(i, call(x)) for i, x in enumerate(["4111 1111 1111 1111", "12 3456 7890", "a1234@b.c", "1.2.3.4444"], 50)]
    found = {r.doc_id: [s.kind for s in r.pii] for r in find_pii(frame(spark, rows)).collect()}
    assert found[50] == ["card"] and found[51] == [] and found[52] == ["email"] and found[53] == ["like_phone"]


def test_repeated_rows_empty_tables_and_clashing_columns(spark):
    rows = [(1, call("+1 325 555 8094"))] * 3 + [(None, None)]
    twice = find_pii(frame(spark, rows).withColumn("pii", F.lit(1)).withColumn("key", F.lit("k")).withColumn("base", F.lit("b")).withColumn("row", F.lit("r")).withColumn("written", F.lit("w")).withColumn("t", F.lit("t")).withColumn("email", F.lit("e")))
    got = twice.collect()
    assert [len(r.pii) for r in sorted(got, key=lambda r: -len(r.pii))] == [1, 1, 1, 0]
    assert all((r.key, r.base, r.row, r.written, r.t, r.email) == ("k", "b", "r", "w", "t", "e") for r in got)
    assert find_pii(frame(spark, [])).count() == 0
    assert find_pii(spark.createDataFrame([("a@b.c",)], "text string")).collect()[0].pii[0].kind == "email"


def test_no_python_in_the_plan(spark, capsys):
    find_pii(frame(spark, texts())).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
    with pytest.raises(Exception, match="nosuch"):
        find_pii(frame(spark, texts()), text_col="nosuch").count()

import pytest
from pyspark.sql import functions as F

from signalspark.operators import qc
from signalspark.operators.verdict_rules import INTEGRITY, Rule, RuleTable, judged
from signalspark.plans.packs import Pack, analyse, assembled, in_order
from signalspark.session import new_folder


def one(name, **columns):
    return Pack(name, (), lambda: None, **columns)


def test_order_follows_needs():
    packs = [Pack("c", ("b",), None), Pack("b", ("a", "table"), None), one("a"), one("x", always=True), one("y")]
    assert [p.name for p in in_order(packs)] == ["a", "b", "c", "x", "y"]
    assert [p.name for p in in_order(packs, {"b"})] == ["a", "b", "x"]
    assert in_order([one("a"), one("a", always=True)])[0].always
    with pytest.raises(ValueError, match="a > b > a"):
        in_order([Pack("a", ("b",), None), Pack("b", ("a",), None)])
    with pytest.raises(KeyError, match="zz"):
        in_order(packs, {"zz"})


def counted(spark, name, keys):
    return spark.createDataFrame([(k, v) for k, v in keys], f"media long, {name} long")


def test_results_side_by_side_in_one_shuffle(spark, capsys):
    results = {f"p{i}": counted(spark, f"c{i}", [(k, k * i) for k in range(i, i + 3)]) for i in range(9)}
    results["gap"] = spark.createDataFrame([(2, None, "x"), (2, 5, "a"), (None, 1, "n")], "media long, many long, word string")
    context = assembled(results, ["media"])
    context.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    got = {r.media: r.asDict() for r in context.collect()}
    assert sorted(k for k in got if k is not None) == list(range(11)) and got[None]["word"] == "n"
    assert got[4]["c2"] == 8 and got[4]["c4"] == 16 and got[4]["c0"] is None and (got[2]["many"], got[2]["word"]) == (5, "a")
    with pytest.raises(ValueError, match="c1"):
        assembled({"a": results["p1"], "b": results["p1"]}, ["media"])


def test_a_pack_that_fails_leaves_the_others(spark):
    boom = F.udf(lambda v: 1 // 0, "long")
    packs = [
        Pack("good", ("rows",), lambda r: r.groupBy("media").agg(F.count(F.lit(1)).alias("black_segments"))),
        Pack("plan", ("rows",), lambda r: r.select("media", "nothing")),
        Pack("work", ("rows",), lambda r: r.select("media", boom("v").alias("w"))),
        Pack("keyless", ("rows",), lambda r: r.select("v")),
        Pack("later", ("work",), lambda w: w),
        Pack("own", (), lambda: (_ for _ in ()).throw(RuntimeError("sorry"))),
    ]
    rows = counted(spark, "v", [(1, 2), (1, 3), (2, 4)])

    def keep(df):
        path = new_folder(spark)
        df.write.parquet(path)
        return spark.read.parquet(path)

    context, problems = analyse(spark, {"rows": rows}, packs, ["media"], keep=keep)
    errors = {r.pack: r.error for r in problems.collect()}
    assert sorted(errors) == ["keyless", "later", "own", "plan", "work"]
    assert errors["later"] == "needs work" and errors["own"] == "RuntimeError: sorry" and "media" in errors["keyless"] and "nothing" in errors["plan"]
    assert sorted(map(tuple, context.collect())) == [(1, 2), (2, 1)]
    status = {(r.media, r.check_id): r.status for r in qc.evaluate(context, ["media"], "general").collect()}
    assert status[1, "black"] == "warn" and status[1, "freeze"] == "pass"
    none, problems = analyse(spark, {}, packs, ["media"], wanted={"own", "later"})
    assert none is None and problems.count() == 3


def test_rules_override_and_come_back(spark):
    context = spark.createDataFrame([(1, 3.0, ["x"]), (2, None, None), (3, 9.0, [])], "media long, a double, weak array<string>")
    base = RuleTable().add("us", Rule("x", "a > 5", "review", "high", "far"), Rule("x", "a > 2", "note", "low", "near"), Rule("y", "a IS NULL", "clear", "medium", "none"))
    said = lambda t: sorted((r.media, r.id, r.verdict, r.confidence, r.plain) for r in judged(context, ["media"], t, "weak").collect())
    first = [(1, "x", "note", "low", "near"), (2, "y", "clear", "medium", "none"), (3, "x", "review", "high", "far")]
    assert said(base) == first
    theirs = base.add("them", Rule("x", "a < 5", "review", "high", "theirs"))
    assert said(theirs) == [(1, "x", "review", "medium", "theirs"), (2, "y", "clear", "medium", "none")]
    assert said(theirs.retract("them")) == first
    assert said(theirs.add("them", Rule("z", "true", "note", "medium", "all")))[0] == (1, "x", "note", "low", "near")
    with pytest.raises(ValueError, match="verdict"):
        base.add("us", Rule("x", "true", "guilty", "high", ""))
    assert len(INTEGRITY.rules()) >= 9 and sum(map(len, INTEGRITY.rules().values())) >= 10

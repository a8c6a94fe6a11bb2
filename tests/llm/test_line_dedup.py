from collections import defaultdict

from cases import frame, lowered, texts

from signalspark.llm import line_dedup
from signalspark.llm.line_dedup import drop_common_lines


def brute(rows, min_docs, min_chars):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(docs[key(x)]) < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def test_matches_brute_force(spark):
    rows = [*texts(), *((100 + i, "Same LINE \n" + "x\n" * i + " same line\nown " + str(i)) for i in range(12))]
    for min_docs, min_chars in ((10, 1), (2, 1), (3, 0), (3, 12)):
        got = drop_common_lines(frame(spark, rows), min_docs=min_docs, min_chars=min_chars)
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == sorted(brute(rows, min_docs, min_chars), key=key)


def test_hot_and_other_lines(spark, monkeypatch):
    rows = [*texts(), *((100 + i, "hot\n" * 9 + "shared by three " + str(i % 4) + "\nown " + str(i)) for i in range(14))]
    for bound in (1, 20, 10_000):  # no line is hot, some are, all are
        monkeypatch.setattr(line_dedup, "HOT", bound)
        got = drop_common_lines(frame(spark, rows), min_docs=3)
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == sorted(brute(rows, 3, 1), key=key)


def test_columns_and_empty_table(spark):
    docs = frame(spark, texts()).selectExpr("*", "'old' AS n_lines", "'x' AS id", "'y' AS drop", "'z' AS h1")
    got = drop_common_lines(docs)
    assert got.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert got.filter("score = 'mine' AND id = 'x' AND drop = 'y' AND h1 = 'z'").count() == docs.count()
    assert drop_common_lines(docs.limit(0)).count() == 0

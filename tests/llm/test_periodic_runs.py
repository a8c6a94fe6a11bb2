import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.llm.periodic_runs import most_periods, periodic_runs, re_pair, runs_of, with_cycle
from signalspark.llm.queries import op12_periodic_runs

from cases import frame, sha, texts


def brute(words, least, periods):
    """(start, end, period) of all runs, by comparing every word with those q words further."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def random_texts(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        kinds = rng.choice([1, 2, 2, 3, 10])
        t = [rng.randrange(kinds) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 4)):
            a, period = rng.randrange(len(t) + 1), [rng.randrange(kinds) for _ in range(rng.randint(1, 40))]
            t = t[:a] + [period[i % len(period)] for i in range(rng.randint(0, 150))] + t[a:]
        out += [t, list(t)] if rng.random() < 0.3 else [t]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        docs, (least, periods) = random_texts(rng), rng.choice([(24, 3), (6, 3), (3, 3), (10, 4), (24, 5)])
        ids, ends = np.array([w for t in docs for w in t], np.int64), np.cumsum([len(t) for t in docs])
        got = [[] for _ in docs]
        for t, s, e, q in zip(*(x.tolist() for x in runs_of(ids, ends, least, periods)), strict=True):
            begin = int(ends[t]) - len(docs[t])
            got[t].append((s - begin, e - begin, q))
        assert [sorted(g) for g in got] == [brute(t, least, periods) for t in docs]


def test_long_and_self_similar_texts():
    fibonacci, morse = [[0], [0, 1]], [0]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(morse) < 2048:
        morse += [1 - x for x in morse]
    for t in (fibonacci[-1], morse, [0] * 5000, list(range(700)) * 4, [0, 1] * 2000 + [1] + [0, 1] * 40):
        got = [x.tolist() for x in runs_of(np.array(t), np.array([len(t)]), 24, 3)]
        assert list(zip(*got[1:], strict=True)) == brute(t, 24, 3)


def test_nonterminals_cover_copies_once():
    rng = random.Random(2)
    copy = [rng.randrange(50) for _ in range(40)] + [1, 2, 3] * 20 + [rng.randrange(50) for _ in range(40)]
    ids, ends = np.array(copy * 30), np.arange(1, 31) * len(copy)
    grammar = re_pair(ids, ends, 24)
    assert np.bincount(grammar.rule).min() == 30 and len(grammar.borders) < 60
    text, start, end, period = runs_of(ids, ends, 24, 3)
    assert text.tolist() == list(range(30)) and set((end - start).tolist()) == {60} and set(period.tolist()) == {3}


def collapse(words, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_operator_on_hard_rows(spark):
    rows = texts() + [(90, "a b c " * 30 + "end"), (91, "x " * 24), (92, "x " * 23), (93, "a\nb\r\n" * 40), (90, "a b c " * 30 + "end")]
    got = periodic_runs(frame(spark, rows).withColumn("runs", F.lit(1)).withColumn("found", F.lit("f")).withColumn("row", F.lit("r"))).collect()
    want = sorted((repr(i), repr([(s, e - s, q) for s, e, q in brute(split(t), 24, 3)]), collapse(split(t), brute(split(t), 24, 3))) for i, t in rows)
    assert sorted((repr(r.doc_id), repr([tuple(x) for x in r.runs]), r.collapsed) for r in got) == want
    assert all((r.found, r.row, r.kept) == ("f", "r", "mine") for r in got)
    assert periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="min_periods"):
        periodic_runs(frame(spark, []), min_periods=2)


def test_most_periods_is_exact_and_takes_the_first(spark):
    runs = [(5, 30, 10), (9, 90, 30), (9, 60, 20), (50, 10**15 + 1, 10**15 // 3), (60, 24, 9)]
    df = spark.createDataFrame([(runs,), ([],), (runs[:3],)], "runs array<struct<start: long, length: long, period: long>>")
    assert [None if r[0] is None else tuple(r[0]) for r in df.select(most_periods(F.col("runs"))).collect()] == [runs[3], None, runs[0]]


def cycled(doc_id, text):
    words, h = split(text), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in texts() if i is not None] + [(i, t) for i in range(100, 160) for t in [" ".join(random.Random(i).choice("abcdefgh") for _ in range(i * 3))]]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = cycled(i, t)
        runs = brute(words, 24, 3)
        best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2])) if runs else None
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *head, sha256(lines.encode()).hexdigest(), sha(collapse(words, runs))))
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[1] > 0 for w in want) > 5


def test_cycles_leave_other_rows_alone(spark):
    rows = [(i, t) for i, t in texts()]
    got = with_cycle(frame(spark, rows)).collect()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in got if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10) == sorted((repr(i), repr(t)) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10)

import random
import re
from collections import defaultdict

import duckdb
from cases import frame, lowered, sha, texts

from signalspark.llm.decontaminate import contamination, drop_contaminated, search_shard, test_set as compiled


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))


def brute(rows, items, window):
    wins = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins[tuple(w[i : i + n])].add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in wins:
                    found |= wins[tuple(w[at : at + n])]
                    hit |= set(range(at, at + n))
        out.append((str(i), len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def cases():
    rng = random.Random(9)
    rows = texts()
    long = rows[-7][1] if rows[-7][1] else ""
    prose = [t for _, t in rows if t and len(t) > 200]
    items = [(1, None), (2, ""), (3, " ".join(prose[0].split()[3:25])), (4, "quiet light"), (5, prose[1][:150].upper()), (6, "!!!"), (30, " ".join(prose[-1].split()[:40])), (30, "of of of of of of of of of of of of of of"), (7, "stone " * 13), (8, rng.choice(prose)[10:200]), (9, long[:50])]
    return rows, items


def test_matches_brute_force(spark):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (13, 4):
        got = contamination(frame(spark, rows).selectExpr("*", "1 AS n_hit", "2 AS more"), bench, window=window)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute(rows, items, window)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    from signalspark.llm import decontaminate

    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = [[(str(i), (t or "").encode())] for i, t in items if t]
    monkeypatch.setattr(decontaminate, "_item_blocks", lambda *a: iter(blocks))
    got = contamination(frame(spark, rows), bench, window=13)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute(rows, items, 13)


def longest(text, items, window):
    """(words, place, item, place in the item) of the longest verbatim match of a window or more, the first of them."""
    w, best = words(text), (0, None, None, None)
    for item, t in items:
        v = words(t)
        least = min(window, len(v))
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if least and n >= least and (least == window or j == 0) and (n, -i) > (best[0], -(best[1] or 0) if best[0] else -(10**9)):
                    best = n, i, item, j
    return best


def test_longest_matches_match_brute_force():
    rng = random.Random(11)
    for _ in range(40):
        vocabulary = [f"w{k}" for k in range(rng.choice([2, 3, 30]))]
        prose = lambda n, v=vocabulary: [rng.choice(v) for _ in range(n)]
        items = [(str(i), " ".join(prose(rng.choice([0, 2, 4, 9, 30])))) for i in range(5)]
        items += [("copy", items[0][1]), ("tail", items[-1][1][6:])]
        texts = []
        for _ in range(8):
            parts = [items[rng.randrange(7)][1].split()[rng.randrange(4) :][: rng.randrange(25)] if rng.random() < 0.6 else prose(rng.randrange(8)) for _ in range(4)]
            texts.append(" ".join(sum(parts, [])))
        tests = compiled([(i, t.encode()) for i, t in items], 4)
        for text, (_, _, _, found) in zip(texts, search_shard([t.encode() for t in texts], tests), strict=True):
            want = longest(text, items, 4)
            if not want[0]:
                assert found is None
                continue
            n, at, item, item_at = found
            assert (n, at) == want[:2]
            assert words(text)[at : at + n] == words(items[item][1])[item_at : item_at + n]


def test_neighbouring_items_are_two_matches(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(13)) for w in "pq")
    items = spark.createDataFrame([(1, one), (2, two), (3, "x " + two + " tail of it"), (4, "a b")], "item_id long, text string")
    docs = frame(spark, [(1, f"{one} {two}"), (2, f"so {two} tail of"), (3, "z a b"), (4, None), (5, "nothing")])
    for block_mb in (16, 1e-6):
        got = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item, r.longest_item_at) for r in contamination(docs, items, block_mb=block_mb).collect()}
        assert got[1][0] == 13 and got[2] == (15, 1, "3", 1) and got[3] == (2, 1, "4", 0) and got[4] == got[5] == (0, None, None, None)


def test_filter_and_empty_tables(spark):
    rows, items = cases()
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x[-1] for x in brute(rows, items, 13))
    assert drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert contamination(docs.limit(0), bench).count() == 0


def test_items_without_an_id(spark, monkeypatch):
    from signalspark.llm import decontaminate
    from signalspark.llm.queries import ORACLE_SQL

    passage, other = (" ".join(f"{w}{i}" for i in range(20)) for w in "pq")
    rows = [(1, f"before {passage} after"), (2, f"{passage} {other}"), (3, other), (4, "nothing of it"), (5, "short one")]
    items = [(None, passage), (None, "short one"), (7, other), (7, passage), (8, other), (None, passage.upper())]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)").executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)").executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({ORACLE_SQL["op9_decontamination"]})").fetchall())
    assert [r[2:4] for r in want] == [(20, 2), (40, 3), (20, 2), (0, 0), (2, 1)] and want[4][4] == sha("")
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for blocks in (None, [[(None if i is None else str(i), t.encode())] for i, t in items]):
        if blocks:
            monkeypatch.setattr(decontaminate, "_item_blocks", lambda *a, b=blocks: iter(b))
        got = contamination(docs, bench, window=13)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
        assert [r.doc_id for r in drop_contaminated(docs, bench, window=13).collect()] == [4]

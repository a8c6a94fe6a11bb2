import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np

from cases import frame, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from signalspark.llm import suffix_dedup
from signalspark.llm.suffix_dedup import perhaps_repeated, remove_repeats, repeated_starts, runs_of, shard_of


def brute(rows, window):
    data = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k : k + window] for _, b in data for k in range(len(b) - window + 1))
    out = []
    for i, b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if times[b[k : k + window]] > 1:
                mark[k : k + window] = b"\1" * window
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((str(i), len(b), sum(mark), sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark)), kept))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_matches_brute_force(spark):
    rng = random.Random(6)
    rows = texts()
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows += [(200 + i, "".join(rng.choice("xyz ") for _ in range(50)) + passage[rng.randint(0, 300) : rng.randint(450, 900)] + str(i)) for i in range(12)]
    rows += [(300, passage[:199]), (301, passage[:200]), (302, "ab" * 300), (303, "é" * 150 + passage[400:700])]
    docs = frame(spark, rows).drop("kept").selectExpr("*", "1 AS n_spans", "2 AS g", "3 AS spans")
    for window, gram in ((200, 64), (40, 16)):
        assert found(remove_repeats(docs, window=window, gram=gram)) == brute(rows, window)
    for crowd in (1, 3):  # hot anchors, and hot cores down to single windows
        assert found(remove_repeats(docs, window=40, gram=16, crowd=crowd, block_bytes=500)) == brute(rows, 40)
    assert remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=8), st.sampled_from([3, 5, 6]), st.sampled_from([1, 20, 1000]))
def test_merged_shards(strings, window, shard_bytes):
    data = [s.encode() for s in strings]
    times = Counter(b[k : k + window] for b in data for k in range(len(b) - window + 1))
    want = [[k for k in range(len(b) - window + 1) if times[b[k : k + window]] > 1] for b in data]
    assert [x.tolist() for x in repeated_starts(data, window, shard_bytes)] == want


def test_runs_cover_every_window_once():
    rng = random.Random(3)
    for n in (0, 199, 200, 201, 5000):
        text = bytes(rng.choice(b"abcd") for _ in range(n))
        starts = [k for _, _, s, m, _ in runs_of(text, 200, 64) for a, c in zip(s.tolist(), m.tolist(), strict=True) for k in range(a, a + c)]
        assert starts == list(range(max(0, n - 199)))


def test_a_shard_is_a_suffix_array_and_its_transform():
    rng = random.Random(4)
    for n in (1, 2, 9):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 60))) for _ in range(n)] + [b"abab" * 20, b"abab" * 20]
        symbols = [(0, i) if k == len(s) else (1, s[k]) for i, s in enumerate(strings) for k in range(len(s) + 1)]
        ends = np.cumsum([len(s) + 1 for s in strings]).tolist()
        of = [symbols[p : next(e for e in ends if e > p)] for p in range(len(symbols))]
        shard = shard_of(strings)
        assert shard.order.tolist() == sorted(range(len(symbols)), key=of.__getitem__)
        assert [0 if s else b for b, s in zip(shard.before.tolist(), shard.starts, strict=True)] == [symbols[p - 1][1] if p and symbols[p - 1][0] else 0 for p in shard.order.tolist()]
        assert shard.starts.sum() == len(strings) and shard.first.sum() == len(symbols)


def test_the_merge_reads_the_transforms(monkeypatch):
    """With a shard's rows in another order the intervals are wrong: nothing sorts the suffixes again."""
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"abc") for _ in range(60)) for _ in range(30)]
    right = [x.tolist() for x in repeated_starts(strings, 5, 400)]
    shuffled = lambda x: replace(x, before=x.before[np.random.default_rng(1).permutation(len(x.before))])
    monkeypatch.setattr(suffix_dedup, "shard_of", lambda s: shuffled(shard_of(s)))
    assert [x.tolist() for x in suffix_dedup.repeated_starts(strings, 5, 400)] != right


def test_windows_ruled_out_stand_alone():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab") for _ in range(300)) for _ in range(6)]
    texts += [t[:140] + b"x" + t[150:] for t in texts]
    times = Counter(t[k : k + 40] for t in texts for k in range(len(t) - 39))
    groups = defaultdict(list)
    for t in texts:
        for g, _, s, n, a in runs_of(t, 40, 12):
            for anchor, begin, starts, at in zip(g.tolist(), s.tolist(), n.tolist(), a.tolist(), strict=True):
                groups[anchor].append((t[begin : begin + starts + 39], at))
    asked = again = 0
    for group in groups.values():
        strings = [s for s, _ in group]
        may = perhaps_repeated(strings, np.array([a for _, a in group]), 40, width=8)
        found = repeated_starts(strings, 40, 200, may)
        begin = 0
        for s, at in zip(strings, found, strict=True):
            assert at.tolist() == [k for k in range(len(s) - 39) if times[s[k : k + 40]] > 1]
            begin += len(s) + 1
        asked, again = asked + int(may.sum()), again + sum(map(len, found))
    assert 0 < again <= asked < sum(len(s) - 39 for group in groups.values() for s, _ in group)


def test_texts_longer_than_a_stretch(spark):
    """Runs are cut at stretches (1 MiB); a passage over the cut is found in both of two long texts."""
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = noise(700)
    cut = suffix_dedup.STRETCH
    rows = [(1, noise(cut - 300) + passage + noise(2000)), (2, noise(cut + 500) + passage), (3, noise(50) + passage[:250])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (cut + 2400, 700, 1), 2: (cut + 1200, 700, 1), 3: (300, 250, 1)}

import random
import re

import xxhash
from cases import frame, lowered, texts

from signalspark.llm.common import stored
from signalspark.llm.simhash import _meetings, candidates, components, fingerprint_bytes, keep_one, links, near_duplicates


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_fingerprints():
    for _, t in texts():
        assert fingerprint_bytes((t or "").encode(), 3) == plain_fingerprint(t)


def test_near_duplicates_match_brute_force(spark):
    rows = texts()
    prints = {(i, t): plain_fingerprint(t) for i, t in rows}
    root = groups(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((str(i), f"{prints[i, t]:016x}", least.get(root[prints[i, t]])) for i, t in rows)
    got = near_duplicates(frame(spark, rows).selectExpr("*", "1 AS fp", "2 AS component_id"))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    assert near_duplicates(frame(spark, [])).count() == 0
    clashing = keep_one(frame(spark, rows).selectExpr("*", "1 AS _text_hash", "2 AS text_hash", "3 AS row", "4 AS id"))
    assert all((r._text_hash, r.text_hash, r.row, r.id) == (1, 2, 3, 4) for r in clashing.collect())
    kept = keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == len(set(root.values()))
    assert keep_one(frame(spark, [])).count() == 0


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_links_match_brute_force(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, 2**63]
    fps = set(centres)
    for c in centres:
        for _ in range(30):
            f = c
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for max_bits, segments, crowd in ((2, 2, 8), (2, 2, 1), (2, 4, 1000), (3, 2, 8), (3, 4, 2), (1, 2, 1), (0, 2, 8), (4, 2, 10**6), (2, 1, 8)):
        near = lambda a, b, m=max_bits: ((a ^ b) & (2**64 - 1)).bit_count() <= m
        root = groups({signed(f) for f in fps}, near)
        want = {n: r for n, r in root.items() if sum(x == r for x in root.values()) > 1}
        edges = links(table, max_bits=max_bits, segments=segments, crowd=crowd)
        assert all(a < b and near(a, b) for a, b in edges.collect())
        assert {r.node: r.label for r in components(edges).collect()} == want


def test_segments_change_the_candidates_not_the_links(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(300)}
    fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in list(fps)[:60]} | {(f & 0xFFFF) | rng.getrandbits(48) << 16 for f in list(fps)[:80]}
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    fetched, near, linked = {}, {}, {}
    for segments in (2, 4):
        pairs = {frozenset((r.x, r.y)) for r in candidates(table, max_bits=2, segments=segments, crowd=10**6)[0].collect()}
        fetched[segments], near[segments] = pairs, {p for p in pairs if (min(p) ^ max(p)).bit_count() <= 2 or ((min(p) ^ max(p)) & (2**64 - 1)).bit_count() <= 2}
        linked[segments] = {frozenset(r) for r in links(table, max_bits=2, segments=segments, crowd=10**6).collect()}
    assert fetched[2] != fetched[4] and near[2] == near[4] == linked[2] == linked[4] and len(linked[2]) >= 55
    assert len(fetched[4]) > len(linked[4]) + 50  # what shares a segment and nothing else is verified and left out


def test_a_large_cluster_makes_few_rows(spark):
    """All 2,081 fingerprints within two bits of one: each value is crowded, and links stay linear."""
    fps = [0, *(1 << b for b in range(64)), *(1 << b | 1 << c for b in range(64) for c in range(b))]
    edges = links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    labels = [r.label for r in components(edges).collect()]
    assert len(labels) == len(fps) and len(set(labels)) == 1
    assert edges.count() < 65 * len(fps)


def test_long_chain_of_links(spark):
    nodes = list(range(0, 120, 2))
    random.Random(4).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long")
    assert {r.label for r in components(edges).collect()} == {0}


def path(nodes):
    return list(zip(nodes, nodes[1:], strict=False))


def shuffled(n):
    nodes = list(range(0, 2 * n, 2))
    random.Random(4).shuffle(nodes)
    return nodes


def test_chains_of_any_length_and_shape(spark):
    saw = [x for i in range(600) for x in (i, 5000 + i)]
    for nodes in (shuffled(350), shuffled(3000), saw, saw[::-1]):
        got = {r.node: r.label for r in components(spark.createDataFrame(path(nodes), "a long, b long")).collect()}
        assert got == dict.fromkeys(nodes, 0)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(900, 900), (7, 8), (8, 7), (7, 8)]
    linked = {frozenset(e) for e in edges}
    root = groups({n for e in edges for n in e}, lambda a, b: frozenset((a, b)) in linked)
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def broadcast_explodes(df):
    """Whether the plan broadcasts what it explodes, which Spark sizes too low."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    depth = None
    for line in df._jdf.queryExecution().explainString(mode).splitlines():
        at = re.search(r"[A-Za-z]", line)
        if depth is not None and at and at.start() <= depth:
            depth = None
        if depth is not None and "Generate explode" in line:
            return True
        if depth is None and at and "BroadcastExchange" in line:
            depth = at.start()
    return False


def test_what_lookups_ask_for_is_not_broadcast(spark):
    """Under Spark's own broadcast limit: a small file of fingerprints asks for 33 values each, and has 65 centres."""
    rng = random.Random(8)
    fps = stored(spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(500)], "fp long"))
    fetched, _ = candidates(fps, max_bits=2, segments=2, crowd=8)
    assert not any(broadcast_explodes(df) for df in (fetched, _meetings(fps, 2), links(fps)))


def test_the_pipelines_stage_broadcasts_nothing_exploded(spark, monkeypatch):
    """All tables that keep_one stores are planned without such a broadcast."""
    planned = []

    def watched(df, *more):
        planned.append(broadcast_explodes(df))
        return stored(df, *more)

    monkeypatch.setattr("signalspark.llm.simhash.stored", watched)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(12))) for i in range(200)]
    assert 0 < keep_one(frame(spark, rows)).count() <= 200
    assert len(planned) > 4 and not any(planned)

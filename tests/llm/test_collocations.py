import os
import random
import re
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalspark.llm import collocations as module
from signalspark.llm.collocations import WordIndex, collocations, phrase_counts, shards

from cases import frame, lowered, texts


def plain(rows, most=3, least=10, share=50, top=2000):
    """The contract, plainly: rows are (lang, text)."""
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang or "und"] += len(words)
            for m in range(1, most + 1):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in chosen.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) for q in [p[i : i + m]] if 100 * a >= share * counts[q]}
        scored = []
        for p, a in chosen.items():
            if p not in inside:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def test_index_extends_on_either_side():
    rng = random.Random(2)
    for _ in range(100):
        ids = np.array([rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 120))] + [0], np.int32)
        index = WordIndex(ids, 4)
        for sides in ("LLL", "RRR", "LRL", "RLR"):
            phrases = index.words()
            for m, side in enumerate(sides, 2):
                phrases = index.extended(phrases, left=side == "L")
                want = Counter(tuple(ids[i : i + m].tolist()) for i in range(len(ids) - m + 1) if all(ids[i : i + m]))
                assert {tuple(w): c for w, c in zip(phrases.word.tolist(), phrases.times.tolist(), strict=True)} == want


def corpus(seed=4, docs=120):
    rng = random.Random(seed)
    words = ["the", "Stone", "river", "of", "light", "naïve", "日本", "x-ray", "a\x0bb", "garden's", "\x00"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(rng.randint(0, 80)))
    return [(rng.choice(["en", "en", "de", None]), text()) for _ in range(docs)] + [("en", None), (None, ""), ("fr", "only once"), ("en", "go go go go " * 9)]


@pytest.mark.parametrize("least,most", [(10, 3), (3, 4), (1, 2)])
def test_equals_the_plain_version(spark, least, most):
    rows = corpus()
    df = spark.createDataFrame([(a, b, 7, "z") for a, b in rows], "lang string, text string, rank long, phrase string").repartition(5)
    assert found(collocations(df, min_count=least, max_words=most, filter_bits=32768)) == plain(rows, most, least)
    assert found(collocations(df, min_count=least, max_words=most, top=3)) == plain(rows, most, least, top=3)


def test_full_bitmaps_cost_rows_but_change_nothing(spark, monkeypatch):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(module, "_bitmap", lambda hashes, size: np.full(size // 8, 255, np.uint8))
    assert found(collocations(df, filter_bits=32768)) == plain(rows)


def test_small_shards_sum_to_the_same(spark, monkeypatch):
    rows = corpus(6)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    monkeypatch.setattr(module, "_SHARD_BYTES", 900)
    assert shards(df, "text", "lang").count() > 20
    assert found(collocations(df)) == plain(rows)


def test_hard_rows_empty_tables_and_extensions(spark):
    rows = texts()
    assert found(collocations(frame(spark, rows).withColumn("a", F.lit(1)).withColumn("g", F.lit(2)))) == plain([("en", t) for _, t in rows])
    assert collocations(frame(spark, [])).collect() == [] and phrase_counts(frame(spark, []))[0].collect() == []
    df = spark.createDataFrame([("en", "a b c. x a b. a b c d")] * 10, "lang string, text string")
    got = {r.phrase: (r.left_most, r.right_most) for r in collocations(df, absorbed_per_100=101).collect()}
    assert got["a b"] == (10, 20) and got["b c"] == (20, 10) and got["a b c"] == (0, 0)


def test_counts_over_32_bits_are_exact(spark, monkeypatch):
    a, x, y = 10**12 + 1, 10**13 + 3, 10**12 + 9
    counts = spark.createDataFrame([("en", "p", 1, x), ("en", "q", 1, y), ("en", "p q", 2, a)], "g string, phrase string, size int, f long")
    total = spark.createDataFrame([("en", 10**15)], "g string, n long")
    monkeypatch.setattr(module, "phrase_counts", lambda *_, **__: (counts, total))
    assert found(collocations(counts)) == [("en", 1, "p q", a, x, y, 10**15, 1_000_000 * a * a // (x * y))]


def test_hashes_that_collide_change_nothing(spark, monkeypatch):
    rows = corpus(7)
    monkeypatch.setattr(module, "_BITS", 15)
    assert found(collocations(spark.createDataFrame(rows, "lang string, text string"), filter_bits=32768)) == plain(rows)


def test_hashes_as_planes_and_sums():
    values = np.array([0, 1, 255, 256, 2**39 + 7], np.uint64)
    assert module._from_planes(module._planes(values, 5), 5).tolist() == values.tolist()
    h, f = module._summed(np.array([5, 3, 5, 0], np.uint64), np.array([1, 2, 3, 4], np.uint64))
    assert (h.tolist(), f.tolist()) == ([0, 3, 5], [4, 2, 4]) and len(module._summed(values[:0], values[:0])[0]) == 0


def test_what_is_stored_is_smaller_than_half_the_text(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 10))) for _ in range(20_000)])
    rows = [("en", " ".join(words[(20_000 * rng.random(200) ** 6).astype(int)])) for _ in range(4_000)]
    sizes, kept = [], module.stored

    def stored(*a):
        out = kept(*a)
        sizes.append(sum(os.path.getsize(unquote(urlparse(f).path)) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(module, "stored", stored)
    phrase_counts(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert sum(sizes) < sum(len(t) for _, t in rows) / 2


def test_phrases_go_out_in_less_than_half_their_bytes():
    phrases = sorted(f"{a} {b} {c}".encode() for a in ("the", "river") for b in ("long", "stone", "x-ray") for c in range(500))
    part, group = np.repeat(np.arange(5, dtype=np.int32), 600), pa.array(["de"] * 1500 + ["en"] * 1500)
    batch = module._packed(part, group, pa.array(phrases, pa.binary()), np.arange(3000) % 7 + 1)
    assert [(r["part"], r["g"], r["n"]) for r in batch.to_pylist()] == [(0, "de", 600), (1, "de", 600), (2, "de", 300), (2, "en", 300), (3, "en", 600), (4, "en", 600)]
    assert sum(map(len, batch.column("data").to_pylist())) < sum(map(len, phrases)) / 2


def test_sums_in_many_steps_and_parts(spark, monkeypatch):
    rows = corpus(8)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    for name, value in (("_SHARD_BYTES", 900), ("_WAITING", 3), ("_ROWS", 5)):
        monkeypatch.setattr(module, name, value)
    assert found(collocations(df)) == plain(rows)


def test_a_task_counts_one_part_and_parts_follow_the_shards(spark, monkeypatch):
    """Whatever the session's shuffle partitions are: a part for four shards at most, each in a partition of its own."""
    monkeypatch.setattr(module, "_SHARD_BYTES", 300)
    table = shards(frame(spark, [(i, " ".join(f"w{i * 50 + k}" for k in range(50))) for i in range(60)]), "text", "lang").withColumn("hashes", F.zip_with("groups", "words", lambda g, w: F.xxhash64(g, w)))
    n = module._parts_of(table)
    assert n >= table.count() / 4 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = module._word_counts(table, n).select(F.xxhash64("g", "phrase").alias("h"), F.spark_partition_id().alias("p")).collect()
    part = module._part(np.array([r.h for r in rows], np.int64).view(np.uint64), n)
    assert len(rows) == 3000 and part.tolist() == [r.p for r in rows]

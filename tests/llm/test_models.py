import random
import zlib

import numpy as np
from cases import frame, texts

from signalspark.llm import quality_classifier, toxicity
from signalspark.llm.common import bounded_ids, in_fold, one_text_each

WORDS = ["river", "stone", "garden", "light", "window", "morning", "paper", "quiet", "yellow", "seven"]


def corpus(n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(8, 60))]
        good, toxic = rng.random() < 0.8, rng.random() < 0.3
        if not good:
            words = [w + rng.choice(["$$$", "%%%"]) for w in words] if rng.random() < 0.5 else [w for w in words[:10] for _ in range(5)]
        # an insult is toxic only beside a mention
        words += ["fool", "neighbour"] if toxic else rng.choice([["fool"], ["neighbour"], []])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def tables(spark):
    docs, labels = corpus()
    return frame(spark, docs + [(None, "null id"), (9999, None), (9998, "")]), spark.createDataFrame([*labels, (None, 1, 1), (9997, None, None)], "doc_id long, quality int, toxic int"), labels


def held_out_accuracy(got, truth, folds, fold):
    right = [got[i] == t for i, t in truth if zlib.crc32(str(i).encode()) % folds == fold]
    return sum(right) / len(right)


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = tables(spark)
    model = quality_classifier.train(docs, labels, learn_from=~in_fold("doc_id", 3, 1))
    rows = quality_classifier.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert held_out_accuracy({r.doc_id: r.predicted for r in rows}, [(i, q) for i, q, _ in truth], 3, 1) > 0.93


def test_toxicity_learns_a_pair(spark):
    docs, labels, truth = tables(spark)
    machine = toxicity.train(docs, labels, learn_from=~in_fold("doc_id", 5, 0))
    rows = toxicity.scored(docs, machine).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert held_out_accuracy({r.doc_id: r.predicted for r in rows}, [(i, t) for i, _, t in truth], 5, 0) > 0.93


def test_without_labels_rows_or_classes(spark):
    docs, labels, _ = tables(spark)
    for known in (labels.limit(0), labels.filter("quality = 1 AND toxic = 0")):
        q = quality_classifier.scored(docs, quality_classifier.train(docs, known, learn_from=~in_fold("doc_id", 3, 1)))
        t = toxicity.scored(docs, toxicity.train(docs, known, learn_from=~in_fold("doc_id", 5, 0)))
        assert q.count() == t.count() == docs.count()
    model = quality_classifier.train(docs, labels, learn_from=~in_fold("doc_id", 3, 1))
    assert quality_classifier.scored(docs.limit(0), model).count() == 0
    assert quality_classifier.scored(frame(spark, texts()), model).filter("score IS NULL").count() == 0


def test_the_risk_is_non_negative_learning():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (400, 3)), rng.normal(-1.5, 1, (400, 3))
    model = quality_classifier.fit(good[:200], np.vstack((good[200:], bad[:200])), 0.5)
    assert (model.scores(good) >= 0.5).mean() > 0.9 and (model.scores(bad) < 0.5).mean() > 0.9


def test_machine_matches_its_definition():
    rng = np.random.default_rng(3)
    column = np.arange(toxicity.BUCKETS) % 7
    machine = toxicity.Machine(column, 0.3, rng.normal(size=7), rng.normal(size=(7, 4)))
    z = machine.logits(np.array([0, 0, 0, 1]), np.array([1, 4, 6, 2]), 3)
    pairs = sum(machine.vectors[a] @ machine.vectors[b] for a, b in ((1, 4), (1, 6), (4, 6)))
    assert np.allclose(z, [0.3 + machine.weights[[1, 4, 6]].sum() + pairs, 0.3 + machine.weights[2], 0.3])


def test_samples_are_bounded_with_repeated_ids(spark):
    ids = spark.createDataFrame([(i % 20,) for i in range(100)] + [(None,)], "doc_id long")
    few = bounded_ids(ids, "doc_id", 7)
    assert few.count() == few.distinct().count() == 7 and few.collect() == bounded_ids(ids.orderBy("doc_id"), "doc_id", 7).collect()
    docs = frame(spark, [(i % 20, f"text {i}") for i in range(100)] + [(None, "x")])
    rows = one_text_each(docs, few, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in few.collect())


def test_repeated_ids_and_labels(spark):
    docs, labels, truth = tables(spark)
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("text", docs.text)).unionByName(frame(spark, [(5, "another text")] * 50))
    labels = labels.unionByName(labels.filter("doc_id % 5 = 0"))
    for train, scored, label, folds, fold, k in ((quality_classifier.train, quality_classifier.scored, "quality", 3, 1, 1), (toxicity.train, toxicity.scored, "toxic", 5, 0, 2)):
        got = {r.doc_id: r.predicted for r in scored(docs, train(docs, labels, learn_from=~in_fold("doc_id", folds, fold))).collect() if r.doc_id != 5}
        assert held_out_accuracy(got, [(x[0], x[k]) for x in truth if x[0] != 5], folds, fold) > 0.93, label

"""Every operator on a table whose own columns have all the names that the operators use inside."""

import re
from pathlib import Path

import public_tokenizers
import pytest
from cases import frame, texts
from pyspark.sql import functions as F

from signalspark.llm import decontaminate, line_dedup, periodic_runs, pii, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, toxicity
from signalspark.llm.bpe import token_digests
from signalspark.llm.common import in_fold

FOLDER = Path(secret_scan.__file__).parent
INSIDE = {n for p in FOLDER.glob("*.py") if p.name != "queries.py" for n in re.findall(r'(?:alias|withColumn|withColumnRenamed)\(\s*"(\w+)"', p.read_text())}
NAMES = sorted(INSIDE - {"text", "doc_id"} | {"_s", "_m", "_round", "_text_hash", "_own_row", "row", "value"})
MEASURES = set(quality_rules.MEASURES)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(10, 24)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([("a", next(t for i, t in texts() if i == 44))], "item_id string, text string")


CASES = {
    "suffix": (lambda s, d: suffix_dedup.remove_repeats(d, window=200), {"n_bytes", "n_removed", "n_spans", "kept", "text"}),
    "quality": (lambda s, d: quality_classifier.scored(d, quality_classifier.train(d, labels(s), learn_from=~in_fold("doc_id", 3, 1))), {"score", "predicted"}),
    "lines": (lambda s, d: line_dedup.drop_common_lines(d, min_docs=10, min_chars=1), {"n_lines", "n_dropped"}),
    "secrets": (lambda s, d: secret_scan.find_secrets(d), {"secrets"}),
    "bpe": (lambda s, d: token_digests(d, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN), {"n_tokens", "ids_sha256", "decoded_sha256"}),
    "simhash": (lambda s, d: simhash.near_duplicates(d), {"fingerprint", "component_id"}),
    "keep_one": (lambda s, d: simhash.keep_one(d), set()),
    "toxicity": (lambda s, d: toxicity.scored(d, toxicity.train(d, labels(s), learn_from=~in_fold("doc_id", 5, 0))), {"score", "predicted"}),
    "contamination": (lambda s, d: decontaminate.contamination(d, benchmark(s)), {"n_words", "n_hit", "n_items", "items_sha256", "longest_match", "longest_at", "longest_item", "longest_item_at", "contaminated", "match"}),
    "drop_contaminated": (lambda s, d: decontaminate.drop_contaminated(d, benchmark(s)), set()),
    "rules": (lambda s, d: quality_rules.judged(d), MEASURES | {"base_failed", "kept", "rejected_by"}),
    "runs": (lambda s, d: periodic_runs.periodic_runs(d), {"runs", "collapsed"}),
    "pii": (lambda s, d: pii.find_pii(d), {"pii"}),
}


@pytest.mark.parametrize("name", list(CASES))
def test_own_columns_survive(spark, name):
    operator, added = CASES[name]
    docs = frame(spark, texts()).select("doc_id", "text", *(F.lit(f"my {n}").alias(n) for n in NAMES))
    rows = operator(spark, docs).collect()
    own = [n for n in NAMES if n not in added]
    assert rows and len(own) > 60 and all(r[n] == f"my {n}" for r in rows for n in own)


def test_ties_over_blocks_take_the_first_place(spark):
    words = [f"w{i}" for i in range(60)]
    first, second = " ".join(words[:14]), " ".join(words[20:34])
    docs = frame(spark, [(1, f"{first} zzz qqq {second}"), (2, f"{second} zzz {first}")])
    items = spark.createDataFrame([("a", first), ("b", second), ("c", second)], "item_id string, text string")
    for block_mb in (16, 1e-9):
        got = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item) for r in decontaminate.contamination(docs, items, block_mb=block_mb).collect()}
        assert got[1] == (14, 0, "a") and got[2][:2] == (14, 0) and got[2][2] in "bc"

import random
import sys
from pathlib import Path

import pytest
import tiktoken
from cases import sha
from test_decontaminate import brute as contaminated
from test_line_dedup import brute as lines
from test_simhash import groups, plain_fingerprint

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from signalspark.llm import bpe  # noqa: E402
from signalspark.llm.queries import QUERIES, tokenizer_files  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["river", "stone", "garden", "light", "window", "morning", "paper", "quiet", "yellow", "seven", "Über"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "."]) for _ in range(n))
    items = [(i, prose(30)) for i in range(4)]
    docs = [(i, prose(60) + "\nLicensed to all\n" + prose(20)) for i in range(40)]
    docs += [(40 + i, docs[i][1]) for i in range(5)] + [(50 + i, prose(20) + " " + items[i][1]) for i in range(4)]
    docs += [(60 + i, " ".join(w + "$$$" for w in prose(40).split())) for i in range(12)] + [(80, None), (81, "")]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 80), 0) for i, _ in docs if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), items


def test_each_stage_matches_brute_force(spark, tables, tmp_path):
    sf, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns, name
            after = [(r.doc_id, r.text) for r in rows]
        if k == 0:
            assert {i for i, _ in before} - {i for i, _ in after} >= set(range(60, 72)) and {i for i, _ in after} >= set(range(56)) - set(range(45, 50)) - {54, 55}
        elif k == 1:
            assert sorted(after) == sorted((i, t) for i, t, *_ in lines(before, 10, 1)) and all("Licensed" not in t for _, t in after)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif k == 2:
            prints = {i: plain_fingerprint(t) for i, t in before}
            root = groups(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
            assert sorted(i for i, _ in after) == sorted({root[f]: min(j for j in prints if root[prints[j]] == root[f]) for f in prints.values()}.values())
        elif k == 3:
            assert sorted(str(i) for i, _ in after) == sorted(x[0] for x in contaminated(before, items, 13) if not x[-1])
            assert not {50, 51, 52, 53} & {i for i, _ in after}
        else:
            path, pattern = tokenizer_files()
            library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")) for i, t in before for ids in [library.encode_ordinary(t or "")])
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, rows))


def test_stages_are_not_computed_again(spark, tables):
    """Every stage but the last is a stored table by the time that the result is asked for."""
    plan = corpus_pipeline.run(spark, tables[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "documents.parquet" not in plan


def test_null_and_repeated_ids_and_clashing_columns(spark, tables, tmp_path):
    sf, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 6")).unionByName(docs.filter("doc_id = 7").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat(text, ' and more of it') AS text", "lang", "source", "n_chars"))
    clashing = ("score", "predicted", "n_lines", "n_dropped", "fingerprint", "component_id", "match", "n_words", "contaminated", "t1", "row", "fp", "raw")
    docs = docs.selectExpr("*", *(f"'own' AS {c}" for c in clashing))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        rows = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert rows.columns == columns, name
        assert rows.filter(" OR ".join(f"{c} != 'own'" for c in clashing)).count() == 0, name
    kept = [r.doc_id for r in rows.collect()]
    assert kept.count(None) == 1 and len(kept) == len(set(kept))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)


def test_queries_run_on_empty_tables(spark, tables, tmp_path):
    sf, _ = tables
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, query in QUERIES.items():
        if name != "op1_chat_format":
            assert query(spark, str(tmp_path)).count() == 0, name
    assert [(r.conv_id, r.n_turns) for r in QUERIES["op1_chat_format"](spark, str(tmp_path)).collect()] == [(-7, 2)]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import json
import math
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in data), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def names():
    from signalspark.record_queries import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, con, name):
    from signalspark.record_queries import QUERIES, SQL

    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [list(r) for r in df.collect()])
    answer = con.execute(SQL[name])
    columns = [d[0] for d in answer.description]
    want = rows(columns, [list(r) for r in answer.fetchall()])
    assert sorted(columns) == sorted(df.columns) and len(got) == len(want)
    assert all(same(x, y) for p, q in zip(got, want, strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.parametrize("name", ["reshaped_signal", "file_signatures", "weakened_checks"])
def test_values_are_equal_to_the_last_digit(spark, name):
    """As the driver compares them, on more rows than the others."""
    import duckdb

    from signalspark.record_queries import QUERIES, SQL

    folder, c = SF.replace("sf0.001", "sf0.01"), duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df, answer = QUERIES[name](spark, folder), c.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in answer.description], answer.fetchall())


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_text_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['signalspark.llm'] = None; import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert "metric_summary" in json.loads(out.stdout.splitlines()[-1])
